"""SimHash near-duplicates with BK-trees.

64-bit fingerprints over 3-word shingles; two documents are linked at three or fewer differing bits; a component is what links
reach. Only distinct fingerprints are searched. They are dealt to shards by blocks of bits that a pair within the radius must
share (four blocks, one of them equal; more and longer ones when there are very many fingerprints), a shard's BK-tree has
children keyed by their integer distance to the parent, and a search follows only edges within the radius of its own distance.
The trees live in the tasks that hold their shards: broadcasting them would gather all fingerprints on the driver.
A shard with more fingerprints than ``SHARD_LIMIT`` is dealt again by blocks of its other bits, which a pair within the radius must share as well;
one that is still larger is split in chunks and each pair of chunks gets a tree, so none is dropped.
A task reports a spanning forest of what it has linked, never all pairs; large-star/small-star rounds join the forests.

Defined results: null and empty texts have the zero fingerprint and are linked like any other; component_id is the smallest
doc_id reached that is not null (null if there is none); repeated rows stay repeated, but ``one_of_each`` keeps one row of a component,
whatever its doc_ids; other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.shared import documents, stored

RADIUS = 3
SHARD_LIMIT = 2048
_STEP = 1 << 15
SHARD = ["k", "v", "k2", "v2", "a", "b"]


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a text's 3-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    last = ends[2:] or ends[-1:]
    digest, n = xxhash.xxh64_intdigest, len(last)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + _STEP], last[at : at + _STEP])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(text: pd.Series) -> pd.Series:
    return text.map(fingerprint).astype("int64")


def fingerprints(text: str) -> Column:
    return F.pandas_udf(_fingerprints, "long")(text)


class BKTree:
    """Nodes are numbers in order of arrival; children of a node are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = len(self.values)
        self.values.append(value)
        self.children.append({})
        node = 0
        while node < at:
            gap = (value ^ self.values[node]).bit_count()
            node = self.children[node].setdefault(gap, at)

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            gap = (value ^ self.values[node]).bit_count()
            if gap <= radius:
                found.append(node)
            below = self.children[node]
            if below:
                stack += [below[k] for k in range(gap - radius, gap + radius + 1) if k in below]
        return found


def forest(values: list[int], radius: int) -> list[int]:
    """For each value the position of the first value of its component."""
    root = list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree = BKTree()
    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
        tree.add(value)
    return [top(i) for i in range(len(values))]


def _linked(radius: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard, a shard may go on in the next batch; out come (fingerprint, fingerprint it hangs on)."""
        kept: list[pd.DataFrame] = []

        def edges(part: pd.DataFrame) -> pd.DataFrame:
            keys = part[SHARD].to_numpy(np.int64)
            prints = part["fp"].to_numpy(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), len(part)]
            unsigned, out = prints.view(np.uint64).tolist(), []
            for s, e in zip(bounds[:-1], bounds[1:]):
                if e - s > 1:
                    out += [(s + i, s + r) for i, r in enumerate(forest(unsigned[s:e], radius)) if i != r]
            pairs = np.array(out, np.int64).reshape(-1, 2)
            return pd.DataFrame({"u": prints[pairs[:, 0]], "v": prints[pairs[:, 1]]})

        for part in parts:
            whole = pd.concat([*kept, part]) if kept else part
            keys = whole[SHARD].to_numpy(np.int64)
            same = (keys == keys[-1:]).all(axis=1) if len(whole) else np.zeros(0, bool)
            cut = len(whole) - int(same.sum())  # sorted: the last shard is at the end
            kept = [whole.iloc[cut:]]
            if cut:
                yield edges(whole.iloc[:cut])
        if kept:
            yield edges(pd.concat(kept))

    return run


def _equal_parts(bits: list[int], n: int) -> list[int]:
    """Masks of n parts of these bit positions, of about equal size."""
    edges = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[s:e]) for s, e in zip(edges[:-1], edges[1:])]


def _keys(masks: list[int], number: str, value: str) -> Column:
    """An array of (number, fingerprint's bits in the mask)."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*(F.struct(F.lit(k).alias(number), F.col("fp").bitwiseAND(F.lit(m)).alias(value)) for k, m in enumerate(signed)))


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Every choice of ``blocks - radius`` of the blocks: radius differing bits leave one choice untouched."""
    parts = _equal_parts(list(range(64)), blocks)
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def links(prints: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT, blocks: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp) -> forest edges (u, v) whose components are those of all pairs within the radius.

    Any number of ``blocks`` over the radius gives the same pairs; more of them make smaller shards and more copies. By default their number
    follows that of the fingerprints, so that shards stay small.
    """
    if blocks is None:
        n = prints.count()
        blocks = radius + (1 if n < 1 << 24 else 2 if n < 1 << 33 else 3)
    masks = block_masks(blocks, radius)
    members = prints.select("fp", F.explode(_keys(masks, "k", "v")).alias("s")).select("fp", "s.*")
    large = members.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    members = members.join(large, ["k", "v"], "left")
    again = F.lit(None)
    for k, mask in enumerate(masks):
        rest = [b for b in range(64) if not mask >> b & 1]
        again = F.when(F.col("k") == k, _keys(_equal_parts(rest, radius + 1), "k2", "v2")).otherwise(again)
    once = F.array(F.struct(F.lit(-1).alias("k2"), F.lit(0).cast("long").alias("v2")))
    members = members.withColumn("s", F.explode(F.when(F.col("n").isNull(), once).otherwise(again))).select("fp", "k", "v", "s.*")
    large = members.groupBy("k", "v", "k2", "v2").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    members = members.join(large, ["k", "v", "k2", "v2"], "left").withColumn("c", F.ceil(F.col("n") / limit))
    own = F.pmod(F.xxhash64("fp"), F.col("c"))
    first = F.array(F.lit(0).cast("long"))
    members = members.withColumn("o", F.explode(F.when(F.col("c").isNull(), first).otherwise(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))))
    members = members.select("k", "v", "k2", "v2", F.coalesce(F.least(own, "o"), F.lit(0)).alias("a"), F.coalesce(F.greatest(own, "o"), F.lit(0)).alias("b"), "fp")
    dealt = members.repartition(*SHARD).sortWithinPartitions(*SHARD, "fp")
    return dealt.mapInPandas(_linked(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> (node, root), root being the smallest node reached; nodes without edges are left out.

    Large-star and small-star rounds, each written to the shared folder. The join with a node's minimum gets an exchange of its
    own on both sides (the key is rewritten), so that adaptive execution can split a node with very many edges.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else pairs
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").bitwiseXOR(F.lit(0)).alias("_u"), F.least("u", "_m").alias("_m"))
        met = both.join(least, F.col("u") == F.col("_u"))
        if larger:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        return met.where("v != _m").select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("_m").alias("v")))

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    now = stored(tidy(edges), "edges")
    seen = mark(now)
    while seen[0]:
        now = stored(tidy(star(tidy(star(now, True)), False)), "edges")
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(marked: DataFrame, first: Column, radius: int = RADIUS) -> DataFrame:
    """Rows with fp -> a row per fingerprint: fp, ``first`` over its rows, and root, the same in all of a component."""
    prints = stored(marked.groupBy("fp").agg(first.alias("first")), "prints")
    roots = components(links(prints.select("fp"), radius))
    return prints.join(roots, prints.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs (doc_id, text) -> a row per document: doc_id, fp, component_id, links (other fingerprints in its component)."""
    marked = stored(docs.select("doc_id", fingerprints("text").alias("fp")), "fingerprints")
    classes = rooted(marked, F.min("doc_id"), radius)
    named = classes.groupBy("root").agg(F.min("first").alias("component_id"), (F.count("*") - 1).alias("links")).withColumnRenamed("root", "_r")
    named = stored(classes.join(named, F.col("root") == F.col("_r")).select("fp", "component_id", "links"), "classes")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "links")


def _placed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of a table in files, and the column that tells each from all others: a digest of its file's name, and its place there. Other rows are written first."""
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place.getField("row_index")).schema  # noqa: B018  raises where rows don't come from such files
    except AnalysisException:
        docs = stored(docs, "documents")
        place = docs.metadataColumn("_metadata")
    return docs, F.struct(F.xxhash64(place.getField("file_path")).alias("file"), place.getField("row_index").alias("at"))


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the first by doc_id (nulls last), then by the text's hash. Texts are shuffled once, to be met by the places of the rows kept."""
    docs, place = _placed(docs)
    marked = docs.select("doc_id", fingerprints("text").alias("fp"), F.xxhash64("text").alias("hash"), place.alias("place"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash", "place"))
    kept = rooted(marked, first, radius).groupBy("root").agg(F.min("first").alias("first")).select("first.place.*")
    rows = docs.select(F.struct("*").alias("row"), place.alias("place"))
    kept = stored(kept, "kept").hint("merge")  # as many as the documents kept, so never broadcast, at small sizes neither
    return rows.join(kept, (F.col("place.file") == F.col("file")) & (F.col("place.at") == F.col("at")), "left_semi").select("row.*")


def op3_simhash(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")
