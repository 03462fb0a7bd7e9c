"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its nearest pivots. It is posted in the inverted files of its first ``POSTED`` pivots; a query
opens the files of its first ones, ranks what it finds there by footrule distance between the orders, and reranks the
first of them by exact cosine: from each file a number of its own, more from its nearest pivots'. A vector that meets a query in several files
is ranked in one of them only, the query's nearest. Pivots grow with the square root of the rows, so that a query meets a share of the rows that
shrinks as they grow. The files that it opens grow with their fourth root (``probes``), as measured recall needs; it scores some 28 rows of each.
Files are split in chunks of at most ``CHUNK`` postings, which share a file's number, one row a chunk at least; only the queries of a file with more
than ``BLOCK`` are dealt to blocks. So a pivot near a third of all rows bounds no task; a task reports a query's k best, never its candidates. Queries that
find fewer than k candidates open all files, which is exact; with ``exact`` all queries do.

Pivots are drawn from a bounded seeded sample. Every row is indexed. Measured recall and shares are in the README.
Defined results: vectors that are null, zero, or hold null or non-finite components take no part; vectors of different lengths aren't compared, each
length has an index of its own; equal scores go to the smaller vec_id; repeated ids are several rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.shared import stored

#: Pivots for n rows: PIVOTS_ROOT * sqrt(n), between these; beyond a billion rows files grow instead, and what is reranked of each with them.
PIVOTS_ROOT, PIVOTS_LEAST, PIVOTS_MOST = 2.0, 32, 65535
ORDERED = 128
POSTED = 8
#: Files that a query opens among so many rows; more among more.
PROBED, PROBED_ROWS = 32, 50_000
CHUNK = 4096
BLOCK = 8192
#: Rows of a file that are reranked: from the query's nearest pivot's to its last probed one's.
RERANKED = (48, 8)
#: Numbers of a block of distances to pivots.
_CELLS = 1 << 20


def probes(rows: int, probed: int = PROBED) -> int:
    return int(np.ceil(probed * max(1.0, rows / PROBED_ROWS) ** 0.25))


def orders(x: np.ndarray, pivots: np.ndarray, ordered: int) -> np.ndarray:
    """The ``ordered`` nearest pivots of each vector, nearest first."""
    unit, out, rows = pivots / np.linalg.norm(pivots, axis=1, keepdims=True), [], max(1, _CELLS // len(pivots))
    for at in range(0, len(x), rows):
        part = x[at : at + rows]
        far = -(part / np.linalg.norm(part, axis=1, keepdims=True)) @ unit.T
        first = np.sort(np.argpartition(far, ordered - 1, axis=1)[:, :ordered], axis=1)
        order = np.argsort(np.take_along_axis(far, first, 1), axis=1, kind="stable")
        out.append(np.take_along_axis(first, order, 1).astype(np.uint16))
    return np.concatenate(out)


def agreement(order: np.ndarray, query: np.ndarray, pivots: int) -> np.ndarray:
    """How far each row's order agrees with the query's: a constant less half the footrule distance, pivots beyond an order being at its end.

    A shared pivot at places i and j brings the distance down from (n - i) + (n - j) to |i - j|, half of which difference is n - max(i, j).
    """
    n = len(query)
    place = np.full(pivots, n, np.int16)
    place[query] = np.arange(n, dtype=np.int16)
    return (n - np.maximum(place[order], np.arange(n, dtype=np.int16))).sum(axis=1, dtype=np.int32)


def _index(pivots: np.ndarray, ordered: int, opened: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x = np.array(part["v"].tolist(), np.float64)
            order = orders(x, pivots, ordered)
            yield pd.DataFrame({"id": part["id"], "row": part["row"], "v": [r.tobytes() for r in x], "o": [r.tobytes() for r in order], "top": list(order[:, :opened].astype(np.int32))})

    return run


def _matrix(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def quotas(probed: int, reranked=RERANKED) -> np.ndarray:
    """Rows to rerank by the place of the file's pivot in the query's order."""
    return np.ceil(np.linspace(reranked[0], reranked[1], probed)).astype(int)


def _search(pivots: int, posted: int, probed: int, k: int, reranked, everything: bool):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": np.zeros(0, np.int64), "qrow": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0), "scored": np.zeros(0, np.int64)})
        if not len(rows) or not len(queries):
            return empty
        pivot = int(key[0])
        rows = rows.sort_values(["id", "row"])
        ids, numbers = rows["id"].to_numpy(np.int64), rows["row"].to_numpy(np.int64)
        x, order = _matrix(rows["v"], np.float64), _matrix(rows["o"], np.uint16)
        norm, first, chunks = np.linalg.norm(x, axis=1), order[:, :posted], int(rows["chunks"].iloc[0])
        wanted, out = quotas(probed, reranked), []
        for q, qrow, v, o in zip(queries["id"], queries["row"], queries["v"], queries["o"]):
            mine = np.frombuffer(o, np.uint16)
            place = np.full(pivots, len(mine), np.int64)
            place[mine] = np.arange(len(mine))
            if everything:  # any fixed rule gives one file a pair
                place = place * pivots + np.arange(pivots)
            here = np.flatnonzero((place[first].min(axis=1) == place[pivot]) & (numbers != qrow))
            if not len(here):
                continue
            if not everything:
                take = -(-max(2 * k, int(wanted[place[pivot]])) // chunks)
                if take < len(here):
                    here = here[np.argsort(-agreement(order[here], mine, pivots), kind="stable")[:take]]
            vector = np.frombuffer(v, np.float64)
            # Row by row, not by BLAS, whose last bits depend on a row's place: equal vectors must tie exactly.
            score = (x[here] * vector).sum(axis=1) / (norm[here] * np.linalg.norm(vector))
            best = np.lexsort((ids[here], -score))[:k]
            out.append(pd.DataFrame({"q": q, "qrow": qrow, "id": ids[here[best]], "score": score[best], "scored": len(here)}))
        return pd.concat(out) if out else empty

    return run


def _found(fine: DataFrame, total: int, is_query, k: int, pivots: int | None, ordered: int, posted: int, probed: int, chunk: int, block: int, reranked, seed: int, exact: bool) -> DataFrame:
    """Vectors of one length (id, v, row) -> q, qrow, id, score: at least each query's k best finds."""
    wished = max(PIVOTS_LEAST, PIVOTS_ROOT * total**0.5)
    n_pivots = pivots or int(min(PIVOTS_MOST, wished))
    if not pivots:
        probed, reranked = probes(total, probed), [x * max(1.0, wished / n_pivots) for x in reranked]
        ordered = max(ordered, probed)
    drawn = fine.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n_pivots).toPandas()  # a bounded sample
    centres = np.array(drawn["v"].tolist(), np.float64)
    n_pivots = len(centres)
    posted, probed = min(posted, n_pivots), min(probed, n_pivots)
    index = stored(fine.mapInPandas(_index(centres, min(ordered, n_pivots), max(posted, probed)), "id long, row long, v binary, o binary, top array<int>"), "index")

    def search(queries: DataFrame, everything: bool) -> DataFrame:
        rows = index.select("id", "row", "v", "o", F.explode(F.slice("top", 1, posted)).alias("p"))
        sizes = {r["p"]: r["n"] for r in rows.groupBy("p").agg(F.count("*").alias("n")).collect()}  # at most one row per pivot
        probes = F.sequence(F.lit(0), F.lit(n_pivots - 1)) if everything else F.slice("top", 1, probed)
        asked = queries.select(*(F.col(c).alias(c) for c in ("id", "row", "v", "o")), F.explode(probes).alias("p"))  # columns of its own: both sides come from the index
        blocks = {r["p"]: -(-r["n"] // block) for r in asked.groupBy("p").agg(F.count("*").alias("n")).collect()}
        files = [(p, -(-n // chunk), blocks[p]) for p, n in sizes.items() if p in blocks]
        if not files:
            return index.sparkSession.createDataFrame([], "q long, qrow long, id long, score double, scored long")
        cut = lambda: F.broadcast(index.sparkSession.createDataFrame(files, "p int, chunks long, blocks long"))  # noqa: E731  at most PIVOTS_MOST rows
        rows = rows.join(cut(), "p").withColumn("c", F.pmod(F.xxhash64("row"), F.col("chunks"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        asked = asked.join(cut(), "p").withColumn("b", F.pmod(F.xxhash64("row"), F.col("blocks"))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        cells = rows.groupBy("p", "c", "b").cogroup(asked.groupBy("p", "c", "b"))
        return cells.applyInPandas(_search(n_pivots, posted, probed, k, reranked, everything), "q long, qrow long, id long, score double, scored long")

    queries = index.where(is_query(F.col("id")))
    if exact:
        return stored(search(queries, True), "found")
    found = stored(search(queries, False), "found")
    met = found.groupBy("qrow").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, total - 1))
    short = queries.join(met, queries.row == met.qrow, "left_anti")
    if short.limit(1).count():
        again = stored(search(short, True), "again")
        found = found.join(met.select("qrow"), "qrow", "left_semi").select(*again.columns).unionByName(again)
    return found


def nearest(
    vectors: DataFrame, is_query, k: int = 5, *, pivots: int | None = None, ordered: int = ORDERED, posted: int = POSTED, probed: int = PROBED, chunk: int = CHUNK, block: int = BLOCK, reranked=RERANKED, seed: int = 7, exact: bool = False,
) -> DataFrame:
    """(id long, v array of numbers) -> each query's k nearest other rows by cosine: query_id, rank, vec_id, score. With ``exact`` each query meets every row, once."""
    v = F.transform("v", lambda x: x.cast("double"))
    fine = vectors.select("id", v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = fine.where(~F.exists("v", odd)).where(F.exists("v", lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id())
    found = None
    for n, total in sorted(map(tuple, fine.groupBy(F.size("v").alias("n")).count().collect())):  # one row per length
        part = _found(fine.where(F.size("v") == n), total, is_query, k, pivots, ordered, posted, probed, chunk, block, reranked, seed, exact)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranked = F.row_number().over(Window.partitionBy("qrow").orderBy(F.desc("score"), "id"))
    best = found.withColumn("rank", ranked).where(F.col("rank") <= k)
    return best.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op7_permutation_index(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(vectors, lambda i: i % 50 == 0)
