"""Mixing sources to target weights by subset-sum budget fitting.

Sources share a budget by weight; what a source cannot hold (more than ``max_repeats`` times its size) goes to the others.
A source whose target is at least its size is taken whole; what then remains is fitted: documents are counted by length, every length
gives the same share of its documents (rounded up or down by chance of a seed), up to a remainder of a few documents' words, and a
bounded-knapsack programme over the lengths, in an order of the seed, fills that to the word. So no length is preferred, however
large the source. Which documents of a length are taken follows a seeded hash.

Defined results: a null text has size 0; null sources are one source, sorted last; rows alike in doc_id, source and size are
taken together, so repeated rows stay repeated alike; other columns may have any name; documents of size 0 take no words; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.shared import documents, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
SEED = 20
#: The knapsack programme first fills so many times the longest document's words, and up to ROOMS[-1] times where it doesn't come out even.
ROOMS = (4, 16, 64)
#: Seeded roundings that are tried for one that leaves about that.
DRAWS = 200
#: Documents of one length in one source are ranked in buckets of about so many.
BUCKET_ROWS = 1000


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_repeats=MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> plus target. One row per source: the windows over all of them sort that small table only.

    Resharing ends where every source has min(cap, level * weight); sorted by cap / weight, the level is known at the
    first source that stays under its cap.
    """
    everything = Window.partitionBy()
    named = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("_w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("_cap", F.col("source_size") * float(max_repeats))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"_full": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_rest": F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing)), "_all": F.sum("source_size").over(everything) * float(share)})
    w = w.withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_rest"))
    under = F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("level")))
    w = w.withColumn("_level", F.min(under).over(everything)["level"])
    return w.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def _fill(lengths: list[int], free: list[int], order: list[int], rest: int) -> tuple[list[int], int]:
    """A bounded knapsack: how many of each length's free documents come nearest to ``rest`` words without passing it, and the words that they leave."""
    took = [0] * len(lengths)
    # Bit s of `reach` says that the items so far can make s words; items are powers of two of a length's free documents.
    reach, mask, steps = 1, (1 << (rest + 1)) - 1, []
    for i in order:
        x = lengths[i]
        left, part = min(free[i], rest // x if x else 0), 1
        while left > 0 and not reach >> rest & 1:
            part = min(part, left)
            more = reach | reach << part * x & mask
            if more == reach:  # no larger number of these makes a new sum either, as their multiples are all reached
                break
            steps.append((i, part, reach))
            reach = more
            left, part = left - part, part * 2
    at = best = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            took[i] += part
            at -= part * lengths[i]
    return took, rest - best


def fit_budget(lengths: list[int], counts: list[int], budget: int, seed: int = SEED) -> list[int]:
    """How many documents of each length to take, so that their words come as near to ``budget`` as they can without passing it.

    That is certain where the budget is within ROOMS[-1] times the longest document; beyond, what is dealt by rounding stays as it is.
    """
    total = sum(x * n for x, n in zip(lengths, counts))
    if budget <= 0 or total == 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    rng = np.random.default_rng(seed)
    x, n = np.array(lengths, np.int64), np.array(counts, np.int64)
    order = rng.permutation(len(x)).tolist()
    step = int(np.gcd.reduce(x[n > 0]))
    best = None
    for room in (k * int(x.max()) for k in ROOMS):
        even = n * (max(0, budget - room) / total)
        took, words = None, 0
        for _ in range(DRAWS):
            drawn = np.minimum(np.floor(even + rng.random(len(x))).astype(np.int64), n)
            at = int((drawn * x).sum())
            if at <= budget and (took is None or abs(budget - at - room) < abs(budget - words - room)):
                took, words = drawn, at
            if took is not None and budget - words <= 2 * room:
                break
        if took is None:  # all draws passed the budget
            took, words = np.floor(even).astype(np.int64), int((np.floor(even).astype(np.int64) * x).sum())
        more, left = _fill(lengths, (n - took).tolist(), order, budget - words)
        if best is None or left < best[0]:
            best = left, (took + np.array(more, np.int64)).tolist()
        if best[0] == budget % step or room >= budget:  # no nearer, or all was tried
            break
    return best[1]


def _plan_source(rows: pd.DataFrame, seed: int = SEED) -> pd.DataFrame:
    rows = rows.sort_values("unit").reset_index(drop=True)
    size, target = int(rows["source_size"][0]), float(rows["target"][0])
    passes = int(target // size) if size else 0
    wanted = fit_budget(rows["unit"].tolist(), rows["n"].tolist(), round(target - passes * size), seed)
    return rows.assign(k=np.array(wanted, np.int64), passes=passes)


def mix(docs: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, **shares) -> DataFrame:
    """docs (doc_id, text, source) -> a row per document: doc_id, source, size, source_size, target, times, taken.

    The text is read once. What is shuffled afterwards is a few numbers per document; per source, one task sees its counts by
    length, whose number is bounded by the longest document and not by the documents.
    """
    sized = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    takes = _takes(sized, seed, bucket_rows, shares).withColumnsRenamed({"doc_id": "_d", "source": "_s", "size": "_z"})
    out = sized.join(takes, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def takes_of(docs: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, **shares) -> DataFrame:
    """docs (doc_id, text, source) -> (doc_id, source, size) that occur, with source_size, target and times."""
    return _takes(docs.select("doc_id", "source", words(F.col("text")).alias("size")), seed, bucket_rows, shares)


def _takes(sized: DataFrame, seed: int, bucket_rows: int, shares: dict) -> DataFrame:
    """(doc_id, source, size) -> a row for each that occurs, with source_size, target and times."""
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    units = stored(units.withColumn("unit", F.col("size") * F.col("m")), "units")
    hist = units.groupBy("source", "unit").agg(F.count("*").alias("n"))
    targets = source_targets(units.groupBy("source").agg(F.sum("unit").alias("source_size")), **shares)
    hist = hist.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = stored(hist.groupBy("source").applyInPandas(lambda rows: _plan_source(rows, seed), "source string, unit long, n long, source_size long, target double, k long, passes long"), "plan")

    rank = F.xxhash64(F.lit(seed), F.col("doc_id"))
    p = plan.withColumnsRenamed({"source": "_s", "unit": "_u"})
    planned = units.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("unit") == F.col("_u"))).drop("_s", "_u")
    planned = planned.withColumns({"_rank": rank, "_bucket": F.pmod(rank, F.ceil(F.col("n") / bucket_rows))})
    some = (F.col("k") > 0) & (F.col("k") < F.col("n"))
    whole = planned.where(~some).withColumn("picked", (F.col("k") > 0).cast("long"))
    # Of a length that is taken in part, whole buckets of the seeded order go first; only the last one taken is ranked.
    part = planned.where(some)
    quota = part.groupBy("source", "unit", "_bucket").agg(F.count("*").alias("_c"), F.first("k").alias("_k"))
    before = Window.partitionBy("source", "unit").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = quota.withColumn("_q", F.col("_k") - F.coalesce(F.sum("_c").over(before), F.lit(0)))
    quota = quota.select(F.col("source").alias("_s"), F.col("unit").alias("_u"), F.col("_bucket").alias("_b"), "_q")
    part = part.join(quota, F.col("source").eqNullSafe(F.col("_s")) & (F.col("unit") == F.col("_u")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_u", "_b")
    ranked = F.row_number().over(Window.partitionBy("source", "unit", "_bucket").orderBy("_rank", "doc_id"))
    part = part.withColumn("picked", (ranked <= F.col("_q")).cast("long")).drop("_q")
    return whole.unionByName(part).select("doc_id", "source", "size", "source_size", "target", (F.col("passes") + F.col("picked")).alias("times"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, rows that it does not take left out. Whatever its columns are called."""
    takes = takes_of(docs, **options).where("times > 0")
    rows = docs.select(F.struct("*").alias("row"))
    on = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (words(F.col("row.text")) == F.col("size"))
    return rows.join(takes, on).select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def op2_mix_sources(spark, sf_dir):
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "times")
