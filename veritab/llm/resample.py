"""Target-distribution importance resampling.

Texts become counts of hashed features, runs of words. What a bucket says of a feature is the log of its share in the target over its share in the
documents, and a document's weight is the mean of that. Seeded Gumbel noise makes the highest scores a draw without replacement.
A task scores the texts of an Arrow batch as arrays. The k-th key by (score downwards, doc_id) is found digit by digit: one count of 16-bit digits over
all rows a round, at most 65,536 numbers for the driver. Only rows up to that key are range-sorted and ranked.

Defined results: a null or empty text has no features and weight 0; a null doc_id counts as the text ``null`` in the noise and comes last among ties;
rows that share score and doc_id are drawn in the order of their texts' hashes; repeated rows stay repeated and count each; a text of any length
counts whole; with an empty target or no documents every bucket still has its gain; an empty table gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.shared import documents, stored
from veritab.operators.number import numbered

BUCKETS = 10_000
RUNS = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Texts are looked at in chunks of about so many bytes.
CHUNK = 1 << 20
#: Longer features are hashed one by one.
_LONG = 48
_DIGIT = 16


def _fold() -> np.ndarray:
    """By byte: A-Z lower-cased; what is no part of a word becomes a blank."""
    byte = np.arange(256)
    lower = np.where((byte >= 0x41) & (byte <= 0x5A), byte + 32, byte)
    word = ((lower >= 0x30) & (lower <= 0x39)) | ((lower >= 0x61) & (lower <= 0x7A)) | (lower >= 0x80)
    return np.where(word, lower, 32).astype(np.uint8)


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, crc >> 1 ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


_FOLD, _TABLE = _fold(), _crc_table()


def crc32_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``data``, a byte of all of them at a time."""
    out = np.empty(len(start), np.uint32)
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = zlib.crc32(data[start[k] : start[k] + size[k]])
    short = np.flatnonzero(size <= _LONG)
    short = short[np.argsort(size[short].astype(np.uint8), kind="stable")[::-1]]
    at, longer = start[short], len(short) - np.cumsum(np.bincount(size[short], minlength=_LONG + 1))
    crc = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for p in range(_LONG):
        live = int(longer[p])
        if not live:
            break
        c = crc[:live]
        crc[:live] = _TABLE[(c ^ data[at[:live] + p]) & np.uint32(255)] ^ c >> np.uint32(8)
    out[short] = ~crc
    return out


def features(data: np.ndarray, ends: np.ndarray, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts that each end in a blank, and where they end -> buckets of all features in the texts' order; features and words a text."""
    data = _FOLD[data]
    word = data != 32
    edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, size = edges[::2], edges[1::2] - edges[::2]
    words = np.diff(np.searchsorted(start, ends), prepend=0)
    shown = data[word | np.concatenate([[False], word[:-1]])]  # words with one blank after each
    last = np.cumsum(size + 1)
    start, text = last - size - 1, np.repeat(np.arange(len(ends)), words)
    found, owner = [], []
    for n in range(1, runs + 1):
        begin = np.arange(max(0, len(start) - n + 1))
        begin = begin[text[begin] == text[begin + n - 1]]
        found.append(crc32_of(shown, start[begin], last[begin + n - 1] - 1 - start[begin]) % np.uint32(buckets))
        owner.append(text[begin])
    if runs > 1:
        order = np.argsort(np.concatenate(owner), kind="stable")
        found, owner = [np.concatenate(found)[order]], [np.concatenate(owner)[order]]
    return found[0].astype(np.int64), np.bincount(owner[0], minlength=len(ends)), words


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of runs of texts, a blank after each and nulls as empty, and where each text ends in them."""
    kind = pa.large_string()
    joined = pc.binary_join_element_wise(pc.fill_null(texts.cast(kind), pa.scalar("", kind)), pa.scalar("", kind), pa.scalar(" ", kind))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)
    bounds = [0, *(np.flatnonzero(np.diff(offsets[1:] // CHUNK)) + 1).tolist(), len(joined)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a < b:
            yield data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]


def counts(rows: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket. A task adds up its own; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, ends in chunks(batch.column(0)):
                total += np.bincount(features(data, ends, runs, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """A bucket's 1000 * ln of its smoothed share in the target over that in the documents, floored."""
    n, all_target, all_source = len(target), int(target.sum()), int(source.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + n) / ((s + 1) * (all_target + n)))) for t, s in zip(target.tolist(), source.tolist())], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise by doc_id, in thousandths, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def scored(docs: DataFrame, gain: np.ndarray, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, hash (of the text), n_words, n_features, weight, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for data, ends in chunks(batch.column(2)):
                found, size, n = features(data, ends, runs, len(gain))
                reach = np.concatenate([[0], np.cumsum(gain[found])])[np.concatenate([[0], np.cumsum(size)])]
                words.append(n)
                sizes.append(size)
                weights.append(np.diff(reach) // np.maximum(size, 1))
            numbers = [pa.array(np.concatenate(x), pa.int64()) for x in (words, sizes, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers], ["doc_id", "hash", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "hash", "text").mapInArrow(run, "doc_id long, hash long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _digit(key: Column, shift: int) -> Column:
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(1 << 63))), shift).bitwiseAND(F.lit((1 << _DIGIT) - 1))


def kth(rows: DataFrame, k: int, *keys: Column) -> list[int | None]:
    """The k-th smallest (k from 1) of composite keys of longs, nulls last: a round counts the next 16-bit digit of the keys that begin like it."""
    found: list[int | None] = []
    begins = F.lit(True)
    for key in keys:
        lo, hi, nulls, n = rows.where(begins).agg(F.min(key), F.max(key), F.count_if(key.isNull()), F.count("*")).first()
        if k > n - nulls:
            found.append(None)
            k -= n - nulls
            begins &= key.isNull()
            continue
        same, value = begins & key.isNotNull(), lo + (1 << 63)
        for shift in range(64 - _DIGIT, -1, -_DIGIT):
            if not (lo ^ hi) >> shift:
                continue  # all begin alike up to this digit
            by_digit = sorted(map(tuple, rows.where(same).groupBy(_digit(key, shift).alias("digit")).count().collect()))
            for digit, n in by_digit:
                if k <= n:
                    break
                k -= n
            value = (value >> shift + _DIGIT << _DIGIT | digit) << shift | value & (1 << shift) - 1
            same &= _digit(key, shift) == digit
        found.append(value - (1 << 63))
        begins &= key == found[-1]
    return found


def drawn(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (doc_id, hash, n_words, n_features, weight, score) plus rank: 1 to k by score downwards, then doc_id; null for the rest. ``rows`` must be a written table."""
    none = F.lit(None).cast("long")
    if k < 1:
        return rows.withColumn("rank", none)
    fit = F.col("fits")
    least, last = kth(rows.where(fit), k, -F.col("score"), F.col("doc_id"))
    tied = F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= last, F.lit(False))
    up_to = fit & ((F.col("score") > -least) | ((F.col("score") == -least) & tied))
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("hash").asc_nulls_last(), F.col("n_features"))
    ranked = numbered(rows.where(up_to), "rank", *order)
    return ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).unionByName(rows.where(~up_to).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """A row per document: doc_id, n_words, n_features, weight, score, and rank among the drawn, ``percent`` of those with enough words."""
    gain = gains(counts(target, runs=runs, buckets=buckets), counts(docs, runs=runs, buckets=buckets))
    rows = stored(scored(docs, gain, runs, seed).withColumn("fits", F.col("n_words") >= least_words), "scored")
    return drawn(rows, percent * rows.where("fits").count() // 100).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark, sf_dir):
    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
