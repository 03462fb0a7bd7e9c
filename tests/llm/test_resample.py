"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from veritab.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feature_list(text, runs):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, least=20, runs=1, buckets=10_000):
    """(doc_id, text) pairs -> rows of doc_id, n_words, n_features, weight, score, rank."""
    s, t, rows = Counter(), Counter(), []
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    for _, text in docs:
        s.update(map(bucket, feature_list(text, runs)[1]))
    for text in target:
        t.update(map(bucket, feature_list(text, runs)[1]))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    for doc_id, text in docs:
        words, found = feature_list(text, runs)
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        rows.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return [(*r, rank.get(id(r))) for r in rows]


def plain(rows):
    return sorted((tuple(None if pd.isna(x) else int(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    folder = SMALL.replace("sf0.001", sf)
    docs, target = (pd.read_parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    got = resample.op13_importance_resampling(spark, folder).toPandas()
    assert list(got.columns) == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute(list(zip(docs.doc_id.tolist(), docs.text)), target.text)
    assert plain(got.itertuples(index=False)) == plain((r[0], *r[2:]) for r in want)


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_odd_rows(spark, odd_docs, no_docs, runs):
    target = ["The quick fox", None, "", "wordy text \U0001f600É"]
    rows = spark.createDataFrame([(x,) for x in target], "text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = resample.resample(odd_docs, rows, 50, 2, runs, 64).collect()
    assert plain(got) == plain(brute(docs, target, 50, 2, runs, 64))
    for none in (0, 100):
        assert sum(r.rank is not None for r in resample.resample(odd_docs, rows, none, 2, runs, 64).collect()) == (len([1 for _, t in docs if len(feature_list(t, 1)[0]) > 1]) if none else 0)
    assert resample.resample(no_docs, rows).count() == 0
    assert plain(resample.resample(odd_docs, rows.where("false"), 50, 2, runs, 64).collect()) == plain(brute(docs, [], 50, 2, runs, 64))


def test_words_of_any_bytes():
    rng = np.random.default_rng(3)
    parts = ["a", "B", "Z9", "é", "\U0001f600", " ", "\n", "_", "\x00", "{", "@", "`", "\x7f", "\x80", "x" * 60, "İ", "ſ"]
    texts = ["".join(rng.choice(parts, int(n))) for n in rng.integers(0, 30, 200)] + ["", "w" * 3_000_000, " " * 70_000, "q r " * 400_000]
    import pyarrow as pa

    for runs in (1, 2):
        at = 0
        for data, ends in resample.chunks(pa.array(texts)):
            found, sizes, words = resample.features(data, ends, runs, 997)
            cut = 0
            for size, n in zip(sizes.tolist(), words.tolist()):
                own, want = feature_list(texts[at], runs)
                assert n == len(own) and sorted(found[cut : cut + size].tolist()) == sorted(zlib.crc32(f.encode()) % 997 for f in want)
                at, cut = at + 1, cut + size
            assert cut == len(found)
        assert at == len(texts)


def test_kth_key(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), None if b % 7 == 0 else int(b)) for a, b in zip(rng.integers(-3, 3, 300), rng.integers(-(2**62), 2**62, 300))]
    rows += [(-(2**63), 2**63 - 1), (2**63 - 1, -(2**63)), (2**63 - 1, 2**63 - 1), (5, 0), (5, 0), (5, 1 << 16), (5, -1)]
    frame = spark.createDataFrame(rows, "a long, b long").cache()
    order = sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0))
    for k in (1, 2, 50, 51, 150, 299, 303, 304, 305, len(rows)):
        assert tuple(resample.kth(frame, k, F.col("a"), F.col("b"))) == order[k - 1]


def test_ties_take_exactly_k(spark):
    rows = spark.range(100).selectExpr("cast(id % 3 as long) doc_id", "id % 2 as hash", "id n_words", "id n_features", "0L weight", "cast(id % 2 as long) score", "true fits")
    got = resample.drawn(rows, 41).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 42)) and [(-r.score, r.doc_id) for r in got] == sorted((-r.score, r.doc_id) for r in got)
