"""op4 and op5 against plain-Python versions: statistics, trees, n-grams and decoding, one text at a time."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from conftest import SMALL
from veritab.llm import langid, quality, queries, shared


def plain_statistics(text):
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality.STATISTICS)
    n, chars = len(raw), Counter(raw)
    words, lines = re.findall(rb"[^ \t\n\r\x0b\x0c]+", raw), raw.split(b"\n")
    m = max(1, len(words))
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    kind = lambda test: sum(k for c, k in chars.items() if test(c)) / n
    blank = b" \t\n\r\x0b\x0c"
    upper, lower, digit = (kind(lambda c, r=r: r[0] <= c <= r[1]) for r in (b"AZ", b"az", b"09"))
    other, blanks = kind(lambda c: c >= 128), kind(lambda c: c in blank)
    stops = sum(chars[c] for c in b".!?")
    return [
        math.log1p(n), math.log1p(len(words)), mean, math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes)), len(set(words)) / m, len({(a, b) for a, b in zip(words, words[1:])}) / m,
        math.log1p(len(lines)), len(set(lines)) / len(lines), math.log1p(n / len(lines)), upper, lower, digit, 1 - upper - lower - digit - other - blanks, other, blanks,
        stops / m, chars[124] / m, sum(chars[c] for c in b"!#$") / m, sum(w.upper() == w and w.lower() != w for w in words) / m, sum(x <= 3 for x in sizes) / m,
        len(zlib.compress(raw, 1)) / n, max(Counter(words).values(), default=0) / m, sum(x.endswith((b".", b"!", b"?")) for x in lines) / len(lines), math.log1p(len(words) / max(1, stops)),
    ]


def test_quality_query_against_plain_trees(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    forest = quality.fit_quality(shared.documents(spark, SMALL), spark.read.parquet(f"{SMALL}/labels.parquet"))
    got = queries.queries()["op4_quality"](spark, SMALL).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for r in docs.itertuples():
        x = plain_statistics(r.text)
        assert np.allclose(x, quality.statistics(r.text), rtol=1e-9, atol=1e-12)
        total = forest.base
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            for _ in range(forest.depth):
                node = 2 * node + (2 if quality.statistics(r.text)[feature[node]] > threshold[node] else 1)
            total += value[node]
        score = 1 / (1 + math.exp(-total))
        row = got.loc[r.doc_id]
        assert abs(row.score - score) < 1e-9 and row.predicted == (row.score >= 0.5) and row.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_the_fit_reads_one_row_of_a_repeated_id(spark):
    docs = shared.documents(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    once, often = (quality.fit_quality(d, labels) for d in (docs, docs.unionByName(docs).unionByName(docs)))
    assert (once.feature == often.feature).all() and np.allclose(once.value, often.value)


def plain_ngrams(text):
    raw = b" " + text.lower().encode() + b" "
    found = Counter()
    for i in range(len(raw) - 1):
        two = (raw[i] * 0x9E3779B1 + raw[i + 1] * 0x85EBCA6B) % 2**32
        found[two >> 20] += 1
        if i + 2 < len(raw):
            three = (two * 0xC2B2AE35 + raw[i + 2] * 0x27D4EB2F) % 2**32
            found[(three >> 20) + langid.BUCKETS // 2] += 1
    return found


def test_language_query_against_plain_counts(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    got = queries.queries()["op5_language"](spark, SMALL).toPandas().set_index("doc_id")
    grams = {r.doc_id: plain_ngrams(r.text) for r in docs.itertuples() if r.text is not None}
    counts = {}
    for r in docs.itertuples():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(grams[r.doc_id])
    languages = sorted(counts)
    share = {x: {b: (counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * langid.BUCKETS) for b in range(langid.BUCKETS)} for x in languages}
    code, bits = langid.codewords(len(languages)), []
    for b in range(code.shape[1]):
        sides = [[x for x, c in zip(languages, code[:, b]) if c == side] for side in (1, -1)]
        one, zero = ([sum(share[x][k] for x in side) / len(side) for k in range(langid.BUCKETS)] for side in sides)
        odds = [math.log(p / q) for p, q in zip(one, zero)]
        bits.append((odds, sum((p - q) * o for p, q, o in zip(one, zero, odds))))
    mean = sum(w for _, w in bits) / len(bits)
    for r in docs.itertuples():
        row = got.loc[r.doc_id]
        assert row.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (row.lang_pred, row.score) == ("und", 0)
            continue
        margins = [langid.SHARPNESS * sum(n * odds[k] for k, n in grams[r.doc_id].items()) / sum(grams[r.doc_id].values()) for odds, _ in bits]
        loss = [sum(math.log1p(math.exp(-c * m)) * w / mean for c, m, (_, w) in zip(word, margins, bits)) for word in code.tolist()]
        chance = [math.exp(min(loss) - x) for x in loss]
        best = max(range(len(languages)), key=lambda k: chance[k])
        assert row.lang_pred == languages[best] and abs(row.score - chance[best] / sum(chance)) < 1e-3
