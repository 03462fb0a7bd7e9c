"""Language identification by error-correcting output codes.

Each language has a codeword; a binary n-gram classifier predicts each bit of it: the mean log-odds of a text's hashed byte 2- and
3-grams between the languages with the bit and those without. Decoding takes the codeword with the least loss, the bits weighted by
how well their classifier separates its sides, and flags texts whose best two codewords are close as ambiguous.
Learning counts n-grams by language over all learning rows; what reaches the driver is languages x buckets numbers.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and for all texts if nothing was learned; with one
learned language every other text gets it; a null lang is not learned; more than ``LANGUAGES_MOST`` languages are an error; a null doc_id is not held out; repeated rows count and are answered each;
a text of any length counts whole; other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.shared import documents

BUCKETS = 8192
_HALF = BUCKETS // 2
#: Margins are mean log-odds times this.
SHARPNESS = 25.0
#: More languages than this are an error: a task holds BUCKETS numbers of each, and so does the driver.
LANGUAGES_MOST = 1000
AMBIGUOUS = 0.75


def ngrams(text: str) -> np.ndarray:
    """Counts of a text's hashed byte 2-grams and 3-grams."""
    a = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + a[2:] * np.uint32(0x27D4EB2F)
    return np.bincount(np.concatenate([two >> np.uint32(20), (three >> np.uint32(20)) + np.uint32(_HALF)]), minlength=BUCKETS)


def codewords(n: int) -> np.ndarray:
    """n distinct rows of -1 and 1: all splits of up to six languages, else seeded columns that split them."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        columns = [[1 if k >> i & 1 else -1 for i in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(columns, np.int8).T
    rng = np.random.default_rng(n)
    width = 15 * int(np.ceil(np.log2(n)))
    best, gap = None, -1
    for _ in range(20):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        code[0, (code == code[0]).all(axis=0)] *= -1
        near = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if near > gap:
            best, gap = code, near
    return best


class Codes:
    """Languages, codewords, bit classifiers and bit weights."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages)).astype(np.float64)
        self.weights, self.bits = np.zeros((BUCKETS, self.code.shape[1]), np.float32), np.ones(self.code.shape[1])
        if len(self.languages) > 1:
            shares = np.stack([(counts[x] + 0.5) / (counts[x] + 0.5).sum() for x in self.languages])
            for b in range(self.code.shape[1]):
                one, zero = shares[self.code[:, b] > 0].mean(axis=0), shares[self.code[:, b] < 0].mean(axis=0)
                self.weights[:, b] = np.log(one / zero)
                self.bits[b] = ((one - zero) * np.log(one / zero)).sum()  # how far apart the sides are
            self.bits /= self.bits.mean()

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            if text is None or not self.languages or not any(map(str.isalpha, text)):
                out.append(("und", 0.0, False))
                continue
            if len(self.languages) == 1:
                out.append((self.languages[0], 1.0, False))
                continue
            grams = ngrams(text)
            margin = SHARPNESS * (grams @ self.weights) / grams.sum()
            loss = np.logaddexp(0, -self.code * margin) @ self.bits
            share = np.exp(loss.min() - loss)
            share /= share.sum()
            k = int(share.argmax())
            out.append((self.languages[k], float(share[k]), bool(share[k] < AMBIGUOUS)))
        return pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for part in parts:
        for lang, text in zip(part["lang"], part["text"]):
            if lang not in counts:
                if len(counts) == LANGUAGES_MOST:
                    raise ValueError(f"there are more than {LANGUAGES_MOST} languages")
                counts[lang] = np.zeros(BUCKETS, np.int64)
            counts[lang] += ngrams(text)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": c[at]})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_languages(docs: DataFrame) -> Codes:
    """Learn from all rows of (doc_id, text, lang) that aren't held out."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sums = rows.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.limit(LANGUAGES_MOST * BUCKETS + 1).toPandas()
    if len(got) > LANGUAGES_MOST * BUCKETS or got["lang"].nunique() > LANGUAGES_MOST:
        raise ValueError(f"there are more than {LANGUAGES_MOST} languages")
    counts: dict[str, np.ndarray] = {}
    for lang, rows in got.groupby("lang"):
        counts[lang] = np.bincount(rows["bucket"], rows["n"], BUCKETS)
    return Codes(counts)


def language(codes: Codes):
    """A column function: text -> struct of lang_pred, score, ambiguous."""

    def predict(text: pd.Series) -> pd.DataFrame:
        return codes.predict(text)

    return F.pandas_udf(predict, "lang_pred string, score double, ambiguous boolean")


def op5_language(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    predict = language(fit_languages(docs))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.*")
