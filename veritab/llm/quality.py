"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text become quantile bins; trees grow level by level on histograms of gradients; the forest is flattened into arrays,
and many documents walk all trees at once in numpy. The forest is fitted on the driver from at most ``SAMPLE`` labelled rows
(a documented bound, taken by hash); scoring reads every whole text once, where it lies, without a shuffle.

Defined results: a null text is an empty one and gets a score; a null doc_id is held out from learning with held_out false;
labels that are null or not 0 or 1 are passed over; of rows that share a labelled doc_id one is learned; other columns may have any name; without labelled rows every score is 0.5, with one class it is that class's share.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.shared import documents

#: The most labelled rows that a fit gathers.
SAMPLE = 20_000
STATISTICS = (
    "bytes", "words", "word_mean", "word_spread", "unique_words", "unique_pairs", "lines", "unique_lines", "line_mean", "upper", "lower", "digits",
    "punctuation", "other_bytes", "blanks", "stops", "pipes", "marks", "upper_words", "short_words", "deflated", "top_word", "line_ends", "sentence_mean",
)
_KIND = np.full(256, 4, np.uint8)
_KIND[:128] = 3
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58))):
    _KIND[list(_chars)] = _k
_KIND[[9, 10, 11, 12, 13, 32]] = 5


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6) / n
    words, lines = raw.split(), raw.split(b"\n")
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    ends = sum(x[-1:] in (b".", b"!", b"?") for x in lines)
    stops = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    return [
        math.log1p(n), math.log1p(len(words)), float(sizes.mean()), float(sizes.std()), len(counts) / m, len(set(zip(words, words[1:]))) / m,
        math.log1p(len(lines)), len(set(lines)) / len(lines), math.log1p(n / len(lines)), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5],
        stops / m, raw.count(b"|") / m, (raw.count(b"!") + raw.count(b"#") + raw.count(b"$")) / m, sum(map(bytes.isupper, words)) / m, float((sizes <= 3).sum()) / m,
        len(zlib.compress(raw, 1)) / n, max(counts.values(), default=0) / m, ends / len(lines), math.log1p(len(words) / max(1, stops)),
    ]


def matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float64).reshape(-1, len(STATISTICS))


@dataclass
class Forest:
    """Trees of equal depth as arrays (trees x nodes): children of node i are 2i+1 and 2i+2; a node that isn't split sends all left."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        return 1 / (1 + np.exp(-(self.base + self.value[trees, node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 4.0) -> Forest:
    """Logistic boosting on histograms. ``least``: the hessian that each side of a split must hold."""
    if not len(x) or y.min() == y.max():
        mean = float(y.mean()) if len(x) else 0.5
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        return Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), 0, math.log(mean / (1 - mean)))
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    cell = binned + np.arange(width)[None, :] * bins
    nodes, inner = 2 ** (depth + 1) - 1, 2**depth - 1
    feature, threshold, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    base = math.log(y.mean() / (1 - y.mean()))
    total, rows = np.full(n, base), np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + cell).ravel()
            hist = [np.bincount(at, np.repeat(v, width), many * width * bins).reshape(many, width, bins) for v in (g, h)]
            (gl, hl), (ga, ha) = [np.cumsum(v, axis=2) for v in hist], [v[:, :1].sum(axis=2, keepdims=True) for v in hist]
            gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
            for f, c in enumerate(cuts):
                gain[:, f, len(c) :] = -1
            gain[(hl < least) | (ha - hl < least)] = -1
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[rows, feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t, inner:] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        total += value[t, node]
    return Forest(feature, threshold, value, depth, base)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Forest:
    """Fit on labelled documents that aren't held out. The sample's ids are at most ``sample``, so they are broadcast."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")
    stats = F.pandas_udf(lambda s: pd.Series(list(matrix(s))), "array<double>")
    # one row of each doc_id, so that what comes to the driver is bounded however often an id is repeated
    got = rows.select("doc_id", "quality", stats("text").alias("x")).groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id", kind="stable")
    return fit(np.array(got["x"].tolist(), np.float64).reshape(-1, len(STATISTICS)), got["quality"].to_numpy(np.float64), **options)


def quality_score(forest: Forest):
    """A column function: text -> score."""

    def score(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text))
        for at in range(0, len(text), 512):
            out[at : at + 512] = forest.scores(matrix(text.iloc[at : at + 512]))
        return pd.Series(out)

    return F.pandas_udf(score, "double")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    return docs.where(quality_score(fit_quality(docs, labels))("text") >= 0.5)


def op4_quality(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    score = quality_score(fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
