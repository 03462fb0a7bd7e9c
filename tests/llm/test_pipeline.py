import brute
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from veritab.llm import quality, shared, wordtok

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark):
    docs = shared.documents(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(shared.stored(stage(spark, seen[-1], SMALL), name))
        assert seen[-1].columns == docs.columns
    good = docs.withColumn("s", quality.quality_score(quality.fit_quality(docs, labels))("text")).where("s >= 0.5").toPandas()
    assert sorted(seen[1].toPandas()["doc_id"]) == sorted(good["doc_id"])
    rows = seen[1].toPandas()
    classes = brute.components(rows["doc_id"].tolist(), [brute.fingerprint(t) for t in rows["text"]])
    assert sorted(seen[2].toPandas()["doc_id"]) == sorted(set(classes))
    before, after = seen[2].toPandas().set_index("doc_id"), seen[3].toPandas().set_index("doc_id")
    for i, r in before.iterrows():
        _, spans = brute.secrets(r["text"])
        kept, at = "", 0
        for _, s, e in spans:
            if s >= at:
                kept += r["text"][at:s] + "<removed>"
            at = max(at, e)
        assert after["text"][i] == kept + r["text"][at:] and after["n_chars"][i] == len(after["text"][i])
    sizes = {i: len(brute.WORD.findall(t)) for i, t in after["text"].items()}
    want = brute.targets(after.assign(z=[sizes[i] for i in after.index]).groupby("source")["z"].sum().to_dict())
    mixed = seen[4].toPandas()
    assert mixed.groupby("doc_id").size().max() <= 2
    for source, rows in mixed.groupby("source"):
        assert abs(sum(sizes[i] for i in rows["doc_id"]) - want[source]) <= max(20, 0.05 * want[source])
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen[4], SMALL)
    t = wordtok.WordTokenizer(wordtok.default_path())
    total = sum(len(x) + 1 for x in t.encode(mixed["text"].tolist()))
    assert pieces.agg(F.sum("length")).first()[0] == total
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_stages_on_odd_documents(spark, odd_docs, no_docs):
    """Nulls, repeated ids with other texts, ties and clashing names go through every stage; an empty table stays empty."""
    docs, counts = odd_docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, SMALL), name)
        assert docs.columns == odd_docs.columns
        counts.append(docs.count())
    assert counts[0] <= odd_docs.count() and counts[1] == counts[2] <= counts[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.where("start = 0").count() == counts[3]
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
