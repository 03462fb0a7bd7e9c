"""Profiles tell values apart by at most 32 bytes each."""

from pyspark.sql import functions as F

from conftest import SMALL
from veritab.operators import profile
from veritab.operators.profile import column_profile
from veritab.plans import catalogue
from veritab.sources.records import from_frame


def test_long_texts_are_not_grouped_whole(spark):
    long = "x" * 1_000_000
    texts = [long + "a", long + "b", long + "a", "", None, "é" * 15, "é" * 16, "é" * 16 + "😀", "a" * 31, "a" * 32, "a" * 32]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "rec long, t string")
    got = column_profile(from_frame(frame, F.col("rec"), ["t"]), None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.drop("ordinal").collect()] == [("t", 11, 1_000_001, 2, 7)]
    assert "sha2(" in plan


def test_whole_tables_pass_no_single_task(spark, monkeypatch):
    plans = []

    def seen(records, sample_rows):
        got = column_profile(records, sample_rows)
        plans.append(got._jdf.queryExecution().optimizedPlan().toString())
        return got

    monkeypatch.setattr(profile, "column_profile", seen)
    assert catalogue.inferred_constraints(spark, SMALL).count() == 8
    assert len(plans) == 3 and not any("Limit" in p or "Sort" in p for p in plans)
