"""What costs grow with: an expression that others repeat, or a sort compares by, is computed once for each row."""

import re

from pyspark.sql import functions as F

from conftest import SMALL
from veritab.functions import canonical as cn
from veritab.functions import text as tx
from veritab.functions.text import _BLANK_SET, BLANKS
from veritab.plans import catalogue


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_made_once(spark):
    plan = planned(catalogue.normalized_rows(spark, SMALL))
    assert re.search(r"Sort \[canon#\d+ ASC NULLS FIRST, rec#\d+L ASC NULLS FIRST\]", plan)
    assert len(re.findall("trim|regexp_replace", "\n".join(line for line in plan.splitlines() if "AS t" in line))) <= 6
    assert all("trim(both" not in line.lower() for line in plan.splitlines() if "AS o2" in line)




def test_trimmed_is_the_pattern(spark):
    odd = "".join(sorted(_BLANK_SET))
    texts = ["", " ", odd, f"{odd}a{odd}", f"a{odd}b", "​ a", "a\u0085", " é　", "😀 ", " ﻿😀", "x" * 50, None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(tx.trimmed(F.col("x")).alias("a"), F.regexp_replace("x", f"^[{BLANKS}]+|[{BLANKS}]+\\z", "").alias("b"))
    assert all(r.a == r.b for r in rows.collect())


def test_dates_are_matched_and_not_taken_apart_by_patterns(spark):
    plan = planned(catalogue.date_canonical(spark, SMALL))
    assert plan.count("regexp_extract") <= 2 and plan.lower().count("trim(") <= 1


def test_parts_of_dates(spark):
    cases = {
        "2:05": "02:05:00.0000000", "12:05:06.5am": "00:05:06.5000000", "12:59:59,1234567 PM": "12:59:59.1234567", "23:00:01": "23:00:01.0000000", "13:00 pm": None, "24:00": None, "1:5": None, "9:30:60": None,
        "1/2/2024": "2024-01-02T00:00:00.0000000Z", "12/31/0100": "0100-12-31T00:00:00.0000000Z", "2/30/2024": None, "1/2/24": None, "2024-02-29": "2024-02-29T00:00:00.0000000Z", "2023-02-29": None,
        "2024-01-01T00:30:15.1239+01:00": "2023-12-31T23:30:15.1230000Z", "2024-01-01 00:30-05:30": "2024-01-01T06:00:00.0000000Z", "2024-01-01t00:30:01z": "2024-01-01T00:30:01.0000000Z", "2024-01-01T00:30:01.5": "2024-01-01T00:30:01.5000000Z",
        "2024-01-01T00:30:01.5Z": "2024-01-01T00:30:01.5000000Z", "2024-01-01T00:30:01-00:01": "2024-01-01T00:31:01.0000000Z", "2024-01-01T00:30:60Z": None, "2024-01-01T00:30+24:00": None, "": None, None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", cn.date(F.col("x")).alias("v")).collect()
    assert {r.x: r.v for r in rows} == cases
