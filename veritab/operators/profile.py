"""Profiles of columns, and starter contracts made from them."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.text import length
from veritab.sources.records import Records


# The csv section of contracts that are made from files.
CSV = {"delimiter": ",", "encoding": "utf-8", "quote": '"', "header": "required", "nullValues": [""], "trimValues": False, "caseSensitive": True, "allowBlankRows": False, "allowRaggedRows": False}


def column_profile(records: Records, sample_rows: int | None = 10_000) -> DataFrame:
    """(column, sampled, max_length, null_count, distinct_count) of the first ``sample_rows`` records (None: all), in one aggregate.

    The sample is the operator's feature: it bounds inference. Without it distinct counts shuffle one row per column and value: the value's bytes if they are
    fewer than a SHA-256, else that, so that no task holds whole texts to tell them apart.
    """
    rows = records.frame if sample_rows is None else records.frame.orderBy("rec").limit(sample_rows)
    cells = [records.cell(i) for i in range(len(records.header))]
    names = F.element_at(F.array(*map(F.lit, records.header)), F.col("ordinal") + 1)
    tall = rows.select(F.inline(F.array(*(F.struct(F.lit(i).alias("ordinal"), _known(c).alias("value"), length(c).alias("units")) for i, c in enumerate(cells)))))
    counted = tall.groupBy("ordinal", "value").agg(F.count("*").alias("n"), F.max("units").alias("units"))
    summed = counted.groupBy("ordinal").agg(
        F.sum("n").alias("sampled"), F.max("units").alias("max_length"), F.coalesce(F.sum(F.when(F.col("units") == 0, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if(F.col("units") > 0).alias("distinct_count"),
    )
    return summed.select("ordinal", names.alias("column"), "sampled", "max_length", "null_count", "distinct_count")


def _known(c: Column) -> Column:
    """A text's UTF-8 if it has fewer than 32 bytes, else its SHA-256, which has 32."""
    return F.when(F.octet_length(c) < 32, F.encode(c, "UTF-8")).otherwise(F.unhex(F.sha2(F.encode(c, "UTF-8"), 256)))


def longest(records: Records) -> dict[str, int]:
    """The greatest length in each column over all records."""
    got = records.frame.agg(*(F.max(length(records.cell(i))).alias(f"m{i}") for i in range(len(records.header)))).first()
    return {h: got[f"m{records.header.index(h)}"] or 0 for h in records.header}


def outline(records: Records, sample_rows: int | None = 10_000, infer: bool = False, sample_tests: bool = True) -> dict:
    """A starter contract: presence, and with ``infer`` not-null, unique and longest length of the sample; with ``sample_tests`` tests of the first record."""
    if not records.header:
        raise ValueError("Cannot create a contract from an empty CSV.")
    if not all(records.header):
        raise ValueError("The CSV header contains an empty column name.")
    if doubled := [h for h, n in Counter(records.header).items() if n > 1]:
        raise ValueError(f"The CSV header contains duplicate column names: {', '.join(doubled)}.")
    columns = {h: {"presence": "required"} for h in records.header}
    if infer:
        found = {r["column"]: r for r in column_profile(records, sample_rows).collect()}
        for h in records.header:
            r = found.get(h)
            full = bool(r) and r["null_count"] == 0
            columns[h]["constraints"] = {"notNull": not r or r["null_count"] == 0, "unique": full and r["distinct_count"] == r["sampled"], "maxLength": r["max_length"] if r else 0}
    tests = []
    first = records.frame.orderBy("rec").select(*(records.cell(i).alias(f"v{i}") for i in range(len(records.header)))).first() if sample_tests else None
    picked = [i for i in range(len(records.header)) if first and first[i] != ""][:2]
    if picked:
        select = {records.header[i]: first[i] for i in picked}
        tests = [
            {"id": "sample-row-exists", "name": "Sample row exists", "select": select, "expect": {"count": {"min": 1}}},
            {"id": "sample-cell-value", "name": "Sample cell has its value", "select": dict(select), "expect": {"count": {"min": 1}, "cells": {records.header[picked[0]]: {"equals": first[picked[0]]}}}},
        ]
    schema = {"allowAdditionalColumns": True, "rowCount": {"min": 1}, "columnCount": {"exact": len(records.header)}, "columns": columns}
    return {"version": 1, "csv": dict(CSV), "schema": schema, "rowTests": tests}


def contract_of_lengths(records: Records) -> dict:
    """A contract that all records fit: every column is required and no longer than its longest cell; nothing else is said of it."""
    if not records.header:
        raise ValueError("Cannot create a contract from an empty CSV.")
    most = longest(records)
    columns = {h: {"presence": "required", "constraints": {"notNull": False, "unique": False, "maxLength": most[h]}} for h in records.header}
    return {"version": 1, "csv": dict(CSV), "schema": {"allowAdditionalColumns": True, "rowCount": {"min": 1}, "columnCount": {"exact": len(records.header)}, "columns": columns}, "rowTests": []}
