"""Complete issue tables from one reading, and checks of one's own."""

import pytest
from pyspark.sql import functions as F

from veritab.functions import text as tx
from veritab.operators import rules as ru
from veritab.operators import validate as va
from veritab.plans import tsql
from veritab.sources import contracts as ct
from veritab.sources.records import from_csv, from_frame
from veritab.streaming.checks import write_issues

TEXT = "a,b,c\n1,x,\n2,x,yy\n1,,zzz\n,x,q\n2,x,yy\n7,x\n"
CONTRACTS = [
    "version: 1\nidentity: {columns: [a, b]}\nschema: {rowCount: {exact: 3}, columns: {a: {presence: required, constraints: {notNull: true, unique: true}}, b: {presence: required, constraints: {allowedValues: [x]}}, c: {presence: optional, constraints: {maxLength: 2}}, d: {presence: required}}}\n"
    "rowTests: [{id: t, select: {a: '2'}, expect: {count: {exact: 1}, cells: {c: {equals: y}}}}]",
    "version: 1\nschema: {columns: {c: {presence: required, constraints: {unique: true}}}}",
    "version: 1\nschema: {columns: {a: {presence: required}}}\ncsv: {allowRaggedRows: true}",
]


@pytest.fixture()
def records(spark, tmp_path):
    (tmp_path / "x.csv").write_text(TEXT)
    return from_csv(spark, str(tmp_path / "x.csv"))


def test_the_same_issues_as_in_results(records):
    contracts = [ct.parse(c) for c in CONTRACTS]
    want = va.validate(records, contracts, 1000)
    results, found = va.all_issues(records, contracts)
    rows = found.collect()
    for k, (w, r) in enumerate(zip(want, results)):
        assert (r.valid, r.row_count, r.column_count, r.test_count, r.issue_count) == (w.valid, w.row_count, w.column_count, w.test_count, w.issue_count)
        mine = sorted((x for x in rows if x.contract == k), key=lambda x: (x.phase, x.row if x.phase == 1 else x.place, x.place if x.phase == 1 else x.row or 0))
        assert [{n: x[n] for n in va._FIELDS} for x in mine] == w.issues


def test_records_are_read_once(spark, records, monkeypatch):
    plans = []

    def spy(df, name="table", **more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
        return written(df, name, **more)

    written = va.written
    monkeypatch.setattr(va, "written", spy)
    _, found = va.all_issues(records, [ct.parse(c) for c in CONTRACTS])
    assert plans[0].count("FileScan text") == 1 and "Exchange hash" not in plans[0]  # what splits and numbers records is a broadcast of a few numbers
    assert all("FileScan text" not in p for p in plans[1:]) and "FileScan text" not in found._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_check(spark):
    rows = from_frame(spark.range(3), F.col("id"), ["id"])
    results, found = va.all_issues(rows, [ct.parse("version: 1\nschema: {columns: {id: {presence: required}}}")])
    assert results[0].valid and results[0].row_count == 3 and found.count() == 0
    results, found = va.all_issues(from_frame(spark.range(0), F.col("id"), ["id"]), [ct.parse(CONTRACTS[0])])
    assert results[0].row_count == 0 and not results[0].valid and {r.code for r in found.collect()} >= {"REQUIRED_COLUMN_MISSING", "TEST_COLUMN_MISSING", "ROW_COUNT_EXACT"}


def test_registered_checks(spark, tmp_path):
    va.register_check("starts-with", lambda cell, start: ~cell.startswith(str(start)), "WRONG_START", lambda column, start: f'"{column}" must start with {start}.')
    contract = ct.parse("version: 1\ncsv: {trimValues: true, caseSensitive: false}\nsqlServer: {schema: s, table: t}\nschema: {columns: {a: {presence: required, constraints: {checks: {starts-with: x}}}}}")
    (tmp_path / "x.csv").write_text("a\nX1\n y2\n\" \"\nx3\ny4\n")
    (result,) = va.validate(from_csv(spark, str(tmp_path / "x.csv")), [contract])
    assert [(i["code"], i["row"], i["message"], i["actual"], i["expected"]) for i in result.issues] == [("WRONG_START", 3, '"a" must start with x.', "y2", "x"), ("WRONG_START", 6, '"a" must start with x.', "y4", "x")]
    rows = spark.createDataFrame([("X1",), (" y2",), (None,), ("y4",)], "a string")
    assert [tuple(r) for r in ru.rule_summary(rows, contract).collect()] == [("a.check-starts-with", '"a" must start with x.', "error", 2)]
    assert "starts-with" in tsql.script(contract | {"conditionalRules": [{"id": "r", "expect": {"column": "a", "operator": "notNull"}}]})["warnings"][0]
    rows.withColumn("id", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a string, id long").parquet(str(tmp_path / "in"))
    write_issues(stream, contract, "id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    unknown = ct.parse("version: 1\nschema: {columns: {a: {presence: required, constraints: {checks: {no-such: 1}}}}}")
    (result,) = va.validate(from_csv(spark, str(tmp_path / "x.csv")), [unknown])
    assert [i["code"] for i in result.issues] == ["UNKNOWN_CHECK"]
    with pytest.raises(ValueError, match="no-such"):
        ru.rules_of(unknown)
    with pytest.raises(ValueError, match="checks"):
        ct.parse("version: 1\nschema: {columns: {a: {presence: required, constraints: {checks: [x]}}}}")


def test_rules_name_declared_columns(spark):
    for target in ("rowLocator: [gone]", "scope: {column: gone, parameter: P, sqlType: int}"):
        with pytest.raises(ValueError, match="undeclared"):
            ru.rules_of(ct.parse(f"version: 1\nsqlServer: {{schema: s, table: t, {target}}}\nschema: {{columns: {{a: {{presence: required, constraints: {{notNull: true}}}}}}}}"))


def test_long_texts_are_cut_in_units(spark):
    cases = ["x" * 160, "x" * 161, "\U0001f600" * 80, "\U0001f600" * 81, "x" + "\U0001f600" * 80, "é" * 156 + "\U0001f600" * 5, "é" * 157 + "\U0001f600" * 5]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(cases)), "k int, x string").orderBy("k").select(tx.display(F.col("x"))).collect()]
    assert got == [tx.display_text(x) for x in cases]
    assert got[0] == cases[0] and got[1] == "x" * 157 + "..." and got[2] == cases[2] and got[3] == "\U0001f600" * 78 + "�..." and got[4] == "x" + "\U0001f600" * 78 + "..."
