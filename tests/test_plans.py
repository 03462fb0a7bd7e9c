import json

import duckdb
import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from conftest import SMALL
from veritab import cli
from veritab.plans import catalogue, suite, tables, tsql
from veritab.sources import contracts as ct
from veritab.sources.records import benchmark_table, from_csv
from veritab.streaming.checks import write_issues

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_against_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SMALL)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tsql():
    made = tsql.script(catalogue.RULES)
    assert made["rule_count"] == 8 and made["warnings"] == [] and "DECLARE @Status nvarchar(1)" in made["sql"] and "DELETE" not in made["sql"]
    bad = json.loads(json.dumps(catalogue.RULES))
    for kind in ("int; drop table x", "varchar(0)", "nvarchar(99999)"):
        bad["sqlServer"]["scope"]["sqlType"] = kind
        with pytest.raises(ValueError):
            tsql.script(bad)
    odd = ct.parse("version: 1\nsqlServer: {schema: a, table: 'b]c'}\nschema: {columns: {\"o'k\": {presence: required, constraints: {allowedValues: [\"it's\"], matches: x}}}}")
    assert "[b]]c]" in tsql.script(odd)["sql"] and "N'it''s'" in tsql.script(odd)["sql"] and len(tsql.script(odd)["warnings"]) == 1


def test_tables():
    tracked = {"schema": "staging", "name": "Timecard", "columns": [
        {"ordinal": 2, "name": "Description", "typeSchema": "sys", "typeName": "nvarchar", "maxLength": 400, "precision": 0, "scale": 0, "nullable": True},
        {"ordinal": 1, "name": "TimecardId", "typeSchema": "sys", "typeName": "bigint", "maxLength": 8, "precision": 19, "scale": 0, "nullable": False, "identitySeed": "1"},
        {"ordinal": 3, "name": "Rate", "typeName": "decimal", "maxLength": 9, "precision": 19, "scale": 4, "nullable": False}, {"ordinal": 4, "name": "Note", "typeName": "varchar", "maxLength": -1, "nullable": False, "computedExpression": "x"},
    ], "indexes": [{"columns": []}, {"primaryKey": True, "columns": [{"name": "x", "included": True}, {"name": "Rate", "keyOrdinal": 2}, {"name": "TimecardId", "keyOrdinal": 1, "included": False}]}]}
    (table,) = tables.from_json(json.dumps(tracked))
    types = {c["name"]: (c["sqlType"], c["maxLength"], c["identity"], c["computed"]) for c in table["columns"]}
    assert types == {"Description": ("nvarchar(200)", 200, False, False), "TimecardId": ("bigint", 8, True, False), "Rate": ("decimal(19,4)", 9, False, False), "Note": ("varchar(max)", -1, False, True)}
    assert table["keys"] == ["TimecardId", "Rate"]
    merged, preview = tables.merge({"version": 1, "schema": {"columns": {}}}, table)
    assert merged["schema"]["columns"]["TimecardId"] == {"presence": "optional"} and merged["schema"]["columns"]["Rate"]["constraints"] == {"notNull": True} and "identity" not in merged
    assert list(merged["schema"]["columns"]) == ["TimecardId", "Description", "Rate", "Note"] and preview["filled"] == ["Description.maxLength", "Rate.notNull"] and preview["target_changed"]
    known = {"formatVersion": 1, "objects": [
        {"schema": "dbo", "name": "Header", "type": "table", "columns": [{"ordinal": 1, "name": "Id", "dataType": "int", "length": 4, "precision": 10, "scale": 0, "nullable": False}, {"ordinal": 2, "name": "Status", "dataType": "varchar", "length": 20, "nullable": True}], "primaryKeys": [{"columns": [{"name": "Id"}]}]},
        {"schema": "dbo", "name": "ViewOnly", "type": "view", "columns": []},
    ]}
    (table,) = tables.from_json(json.dumps(known))
    contract = ct.parse("version: 1\nsqlServer: {schema: old, table: Old, detailLimit: 25}\nschema: {columns: {Status: {presence: required, constraints: {notNull: true, maxLength: 12}}, Legacy: {presence: optional}}}")
    before = json.dumps(contract)
    merged, preview = tables.merge(contract, table)
    assert json.dumps(contract) == before and list(merged["schema"]["columns"]) == ["Id", "Status", "Legacy"] and merged["identity"] == {"columns": ["Id"], "unique": True}
    assert preview == {"added": ["Id"], "existing": ["Status"], "contract_only": ["Legacy"], "filled": ["Id.notNull"], "preserved_conflicts": ["Status.notNull", "Status.maxLength"], "target_changed": True, "identity_initialized": True}
    target = merged["sqlServer"]
    assert (target["schema"], target["table"], target["detailLimit"], target["importedSchema"]["sourceKind"], target["importedSchema"]["columns"][1]["sqlType"]) == ("dbo", "Header", 25, "database-knowledge", "varchar(20)")
    ct.parse(ct.dump(merged))
    for bad in ("not json", '{"objects": []}', '{"name": "t"}'):
        with pytest.raises(ValueError):
            tables.from_json(bad)
    plain = tables.from_struct(T.StructType([T.StructField("k", T.VarcharType(5), False)]), "t", keys=("k",))
    merged, _ = tables.merge(contract, plain)
    assert merged["schema"]["columns"]["k"] == {"presence": "required", "constraints": {"notNull": True, "maxLength": 5}} and merged["identity"]["columns"] == ["k"]


def test_suite_and_cli(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("Id,Name\n1,Ada\n2,Grace\n")
    (tmp_path / "b.csv").write_text("Id,Name\n1,Ada\n1,Ada\n")
    assert cli.main(["init", "--csv", str(tmp_path / "a.csv"), "--out", str(tmp_path / "a.csvtest.yaml"), "--infer-constraints"], spark) == 0
    assert cli.main(["init", "--csv", str(tmp_path / "a.csv"), "--out", str(tmp_path / "a.csvtest.yaml")], spark) == 2
    assert cli.main(["test", "--spec", str(tmp_path / "a.csvtest.yaml")], spark) == 0
    assert cli.main(["test", "--spec", str(tmp_path / "a.csvtest.yaml"), "--csv", str(tmp_path / "b.csv"), "--json"], spark) == 1
    assert cli.main(["compare", str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], spark) == 1
    (tmp_path / "bad.csvtest.yaml").write_text("version: 3")
    (tmp_path / "none.csvtest.yaml").write_text("version: 1\nschema: {columns: {a: {presence: optional}}}")
    runs = suite.run_suite(spark, str(tmp_path))
    assert suite.rollup(runs) == {"valid": False, "runs": 3, "passed": 1, "failed": 2, "targets": 1} and any("no targets" in (r.error or "") for r in runs)
    assert "<table>" in suite.as_html(runs) and "PASS" in suite.as_text(runs)
    capsys.readouterr()


def test_reports_are_grouped_by_target(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("Id;Name\n1;Ada\n2;\n")
    args = ["init", "--csv", str(tmp_path / "a.csv"), "--out", str(tmp_path / "a.csvtest.yaml"), "--delimiter", ";"]
    assert cli.main([*args, "--no-sample-tests"], spark) == 0
    made = ct.parse((tmp_path / "a.csvtest.yaml").read_text())
    assert made["targets"] == [{"path": "./a.csv"}] and made["csv"]["delimiter"] == ";" and not made.get("rowTests") and made["schema"]["columns"] == {"Id": {"presence": "required"}, "Name": {"presence": "required"}}
    strict = ct.parse("version: 1\ncsv: {delimiter: ';'}\nschema: {columns: {Name: {presence: required, constraints: {notNull: true}}, Id: {presence: required}}}")
    (tmp_path / "b.csv").write_text("Id;Name\n1;Ada\n")
    runs = suite.run_plans(spark, {str(tmp_path / "a.csv"): [("loose", made), ("strict", strict)]})
    one = suite.as_json(runs)
    assert (one["csv"], one["valid"], [r["result"]["valid"] for r in one["runs"]]) == (str(tmp_path / "a.csv"), False, [True, False])
    assert one["performance"]["bytesRead"] == 17 and one["performance"]["passes"] == 1
    lines = suite.as_text(runs).split("\n")
    assert lines[:4] == [f"FAIL {tmp_path / 'a.csv'}", "  PASS loose — 2 rows, 2 columns, 0 issues", "  FAIL strict — 2 rows, 2 columns, 1 issues", "    " + suite.issue_line(runs[1].result.issues[0])]
    assert lines[4].startswith("  Performance: ") and "17 B read, 1 pass(es)" in lines[4] and len(lines) == 5
    more = runs + suite.run_plans(spark, {str(tmp_path / "b.csv"): [("strict", strict)]})
    assert [f["valid"] for f in suite.as_json(more)["files"]] == [False, True] and suite.as_text(more).endswith("FAIL 2 CSV targets.")
    assert [suite.show_bytes(n) for n in (0, 1023, 1536, 5 << 40)] == ["0 B", "1023 B", "1.5 KB", "5.0 TB"]
    assert [suite.show_duration(n) for n in (12.4, 2500, 59_000, 61_000)] == ["12 ms", "2.5 sec", "59 sec", "1 min 1 sec"]
    capsys.readouterr()


def test_benchmark_rows(spark):
    rows = benchmark_table(spark, 21, 7)
    assert rows.columns[-1] == "Column007" and rows.first()[0] == "000000000001" and rows.where("OptionalComment <> ''").count() == 3


def test_stream(spark, tmp_path):
    spark.range(20).selectExpr("id", "if(id % 5 = 0, '', 'x') as a").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, a string").parquet(str(tmp_path / "in"))
    contract = ct.parse("version: 1\nschema: {columns: {a: {presence: required, constraints: {notNull: true}}}}")
    write_issues(stream, contract, "id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_csv_splits_into_records(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b\n1;2;3\n")
    got = from_csv(spark, str(tmp_path / "x.csv"), ";")
    assert got.header == ["a", "b"] and [tuple(r) for r in got.frame.collect()] == [(2, 3, ["1", "2", "3"])]
