import json

import pytest
from pyspark.sql import functions as F

from veritab.operators.compare import ComparisonError, Options, compare
from veritab.sources.evidence import write_evidence
from veritab.sources.records import from_csv, from_frame


def side(spark, header, rows):
    names = header.split(",")
    schema = "rec long" + "".join(f", c{i} string" for i in range(len(names)))
    frame = spark.createDataFrame([(k + 1, *r) for k, r in enumerate(rows)], schema)
    out = from_frame(frame, F.col("rec"), [f"c{i}" for i in range(len(names))])
    out.header = names
    return out


def made(spark, header, left, right, **options):
    return compare(side(spark, header, left), side(spark, header, right), Options(**options))


def test_bags(spark):
    a, g = ("0001", "Ada"), ("0002", "Grace")
    s = made(spark, "Id,Name", [a, g], [g, a]).summary()
    assert (s["status"], s["exit_code"], s["differences"]["unchanged"]) == ("equal", 0, 2)
    c = made(spark, "Id,Name", [a, a], [a])
    s = c.summary()
    assert s["exit_code"] == 1 and s["differences"]["removed"] == 1 and s["differences"]["duplicate_row_count_differences"] == 1
    assert s["diagnostics"] == [("row-000001", "row-count-changed", 1)] and s["left"]["duplicate_row_groups"] == 1
    assert [tuple(r) for r in c.only(0).collect()] == [a] and c.only(1).count() == 0


def test_keys(spark):
    left, right = [("0001", "Ada", "8"), ("0002", "Grace", "7")], [("0001", "Ada", "9"), ("0002", "Grace", "7"), ("0003", "Linus", "6")]
    c = made(spark, "Id,Name,Hours", left, right, keys=["Id"], context=["Name"])
    s = c.summary()
    assert (s["differences"]["added"], s["differences"]["changed"], s["differences"]["changed_cells"], s["differences"]["unchanged"]) == (1, 1, 1, 1)
    assert s["differences"]["changed_cells_by_column"] == {"Name": 0, "Hours": 1}
    assert s["diagnostics"] == [("key-000001-changed", "key-changed", 1), ("key-000003-added", "key-added", 1)]
    assert [tuple(r) for r in c.changed_cells().collect()] == [("key-000001", "0001", "Ada", "Hours", "8", "9")]
    assert [tuple(r) for r in c.keys_only(1).collect()] == [("key-000003", "0003", "Linus", 1)]


def test_duplicate_keys_are_never_paired(spark):
    c = made(spark, "Id,Name", [("0001", "Ada"), ("0001", "Grace")], [("0001", "Ada")], keys=["Id"])
    s = c.summary()
    assert (s["exit_code"], s["differences"]["duplicate_keys_left"], s["differences"]["changed"], s["differences"]["unchanged"]) == (4, 1, 0, 0)
    assert s["diagnostics"] == [("key-000001-duplicate-left", "duplicate-key-left", 2)]
    assert [tuple(r) for r in c.duplicate_rows(0).orderBy("key_occurrence").collect()] == [("key-000001", "0001", "Ada", 1, 2), ("key-000001", "0001", "Grace", 2, 2)]


def test_schema_and_normalisation(spark):
    c = compare(side(spark, "Id,Name", [("1", "a")]), side(spark, "Id,FullName", [("1", "a")]))
    s = c.summary()
    assert (s["exit_code"], s["differences"]["schema_changes"], [d[0] for d in s["diagnostics"]]) == (3, 2, ["schema-left-1", "schema-right-1"])
    options = dict(trim=True, case_fold=True, blank_null=True, dates=["WorkDate"], decimals=["Amount"])
    left, right = [("0001", " ada ", "   ", "07/17/2026", "1.00")], [("0001", "ADA", "", "2026-07-17", "1")]
    assert made(spark, "Id,Name,Value,WorkDate,Amount", left, right, **options).summary()["exit_code"] == 0
    with pytest.raises(ComparisonError) as error:
        made(spark, "Id,Amount", [("1", "5"), ("2", "secret")], [("1", "5")], decimals=["Amount"])
    assert error.value.code == "DECIMAL_NORMALIZATION" and "secret" not in str(error.value) and error.value.record == 2


def test_options_and_empty(spark):
    for options, code in ((dict(keys=["Id", "Id"]), "DUPLICATE_OPTION_COLUMN"), (dict(keys=["X"]), "CONFIGURED_COLUMN_MISSING"), (dict(dates=["Id"], decimals=["Id"]), "CONFLICTING_NORMALIZATION"), (dict(keys=["Id"], ignored=["Id"]), "INVALID_KEY_COLUMN"), (dict(context=["Id"]), "CONTEXT_REQUIRES_KEYS")):
        with pytest.raises(ComparisonError) as error:
            made(spark, "Id,Name", [], [], **options)
        assert error.value.code == code
    assert made(spark, "Id,Name", [], []).summary()["exit_code"] == 0


def test_evidence(spark, tmp_path):
    names = write_evidence(made(spark, "Id,Name", [("1", 'a"b')], [("1", "c")], keys=["Id"]), str(tmp_path / "out"))
    assert {"ComparisonSummary.json", "ChangedRows.csv", "NormalizedLeft.csv", "ColumnSummary.csv"} <= set(names)
    assert (tmp_path / "out" / "ChangedRows.csv").read_text() == '"Id","ChangedColumn","LeftValue","RightValue"\n"1","Name","a""b","c"\n'
    evidence = (tmp_path / "out" / "ComparisonEvidence.csv").read_text()
    assert evidence.startswith('"recordType","name","countOrValue","column","keyReference","diagnosticId"\n"summary","status","different","false","1",""\n')
    assert '"diagnostic","key-changed","1","","key-000001","key-000001-changed"' in evidence
    page = (tmp_path / "out" / "ComparisonSummary.md").read_text()
    assert "| 0 | 0 | 1 | 0 | 1 | 0/0 |" in page and "Included 1 of 1." in page


def test_evidence_in_full(spark, tmp_path):
    """Complete files in canonical order, whatever the order of records and the number of tasks."""
    left = [("2", "b", "x"), ("10", "a", "y"), ("3", "c", "z"), ("10", "q", "y"), ("\U0001f600", "e", "1"), ("\uff5e", "e", "1"), ("4", "two\nlines", "k")]
    right = [("5", "n", "w"), ("2", "B", "X"), ("4", "two\nlines", None), ("5", "m", "w")]
    c = made(spark, "Id,Name,Note", left, right, keys=["Id"], context=["Note"])
    names = write_evidence(c, str(tmp_path / "out"))
    read = {p.name: p.read_text() for p in (tmp_path / "out").glob("*.*")}
    assert sorted(names) == sorted(n for n in read if not n.startswith(".") and n != "Manifest.json")
    assert [f["name"] for f in json.loads(read["Manifest.json"])["files"]] == names
    assert read["KeysOnlyInLeft.csv"] == '"Id","Note","OccurrenceCount"\n"3","z","1"\n"\uff5e","1","1"\n"10","y","2"\n"\U0001f600","1","1"\n'
    assert read["KeysOnlyInRight.csv"] == '"Id","Note","OccurrenceCount"\n"5","w","2"\n'
    assert read["ChangedRows.csv"] == '"Id","Note","ChangedColumn","LeftValue","RightValue"\n"2","X","Name","b","B"\n"2","X","Note","x","X"\n"4","","Note","k",""\n'
    assert read["DuplicateKeysLeft.csv"] == '"Id","Name","Note","KeyOccurrence","KeyCount"\n"10","a","y","1","2"\n"10","q","y","2","2"\n'
    assert read["ColumnChangeSummary.csv"] == '"ColumnName","ChangedCellCount"\n"Name","1"\n"Note","2"\n'
    assert read["NormalizedRight.csv"] == '"Id","Name","Note"\n"2","B","X"\n"4","two\nlines",""\n"5","m","w"\n"5","n","w"\n'
    made_of = json.loads(read["ComparisonSummary.json"])
    assert list(made_of) == ["schema", "name", "mode", "options", "columns", "status", "semanticEqual", "exitCode", "left", "right", "differences", "diagnostics"]
    assert made_of["diagnostics"]["items"][0] == {"id": "key-000001-changed", "kind": "key-changed", "count": 1, "keyReference": "key-000001"} and made_of["diagnostics"]["truncated"] is False
    assert made_of["differences"]["changedCellsByColumn"] == {"Name": 1, "Note": 2} and made_of["left"]["duplicateKeyCount"] == 1 and made_of["options"]["normalization"]["caseFold"] is False
    bag = made(spark, "A,B", [("b", "1"), ("a", "2"), ("b", "1"), ("b", "1")], [("b", "1")])
    write_evidence(bag, str(tmp_path / "bag"))
    assert (tmp_path / "bag" / "LeftOnly.csv").read_text() == '"A","B"\n"a","2"\n"b","1"\n"b","1"\n' and (tmp_path / "bag" / "RightOnly.csv").read_text() == '"A","B"\n'
    assert json.loads((tmp_path / "bag" / "ComparisonSummary.json").read_text())["left"]["uniqueKeyCount"] is None
    other = compare(side(spark, "Id,Name", [("1", "a")]), side(spark, "Id,FullName", [("1", "a")]), Options(keys=["Id"]))
    found = write_evidence(other, str(tmp_path / "other"))
    assert {"ChangedRows.csv", "DuplicateKeysLeft.csv", "ColumnChangeSummary.csv"} <= set(found) and (tmp_path / "other" / "ChangedRows.csv").read_text() == '"Id","ChangedColumn","LeftValue","RightValue"\n'
    assert json.loads((tmp_path / "other" / "ComparisonSummary.json").read_text())["diagnostics"]["items"][0] == {"id": "schema-left-1", "kind": "schema-left-only", "count": 1, "column": "Name"}


def test_evidence_appears_at_once(spark, tmp_path, monkeypatch):
    from veritab.sources import evidence

    out = tmp_path / "out"
    write_evidence(made(spark, "A", [("1",)], [("1",)]), str(out))
    before = {p.name: p.read_bytes() for p in out.iterdir()}
    lines = evidence.Staged.lines

    def fails(self, name, head, rows):
        if name == "NormalizedLeft.csv":
            raise OSError("no room")
        lines(self, name, head, rows)

    monkeypatch.setattr(evidence.Staged, "lines", fails)
    with pytest.raises(OSError, match="no room"):
        write_evidence(made(spark, "A", [("2",)], [("1",)]), str(out))
    monkeypatch.undo()
    assert {p.name: p.read_bytes() for p in out.iterdir()} == before and [p.name for p in tmp_path.iterdir()] == ["out"]
    out.rename(tmp_path / ".out.old")  # as if the process had ended between the two renamings
    staged = evidence.Staged(spark, str(out))
    assert {p.name: p.read_bytes() for p in out.iterdir()} == before
    staged.clean()
    write_evidence(made(spark, "A", [("2",)], [("1",)]), str(out))
    assert (out / "LeftOnly.csv").read_text() == '"A"\n"2"\n' and [p.name for p in tmp_path.iterdir()] == ["out"]


def exchanges(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") + df._jdf.queryExecution().optimizedPlan().toString().count("Repartition")


def test_details_without_references_rank_nothing(spark):
    c = made(spark, "Id,Name", [("1", "a"), ("2", "b")], [("1", "c"), ("2", "b")], keys=["Id"])
    assert exchanges(c.changed_cells(references=False)) == 1 and "rank" not in c.changed_cells(references=False).columns
    c.keep()
    for table in (c.changed_cells(references=False), c.difference_sums(), c.bag):
        assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert c.groups.count() == 2 and exchanges(c.groups) == 0  # read, not shuffled again


def test_csv_records(spark, tmp_path):
    """Ragged records stop a comparison, records of blanks are no rows."""

    def sides(left, right):
        for name, text in (("l", left), ("r", right)):
            (tmp_path / f"{name}.csv").write_text(text)
        return (from_csv(spark, str(tmp_path / f"{name}.csv")) for name in "lr")

    for left, right, side_name, said in (("A,B\n1,2,9\n", "A,B\n1,2\n", "Left", "CSV row 2 has 3 cells; expected 2."), ("A,B\n3,\n", "A,B\n\n3,\n3\n", "Right", "CSV row 3 has 1 cells; expected 2.")):
        with pytest.raises(ComparisonError) as error:
            compare(*sides(left, right))
        assert error.value.code == "CSV_PARSE" and str(error.value) == f"{side_name} CSV could not be parsed: {said}"
    s = compare(*sides("A,B\n1,2\n , \n,\n", "A,B\n1,2\n")).summary()
    assert (s["status"], s["left"]["row_count"], s["right"]["row_count"]) == ("equal", 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_a_frequent_key_are_numbered_over_all_tasks(spark):
    rows = [("hot" if k % 3 else f"k{k % 5}", str(k)) for k in range(300)] + [(None, "x"), (None, "y")]
    c = made(spark, "Id,Name", rows, [("hot", "1")], keys=["Id"])
    found = c.duplicate_rows(0)
    assert "Window" not in plan_of(found)
    seen = {}
    for r in sorted(found.collect(), key=lambda r: r["key_occurrence"]):
        seen.setdefault(r["Id"], []).append((r["key_occurrence"], r["Name"], r["key_count"]))
    want = {}
    for name, value in rows:
        want.setdefault("" if name is None else name, []).append(value)
    assert seen == {k: [(n + 1, x, len(v)) for n, x in enumerate(v)] for k, v in want.items() if len(v) > 1}


def test_rows_repeat_any_number_of_times(spark):
    from veritab.operators.number import repeated, running

    rows = spark.createDataFrame([("a", 1), ("b", 4), ("c", 5), ("d", 16), ("e", 17), ("f", 64), ("g", 63)], "x string, n long")
    got = {r["x"]: r["count"] for r in repeated(rows, F.col("n"), 4).groupBy("x").count().collect()}
    assert got == {r["x"]: r["n"] for r in rows.collect()}
    many = repeated(spark.createDataFrame([("a", 3_000_000_000)], "x string, n long"), F.col("n"))
    assert many.limit(5).count() == 5 and "cast(" not in plan_of(many).replace("as bigint", "").replace("cast(0", "")
    more = repeated(spark.createDataFrame([("a", 70_000), ("b", 2)], "x string, n long"), F.col("n"))
    assert more.groupBy("x").count().orderBy("x").collect() == [("a", 70_000), ("b", 2)]
    sums = running(spark.range(1000).selectExpr("id", "id % 7 as v"), "before", F.col("v"), F.col("id").desc())
    want, total = {}, 0
    for k in reversed(range(1000)):
        want[k], total = total, total + k % 7
    assert {r["id"]: r["before"] for r in sums.collect()} == want


def test_blank_is_not_empty_unless_trimmed(spark):
    left, right = [("1", "  "), ("2", "")], [("1", ""), ("2", "")]
    assert made(spark, "Id,V", left, right, keys=["Id"], blank_null=True).summary()["differences"]["changed_cells"] == 1
    assert made(spark, "Id,V", left, right, keys=["Id"], blank_null=True, trim=True).summary()["status"] == "equal"
    with pytest.raises(ComparisonError):
        made(spark, "Id,V", left, right, blank_null=True, dates=["V"])
