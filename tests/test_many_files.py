"""Several files in one scan give the results of each by itself."""

import json
import random

import pytest

from veritab import cli
from veritab.operators.validate import validate, validate_files
from veritab.plans import suite
from veritab.sources import contracts as ct
from veritab.sources.records import from_csv, native_csv, open_files, parse_records

CONTRACT = """
version: 1
identity: {columns: [a, b]}
schema: {rowCount: {min: 2}, columns: {a: {presence: required, constraints: {notNull: true, unique: true}}, b: {presence: required, constraints: {maxLength: 3}}}}
rowTests: [{id: t, select: {a: x}, expect: {count: {exact: 1}, cells: {b: {equals: "1"}}}}]
"""


@pytest.fixture(params=["60", "128m"])
def splits(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def write(folder, seed, n, quoted=True):
    """Files that share a header, plain and quoted, with blank lines before it, and some that don't, are empty or blank."""
    dice, texts = random.Random(seed), {}
    cells = ["", "a", "x", "1", "long cell"] + (['"q ""u"""', '"two\nlines"', '"' + "long\r\n" * 20 + '"'] if quoted else [])
    for k in range(n):
        head = dice.choice(["a,b\n", "\n\na,b\n", "﻿a,b\r\n", '"a",b\n' if quoted else "a,b\n", "b,a,c\n"])
        texts[f"f {k}.csv"] = head + "".join(f"{dice.choice(cells)},{dice.choice(cells)}" + dice.choice(["\n", "\r\n", "\n\n"]) for _ in range(dice.randint(0, 9)))
    texts |= {"empty.csv": "", "blank.csv": "\n \n"}
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    return texts


def test_records_are_those_of_each_file(spark, tmp_path, splits):
    texts = write(tmp_path, 1, 14)
    texts["open.csv"] = 'a,b\n1,"' + "open\n" * 50
    (tmp_path / "open.csv").write_text(texts["open.csv"])
    groups, errors = open_files(spark, [str(tmp_path / name) for name in texts] + [str(tmp_path / "none.csv")])
    assert {e.split("/")[-1]: str(x) for e, x in errors.items()} == {"open.csv": "Unterminated quoted field at end of CSV.", "none.csv": f"{tmp_path}/none.csv does not exist."}
    got = {}
    for records in groups:
        for path in records.files:
            got[path.split("/")[-1]] = (records.header, [])
        for r in records.frame.collect():
            got[records.files[r["file"]].split("/")[-1]][1].append((r["rec"], r["n_fields"], list(r["fields"])))
    for name in texts.keys() - {"open.csv"}:
        want = list(parse_records(texts[name]))
        assert got[name][0] == (want[0][1] if want else []) and sorted(got[name][1]) == [(n, len(r), r) for n, r in want[1:]], name


def test_results_are_those_of_each_file(spark, tmp_path):
    texts = write(tmp_path, 2, 12)
    contracts = [ct.parse(CONTRACT), ct.parse("version: 1\nschema: {columns: {c: {presence: required}, a: {presence: optional, constraints: {unique: true}}}}")]
    for most in (3, 1000):
        groups, _ = open_files(spark, [str(tmp_path / name) for name in texts])
        seen = 0
        for records in groups:
            for path, results in zip(records.files, validate_files(records, contracts, most), strict=True):
                assert results == validate(from_csv(spark, path), contracts, most), (path, most)
                seen += 1
        assert seen == len(texts)


def test_a_folder_is_one_scan(spark, tmp_path, capsys):
    """Hundreds of small files take as many jobs as a few do."""
    jobs = []
    for n in (3, 300):
        folder = tmp_path / str(n)
        folder.mkdir()
        for k in range(n):
            (folder / f"{k:03d}.csv").write_text("a,b\nx,1\ny,2\n" if k else "a,b\nx,1\nx,2\n")
        (tmp_path / "c.csvtest.yaml").write_text(CONTRACT)
        spark.sparkContext.setJobGroup(str(n), "")
        assert cli.main(["test", "--spec", str(tmp_path / "c.csvtest.yaml"), "--csv", str(folder), "--format", "json"], spark) == 1
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(n))))
        made = json.loads(capsys.readouterr().out)
        assert [f["valid"] for f in made["files"]] == [False] + [True] * (n - 1) and len({f["csv"] for f in made["files"]}) == n
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs[1] <= jobs[0] + 2


def test_every_given_target_is_tested(spark, tmp_path, capsys):
    (tmp_path / "c.csvtest.yaml").write_text(CONTRACT)
    (tmp_path / "good.csv").write_text("a,b\nx,1\ny,2\n")
    (tmp_path / "bad.csv").write_text("a,b\nx,1\n,2\n")
    spec, good, bad = (str(tmp_path / n) for n in ("c.csvtest.yaml", "good.csv", "bad.csv"))
    for given, code in (([bad, good], 1), ([good, bad], 1), ([good, good], 0), ([good, str(tmp_path / "none.csv")], 2)):
        assert cli.main(["test", "--spec", spec, *(x for c in given for x in ("--csv", c))], spark) == code
        out = capsys.readouterr().out
        assert all(c in out for c in given) and out.count("Performance") == len({*given} - {str(tmp_path / "none.csv")})
    for bad_bound in ("0", "-1", "x"):
        with pytest.raises(SystemExit):
            cli.main(["test", "--spec", spec, "--max-issues", bad_bound], spark)
    assert cli.main(["test", "--csv", good], spark) == 2
    capsys.readouterr()


def test_plans():
    one, two = ("one.csvtest.yaml", {"targets": [{"path": "../exports/a.csv"}, {"path": "../exports/b.csv"}]}), ("two.csvtest.yaml", {"targets": [{"path": "../exports/a.csv"}]})
    planned = suite.plans([(f"/w/c/{one[0]}", one[1]), (f"/w/c/{two[0]}", two[1])])
    assert {t: [s for s, _ in own] for t, own in planned.items()} == {"/w/exports/a.csv": ["/w/c/one.csvtest.yaml", "/w/c/two.csvtest.yaml"], "/w/exports/b.csv": ["/w/c/one.csvtest.yaml"]}
    planned = suite.plans([one, two], ["/x/../explicit.csv", "HTTPS://Example.com/Export.csv", "/explicit.csv", "hdfs://n/x.csv"])
    assert {t: len(own) for t, own in planned.items()} == {"/explicit.csv": 2, "https://example.com/Export.csv": 2, "hdfs://n/x.csv": 2}
    for target in ({"path": " "}, {"url": "ftp://x"}):
        with pytest.raises(ValueError, match="target"):
            suite.plans([("s", {"targets": [target]})])


def test_native_rows_are_numbered_without_gaps(spark, tmp_path):
    spark.range(400).selectExpr("id", "'x' as b").repartition(4).write.option("header", True).csv(str(tmp_path / "n"))
    for multiline in (True, False):
        rows = native_csv(spark, str(tmp_path / "n"), multiline=multiline)
        assert sorted(r["rec"] for r in rows.frame.collect()) == list(range(2, 402)) and rows.header == ["id", "b"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("a,b\n")
    assert native_csv(spark, str(tmp_path / "none")).frame.count() == 0


def test_other_splits_are_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n" + "1,2\n" * 500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        records = from_csv(spark, str(tmp_path / "x.csv"))
        assert records.frame.count() == 500
        frame = records.frame.select("rec")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        again = frame.where("rec > 0").select("rec")
        with pytest.raises(Exception, match="splits changed"):
            again.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_head_is_bounded(spark, tmp_path):
    from veritab.sources.records import RecordError, head_csv

    (tmp_path / "x.csv").write_text('a,b\n1,"' + "open\n" * 4000)
    with pytest.raises(RecordError, match="bytes"):
        head_csv(spark, str(tmp_path / "x.csv"), 5, most_bytes=5000)


def test_progress_goes_to_standard_error(spark, tmp_path, capsys):
    (tmp_path / "c.csvtest.yaml").write_text("version: 1\nschema: {columns: {a: {presence: required, constraints: {unique: true}}}}")
    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f"{k},1\n" for k in range(20_000)))
    args = ["test", "--spec", str(tmp_path / "c.csvtest.yaml"), "--csv", str(tmp_path / "x.csv"), "--format", "json", "--progress-interval"]
    assert cli.main([*args, "0"], spark) == 0
    assert "Progress" not in capsys.readouterr().err
    assert cli.main([*args, "1"], spark) == 0
    got = capsys.readouterr()
    assert json.loads(got.out)["valid"] and f"Progress {tmp_path / 'x.csv'}: " in got.err and " rows, " in got.err
    with pytest.raises(SystemExit):
        cli.main([*args, "-1"], spark)


def test_contracts_from_files(spark, tmp_path, capsys):
    """init infers only when asked; a schema source needs no contract."""
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,\n2,long\n")
    out = tmp_path / "x.csvtest.yaml"
    assert cli.main(["init", "--csv", str(tmp_path / "x.csv"), "--out", str(out)], spark) == 0
    assert capsys.readouterr().out == f"Created {out} (2 columns, 1 sampled rows).\n"
    text = out.read_text()
    assert text.startswith("# Generated from x.csv.\n# Review column presence") and "# No data constraints were inferred;" in text and "constraints" not in text.split("\n", 3)[3]
    assert ct.parse(text)["csv"]["encoding"] == "utf-8" and len(ct.parse(text)["rowTests"]) == 2
    assert cli.main(["init", "--csv", str(tmp_path / "x.csv"), "--out", str(out), "--infer-constraints", "--sample-rows", "2", "--force"], spark) == 0
    made = ct.parse(out.read_text())["schema"]["columns"]
    assert made == {"a": {"presence": "required", "constraints": {"notNull": True, "unique": True, "maxLength": 1}}, "b": {"presence": "required", "constraints": {"notNull": False, "unique": False, "maxLength": 1}}}
    assert "inferred from the first 2 data rows" in out.read_text()
    for head, said in (("a,,b\n", "empty column name"), ("a,b,a\n", "duplicate column names: a.")):
        (tmp_path / "y.csv").write_text(head)
        assert cli.main(["init", "--csv", str(tmp_path / "y.csv"), "--out", str(tmp_path / "y.yaml")], spark) == 2
        assert said in capsys.readouterr().err
    tables_json = {"schema": "s", "name": "T", "columns": [{"ordinal": 1, "name": "Id", "typeName": "int", "maxLength": 4, "nullable": False}]}
    (tmp_path / "t.json").write_text(json.dumps(tables_json))
    assert cli.main(["schema", "--source", str(tmp_path / "t.json"), "--out", str(tmp_path / "t.yaml")], spark) == 0
    assert "Imported 1 columns from s.T into" in capsys.readouterr().out and ct.parse((tmp_path / "t.yaml").read_text())["schema"]["columns"]["Id"]["presence"] == "required"
    assert cli.main(["schema", "--source", str(tmp_path / "t.json"), "--out", str(tmp_path / "t.yaml"), "--table", "s.none"], spark) == 2
    assert "was not found. Available tables: s.T" in capsys.readouterr().err
