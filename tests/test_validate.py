import pytest
from pyspark.sql import functions as F

from veritab.operators.validate import validate
from veritab.sources import contracts as ct
from veritab.sources.records import RecordError, from_csv, from_frame, parse_records

FULL = ct.parse("""
version: 1
identity: {columns: [Company, EmployeeId]}
schema:
  allowAdditionalColumns: false
  rowCount: {min: 1, max: 10}
  columnCount: {min: 4, max: 5}
  columns:
    Company: {presence: required, constraints: {notNull: true, matches: '^\\d{2}$'}}
    EmployeeId: {presence: required, constraints: {notNull: true, unique: true, minLength: 6, maxLength: 6, matches: '^\\d{6}$'}}
    Name: {presence: required, constraints: {notNull: true, maxLength: 20}}
    Status: {presence: required, constraints: {notNull: true, allowedValues: [Active, Inactive]}}
    OptionalComment: {presence: optional, constraints: {maxLength: 20}}
rowTests:
  - {id: expected-ada, select: {Company: '01', EmployeeId: '000123'}, expect: {count: {exact: 1}, cells: {Status: {equals: Active}}}}
  - {id: forbidden, select: {Company: '99', EmployeeId: '999999'}, expect: {count: {exact: 0}}}
""")
HEAD = "Company,EmployeeId,Name,Status,OptionalComment\n"
ADA = '01,000123,"Ada, Jr.",Active,"Line 1\nLine 2"\n'
CASES = {
    "pass": (HEAD + ADA + "02,000456,Grace,Inactive,\n", []),
    "optional": ("Company,EmployeeId,Name,Status\n01,000123,Ada,Active\n02,000456,Grace,Inactive\n", []),
    "blank lines": (HEAD + ADA + "\n" + "02,000456,Grace,Inactive,\n", []),
    "null": (HEAD + ADA + "02,000456,,Inactive,\n", [("NULL_VALUE", "Name", 3)]),
    "duplicate": (HEAD + ADA + ADA, [("NOT_UNIQUE", "EmployeeId", 3), ("IDENTITY_NOT_UNIQUE", None, 3), ("MATCH_COUNT_EXACT", None, None)]),
    "length": (HEAD + ADA + f"02,000456,{'x' * 25},Active,{'y' * 29}\n", [("MAX_LENGTH", "Name", 3), ("MAX_LENGTH", "OptionalComment", 3)]),
    "pattern": (HEAD + ADA + "AA,ABCDEF,Grace,Active,\n", [("REGEX_MISMATCH", "Company", 3), ("REGEX_MISMATCH", "EmployeeId", 3)]),
    "allowed": (HEAD + ADA + "02,000456,Grace,Pending,\n", [("NOT_ALLOWED", "Status", 3)]),
    "missing": ("Company,EmployeeId,Status,OptionalComment\n01,000123,Active,\n", [("REQUIRED_COLUMN_MISSING", "Name", None)]),
    "additional": (HEAD[:-1] + ",Unexpected\n" + "01,000123,Ada,Active,,x\n", [("COLUMN_COUNT_MAX", None, None), ("ADDITIONAL_COLUMN", "Unexpected", None)]),
    "ragged": (HEAD + ADA + "02,000456\n", [("RAGGED_ROW", None, 3), ("NULL_VALUE", "Name", 3), ("NULL_VALUE", "Status", 3)]),
    "absent": (HEAD + "02,000456,Grace,Active,\n", [("MATCH_COUNT_EXACT", None, None)]),
    "cell": (HEAD + "01,000123,Ada,Inactive,\n", [("CELL_NOT_EQUAL", "Status", 2)]),
    "forbidden": (HEAD + ADA + "99,999999,Mallory,Active,\n", [("MATCH_COUNT_EXACT", None, None)]),
    "empty": ("\n", [("COLUMN_COUNT_MIN", None, None)] + [("REQUIRED_COLUMN_MISSING", c, None) for c in ("Company", "EmployeeId", "Name", "Status")] + [("IDENTITY_COLUMN_MISSING", c, None) for c in ("Company", "EmployeeId")]
              + [("TEST_COLUMN_MISSING", c, None) for c in ("Company", "EmployeeId", "Status", "Company", "EmployeeId")] + [("CSV_EMPTY", None, None), ("ROW_COUNT_MIN", None, None)]),
}


def run(spark, tmp_path, text, *contracts, **options):
    path = tmp_path / "in.csv"
    path.write_bytes(text.encode())
    return validate(from_csv(spark, str(path)), list(contracts), **options)


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, tmp_path, name):
    text, wanted = CASES[name]
    (result,) = run(spark, tmp_path, text, FULL)
    assert [(i["code"], i["column"], i["row"]) for i in result.issues] == wanted
    assert result.valid == (not wanted) and result.issue_count == len(wanted) and not result.truncated


def test_structure_issues(spark, tmp_path):
    base = "version: 1\nschema: {columns: {Id: {presence: required, constraints: {matches: '[unterminated'}}, Note: {presence: optional}}}\n"
    tests = "rowTests:\n  - {id: a, select: {Id: '1'}, expect: {count: {exact: 1}}}\n  - {id: a, select: {Note: x, Nope: y}, expect: {count: {exact: 1}}}\n"
    (result,) = run(spark, tmp_path, "Id,Id\n1,2\n", ct.parse(base + tests))
    assert [i["code"] for i in result.issues] == ["DUPLICATE_HEADER", "INVALID_REGEX", "DUPLICATE_TEST_ID", "TEST_COLUMN_MISSING", "UNDECLARED_TEST_COLUMN"]
    assert result.issues[0]["message"] == 'Header "Id" appears more than once.'


def test_case_insensitive_and_yaml(spark, tmp_path):
    contract = ct.parse("""
version: 1
csv: {trimValues: true, caseSensitive: false, nullValues: ['', 'NULL']}
schema: {columns: {Code: {presence: required, constraints: {unique: true, allowedValues: [alpha, beta]}}, Value: {presence: required}}}
rowTests: [{id: alpha, select: {Code: alpha}, expect: {cells: {Value: {equals: yes}}}}]
""")
    assert contract["rowTests"][0]["expect"]["cells"]["Value"]["equals"] == "yes"
    (result,) = run(spark, tmp_path, "Code,Value\n ALPHA ,YES\nbeta,no\nnull,x\n", contract)
    assert result.valid and result.row_count == 3


def test_bounded_issues_and_shared_scan(spark, tmp_path):
    contract = ct.parse("version: 1\nschema: {columns: {Id: {presence: required, constraints: {notNull: true, unique: true}}, Name: {presence: required, constraints: {notNull: true}}}}")
    loose = ct.parse("version: 1\nschema: {columns: {Id: {presence: required}}}")
    strict, free = run(spark, tmp_path, "Id,Name\n1,\n1,\n1,\n", contract, loose, max_issues=4)
    assert (strict.issue_count, strict.truncated, len(strict.issues)) == (5, True, 4)
    assert [i["row"] for i in strict.issues] == [2, 3, 4, 3] and strict.issues[-1]["message"] == '"Id" duplicates CSV record 2.'
    assert free.valid


def test_records():
    parse = lambda t, **o: [r for _, r in parse_records(t, **o)]
    assert parse('﻿a,b\r\n"x\r\n""y""",z\r1,\n') == [["a", "b"], ['x\r\n"y"', "z"], ["1", ""]]
    assert parse('"a"b,c') == [["ab", "c"]]
    assert list(parse_records("a\n\n1\n")) == [(1, ["a"]), (3, ["1"])]
    assert parse("a\n\n1\n", allow_blank=True) == [["a"], [""], ["1"]]
    assert parse("") == []
    with pytest.raises(RecordError):
        parse('a\n"open')


def test_contract_structure():
    for bad in ("version: 2\nschema: {columns: {a: {presence: required}}}", "version: 1\nschema: {columns: {a: {presence: maybe}}}", "version: 1\nschema: {columns: {a: {presence: required}}}\nextra: 1"):
        with pytest.raises(ct.ContractError):
            ct.parse(bad)
    assert ct.parse(ct.dump(FULL)) == FULL


def test_frames_prune_columns(spark):
    frame = spark.range(10).select("id", F.lit(None).cast("string").alias("a"), F.lit("x").alias("unused"))
    (result,) = validate(from_frame(frame, F.col("id"), ["a"]), [ct.parse("version: 1\nschema: {columns: {a: {presence: required, constraints: {notNull: true}}}}")])
    assert result.issue_count == 10
