"""A CSV file in many splits gives the records of one split."""

import random

import pytest

from veritab.sources.records import RecordError, from_csv, head_csv, parse_records


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def records_of(records):
    return records.header, sorted((r["rec"], list(r["fields"])) for r in records.frame.collect())


@pytest.mark.parametrize("seed", range(3))
def test_splits_give_the_records_of_the_whole_file(spark, tmp_path, small_splits, seed):
    dice = random.Random(seed)
    cells = ["", "a", "bb b", 'x"y', '"q, ""u"" r"', '"two\nlines"', '"' + "long\r\n" * 30 + '"', "é€", '"after"wards"', '""', '"""', '"\r"']
    text = "﻿h1,h2\n" if seed % 2 else ""
    for _ in range(25):
        text += ",".join(dice.choice(cells) for _ in range(dice.randint(1, 3))) + dice.choice(["\n", "\n", "\r\n", "\r", "\n\n"])
    try:
        want = list(parse_records(text))
    except RecordError:
        text += '"\n'
        want = list(parse_records(text))
    path = tmp_path / "x.csv"
    path.write_bytes(text.encode())
    header, rows = records_of(from_csv(spark, str(path)))
    assert (header, rows) == (want[0][1], want[1:])


def test_cut_header_empty_and_unterminated_files(spark, tmp_path, small_splits):
    path = tmp_path / "x.csv"
    path.write_text('\n"' + "head\n" * 30 + '",b\n1,2')
    assert records_of(from_csv(spark, str(path))) == (["head\n" * 30, "b"], [(3, ["1", "2"])])
    path.write_text("")
    assert records_of(from_csv(spark, str(path))) == ([], [])
    path.write_text('a,b\n1,"' + "open\n" * 50)
    with pytest.raises(RecordError, match="Unterminated"):
        from_csv(spark, str(path))


def test_head_reads_first_records(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n" + '1,"x\ny\nz"\n' * 50)
    whole, head = records_of(from_csv(spark, str(path))), records_of(head_csv(spark, str(path), 7))
    assert head == (whole[0], whole[1][:7])
    path.write_text("a,b\n1,2\n")
    assert records_of(head_csv(spark, str(path), 7)) == (["a", "b"], [(2, ["1", "2"])])
    path.write_text("")
    assert records_of(head_csv(spark, str(path), 7)) == ([], [])


@pytest.mark.parametrize("blank", [False, True])
def test_lines_without_quotes(spark, tmp_path, small_splits, blank):
    dice = random.Random(7)
    text = "\ufeff" + "".join("|".join(dice.choice(["", " ", "a", "bb b", "é€" * 9, "\t"]) for _ in range(dice.randint(1, 4))) + dice.choice(["\n", "\r\n"]) for _ in range(80)) + "last|"
    path = tmp_path / "x.csv"
    path.write_bytes(text.encode())
    want = list(parse_records(text, "|", allow_blank=blank))
    records = from_csv(spark, str(path), "|", allow_blank=blank)
    assert "MapInArrow" not in records.frame._jdf.queryExecution().executedPlan().toString()
    assert records_of(records) == (want[0][1], want[1:])
