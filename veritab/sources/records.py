"""Records: a header on the driver and rows of (rec, n_fields, cells) on the cluster.

``from_frame`` takes any DataFrame and keeps its columns, so that Parquet reads only those that are checked. ``from_csv`` and ``open_files`` keep exact
record numbers, widths, line ends and quotes, of one file or of many in one scan, and split files of any size. ``native_csv`` is Spark's own reader, for
folders of files: it loses record widths and numbers rows instead of records.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.text import BLANKS

RECORDS = "rec long, n_fields int, fields array<string>"
COUNTS = "file long, split long, n0 long, open0 boolean, n1 long, open1 boolean, number long, fields array<string>"
COUNTS_NAMES = [c.split()[0] for c in COUNTS.split(", ")]
_SENTINEL = "\ue000end of file"


class RecordError(ValueError):
    pass


@dataclass
class Records:
    header: list[str]
    frame: DataFrame
    cell: Callable[[int], Column]
    exact: bool
    #: The files that the frame's ``file`` column numbers, where it has one.
    files: list[str] = field(default_factory=list)

    @property
    def rec(self) -> Column:
        return F.col("rec")


def parse_records(text: str, delimiter: str = ",", quote: str = '"', allow_blank: bool = False, most: int | None = None) -> Iterator[tuple[int, list[str]]]:
    """(record number, cells): the header is record 1; blank records are skipped but counted unless allowed."""
    text = text.removeprefix("\ufeff")
    bare = text and text[-1] not in "\r\n"
    csv.field_size_limit(1 << 31)

    def lines():
        yield from io.StringIO(text + "\n" if bare else text, newline="")
        yield _SENTINEL

    number, given, ended = 0, 0, False
    for row in csv.reader(lines(), delimiter=delimiter, quotechar=quote, doublequote=True):
        if row == [_SENTINEL]:
            ended = True
            break
        if row and _SENTINEL in row[-1]:
            raise RecordError("Unterminated quoted field at end of CSV.")
        number += 1
        row = row or [""]
        if not allow_blank and _is_blank(row):
            continue
        yield number, row
        given += 1
        if most is not None and given >= most:
            return
    if not ended:
        raise RecordError("Unterminated quoted field at end of CSV.")


def _shapes(delimiter: str, quote: str) -> tuple[re.Pattern, re.Pattern]:
    """A quoted cell from its opening quote, and what is left of one that is open; group 1 is empty where it stays open."""
    d, q = re.escape(delimiter), re.escape(quote)
    body = f"(?:[^{q}]+|{q}{q})*+({q}?)"
    return re.compile(f"(?:\\A|(?<=[{d}\r\n])){q}{body}"), re.compile(body)


def _walk(text: str, inside: bool, cell: re.Pattern, rest: re.Pattern) -> tuple[int, bool]:
    """How many records end in whole lines that begin inside or outside a quoted cell, and whether one is open at their end."""
    if inside:
        found = rest.match(text)
        if not found[1]:
            return 0, True
        text = "x" + text[found.end() :]
    still_open = False

    def stand_in(found: re.Match) -> str:
        nonlocal still_open
        still_open = not found[1]
        return "x"

    bare = cell.sub(stand_in, text)
    return bare.count("\n") + bare.count("\r") - bare.count("\r\n"), still_open


def _texts(parts: Iterator[pa.RecordBatch], encoding_errors: str) -> Iterator[tuple[tuple[int, int], str]]:
    """(file and start of its split, some of its lines)"""
    begun = None
    for part in parts:
        for key, lines in part.to_pandas().groupby(["file", "split"], sort=False)["value"]:
            text = (b"\n".join(lines) + b"\n").decode("utf-8", encoding_errors)
            yield key, text.removeprefix("\ufeff") if key[1] == 0 and begun != key else text
            begun = key


def _first_record(text: str, delimiter: str, quote: str, allow_blank: bool) -> tuple[int, list[str]] | None:
    """Which record of some lines is the first to count, and its cells, if it ends in them."""
    try:
        return next(iter(parse_records(text, delimiter, quote, allow_blank)), None)
    except RecordError:
        return None


def _counts(delimiter: str, quote: str, allow_blank: bool, encoding_errors: str):
    """For each split, if it begins outside and if it begins inside a quoted cell: the records that end in it, and whether a cell is open at its end. A file's first split also has its header."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _shapes(delimiter, quote)
        for (file, split), texts in groupby(_texts(parts, encoding_errors), itemgetter(0)):
            ended, state, head = [0, 0], [False, True], None
            for k, (_, text) in enumerate(texts):
                if k == 0 and split == 0:
                    head = _first_record(text, delimiter, quote, allow_blank)
                for k in (0, 1):
                    n, state[k] = _walk(text, state[k], *shapes)
                    ended[k] += n
            number, fields = head or (None, None)
            columns = [pa.array([x]) for x in (file, split, ended[0], state[0], ended[1], state[1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([number], pa.int64()), pa.array([fields], pa.list_(pa.string()))], COUNTS_NAMES)

    return run


def _is_blank(row: list[str]) -> bool:
    return len(row) == 1 and re.fullmatch(f"[{BLANKS}]*", row[0]) is not None


def _batch(file: int, records: list[tuple[int, list[str]]]) -> pa.RecordBatch:
    widths = [len(r) for _, r in records]
    fields = pa.ListArray.from_arrays(pa.array([0, *accumulate(widths)], pa.int32()), pa.array(list(chain.from_iterable(r for _, r in records)), pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([file] * len(records), pa.int32()), pa.array([n for n, _ in records], pa.int64()), pa.array(widths, pa.int32()), fields], ["file", "rec", "n_fields", "fields"])


@dataclass
class _Start:
    """How a split begins: its file's place in the list, the number of its first record, whether that began in an earlier split; and the number of the file's header."""

    file: int
    number: int
    begun: bool
    head: int


def _rows(starts: dict[tuple[int, int], _Start], delimiter: str, quote: str, allow_blank: bool, encoding_errors: str, pieces: bool):
    """The records after the header that lie within a split or, with ``pieces``, the lines of those that do not."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 31)
        for key, texts in groupby(_texts(parts, encoding_errors), itemgetter(0)):
            start = starts[key]
            begun, number = start.begun, start.number
            held: list = []

            def lines(texts=texts, begun=begun, held=held):
                mark = quote if begun else ""  # an open cell goes on
                for _, text in texts:
                    for line in io.StringIO(text, newline=""):
                        if pieces:
                            held.append(line)
                        yield mark + line
                        mark = ""
                yield _SENTINEL

            found = []
            for row in csv.reader(lines(), delimiter=delimiter, quotechar=quote, doublequote=True):
                if row == [_SENTINEL]:
                    break
                row = row or [""]
                cut = begun or _SENTINEL in row[-1]
                if number <= start.head:
                    pass
                elif pieces and cut:
                    yield pa.RecordBatch.from_pydict({"file": pa.array([start.file], pa.int32()), "rec": [number], "split": [key[1]], "piece": ["".join(held)]})
                elif not pieces and not cut and (allow_blank or not _is_blank(row)):
                    found.append((number, row))
                    if len(found) == 20_000:
                        yield _batch(start.file, found)
                        found = []
                held.clear()
                begun, number = False, number + 1
            if found:
                yield _batch(start.file, found)

    return run


def _joined(delimiter: str, quote: str, allow_blank: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 31)
        for part in parts:
            for file, n, text in zip(*(part[c].to_pylist() for c in ("file", "rec", "text"))):
                row = next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar=quote, doublequote=True))
                if allow_blank or not _is_blank(row):
                    yield _batch(file, [(n, row)])

    return run


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of files, each with a digest of its file's name and the start of the split that it begins in."""
    lines = spark.read.text(paths, lineSep="\n")
    if len(lines.inputFiles()) > len(paths):
        raise RecordError(f"{', '.join(paths[:3])} is more than one file.")
    name = F.col("_metadata.file_path")
    return lines.select(F.col("value").cast("binary").alias("value"), F.xxhash64(name).alias("file"), F.col("_metadata.file_block_start").alias("split"), name.alias("name"))


def _cell(i: int) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(i + 1)), F.lit(""))


def _line_text(c: Column) -> Column:
    text = F.make_valid_utf8(c.cast("string"))
    return F.when(text.endswith("\r"), text.substr(F.lit(1), F.char_length(text) - 1)).otherwise(text)


def _plain(lines: DataFrame, starts: list[tuple], delimiter: str, allow_blank: bool) -> DataFrame:
    """Records of files in which each line is one, without Python: a line's number is the count of lines in the file's splits before it and its place in its own.

    ``starts``: (digest of the file, split, place of its first line, lines, lines of the file before it, the file's place in the list, number of its header).
    """
    base = lines.sparkSession.createDataFrame(starts, "f long, s long, first long, n long, before long, at int, head long")
    placed = lines.drop("name").withColumn("place", F.monotonically_increasing_id())
    joined = placed.join(F.broadcast(base), (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")), "left")  # 52 bytes a split
    within = F.col("place") - F.col("first")
    changed = F.raise_error(F.lit("the files' splits changed while they were read")).cast("long")
    rec = F.when((within >= 0) & (within < F.col("n")), F.col("before") + within + 1).otherwise(changed)
    rows = joined.select(F.col("at").alias("file"), rec.alias("rec"), "head", _line_text(F.col("value")).alias("text"))
    text = F.when(F.col("rec") == 1, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text"))
    rows = rows.where("rec > head").select("file", "rec", F.split(text, re.escape(delimiter), -1).alias("fields")).select("file", "rec", F.size("fields").alias("n_fields"), "fields")
    return rows if allow_blank else rows.where((F.col("n_fields") > 1) | F.element_at("fields", 1).rlike(f"[^{BLANKS}]"))


def _qualified(spark: SparkSession, path: str) -> tuple[str, bool]:
    """A path as Spark names its files, and whether it exists."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return _short(files.makeQualified(own).toUri().toString()), files.exists(own)


def _short(name: str) -> str:
    """One spelling of names without a host: file:/x for file:///x."""
    return re.sub("^([a-z]+):///", r"\1:/", name)


@dataclass
class _Found:
    """What the first pass says of a file: (split, lines, first place) of its splits, whether it needs a parser, and its header with its number."""

    splits: list[tuple[int, int, int]]
    odd: bool
    header: list[str] | None
    head: int


def _look(lines: DataFrame, delimiter: str, quote: str, allow_blank: bool, encoding_errors: str) -> dict[tuple[int, str], _Found]:
    """The first pass, by digest and name of the file."""
    value = F.col("value").cast("string")
    odd = F.contains(value, F.lit(quote)) | (F.contains(value, F.lit("\r")) & value.rlike("\r(?!\\z)"))
    if encoding_errors != "replace":
        odd |= ~F.is_valid_utf8(value)
    text = _line_text(F.col("value"))
    counts = F.lit(True) if allow_blank else text.rlike(f"[^{BLANKS}]") | F.contains(text, F.lit(delimiter))
    placed = lines.withColumn("place", F.monotonically_increasing_id())
    first = F.when(counts, F.col("place"))
    seen = placed.groupBy("file", "split").agg(F.first("name").alias("name"), F.count("*").alias("n"), F.min("place").alias("first"), F.bool_or(odd).alias("odd"), F.min(first).alias("at"), F.min_by(text, first).alias("head"))
    out: dict[tuple[int, str], _Found] = {}
    for r in sorted(seen.collect(), key=lambda r: (r["file"], r["split"])):
        own = out.setdefault((r["file"], _short(r["name"])), _Found([], False, None, 0))
        if own.header is None and r["at"] is not None:
            own.head = sum(n for _, n, _ in own.splits) + r["at"] - r["first"] + 1
            own.header = (r["head"].removeprefix("\ufeff") if own.head == 1 else r["head"]).split(delimiter)
        own.splits.append((r["split"], r["n"], r["first"]))
        own.odd |= r["odd"]
    if len({f for f, _ in out}) < len(out):
        raise RecordError("Two file names have the same digest.")
    return out


def open_files(spark: SparkSession, paths: list[str], delimiter: str = ",", quote: str = '"', allow_blank: bool = False, encoding_errors: str = "replace") -> tuple[list[Records], dict[str, RecordError]]:
    """Files of any number and size with exact records, those of one header in one frame; and the errors of files that cannot be read.

    A first pass counts the lines of each split of each file and looks for quotes and bare carriage returns. Where a file has none, each line is a record, and Python sees none
    of them. Else a second pass counts the records of each split, once for each way it may begin (outside or inside a quoted cell). The driver, which sees a few numbers a
    split, adds them up file by file, and then knows how each split begins and which number its first record has. The last pass parses; only records that splits cut are
    shuffled, to be put together. Files that differ in header, or in needing a parser, are read group by group.
    """
    names, errors = {}, {}
    for path in dict.fromkeys(paths):
        name, exists = _qualified(spark, path)
        if exists:
            names.setdefault(name, path)
        else:
            errors[path] = RecordError(f"{path} does not exist.")
    if not names:
        return [], errors
    lines = _lines(spark, list(names.values()))
    found = _look(lines, delimiter, quote, allow_blank, encoding_errors)
    by_name = {name: (digest, own) for (digest, name), own in found.items()}
    groups: dict[tuple, list[str]] = {}
    for name in names:
        own = by_name[name][1] if name in by_name else _Found([], False, None, 0)
        groups.setdefault(("odd",) if own.odd else ("plain", *(own.header or ())), []).append(name)
    reopened = lambda some: open_files(spark, [names[n] for n in some], delimiter, quote, allow_blank, encoding_errors)
    if len(groups) > 1:
        opened = [reopened(some) for some in groups.values()]
        return [r for records, _ in opened for r in records], errors | {k: e for _, more in opened for k, e in more.items()}
    (kind, *header), files = next(iter(groups)), list(names)
    given = [names[n] for n in files]
    if kind == "plain":
        if not header:
            return [Records([], spark.createDataFrame([], f"file int, {RECORDS}"), _cell, True, given)], errors
        starts = []
        for at, name in enumerate(files):
            (digest, own), before = by_name[name], 0
            for split, n, first in own.splits:
                starts.append((digest, split, first, n, before, at, own.head))
                before += n
        return [Records(list(header), _plain(lines, starts, delimiter, allow_blank), _cell, True, given)], errors
    return _parsed(lines, {name: (by_name[name][0], at) for at, name in enumerate(files)}, names, (delimiter, quote, allow_blank, encoding_errors), errors, reopened)


def _parsed(lines: DataFrame, files: dict[str, tuple[int, int]], names: dict[str, str], how: tuple, errors: dict, reopened) -> tuple[list[Records], dict]:
    """``open_files`` for files that need a parser; ``files``: name -> digest and place in the list."""
    delimiter, quote, allow_blank, encoding_errors = how
    lines = lines.drop("name")
    counted: dict[int, list] = {}
    for r in sorted(lines.mapInArrow(_counts(*how), COUNTS).collect(), key=lambda r: (r["file"], r["split"])):
        counted.setdefault(r["file"], []).append(r)
    starts: dict[tuple[int, int], _Start] = {}
    headers: dict[str, list[str] | None] = {}
    for name, (digest, at) in files.items():
        number, inside, first = 1, False, counted[digest][0]
        headers[name] = first["fields"]
        for r in counted[digest]:
            starts[digest, r["split"]] = _Start(at, number, inside, first["number"] or 0)
            number += r["n1"] if inside else r["n0"]
            inside = r["open1"] if inside else r["open0"]
        if inside:
            errors = errors | {names[name]: RecordError("Unterminated quoted field at end of CSV.")}
    good = [name for name in files if names[name] not in errors]
    if len(good) < len(files):
        records, more = reopened(good) if good else ([], {})
        return records, errors | more

    def frame() -> DataFrame:
        rows = lambda schema, pieces: lines.mapInArrow(_rows(starts, *how, pieces), schema)
        whole = rows(f"file int, {RECORDS}", False)
        if not any(s.begun for s in starts.values()):
            return whole
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "piece"))), lambda x: x["piece"]), "")
        cut = rows("file int, rec long, split long, piece string", True).groupBy("file", "rec").agg(text.alias("text"))
        return whole.unionByName(cut.mapInArrow(_joined(delimiter, quote, allow_blank), f"file int, {RECORDS}"))

    late = [at for name, (_, at) in files.items() if headers[name] is None]  # a header that no split's first lines hold whole
    if late:
        heads = {r["file"]: r for r in frame().where(F.col("file").isin(late)).groupBy("file").agg(F.min("rec").alias("rec"), F.min_by("fields", "rec").alias("fields")).collect()}
        for name, (digest, at) in files.items():
            if at in heads:
                headers[name] = heads[at]["fields"]
                for key, start in starts.items():
                    if key[0] == digest:
                        start.head = heads[at]["rec"]
    groups: dict[tuple, list[str]] = {}
    for name in files:
        groups.setdefault(tuple(headers[name] or ()), []).append(name)
    if len(groups) > 1:
        opened = [reopened(some) for some in groups.values()]
        return [r for records, _ in opened for r in records], errors | {k: e for _, more in opened for k, e in more.items()}
    return [Records(list(next(iter(groups))), frame(), _cell, True, [names[n] for n in files])], errors


def from_csv(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', allow_blank: bool = False, encoding_errors: str = "replace") -> Records:
    """One file of any size with exact records; each task reads one split of it (``open_files``)."""
    records, errors = open_files(spark, [path], delimiter, quote, allow_blank, encoding_errors)
    if path in errors:
        raise errors[path]
    records[0].frame = records[0].frame.drop("file")
    return records[0]


def head_csv(spark: SparkSession, path: str, most: int, delimiter: str = ",", quote: str = '"', most_bytes: int = 256 << 20) -> Records:
    """The header and the first ``most`` records, from as many of the file's first lines as hold them; the rest of the file is not read.

    A cell that is never closed would need all lines, so what comes to the driver is bounded: beyond ``most_bytes`` it is an error.
    """
    lines, want = _lines(spark, [path]).drop("name"), most + 1
    while True:
        size = lines.limit(want).agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
        if size > most_bytes:
            raise RecordError(f"The first {want} lines of {path} have {size} bytes; the first {most} records may take {most_bytes}.")
        got = lines.limit(want).collect()
        text = "".join(text for _, text in _texts([pa.RecordBatch.from_pylist([r.asDict() for r in got])], "replace")) if got else ""
        found = []
        try:
            found += parse_records(text, delimiter, quote, most=most + 1)
        except RecordError:
            if len(got) < want:
                raise
        if len(got) < want or len(found) > most:
            break
        want *= 2
    rows = [(n, len(r), r) for n, r in found[1:]]
    return Records(found[0][1] if found else [], spark.createDataFrame(rows, RECORDS), _cell, True)


def native_csv(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', multiline: bool = True) -> Records:
    """Spark's own reader, for a file or a folder of files. Rows are numbered from 2 on in the order in which they are read, without gaps over all files: these are
    numbers of rows, not of a file's records. ``multiline=False`` lets Spark split files whose quoted cells hold no line ends.

    A first pass counts the rows of each partition, whose numbers reach the driver.
    """
    df = spark.read.csv(path, header=True, sep=delimiter, quote=quote, escape=quote, multiLine=multiline, inferSchema=False)
    low = (1 << 33) - 1
    place, part = F.monotonically_increasing_id(), F.shiftright(F.monotonically_increasing_id(), 33)
    before, total = [], 0
    for p, n in sorted(map(tuple, df.select(part.alias("p")).groupBy("p").count().collect())):
        before.append((p, n, total))
        total += n
    if not before:
        return from_frame(df, F.lit(0))
    starts = F.broadcast(spark.createDataFrame(before, "_p long, _n long, _before long"))  # 24 bytes a partition
    header = df.columns
    placed = df.toDF(*(f"c{i}" for i in range(len(header)))).withColumn("_place", place)
    joined = placed.join(starts, F.shiftright("_place", 33) == F.col("_p"), "left")
    within = F.col("_place").bitwiseAND(F.lit(low))
    rec = F.when(within < F.col("_n"), F.col("_before") + within + 2).otherwise(F.raise_error(F.lit("the files' partitions changed while they were read")).cast("long"))
    cells = [F.col(f"c{i}").cast("string").alias(f"c{i}") for i in range(len(header))]
    return Records(header, joined.select(rec.alias("rec"), *cells), lambda i: F.coalesce(F.col(f"c{i}"), F.lit("")), False)


def from_frame(df: DataFrame, rec: Column, columns: list[str] | None = None) -> Records:
    """Any DataFrame: cells are its columns as texts, null as an empty one; ``rec`` must be a unique number."""
    header = columns or df.columns
    named = df.select(rec.cast("long").alias("rec"), *(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(header)))
    return Records(header, named, lambda i: F.coalesce(F.col(f"c{i}"), F.lit("")), False)


def benchmark_table(spark: SparkSession, rows: int, columns: int = 100) -> DataFrame:
    """The published benchmark's rows: 12-digit Id, Company, Status, Name, OptionalComment, ColumnNNN."""
    n = F.col("id") + 1
    text = lambda c: c.cast("string")
    base = [
        F.lpad(text(n), 12, "0").alias("Id"), F.lpad(text(n % 100), 2, "0").alias("Company"), F.when(n % 10 == 0, "Inactive").otherwise("Active").alias("Status"),
        F.concat(F.lit("Employee "), F.lpad(text(n), 12, "0")).alias("Name"), F.when(n % 7 == 0, F.concat(F.lit("Note "), text(n % 1000))).otherwise("").alias("OptionalComment"),
    ]
    more = [F.concat(F.lit(f"V{k}_"), text(n % 1000)).alias(f"Column{k:03d}") for k in range(6, columns + 1)]
    return spark.range(rows).select(*base, *more)
