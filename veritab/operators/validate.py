"""Contract validation: structure on the driver, cells in one aggregate, duplicates in one shuffle, issues only where there are any."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from veritab.functions import patterns
from veritab.functions import text as tx
from veritab.operators.number import written
from veritab.sources.contracts import csv_options
from veritab.sources.records import Records

ISSUE = "level string, code string, message string, column string, row long, test_id string, actual string, expected string"
_FIELDS = [f.split()[0] for f in ISSUE.split(", ")]


def issue(level, code, message, column=None, row=None, test_id=None, actual=None, expected=None) -> dict:
    return dict(zip(_FIELDS, (level, code, message, column, row, test_id, None if actual is None else str(actual), None if expected is None else str(expected))))


def count_issues(name: str, actual: int, expectation: dict | None, level: str, test_id: str | None = None) -> list[dict]:
    """An issue for each bound that a count breaks."""
    out = []
    for bound, word, broken in (("exact", "exactly", lambda e: actual != e), ("min", "at least", lambda e: actual < e), ("max", "at most", lambda e: actual > e)):
        want = (expectation or {}).get(bound)
        if want is not None and broken(want):
            out.append(issue(level, f"{name.upper()}_{bound.upper()}", f"{name} is {actual}; expected {word} {want}.", test_id=test_id, actual=actual, expected=want))
    return out


@dataclass
class Check:
    """A condition that makes a row an issue. ``texts``: message, actual, expected as columns; ``order``: its place within a record."""

    level: str
    code: str
    condition: Column
    message: Column
    column: str | None = None
    test_id: str | None = None
    actual: Column | None = None
    expected: Column | None = None

    def issue(self, order: int, rec: Column) -> Column:
        text = lambda c: (c if c is not None else F.lit(None)).cast("string")
        parts = [F.lit(order).alias("ord"), F.lit(self.level).alias("level"), F.lit(self.code).alias("code"), self.message.alias("message"), text(F.lit(self.column)).alias("column"), rec.alias("row")]
        return F.struct(*parts, text(F.lit(self.test_id)).alias("test_id"), text(self.actual).alias("actual"), text(self.expected).alias("expected"))


@dataclass(frozen=True)
class Registered:
    """A check of one's own: whether a cell fails, given its normalised text and the contract's parameter; what an issue is called and says."""

    fails: Callable[[Column, object], Column]
    code: str
    message: Callable[[str, object], str]


_REGISTERED: dict[str, Registered] = {}


def register_check(name: str, fails: Callable[[Column, object], Column], code: str | None = None, message: Callable[[str, object], str] | None = None) -> None:
    """Make ``constraints: {checks: {name: parameter}}`` mean ``fails``: cells that aren't null and for which it is true are issues, counted, fetched and
    reported like those of the built-in checks, in files, tables and streams. A condition that is null doesn't fail."""
    _REGISTERED[name] = Registered(fails, code or name.upper().replace("-", "_"), message or (lambda column, parameter: f'"{column}" fails {name} ({parameter}).'))


def registered(name: str) -> Registered | None:
    return _REGISTERED.get(name)


@dataclass
class Bound:
    """A contract bound to a header."""

    contract: dict
    structure: list[dict] = field(default_factory=list)
    checks: list[Check] = field(default_factory=list)
    uniques: list[tuple[str | None, list[Column], Column, Column | None]] = field(default_factory=list)
    tests: list[tuple[dict, Column]] = field(default_factory=list)


def bind(contract: dict, records: Records) -> Bound:
    """Structural issues, and the conditions to evaluate."""
    o, out = csv_options(contract), Bound(contract)
    trim, cased = o["trimValues"], o["caseSensitive"]
    norm = lambda c: tx.normal(c, trim, cased)
    norm_text = lambda s: tx.normal_text(str(s), trim, cased)
    headers = [tx.trim_text(h) if trim else h for h in records.header]
    place: dict[str, int] = {}
    for i, h in enumerate(headers):
        place.setdefault(h, i)
    found, schema = out.structure, contract["schema"]
    for h, n in Counter(headers).items():
        if n > 1:
            found.append(issue("file", "DUPLICATE_HEADER", f'Header "{h}" appears more than once.', column=h))
    found += count_issues("column_count", len(headers), schema.get("columnCount"), "file")
    if records.exact and not o["allowRaggedRows"]:
        wide = F.col("n_fields").cast("string")
        said = F.concat(F.lit("CSV record "), records.rec.cast("string"), F.lit(" has "), wide, F.lit(f" cells; expected {len(headers)}."))
        out.checks.append(Check("file", "RAGGED_ROW", F.col("n_fields") != len(headers), said, actual=wide, expected=F.lit(str(len(headers)))))
    markers = [norm_text(m) for m in o["nullValues"]]
    for name, definition in schema["columns"].items():
        if name not in place:
            if definition["presence"] == "required":
                found.append(issue("column", "REQUIRED_COLUMN_MISSING", f'Required column "{name}" is missing.', column=name))
            continue
        want = definition.get("constraints") or {}
        raw = records.cell(place[name])
        value, plain = (tx.trimmed(raw) if trim else raw), norm(raw)
        empty, size, shown = plain.isin(markers) if markers else F.lit(False), tx.length(value), tx.display(value)

        def add(code, condition, message, actual=None, expected=None, column=name):
            out.checks.append(Check("cell", code, condition, message, column, None, actual, expected))

        if want.get("notNull"):
            add("NULL_VALUE", empty, F.lit(f'"{name}" contains a configured null value.'))
        if want.get("minLength") is not None:
            n = want["minLength"]
            add("MIN_LENGTH", ~empty & (size < n), F.lit(f'"{name}" is shorter than {n} characters.'), size.cast("string"), F.lit(str(n)))
        if want.get("maxLength") is not None:
            n = want["maxLength"]
            add("MAX_LENGTH", ~empty & (size > n), F.lit(f'"{name}" exceeds {n} characters.'), size.cast("string"), F.lit(str(n)))
        if want.get("allowedValues") is not None:
            allowed = [norm_text(v) for v in want["allowedValues"]]
            add("NOT_ALLOWED", ~empty & (~plain.isin(allowed) if allowed else F.lit(True)), F.concat(F.lit(f'"{name}" value "'), shown, F.lit('" is not allowed.')), shown)
        if want.get("matches"):
            try:
                java = patterns.to_java(want["matches"], not cased)
                add("REGEX_MISMATCH", ~empty & ~value.rlike(java), F.concat(F.lit(f'"{name}" value "'), shown, F.lit(f'" does not match {want["matches"]}.')), shown)
            except patterns.InvalidPattern as error:
                found.append(issue("column", "INVALID_REGEX", f'"{name}" has an invalid regex: {error}', column=name))
        for own, parameter in (want.get("checks") or {}).items():
            check = registered(own)
            if check is None:
                found.append(issue("column", "UNKNOWN_CHECK", f'"{name}" asks for a check "{own}" that is not registered.', column=name))
            else:
                add(check.code, ~empty & F.coalesce(check.fails(plain, parameter), F.lit(False)), F.lit(check.message(name, parameter)), shown, F.lit(str(parameter)))
        if want.get("unique"):
            out.uniques.append((name, [plain], ~empty, plain))
    if schema.get("allowAdditionalColumns") is False:
        found += [issue("column", "ADDITIONAL_COLUMN", f'Undeclared column "{h}" is not allowed.', column=h) for h in headers if h not in schema["columns"]]
    identity = contract.get("identity")
    if identity:
        missing = [c for c in identity["columns"] if c not in schema["columns"] or c not in place]
        found += [issue("column", "IDENTITY_COLUMN_MISSING", f'Identity column "{c}" must be declared and present.', column=c) for c in missing]
        if identity.get("unique", True) and not missing:
            out.uniques.append((None, [norm(records.cell(place[c])) for c in identity["columns"]], F.lit(True), None))
    seen: set[str] = set()
    for test in contract.get("rowTests", []):
        cells, problems = test["expect"].get("cells") or {}, []
        if test["id"] in seen:
            problems.append(issue("row", "DUPLICATE_TEST_ID", f'Row test id "{test["id"]}" is duplicated.', test_id=test["id"]))
        seen.add(test["id"])
        for column in [*test["select"], *cells]:
            if column not in schema["columns"]:
                problems.append(issue("row", "UNDECLARED_TEST_COLUMN", f'Test "{test["id"]}" references undeclared column "{column}".', column=column, test_id=test["id"]))
            elif column not in place:
                problems.append(issue("row", "TEST_COLUMN_MISSING", f'Test "{test["id"]}" references optional column "{column}", but it is absent from this CSV.', column=column, test_id=test["id"]))
        found += problems
        if problems:
            continue
        match = tx.all_of(norm(records.cell(place[c])) == F.lit(norm_text(v)) for c, v in test["select"].items())
        out.tests.append((test, match))
        for column, wanted in cells.items():
            raw, want = records.cell(place[column]), str(wanted["equals"])
            shown = tx.display(tx.trimmed(raw) if trim else raw)
            said = F.concat(F.lit(f'Test "{test["id"]}" expected "{column}" to equal "{tx.display_text(want)}", found "'), shown, F.lit('".'))
            out.checks.append(Check("cell", "CELL_NOT_EQUAL", match & (norm(raw) != F.lit(norm_text(want))), said, column, test["id"], shown, F.lit(tx.display_text(want))))
    return out


def keyed(bound: Bound | list[Bound], records: Records) -> DataFrame | None:
    """(target, key, rec, shown) of every uniqueness check, numbered over all the contracts, in one pass: one shuffle serves them all. Keys of several files have the file too."""
    uniques = [u for b in (bound if isinstance(bound, list) else [bound]) for u in b.uniques]
    if not uniques:
        return None
    rows = []
    for k, (_, key, when, shown) in enumerate(uniques):
        row = F.struct(F.lit(k).alias("target"), F.array(*key).alias("key"), (tx.display(shown) if shown is not None else F.lit(None).cast("string")).alias("shown"))
        rows.append(F.when(when, row))
    by = _by(records)
    return records.frame.select(*by, records.rec.alias("rec"), F.explode(F.array_compact(F.array(*rows))).alias("u")).select(*by, "rec", "u.*")


def _by(records: Records) -> list[str]:
    """What tells the records of several files apart."""
    return ["file"] if "file" in records.frame.columns and records.files else []


def duplicates(bound: Bound, records: Records) -> DataFrame | None:
    """Later records of a key, with the first one. Only keys that occur twice are joined back, so a frequent key meets one small row."""
    keys = keyed(bound, records)
    if keys is None:
        return None
    by = _by(records)
    names = [*by, "target", "key"]
    twice = keys.groupBy(*names).agg(F.count("*").alias("n"), F.min("rec").alias("first")).where("n > 1").select(*(F.col(c).alias(f"_{c}") for c in names), "first")
    return keys.join(twice, tx.all_of(F.col(c) == F.col(f"_{c}") for c in names)).where("rec > first").select(*by, "target", "rec", "first", "shown")


def cell_issues(bound: Bound, records: Records) -> DataFrame:
    """An issue row for each check that a record fails, with ``phase`` and ``ord`` for the order."""
    hits = [F.when(c.condition, c.issue(k, records.rec)) for k, c in enumerate(bound.checks)]
    if not hits:
        return records.frame.sparkSession.createDataFrame([], f"{'file int, ' if _by(records) else ''}phase int, ord int, {ISSUE}")
    failing = records.frame.where(tx.any_of(c.condition for c in bound.checks))
    by = _by(records)
    return failing.select(*by, F.explode(F.array_compact(F.array(*hits))).alias("i")).select(*by, F.lit(1).alias("phase"), "i.*")


def duplicate_issues(bound: Bound, records: Records) -> DataFrame | None:
    found = duplicates(bound, records)
    if found is None:
        return None
    names = F.array(*(F.lit(name) for name, *_ in bound.uniques)).cast("array<string>")
    name = F.element_at(names, F.col("target") + 1)
    text = F.col("first").cast("string")
    said = F.when(name.isNull(), F.concat(F.lit("Composite identity duplicates CSV record "), text, F.lit("."))).otherwise(F.concat(F.lit('"'), name, F.lit('" duplicates CSV record '), text, F.lit(".")))
    none = F.lit(None).cast("string")
    return found.select(
        *_by(records), F.lit(2).alias("phase"), F.col("target").alias("ord"), F.when(name.isNull(), "row").otherwise("cell").alias("level"),
        F.when(name.isNull(), "IDENTITY_NOT_UNIQUE").otherwise("NOT_UNIQUE").alias("code"), said.alias("message"), name.alias("column"), F.col("rec").alias("row"), none.alias("test_id"), F.col("shown").alias("actual"), none.alias("expected"),
    )


@dataclass
class Result:
    valid: bool
    row_count: int
    column_count: int
    test_count: int
    issue_count: int
    truncated: bool
    issues: list[dict]


def totals(bounds: list[Bound], records: Records) -> list[list[dict]]:
    """One scan for all contracts: rows, failures of each check, matches of each test; one shuffle for surplus records of keys. A list for each file, or one."""
    cols, by = [F.count("*").alias("rows")], _by(records)
    for b, bound in enumerate(bounds):
        cols += [F.count_if(c.condition).alias(f"c{b}_{k}") for k, c in enumerate(bound.checks)]
        cols += [F.count_if(m).alias(f"m{b}_{k}") for k, (_, m) in enumerate(bound.tests)]
    file_of = lambda row: row["file"] if by else 0
    got = {file_of(r): r.asDict() for r in records.frame.groupBy(*by).agg(*cols).collect()}
    surplus: dict[tuple[int, int], int] = {}
    keys = keyed(bounds, records)
    if keys is not None:
        counted = keys.groupBy(*by, "target", "key").agg((F.count("*") - 1).alias("n")).groupBy(*by, "target").agg(F.sum("n").alias("n"))
        surplus = {(file_of(r), r["target"]): r["n"] for r in counted.collect()}
    out = []
    for file in range(len(records.files) if by else 1):
        row, own, first = got.get(file, {}), [], 0
        for b, bound in enumerate(bounds):
            mine = range(first, first + len(bound.uniques))
            first = mine.stop
            sums = {"rows": row.get("rows", 0), "checks": [row.get(f"c{b}_{k}", 0) for k in range(len(bound.checks))], "tests": [row.get(f"m{b}_{k}", 0) for k in range(len(bound.tests))]}
            own.append(sums | {"duplicates": sum(surplus.get((file, k), 0) for k in mine)})
        out.append(own)
    return out


def _first_issues(rows, bound: Bound, records: Records, room: dict[int, int]) -> dict[int, list[dict]]:
    """The first issues of each file, in one job; a file with many is cut in every task before its rest is sorted."""
    order, by = ("row", "ord") if rows is cell_issues else ("ord", "row"), _by(records)
    found = rows(bound, records)
    if not by:
        return {0: [r.asDict() for r in found.orderBy(*order).limit(room[0]).select(*_FIELDS).collect()]}
    found = found.where(F.col("file").isin(list(room))).withColumn("_k", F.row_number().over(Window.partitionBy("file").orderBy(*order))).where(F.col("_k") <= max(room.values()))
    out: dict[int, list[dict]] = {}
    for r in sorted(found.select("file", "_k", *_FIELDS).collect(), key=lambda r: (r["file"], r["_k"])):
        if r["_k"] <= room[r["file"]]:
            out.setdefault(r["file"], []).append({c: r[c] for c in _FIELDS})
    return out


def validate_files(records: Records, contracts: list[dict], max_issues: int = 1000) -> list[list[Result]]:
    """For each file of the records (or once, where they are of one source) a result per contract, all from one scan. Issues are fetched, ``max_issues`` at most a result, only
    for contracts that have any: one job for those of all files."""
    bounds = [bind(c, records) for c in contracts]
    by_file = totals(bounds, records)
    out: list[list[Result]] = [[] for _ in by_file]
    for b, bound in enumerate(bounds):
        schema = bound.contract["schema"]
        first = list(bound.structure)
        if not records.header:
            first.append(issue("file", "CSV_EMPTY", "CSV is empty."))
        kept = [first[:max_issues] for _ in by_file]
        for name, rows in (("checks", cell_issues), ("duplicates", duplicate_issues)):
            room = {k: max_issues - len(kept[k]) for k, sums in enumerate(by_file) if (sum(sums[b]["checks"]) if name == "checks" else sums[b]["duplicates"]) and len(kept[k]) < max_issues}
            if room:
                for k, found in _first_issues(rows, bound, records, room).items():
                    kept[k] += found
        for k, sums in enumerate(by_file):
            last = count_issues("row_count", sums[b]["rows"], schema.get("rowCount"), "file")
            for (test, _), n in zip(bound.tests, sums[b]["tests"]):
                last += count_issues("match_count", n, test["expect"].get("count") or {"exact": 1}, "row", test["id"])
            total = len(first) + sum(sums[b]["checks"]) + sums[b]["duplicates"] + len(last)
            kept[k] += last[: max(0, max_issues - len(kept[k]))]
            tests = len(schema["columns"]) + len(bound.contract.get("rowTests", []))
            out[k].append(Result(total == 0, sums[b]["rows"], len(records.header), tests, total, total > len(kept[k]), kept[k]))
    return out


def all_issues(records: Records, contracts: list[dict]) -> tuple[list[Result], DataFrame]:
    """Every issue of every contract, and a result each, without issues of its own. The records, of one source, are read once.

    Failing cells and the keys of uniqueness checks are written in one pass, which counts as it writes; duplicates then come from the written keys. The table
    has the contract's place in the list, and phase, place and row, which put its issues in order.
    """
    bounds, seen = [bind(c, records) for c in contracts], Observation()
    metrics, rows, targets = [F.count(F.lit(1)).alias("rows")], [], []
    names = [*_FIELDS, "key"]
    kinds = dict.fromkeys(names, "string") | {"row": "long", "key": "array<string>"}

    def row(contract: int, phase: int, place: int, **given: Column) -> Column:
        cells = [given.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names]
        return F.struct(F.lit(contract).alias("contract"), F.lit(phase).alias("phase"), F.lit(place).alias("place"), *cells)

    for b, bound in enumerate(bounds):
        for k, c in enumerate(bound.checks):
            metrics.append(F.count_if(c.condition).alias(f"c{b}_{k}"))
            texts = {n: x for n, x in (("actual", c.actual), ("expected", c.expected)) if x is not None}
            rows.append(F.when(c.condition, row(b, 1, k, level=F.lit(c.level), code=F.lit(c.code), message=c.message, column=F.lit(c.column), row=records.rec, test_id=F.lit(c.test_id), **texts)))
        metrics += [F.count_if(m).alias(f"m{b}_{k}") for k, (_, m) in enumerate(bound.tests)]
        for k, (_, key, when, shown) in enumerate(bound.uniques):
            shown = {} if shown is None else {"actual": tx.display(shown)}
            rows.append(F.when(when, row(b, 2, k, row=records.rec, key=F.array(*key), **shown)))
            targets.append((b, k))
    none = F.when(F.lit(False), row(0, 1, 0))
    found = written(records.frame.observe(seen, *metrics).select(F.explode(F.array_compact(F.array(*(rows or [none])))).alias("x")).select("x.*"), "found")
    got = seen.get
    keys = found.where("phase = 2")
    by = ["contract", "place", "key"]
    twice = keys.groupBy(*by).agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1").select(*(F.col(c).alias(f"_{c}") for c in by), "first")
    later = keys.join(twice, tx.all_of(F.col(c) == F.col(f"_{c}") for c in by)).where(F.col("row") > F.col("first"))
    name = F.coalesce(*(F.when((F.col("contract") == b) & (F.col("place") == k), F.lit(bounds[b].uniques[k][0])) for b, k in targets)) if targets else F.lit(None).cast("string")
    first = F.col("first").cast("string")
    said = F.when(name.isNull(), F.concat(F.lit("Composite identity duplicates CSV record "), first, F.lit("."))).otherwise(F.concat(F.lit('"'), name, F.lit('" duplicates CSV record '), first, F.lit(".")))
    made = {"level": F.when(name.isNull(), "row").otherwise("cell"), "code": F.when(name.isNull(), "IDENTITY_NOT_UNIQUE").otherwise("NOT_UNIQUE"), "message": said, "column": name}
    shape = [F.col(c) for c in ("contract", "phase", "place")]
    repeats = written(later.select(*shape, *(made.get(n, F.col(n)).alias(n) for n in _FIELDS)), "repeats")
    surplus = dict(map(tuple, repeats.groupBy("contract").count().collect()))
    results, others = [], []
    for b, bound in enumerate(bounds):
        schema = bound.contract["schema"]
        before = bound.structure + ([] if records.header else [issue("file", "CSV_EMPTY", "CSV is empty.")])
        after = count_issues("row_count", got["rows"], schema.get("rowCount"), "file")
        for k, (test, _) in enumerate(bound.tests):
            after += count_issues("match_count", got[f"m{b}_{k}"], test["expect"].get("count") or {"exact": 1}, "row", test["id"])
        others += [(b, phase, k, *(i[n] for n in _FIELDS)) for phase, some in ((0, before), (3, after)) for k, i in enumerate(some)]
        total = len(before) + sum(got[f"c{b}_{k}"] for k in range(len(bound.checks))) + surplus.get(b, 0) + len(after)
        results.append(Result(total == 0, got["rows"], len(records.header), len(schema["columns"]) + len(bound.contract.get("rowTests", [])), total, total > 0, []))
    fixed = records.frame.sparkSession.createDataFrame(others, f"contract int, phase int, place int, {ISSUE}")
    return results, fixed.unionByName(found.where("phase = 1").drop("key")).unionByName(repeats)


def validate(records: Records, contracts: list[dict], max_issues: int = 1000) -> list[Result]:
    """A result per contract, all from one scan of the records of one source."""
    (results,) = validate_files(records, contracts, max_issues)
    return results
