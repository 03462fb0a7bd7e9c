"""Evidence of a comparison: files that appear together in a folder, tables among them in canonical order."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.text import canonical
from veritab.operators.compare import Comparison, column_status


def field(x) -> str:
    return '"' + ("" if x is None else str(x).lower() if isinstance(x, bool) else str(x)).replace('"', '""') + '"'


def csv_text(header: list[str], rows) -> str:
    return "".join(",".join(map(field, r)) + "\n" for r in [header, *rows])


@dataclass
class Detail:
    """A table of the evidence: its titles, its rows (none where the headers differ), and what they are ordered by, given their columns."""

    titles: list[str]
    rows: DataFrame | None
    order: Callable[[list[Column]], list[Column]]


def details(c: Comparison) -> dict[str, Detail]:
    """File name -> table, by mode. All lazy."""
    differ = bool(c.schema["left_only"] or c.schema["right_only"])
    rows = lambda make, *args: None if differ else make(*args)
    n, o = len(c.keys), c.options
    named = [*o.keys, *o.context]
    business = F.array(*(F.lit(c.columns[i]) for i in c.business)).cast("array<string>")
    by_row = lambda x: [ordinal(x)]
    if c.keys:
        by_key = lambda x: [ordinal(x[:n])]
        by_cell = lambda x: [ordinal(x[:n]), F.array_position(business, x[len(named)])]
        by_occurrence = lambda x: [ordinal([x[i] for i in c.keys]), x[-2].cast("long")]
        out = {
            "KeysOnlyInLeft": Detail([*named, "OccurrenceCount"], rows(c.keys_only, 0, False), by_key), "KeysOnlyInRight": Detail([*named, "OccurrenceCount"], rows(c.keys_only, 1, False), by_key),
            "ChangedRows": Detail([*named, "ChangedColumn", "LeftValue", "RightValue"], rows(c.changed_cells, False), by_cell),
            "DuplicateKeysLeft": Detail([*c.columns, "KeyOccurrence", "KeyCount"], rows(c.duplicate_rows, 0, False), by_occurrence),
            "DuplicateKeysRight": Detail([*c.columns, "KeyOccurrence", "KeyCount"], rows(c.duplicate_rows, 1, False), by_occurrence),
            "ColumnChangeSummary": Detail(["ColumnName", "ChangedCellCount"], rows(c.changed_by_column) if c.business else None, lambda x: [F.array_position(business, x[0])]),
        }
    else:
        out = {"LeftOnly": Detail(c.columns, rows(c.only, 0), by_row), "RightOnly": Detail(c.columns, rows(c.only, 1), by_row)}
    return out | {name: Detail(c.columns, c.side_rows(side), by_row) for side, name in enumerate(("NormalizedLeft", "NormalizedRight"))}


def ordinal(values: list[Column]) -> Column:
    """What rows of these texts are ordered by."""
    return F.encode(canonical(values), "UTF-16BE")


#: Titles of the summary files, and the counts of the evidence file as name -> place in a summary's differences. The other titles and sentences here are fixed values too.
EVIDENCE_TITLES = ["recordType", "name", "countOrValue", "column", "keyReference", "diagnosticId"]
COLUMN_TITLES = ["Status", "ColumnName", "LeftOrdinal", "RightOrdinal", "Comparable", "Ignored"]
COUNTS = {
    "added": "added", "removed": "removed", "changed": "changed", "unchanged": "unchanged", "changedCells": "changed_cells", "schemaChanges": "schema_changes", "duplicateKeysLeft": "duplicate_keys_left",
    "duplicateKeysRight": "duplicate_keys_right",
}


def _reference(kind: str, name: str) -> str:
    """The key that a diagnostic's id starts with; other diagnostics have none."""
    return "-".join(name.split("-")[:2]) if name.startswith("key-") else ""


def evidence_rows(summary: dict) -> list[tuple]:
    """(recordType, name, countOrValue, column, keyReference, diagnosticId) of a summary."""
    sums = summary["differences"]
    rows = [("summary", "status", summary["status"], str(summary["semantic_equal"]).lower(), summary["exit_code"], ""), ("summary", "mode", summary["mode"], "", "", "")]
    rows += [("count", f"{side}Rows", summary[side]["row_count"], "", "", "") for side in ("left", "right")]
    rows += [("count", name, sums[key], "", "", "") for name, key in COUNTS.items()]
    return rows + [("diagnostic", kind, n, column[0] if column else "", _reference(kind, name), name) for name, kind, n, *column in summary["diagnostics"]]


def summary_markdown(summary: dict) -> str:
    columns, d = summary["columns"], summary["differences"]
    listed = lambda names: ", ".join(names) or "(none)"
    facts = {"Status": f"**{summary['status']}**", "Mode": summary["mode"], "Semantically equal": str(summary["semantic_equal"]).lower()}
    facts |= {"Left rows": summary["left"]["row_count"], "Right rows": summary["right"]["row_count"], "Comparable columns": len(columns["comparable"])}
    schema = {"Columns only in left": listed(columns["left_only"]), "Columns only in right": listed(columns["right_only"]), "Shared columns reordered": str(columns["reordered"]).lower()}
    sums = [d["added"], d["removed"], d["changed"], d["unchanged"], d["changed_cells"], f"{d['duplicate_keys_left']}/{d['duplicate_keys_right']}"]
    lines = [f"# {summary['name']}", "", *(f"- {k}: {v}" for k, v in facts.items()), "", "## Results", ""]
    lines += ["| Added | Removed | Changed keys | Unchanged | Changed cells | Duplicate keys (left/right) |", "|" + " ---: |" * 6, "| " + " | ".join(map(str, sums)) + " |"]
    lines += ["", "## Schema", "", *(f"- {k}: {v}" for k, v in schema.items()), "", "## Diagnostics", ""]
    lines += [f"Diagnostics are aggregate and redacted. Included {len(summary['diagnostics'])} of {summary['diagnostics_total']}.", "Detailed review CSV rows are complete."]
    if summary["diagnostics"]:
        lines += ["", "| Kind | Count | Column | Reference |", "| --- | ---: | --- | --- |"]
        lines += [f"| {kind} | {n} | {column[0] if column else ''} | {_reference(kind, name)} |" for name, kind, n, *column in summary["diagnostics"]]
    return "\n".join(lines) + "\n"


def published(c: Comparison, summary: dict) -> dict:
    """A summary in the published layout."""
    o, columns, d = c.options, summary["columns"], summary["differences"]
    most = max(0, min(1000, o.max_diagnostics))
    side = lambda x: {"rowCount": x["row_count"], "distinctRowCount": x["distinct_row_count"], "duplicateRowGroups": x["duplicate_row_groups"], "uniqueKeyCount": x.get("unique_key_count"), "duplicateKeyCount": x.get("duplicate_key_count")}
    items = []
    for name, kind, n, *column in summary["diagnostics"][:most]:
        reference = _reference(kind, name)
        items.append({"id": name, "kind": kind, "count": n} | ({"column": column[0]} if column else {}) | ({"keyReference": reference} if reference else {}))
    return {
        "schema": "veritab.csv-semantic-comparison/v1", "name": summary["name"], "mode": summary["mode"],
        "options": {
            "keyColumns": o.keys, "contextColumns": o.context, "ignoredColumns": o.ignored,
            "normalization": {"trim": o.trim, "caseFold": o.case_fold, "blankNullEquivalent": o.blank_null, "dateColumns": o.dates, "decimalColumns": o.decimals}, "maxDiagnostics": most,
        },
        "columns": {"leftColumns": c.headers[0], "rightColumns": c.headers[1], "comparableColumns": columns["comparable"], "columnsOnlyInLeft": columns["left_only"], "columnsOnlyInRight": columns["right_only"], "reordered": columns["reordered"]},
        "status": summary["status"], "semanticEqual": summary["semantic_equal"], "exitCode": summary["exit_code"], "left": side(summary["left"]), "right": side(summary["right"]),
        "differences": {
            "added": d["added"], "removed": d["removed"], "changed": d["changed"], "unchanged": d["unchanged"], "changedCells": d["changed_cells"], "schemaChanges": d["schema_changes"],
            "duplicateRowCountDifferences": d["duplicate_row_count_differences"], "duplicateKeysLeft": d["duplicate_keys_left"], "duplicateKeysRight": d["duplicate_keys_right"], "changedCellsByColumn": d.get("changed_cells_by_column", {}),
        },
        "diagnostics": {"total": summary["diagnostics_total"], "included": len(items), "truncated": summary["diagnostics_total"] > len(items), "items": items},
    }


class Staged:
    """A folder of files that appears whole: everything is written beside it, listed in a manifest, and put in its place by renaming.

    What was there before is set aside until then, and put back by the next use if a process ended between the two renamings.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.target = self._path(folder.rstrip("/"))
        self.files = self.target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.target = self.files.makeQualified(self.target)
        parent, name = self.target.getParent().toString(), self.target.getName()
        self.old, self.staged = self._path(f"{parent}/.{name}.old"), self._path(f"{parent}/.{name}.staged-{uuid.uuid4().hex}")
        self.parts, self.listed = self._path(f"{parent}/.{name}.parts-{uuid.uuid4().hex}"), {}
        if not self.files.exists(self.target) and self.files.exists(self.old):
            self.files.rename(self.old, self.target)
        self.files.mkdirs(self.staged)
        self.files.setWriteChecksum(False)  # a local file system would put a checksum file beside each

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def text(self, name: str, content: str) -> None:
        out = self.files.create(self._path(f"{self.staged}/{name}"))
        out.write(bytearray(content.encode("utf-8")))
        out.close()
        self.listed[name] = None

    def lines(self, name: str, head: str, lines: DataFrame | None) -> None:
        """Ordered lines as one file: what Spark has written in parts is joined by the file system, or copied where that can't."""
        self.text(name, head)
        if lines is None:
            return
        folder = f"{self.parts}/{name}"
        lines.write.text(folder)
        found = sorted(s.getPath().toString() for s in self.files.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-") and s.getLen())
        target = self._path(f"{self.staged}/{name}")
        some = self.jvm.java.lang.reflect.Array.newInstance(target.getClass(), len(found))
        for k, path in enumerate(found):
            some[k] = self._path(path)
        try:
            if found:
                self.files.concat(target, some)
        except UnsupportedOperationException:
            out = self.files.create(target)
            out.write(bytearray(head.encode("utf-8")))
            for path in some:
                part = self.files.open(path)
                self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                part.close()
            out.close()

    def publish(self) -> list[str]:
        names = sorted(self.listed)
        sizes = {name: self.files.getFileStatus(self._path(f"{self.staged}/{name}")).getLen() for name in names}
        self.text("Manifest.json", json.dumps({"files": [{"name": n, "bytes": b} for n, b in sizes.items()]}, indent=2) + "\n")
        self.files.delete(self.old, True)
        if self.files.exists(self.target):
            self.files.rename(self.target, self.old)
        if not self.files.rename(self.staged, self.target):
            raise OSError(f"{self.staged} could not be put in place as {self.target}")
        self.files.delete(self.old, True)
        return names

    def clean(self) -> None:
        self.files.setWriteChecksum(True)
        for path in (self.staged, self.parts):
            self.files.delete(path, True)


def _ordered_lines(detail: Detail) -> DataFrame | None:
    if detail.rows is None:
        return None
    rows = detail.rows.toDF(*(f"c{i}" for i in range(len(detail.titles))))
    cells = [F.col(c) for c in rows.columns]
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    keyed = rows.select(F.concat_ws(",", *map(quoted, cells)).alias("value"), *(c.alias(f"o{k}") for k, c in enumerate(detail.order(cells))))
    return keyed.orderBy(*(c for c in keyed.columns if c != "value")).select("value")


def write_evidence(c: Comparison, folder: str) -> list[str]:
    """The evidence as published: JSON, CSV and Markdown of the summary, and complete tables in canonical order, a file each. It replaces what is in ``folder``, all at once; a folder that
    driver and executors share."""
    summary = c.summary()
    evidence = Staged(c.both.sparkSession, folder)
    try:
        evidence.text("ComparisonSummary.json", json.dumps(published(c, summary), indent=2, ensure_ascii=False) + "\n")
        evidence.text("ComparisonEvidence.csv", csv_text(EVIDENCE_TITLES, evidence_rows(summary)))
        evidence.text("ComparisonSummary.md", summary_markdown(summary))
        evidence.text("ColumnSummary.csv", csv_text(COLUMN_TITLES, column_status(*c.headers, c.options.ignored)))
        for name, detail in details(c).items():
            evidence.lines(f"{name}.csv", csv_text(detail.titles, []), _ordered_lines(detail))
        return evidence.publish()
    finally:
        evidence.clean()
