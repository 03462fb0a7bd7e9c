"""Command line: test, init, sql, schema, compare. Exit codes: 0 good, 1 issues, 2 errors; a comparison has its own."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from veritab.operators.compare import ComparisonError, Options, compare
from veritab.operators.profile import outline
from veritab.plans import suite, tables, tsql
from veritab.plans.progress import progress
from veritab.sources import contracts as ct
from veritab.sources.evidence import write_evidence
from veritab.sources.records import from_csv, head_csv


# What is said of a generated contract.
REVIEW = "Review column presence and replace or remove generated sample assertions before relying on this contract."
NOT_INFERRED = "No data constraints were inferred; add notNull, unique, length, regex, or allowedValues rules deliberately."


def _positive(text: str) -> int:
    if not text.isdecimal() or int(text) < 1:
        raise argparse.ArgumentTypeError(f"{text} is not a positive integer")
    return int(text)


def _whole(text: str) -> int:
    if not text.isdecimal():
        raise argparse.ArgumentTypeError(f"{text} is not a non-negative integer")
    return int(text)


def _save(path: str, text: str, force: bool) -> None:
    if os.path.exists(path) and not force:
        raise ValueError(f"{path} exists; --force overwrites it")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _relative(path: str, folder: str) -> str:
    """A path from a folder with ``/``; one on another drive stays whole."""
    try:
        found = os.path.relpath(path, folder).replace(os.sep, "/")
    except ValueError:
        return os.path.abspath(path)
    return found if found.startswith(".") else f"./{found}"


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _import_schema(a: argparse.Namespace) -> int:
    """Columns of a table into a contract, or into a new one where there is none: written to --out, or with --write in its place."""
    found = tables.from_json(_read(a.source))
    names = ", ".join(f"{x['schema']}.{x['table']}" for x in found)
    named = [x for x in found if not a.table or f"{x['schema']}.{x['table']}".lower() == a.table.lower()]
    if not named:
        raise ValueError(f"Table '{a.table}' was not found. Available tables: {names}")
    if len(named) > 1:
        raise ValueError(f"The source contains multiple tables; use --table. Available tables: {names}")
    if not a.out and not a.spec:
        raise ValueError("schema needs --out or --spec")
    contract = ct.parse(_read(a.spec)) if a.spec else {"version": 1, "schema": {"allowAdditionalColumns": True, "columns": {}}}
    merged, preview = tables.merge(contract, named[0])
    if not a.out:
        print(json.dumps(preview, indent=2))
        if a.write:
            _save(a.spec, ct.dump(merged), True)
        return 0
    _save(a.out, ct.dump(merged), True)
    print(f"Imported {len(named[0]['columns'])} columns from {named[0]['schema']}.{named[0]['table']} into {os.path.abspath(a.out)}.")
    print(f"Added {len(preview['added'])}; preserved {len(preview['existing'])} existing and {len(preview['contract_only'])} contract-only columns.")
    if preview["preserved_conflicts"]:
        print(f"WARNING: Preserved reviewed conflicts: {', '.join(preview['preserved_conflicts'])}", file=sys.stderr)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="veritab")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("test")
    t.add_argument("--spec", action="append", default=[])
    t.add_argument("--suite")
    t.add_argument("--csv", action="append", default=[])
    t.add_argument("--format", choices=("text", "json"), default="text")
    t.add_argument("--json", action="store_const", const="json", dest="format")
    t.add_argument("--html")
    t.add_argument("--max-issues", type=_positive, default=1000)
    t.add_argument("--progress-interval", type=_whole, default=250_000, help="rows between two lines on standard error; 0: none")
    i = sub.add_parser("init")
    i.add_argument("--csv", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--sample-rows", type=_positive, default=10_000)
    i.add_argument("--delimiter", default=",")
    i.add_argument("--infer-constraints", action="store_true")
    i.add_argument("--no-sample-tests", action="store_true")
    i.add_argument("--force", action="store_true")
    q = sub.add_parser("sql")
    q.add_argument("--spec", required=True)
    q.add_argument("--out", required=True)
    q.add_argument("--force", action="store_true")
    s = sub.add_parser("schema")
    s.add_argument("--spec")
    s.add_argument("--source", required=True)
    s.add_argument("--out")
    s.add_argument("--table")
    s.add_argument("--write", action="store_true")
    c = sub.add_parser("compare")
    c.add_argument("left")
    c.add_argument("right")
    for option in ("keys", "context", "ignored", "dates", "decimals"):
        c.add_argument(f"--{option}", action="append", default=[])
    for option in ("trim", "case-fold", "blank-null"):
        c.add_argument(f"--{option}", action="store_true")
    c.add_argument("--delimiter", default=",")
    c.add_argument("--evidence")
    a = p.parse_args(argv)
    try:
        if a.command == "sql":
            made = tsql.script(ct.parse(_read(a.spec)))
            _save(a.out, made["sql"], a.force)
            print(f"{made['rule_count']} rules, {len(made['warnings'])} warnings")
            return 0
        if a.command == "schema":
            return _import_schema(a)
        spark = spark or SparkSession.builder.appName("veritab").getOrCreate()
        if a.command == "test":
            if not a.suite and not a.spec:
                raise ValueError("test needs --spec or --suite")
            with progress(spark, a.suite or ", ".join(a.csv or a.spec), a.progress_interval, suite.show_bytes):
                if a.suite:
                    runs = suite.run_suite(spark, a.suite, a.max_issues)
                else:
                    runs = suite.run_plans(spark, suite.plans([(x, ct.parse(_read(x))) for x in a.spec], suite.within_folders(spark, a.csv)), a.max_issues)
            print(json.dumps(suite.as_json(runs), indent=2) if a.format == "json" else suite.as_text(runs))
            if a.html:
                _save(a.html, suite.as_html(runs), True)
            return 2 if any(r.error for r in runs) else 0 if suite.rollup(runs)["valid"] else 1
        if a.command == "init":
            needed = a.sample_rows if a.infer_constraints else 1 if not a.no_sample_tests else 0
            head = head_csv(spark, a.csv, needed, a.delimiter)
            contract, sampled = outline(head, needed, a.infer_constraints, not a.no_sample_tests), head.frame.count()
            contract["csv"]["delimiter"] = a.delimiter
            place = _relative(a.csv, os.path.dirname(os.path.abspath(a.out)))
            contract["targets"] = [{"path": place}]
            said = f"Constraint values were inferred from the first {sampled} data rows and must be reviewed." if a.infer_constraints else NOT_INFERRED
            _save(a.out, "".join(f"# {line}\n" for line in (f"Generated from {os.path.basename(a.csv)}.", REVIEW, said)) + ct.dump(contract), a.force)
            print(f"Created {os.path.abspath(a.out)} ({len(head.header)} columns, {sampled} sampled rows).")
            return 0
        made = compare(from_csv(spark, a.left, a.delimiter), from_csv(spark, a.right, a.delimiter), Options(keys=a.keys, context=a.context, ignored=a.ignored, trim=a.trim, case_fold=a.case_fold, blank_null=a.blank_null, dates=a.dates, decimals=a.decimals))
        summary = made.summary()
        if a.evidence:
            write_evidence(made, a.evidence)
        print(json.dumps(summary, indent=2))
        return summary["exit_code"]
    except (ValueError, OSError, ComparisonError) as error:
        print(str(error), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
