"""Suites: contracts grouped by the target they check, so that each target is scanned once per set of reading options."""

from __future__ import annotations

import os
import re
import time
import urllib.parse
import urllib.request
import uuid
from contextlib import ExitStack, contextmanager
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from veritab.operators.number import shared_dir
from veritab.operators.validate import Result, validate_files
from veritab.sources import contracts as ct
from veritab.sources.records import open_files

#: Folders of a workspace that hold no contracts of its own.
LEFT_OUT = {"node_modules", ".git", "dist", ".vscode-test", ".vscode-test-web"}
#: Bytes of a URL target that the driver holds at once.
CHUNK = 1 << 20


@dataclass
class Run:
    spec: str
    target: str
    result: Result | None
    error: str | None = None
    seconds: float = 0.0
    size: int = 0


def show_bytes(n: float) -> str:
    units = ("B", "KB", "MB", "GB", "TB")
    k = 0
    while n >= 1024 and k < len(units) - 1:
        n, k = n / 1024, k + 1
    return f"{n:.{1 if k else 0}f} {units[k]}"


def show_duration(ms: float) -> str:
    if ms < 1000:
        return f"{max(0, round(ms))} ms"
    if ms < 60_000:
        return f"{ms / 1000:.{1 if ms < 10_000 else 0}f} sec"
    return f"{int(ms // 60_000)} min {round(ms % 60_000 / 1000)} sec"


def resolve(spec: str, target: dict) -> str:
    """A configured target's address; paths are relative to the contract."""
    if "url" in target:
        if not is_url(target["url"]):
            raise ValueError(f"{spec}: a target's URL must use HTTP or HTTPS, not {target['url']}")
        return target["url"]
    if not (target.get("path") or "").strip():
        raise ValueError(f"{spec}: a target must have a path or a URL")
    return os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(spec)), target["path"]))


def is_url(target: str) -> bool:
    return re.match("https?://", target, re.IGNORECASE) is not None


def located(target: str) -> str:
    """One spelling of a target: a URL with its scheme and host in lower case, an absolute path; names of other file systems stay."""
    if is_url(target):
        parts = urllib.parse.urlsplit(target)
        return parts._replace(scheme=parts.scheme.lower(), netloc=parts.netloc.lower(), path=parts.path or "/").geturl()
    return target if re.match("[a-zA-Z][a-zA-Z0-9+.-]+:/", target) else os.path.abspath(target)


def within_folders(spark: SparkSession, targets: list[str]) -> list[str]:
    """Targets, with a folder's CSV files in its place."""
    out = []
    for target in targets:
        path, files = (None, None) if is_url(target) else _file(spark, target)
        if path is not None and files.exists(path) and files.getFileStatus(path).isDirectory():
            base = target.rstrip("/")
            out += sorted(f"{base}/{name}" for name in (s.getPath().getName() for s in files.listStatus(path)) if name.lower().endswith(".csv"))
        else:
            out.append(target)
    return out


def plans(specs: list[tuple[str, dict]], explicit: list[str] | str | None = None) -> dict[str, list[tuple[str, dict]]]:
    """target -> the contracts that check it, each once. Explicit targets take the place of the configured ones, for every contract."""
    given = [explicit] if isinstance(explicit, str) else list(explicit or [])
    out: dict[str, list[tuple[str, dict]]] = {}
    if given:
        for t in map(located, given):
            own = out.setdefault(t, [])
            own += [(spec, contract) for spec, contract in specs if spec not in [s for s, _ in own]]
        return out
    for spec, contract in specs:
        targets = [located(resolve(spec, t)) for t in contract.get("targets", [])]
        if not targets:
            raise ValueError(f"{spec} has no targets, and none was given")
        for t in targets:
            own = out.setdefault(t, [])
            if spec not in [s for s, _ in own]:
                own.append((spec, contract))
    return out


def _file(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def local(spark: SparkSession, target: str):
    """The target's path; a URL is copied in chunks to a new folder that driver and executors share, which goes afterwards."""
    if not is_url(target):
        yield target
        return
    path, files = _file(spark, f"{shared_dir(spark)}/veritab-{uuid.uuid4().hex}/target.csv")
    try:
        with urllib.request.urlopen(target) as got:  # raises for other answers than 2xx
            out = files.create(path)
            try:
                while chunk := got.read(CHUNK):
                    out.write(chunk, 0, len(chunk))
            finally:
                out.close()
            if got.length:  # reads in chunks end without an error where the connection does
                raise OSError(f"{target} ended {got.length} bytes early")
        yield path.toString()
    finally:
        files.delete(path.getParent(), True)


def run_plans(spark: SparkSession, planned: dict, max_issues: int = 1000) -> list[Run]:
    """One scan for all targets that the same contracts check and read alike, however many. A target that cannot be read gives error entries."""
    batches: dict[tuple, tuple[list[tuple[str, dict]], list[str]]] = {}
    for target, specs in planned.items():
        groups: dict[tuple, list[tuple[str, dict]]] = {}
        for spec, contract in specs:
            o = ct.csv_options(contract)
            groups.setdefault((o["delimiter"], o["quote"], o["allowBlankRows"]), []).append((spec, contract))
        for how, group in groups.items():
            batches.setdefault((how, tuple(s for s, _ in group)), (group, []))[1].append(target)
    out = []
    for (how, _), (group, targets) in batches.items():
        out += _run_batch(spark, how, group, targets, max_issues)
    return sorted(out, key=lambda r: (r.spec, r.target))


def _run_batch(spark: SparkSession, how: tuple, group: list[tuple[str, dict]], targets: list[str], max_issues: int) -> list[Run]:
    """Runs of contracts on targets. What the batch took is shared out by the targets' bytes."""
    failed = lambda target, error: [Run(s, target, None, str(error).split("\n")[0]) for s, _ in group]
    out, by_path, sizes, began = [], {}, {}, time.monotonic()
    with ExitStack() as copies:
        for target in targets:
            try:
                path = copies.enter_context(local(spark, target))
                at, files = _file(spark, path)
                if not files.exists(at):
                    raise FileNotFoundError(f"{target} does not exist")
                sizes[target], by_path[path] = files.getFileStatus(at).getLen(), target
            except Exception as error:  # noqa: BLE001  one target's failure is a finding of the suite
                out += failed(target, error)
        done = []
        try:
            records, errors = open_files(spark, list(by_path), *how)
        except Exception as error:  # noqa: BLE001
            records, errors = [], dict.fromkeys(by_path, error)
        for path, error in errors.items():
            out += failed(by_path[path], error)
        for some in records:
            try:
                done += zip(some.files, validate_files(some, [c for _, c in group], max_issues))
            except Exception as error:  # noqa: BLE001
                out += [r for path in some.files for r in failed(by_path[path], error)]
        share = (time.monotonic() - began) / max(1, sum(sizes[by_path[path]] for path, _ in done))
        for path, results in done:
            target = by_path[path]
            out += [Run(s, target, r, None, sizes[target] * share, sizes[target]) for (s, _), r in zip(group, results)]
    return out


def run_suite(spark: SparkSession, folder: str, max_issues: int = 1000) -> list[Run]:
    """Every contract under a folder; those that cannot be parsed are error entries."""
    specs, broken = [], []  # a contract without targets is a finding of its own, not the end of the run
    for path in sorted([*Path(folder).rglob("*.csvtest.yaml"), *Path(folder).rglob("*.csvtest.yml")]):
        if LEFT_OUT & set(path.relative_to(folder).parts[:-1]):
            continue
        try:
            specs.append((str(path), ct.parse(path.read_text("utf-8"))))
            plans(specs[-1:])
        except Exception as error:  # noqa: BLE001
            specs = [s for s in specs if s[0] != str(path)]
            broken.append(Run(str(path), "", None, str(error)))
    return broken + run_plans(spark, plans(specs), max_issues)


def rollup(runs: list[Run]) -> dict:
    good = [r for r in runs if r.result and r.result.valid]
    return {"valid": bool(runs) and len(good) == len(runs), "runs": len(runs), "passed": len(good), "failed": len(runs) - len(good), "targets": len({r.target for r in runs if r.target})}


def _targets(runs: list[Run]) -> dict[str, list[Run]]:
    out: dict[str, list[Run]] = {}
    for r in runs:
        out.setdefault(r.target, []).append(r)
    return out


def _passed(runs: list[Run]) -> bool:
    return bool(runs) and all(r.result and r.result.valid for r in runs)


def _timing(runs: list[Run]) -> dict:
    """What reading one target took: contracts that are read alike share a pass."""
    passes = {(r.seconds, r.size) for r in runs if r.result}
    seconds, rows = sum(t for t, _ in passes), max((r.result.row_count for r in runs if r.result), default=0)
    return {"durationMs": round(seconds * 1000), "rowsPerSecond": round(rows / seconds) if seconds else 0, "bytesRead": sum(b for _, b in passes), "passes": len(passes)}


def as_json(runs: list[Run]) -> dict:
    """One object for a single target, else {valid, files}."""
    entry = lambda r: {"spec": r.spec, "error": r.error, "result": asdict(r.result) if r.result else None}
    files = [{"csv": t, "valid": _passed(own), "runs": [entry(r) for r in own], "performance": _timing(own)} for t, own in _targets(runs).items()]
    return files[0] if len(files) == 1 else {"valid": _passed(runs), "files": files}


def issue_line(i: dict) -> str:
    where = [x for x in (i["column"], f"record {i['row']}" if i["row"] is not None else None, i["test_id"]) if x]
    return f"{i['code']}{' [' + ' · '.join(where) + ']' if where else ''}: {i['message']}"


def as_text(runs: list[Run]) -> str:
    lines, word = [], lambda good: "PASS" if good else "FAIL"
    targets = _targets(runs)
    for target, own in targets.items():
        lines.append(f"{word(_passed(own))} {target}")
        for r in own:
            if not r.result:
                lines.append(f"  FAIL {r.spec} — {r.error}")
                continue
            shown = f"; showing first {len(r.result.issues)}" if r.result.issue_count > len(r.result.issues) else ""
            lines.append(f"  {word(r.result.valid)} {r.spec} — {r.result.row_count:,} rows, {r.result.column_count} columns, {r.result.issue_count:,} issues{shown}")
            lines += [f"    {issue_line(i)}" for i in r.result.issues]
        if not any(r.result for r in own):
            continue
        p = _timing(own)
        lines.append(f"  Performance: {show_duration(p['durationMs'])}, {p['rowsPerSecond']:,} rows/s, {show_bytes(p['bytesRead'])} read, {p['passes']} pass(es)")
    if len(targets) > 1:
        lines.append(f"{word(_passed(runs))} {len(targets)} CSV targets.")
    return "\n".join(lines)


def as_html(runs: list[Run]) -> str:
    from html import escape

    sums = rollup(runs)
    rows = "".join(
        f"<tr><td>{'PASS' if r.result and r.result.valid else 'FAIL'}</td><td>{escape(r.spec)}</td><td>{escape(r.target)}</td><td>{r.result.issue_count if r.result else escape(r.error or '')}</td></tr>"
        + "".join(f"<tr><td></td><td colspan=3>{escape(issue_line(i))}</td></tr>" for i in (r.result.issues if r.result else []))
        for r in runs
    )
    return f"<!doctype html><meta charset=utf-8><title>Suite</title><h1>{sums['passed']} of {sums['runs']} passed</h1><table>{rows}</table>"
