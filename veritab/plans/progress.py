"""Lines on standard error while a job runs: the rows and bytes that Spark's stages have read so far."""

from __future__ import annotations

import sys
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def progress(spark: SparkSession, what: str, every: int, show_bytes, pause: float = 0.5) -> Iterator[None]:
    """A line whenever at least ``every`` more rows were read (0: none), from a thread that asks Spark's status every ``pause`` seconds; and one at the end if any was."""
    if not every:
        yield
        return
    done, seen, shown = threading.Event(), {}, [0]
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()

    def look(last: bool = False) -> None:
        for stage in {*tracker.getActiveStageIds(), *seen}:
            if seen.get(stage, (0, 0, False))[2]:
                continue
            try:
                data = store.lastStageAttempt(stage)
                seen[stage] = data.inputRecords(), data.inputBytes(), str(data.status()) not in ("ACTIVE", "PENDING")
            except Exception:  # noqa: BLE001  what Spark no longer knows of a stage stays as it was
                seen.setdefault(stage, (0, 0, True))
        rows, read = (sum(x[k] for x in seen.values()) for k in (0, 1))
        if rows - shown[0] >= every or (last and rows > shown[0] > 0):
            shown[0] = rows
            print(f"Progress {what}: {rows:,} rows, {show_bytes(read)} read", file=sys.stderr, flush=True)

    def watch() -> None:
        while not done.wait(pause):
            look()

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        done.set()
        watcher.join()
        look(last=True)
