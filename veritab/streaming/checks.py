"""Row checks on streams: they keep no state, so they run on ``readStream`` as they are. Uniqueness and counts stay with batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritab.operators.validate import bind, cell_issues
from veritab.sources.records import from_frame


def stream_issues(stream: DataFrame, contract: dict, rec: str) -> DataFrame:
    """The issues of each arriving row; ``rec`` names its number."""
    records = from_frame(stream, F.col(rec))
    return cell_issues(bind(contract, records), records).drop("phase", "ord")


def write_issues(stream: DataFrame, contract: dict, rec: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append the issues to Parquet, exactly once per checkpoint."""
    issues = stream_issues(stream, contract, rec)
    return issues.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
