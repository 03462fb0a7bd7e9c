"""Global numbers and sums, and rows repeated any number of times, without one task that sees all rows or those of one key."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master, as in tests, gets a temporary one where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veritab-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def written(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: later reads agree, the lineage ends there, and a lost executor costs nothing. It is removed when the driver ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/veritab-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(f"{folder}/{name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def _ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` in range partitions of the given order, as a written table with each row's partition ``_p`` and place ``_k`` in it."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def _started(sums: DataFrame) -> Column:
    """From (_p, sum): what the partitions before a row's partition add up to. One number per partition reaches the driver."""
    before, total = {}, 0
    for p, n in sorted(map(tuple, sums.collect())):
        before[p], total = total, total + n
    return F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("_p")) if before else F.lit(0)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` plus ``name``, 1 to n in the given order (which must be total): range partitions are sorted and their sizes added up."""
    rows = _ranged(df, *order)
    start = _started(rows.groupBy("_p").count())
    return rows.withColumn(name, (start + F.col("_k") + 1).cast("long")).drop("_p", "_k")


def running(df: DataFrame, name: str, value: Column, *order: Column) -> DataFrame:
    """``df`` plus ``name``, the sum of ``value`` (not null) over the rows before, in the given order (which must be total). A task adds up one range partition."""
    rows = _ranged(df.withColumn("_v", value.cast("long")), *order)
    start = _started(rows.groupBy("_p").agg(F.sum("_v")))
    within = F.sum("_v").over(Window.partitionBy("_p").orderBy("_k")) - F.col("_v")
    return rows.withColumn(name, (start + within).cast("long")).drop("_p", "_k", "_v")


def repeated(df: DataFrame, times: Column, block: int = 1 << 16) -> DataFrame:
    """Rows of ``df`` as often as ``times`` (a long from 1 to block ** 3) says. Where that is more than ``block``, rows become blocks, which are dealt out and
    only then become rows; no array has more than ``block`` numbers."""
    rows, names = df.withColumn("_n", times.cast("long")), df.columns
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, as blocks are small but what becomes of them isn't
    few = rows.where(F.col("_n") <= block).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    last = F.col("_n") - 1
    up_to = lambda most: F.explode(F.sequence(F.lit(0).cast("long"), F.least(most, F.lit(block - 1).cast("long"))))
    whole = lambda x, by: F.expr(f"({x}) div {by}")
    many = rows.where(F.col("_n") > block).withColumn("_a", up_to(whole("_n - 1", block * block))).repartition(parts, "_a", *names)
    many = many.withColumn("_b", up_to(whole("_n - 1", block) - F.col("_a") * block)).repartition(parts, "_a", "_b", *names)
    many = many.withColumn("_i", up_to(last - (F.col("_a") * block + F.col("_b")) * block))
    return few.select(*names).unionByName(many.select(*names))
