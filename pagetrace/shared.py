"""The folder that driver and executors share, and what is kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; only a local session may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagetrace-")
    return f"{found.rstrip('/')}/pagetrace-{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str = "rows") -> DataFrame:
    """df written to the shared folder and read again: it is computed once, and its rows stay where they are."""
    at = folder(df.sparkSession, tag)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt out to some tasks for each core: a table in one file of one block is read by a single task, which would also do all the work on its rows."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `_range` and `_place`: ranges of that order, and the place in each of them.  What would need a whole group in order can be done by range and added up."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # an id has its partition above 33 bits, and its place in it below
    placed = kept(ranges.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    return placed.withColumn("_range", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `number`, from 0, in that order over all of them; no task holds more than a range."""
    placed = in_ranges(rows, *order)
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = placed.groupBy(F.col("_range").alias("_r")).count().select("_r", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(base), F.col("_range") == F.col("_r")).withColumn("number", F.col("_base") + F.col("_place")).drop("_range", "_place", "_r", "_base")
