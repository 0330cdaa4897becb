"""Structured Streaming jobs: event ingest, cursors, monthly spend, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagetrace.sources.events import parse_events


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """Rows of the Parquet files that arrive at a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def parsed_stream(spark: SparkSession, path: str) -> DataFrame:
    """CI events (JSON lines) as changes; unknown ones are left out."""
    raw = spark.readStream.text(path)
    return parse_events(raw).where("kind <> 'unknown'")


def once(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """First event of each key; state is dropped once events may no longer be that late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, path: str, mode: str, checkpoint: str) -> StreamingQuery:
    """What is there now, each batch's rows as a new version of a Parquet folder (see `current_cursors`)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to a log of JSON lines; each is written once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def retained(stream: DataFrame, time: str, keep: int, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest `keep` rows of a stream in a Parquet folder; a batch that is run again changes nothing."""

    def compact(batch: DataFrame, batch_id: int) -> None:
        old = current_cursors(batch.sparkSession, path, batch_id)
        both = batch if old is None else batch.unionByName(old)
        order = [F.desc(time), *(F.desc(c) for c in sorted(batch.columns) if c != time)]
        both.orderBy(*order).limit(keep).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return stream.writeStream.foreachBatch(compact).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cursors(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Latest value of each key."""
    return stream.groupBy(key).agg(F.max(F.struct(time, value)).alias("last")).select(key, F.col(f"last.{value}").alias(value))


def month_totals(stream: DataFrame, time: str, amount: str) -> DataFrame:
    """Sum of each calendar month (months differ in length, so no fixed window)."""
    return stream.groupBy(F.date_trunc("month", F.col(time)).cast("timestamp").alias("month")).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))


def upsert_cursors(stream: DataFrame, key: str, time: str, value: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest value of each key in a Parquet folder; a batch that is run again changes nothing.

    Each batch writes a new version and the marker that names it comes last, so
    readers of `current_cursors` never see half of one.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(key, time, value)
        old = current_cursors(spark, path, batch_id)
        both = new if old is None else new.unionByName(old)
        last = both.groupBy(key).agg(F.max(F.struct(time, value)).alias("last")).select(key, f"last.{time}", f"last.{value}")
        last.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_cursors(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest whole version (one with Spark's _SUCCESS marker) earlier than `before`, if any."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    whole = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if s.getPath().getName().startswith("version=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    versions = [v for v in whole if before is None or v < before]
    return spark.read.parquet(f"{path}/version={max(versions)}") if versions else None
