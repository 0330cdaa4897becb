"""The run log: JSON lines, read tolerantly, appended to, and kept to its newest lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrace import schemas


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a log; lines that aren't whole JSON records of the schema, and blank ones, are left out."""
    return parse_lines(spark.read.text(path))


def parse_lines(lines: DataFrame) -> DataFrame:
    parsed = F.from_json("value", schemas.RUN + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.where(F.trim("value") != "").select(parsed.alias("r")).where("r._bad is null and r.timestamp is not null").select("r.*").drop("_bad")


def append(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def newest(runs: DataFrame, keep: int = 1000) -> DataFrame:
    """The newest runs by parsed time, oldest first; of runs of one time the later head_sha counts as newer."""
    at = F.try_to_timestamp("timestamp")
    return runs.orderBy(at.desc_nulls_last(), F.desc("timestamp"), F.desc("head_sha")).limit(keep).orderBy(at, "timestamp", "head_sha")


def latest_cursors(runs: DataFrame) -> DataFrame:
    """repo, head_sha of each repository's last run."""
    last = Window.partitionBy("repo").orderBy(F.try_to_timestamp("timestamp").desc(), F.desc("head_sha"))
    return runs.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("repo", "head_sha")


def pages_of(runs: DataFrame) -> DataFrame:
    return runs.select("command", "timestamp", F.explode("pages").alias("p")).select("command", "timestamp", "p.*")


def usage_of(runs: DataFrame) -> DataFrame:
    return runs.select("timestamp", F.explode("usage.by_model").alias("u")).select("timestamp", "u.*")
