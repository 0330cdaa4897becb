"""What every operator of this subpackage needs from the session."""

from __future__ import annotations

import gc
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a local session has none (as in tests) is a folder of our own set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext.getCheckpointDir()
        found = posixpath.dirname(at) if at else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagetrace-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/pagetrace-{tag}-{uuid.uuid4().hex}"


def in_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """df, whose whole texts go to Python in Arrow batches of `most` bytes, unless the session sets a limit of its own.

    Spark's own limit is eight times that, twice in the JVM and once more in each worker.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(limit, "67108864b") in ("67108864b", "64m", "64MB"):
        df.sparkSession.conf.set(limit, most)
    return df


def stash(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; Spark's cleaner drops it once unused."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles and checkpoints that nothing refers to any more; else they stay until the driver's heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
