"""Changed files and hunks from unified diffs and from compare responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrace import schemas


def hunks_of(patch: Column) -> Column:
    """A patch's parts from each line that begins with @@ on; what comes before the first goes; null has none."""
    parts = F.split(patch, r"\n(?=@@)")
    return F.coalesce(F.filter(parts, lambda h: h.startswith("@@")), F.array().cast("array<string>"))


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """diff_id, ord, path, status, previous_path, hunks of every file of unified diffs (diff_id, text).

    A file that is at once several things is added before removed before renamed
    before modified.
    """
    files = diffs.select("diff_id", F.posexplode(F.filter(F.split("text", r"(?m)^(?=diff --git )"), lambda p: p.startswith("diff --git "))).alias("ord", "part"))
    old = F.regexp_extract("part", r"(?m)^--- (?:a/)?([^\n\t]+)", 1)
    new = F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?([^\n\t]+)", 1)
    named = F.regexp_extract("part", r"^diff --git a/(.*?) b/([^\n]*)", 2)
    source = F.regexp_extract("part", r"(?m)^rename from ([^\n]+)", 1)
    target = F.regexp_extract("part", r"(?m)^rename to ([^\n]+)", 1)
    status = F.when(F.col("part").rlike(r"(?m)^new file mode") | (old == "/dev/null"), "added").when(F.col("part").rlike(r"(?m)^deleted file mode") | (new == "/dev/null"), "removed").when(source != "", "renamed").otherwise("modified")
    path = F.when(status == "removed", F.when(old != "", old).otherwise(named)).when(target != "", target).when((new != "") & (new != "/dev/null"), new).otherwise(named)
    return files.select("diff_id", F.col("ord").cast("long").alias("ord"), path.alias("path"), status.alias("status"), F.when(status == "renamed", source).alias("previous_path"), hunks_of(F.regexp_replace("part", r"\n\z", "")).alias("hunks"))


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """Unified diffs, one to a file of the folder."""
    return parse_diffs(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("diff_id"), F.col("value").alias("text")))


def compared_files(responses: DataFrame) -> DataFrame:
    """The same columns from compare responses (diff_id, files): `changed` is modified, `copied` is added, unknown is modified."""
    each = responses.select("diff_id", F.posexplode("files").alias("ord", "f"))
    s = F.col("f.status")
    status = F.when(s.isin("added", "copied"), "added").when(s.isin("removed", "renamed"), s).otherwise("modified")
    return each.select("diff_id", F.col("ord").cast("long").alias("ord"), F.col("f.filename").alias("path"), status.alias("status"), F.when(status == "renamed", F.col("f.previous_filename")).alias("previous_path"), hunks_of(F.col("f.patch")).alias("hunks"))


def read_compare(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.COMPARE).json(path, multiLine=True)
    return compared_files(raw.select(F.col("_metadata.file_name").alias("diff_id"), "files"))


def changed_paths(files: DataFrame) -> DataFrame:
    """diff_id, ord, path: each file's path and, of a renamed file, the one before."""
    return files.select("diff_id", "ord", F.explode(F.array_compact(F.array("path", "previous_path"))).alias("path"))
