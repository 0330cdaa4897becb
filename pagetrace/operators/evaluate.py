"""Scoring against labelled sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def score_cases(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """case_id, tp, fp, fn from (case_id, page_path) sets; repeated pages count once."""
    e = expected.select("case_id", "page_path").distinct().withColumn("_e", F.lit(True))
    a = actual.select("case_id", "page_path").distinct().withColumn("_a", F.lit(True))
    both = e.join(a, ["case_id", "page_path"], "full_outer")
    return both.groupBy("case_id").agg(
        F.count_if(F.col("_e").isNotNull() & F.col("_a").isNotNull()).alias("tp"),
        F.count_if(F.col("_e").isNull()).alias("fp"),
        F.count_if(F.col("_a").isNull()).alias("fn"),
    )


def micro(cases: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the summed counts; 0 where undefined."""
    total = cases.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    rated = total.withColumn("precision", _rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _rate(F.col("tp"), F.col("tp") + F.col("fn")))
    return rated.withColumn("f1", _rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def breaches(metrics: DataFrame, floors: dict[str, float | None]) -> DataFrame:
    """metric, value, floor for every floor that is set and undershot."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(f).cast("double").alias("floor")) for m, f in floors.items()))
    return metrics.select(F.explode(pairs).alias("x")).select("x.*").where("value < floor")
