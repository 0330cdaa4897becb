"""Run history and model cost: roll-ups, running sums, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrace.shared import in_ranges


def drop_reason(note: Column) -> Column:
    """Why a page was dropped, by how its note begins; null if it wasn't."""
    # fixed values: how the notes of dropped pages begin
    return (
        F.when(note.startswith("dropped by validation"), "validation")
        .when(note.startswith("dropped by self-critique"), "critique")
        .when(note.startswith("edit not applicable"), "not_applicable")
        .when(note.startswith("edit generation failed") | note.startswith("page not found") | note.startswith("unexpected error"), "error")
    )


def overview(runs: DataFrame) -> DataFrame:
    """One row over runs (command, status, calls, hit_rate, cost, updated, authored, ts): counts, success share, hit rate of runs with calls, cost, first and last time."""
    total = lambda c, only=F.lit(True): F.coalesce(F.sum(F.when(only, F.col(c))), F.lit(0))
    bootstrap = F.col("command") == "bootstrap"
    return runs.agg(
        F.count("*").alias("runs"),
        F.count_if(~bootstrap).alias("run_count"),
        F.count_if(bootstrap).alias("bootstrap_count"),
        total("updated", ~bootstrap).alias("updated"),
        total("authored", bootstrap).alias("authored"),
        total("cost").cast("double").alias("cost"),
        total("calls").alias("calls"),
        F.coalesce(F.try_divide(F.count_if(F.col("status") != "error").cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(F.when(F.col("calls") > 0, F.col("hit_rate"))), F.lit(0.0)).alias("mean_hit_rate"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def page_overview(pages: DataFrame) -> DataFrame:
    """One row over pages (command, note, applied) of `run` commands: attempted (not skipped), dropped and their share."""
    tried = (F.col("command") == "run") & ~F.col("note").startswith("skipped:")
    counts = pages.where(tried).agg(F.count("*").alias("attempted"), F.count_if(~F.col("applied") & drop_reason(F.col("note")).isNotNull()).alias("dropped"))
    return counts.withColumn("drop_rate", F.coalesce(F.try_divide(F.col("dropped").cast("double"), F.col("attempted").cast("double")), F.lit(0.0)))


def page_summaries(outcomes: DataFrame, originals: DataFrame) -> DataFrame:
    """outcomes (page_path, applied, note, edits, passed, warnings, new_content) with edit_count, rationales, warnings (none if null) and the page's text before (null if there is none)."""
    before = originals.groupBy("page_path").agg(F.max("text").alias("before"))
    edits = F.coalesce("edits", F.array().cast(outcomes.schema["edits"].dataType))
    told = outcomes.withColumns({"edit_count": F.size(edits).cast("long"), "rationales": F.transform(edits, lambda e: e["rationale"]), "warnings": F.coalesce("warnings", F.array().cast("array<string>"))})
    return told.drop("edits").join(before, "page_path", "left").withColumn("changed", F.coalesce(F.col("before") != F.col("new_content"), F.lit(False)))


def usage_rows(runs: DataFrame) -> DataFrame:
    """One row for each model and stage of runs (run_id, by_model): tokens are those of the prompt and of the output."""
    each = runs.select("run_id", F.explode("by_model").alias("m"))
    return each.select("run_id", "m.model", "m.stage", "m.calls", (F.col("m.prompt_tokens") + F.col("m.output_tokens")).alias("tokens"), "m.cost_usd")


def drops_by_reason(pages: DataFrame) -> DataFrame:
    """reason, n over the pages (command, note, applied) of `run` commands that were dropped, not skipped."""
    reason = drop_reason(F.col("note"))
    kept = pages.where((F.col("command") == "run") & ~F.col("note").startswith("skipped:") & ~F.col("applied"))
    return kept.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def cost_over_time(runs: DataFrame, by: str) -> DataFrame:
    """Runs with cumulative cost in time order within `by`; a null cost is 0.

    Costs are added up within ranges of that order, and ranges after each other, so
    no task holds all runs of one `by`.
    """
    cost = F.coalesce("cost", F.lit(0.0))
    placed = in_ranges(runs, by, "ts", "ord")
    own = Window.partitionBy(by, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_by").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = placed.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_r")).agg(F.sum(cost).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    both = placed.withColumn("_own", F.sum(cost).over(own)).join(base, (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by")))
    return both.withColumn("cumulative", F.col("_base") + F.col("_own")).drop("_range", "_place", "_own", "_by", "_r", "_sum", "_base")


def model_stages(usage: DataFrame) -> DataFrame:
    """model, stage: calls, tokens, cost; a null stage is a group."""
    return usage.groupBy("model", "stage").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """model_stages and, in the row without either, the grand total (is_total 1)."""
    rate = F.try_divide(F.sum("cache_read").cast("double"), F.sum(F.col("input_tokens") + F.col("cache_write") + F.col("cache_read")))
    return usage.groupingSets([["model", "stage"], []], "model", "stage").agg(
        F.grouping("model").cast("long").alias("is_total"),
        *(F.sum(c).alias(c) for c in ("calls", "input_tokens", "cache_write", "cache_read")),
        F.coalesce(rate, F.lit(0.0)).alias("hit_rate"),
    )


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with the price row of the longest prefix of its model (else the fallback) and its cost in USD.

    prices: prefix, input, output, cache_write, cache_read (USD a million tokens), is_fallback; without a fallback
    row, other models have no price and no cost.  Prices are found once for each distinct model, by equality with
    each beginning of its name, not for each row.
    """
    models = usage.select(F.col("model")).distinct()
    begins = models.withColumn("prefix", F.explode_outer(F.when(F.length("model") > 0, F.transform(F.sequence(F.lit(0), F.length("model")), lambda n: F.substring(F.col("model"), F.lit(1), n)))))
    named = models.join(begins.join(prices.where("not is_fallback"), "prefix"), "model", "left")
    best = named.withColumn("_n", F.row_number().over(Window.partitionBy("model").orderBy(F.desc(F.length("prefix"))))).where("_n = 1").drop("_n", "is_fallback")
    other = prices.where("is_fallback").first()
    best = best.select("model", "prefix", *(F.when(F.col("prefix").isNull(), F.lit(other[c] if other else None).cast("double")).otherwise(F.col(c)).alias("price_" + c) for c in ("input", "output", "cache_write", "cache_read")))
    cost = sum((F.col(t) * F.col("price_" + p) for t, p in (("input_tokens", "input"), ("output_tokens", "output"), ("cache_write", "cache_write"), ("cache_read", "cache_read"))), F.lit(0.0)) / F.lit(1e6)
    return usage.join(best, usage["model"].eqNullSafe(best["model"])).drop(best["model"]).withColumn("cost", cost)


def month_budget(costs: DataFrame, now: str, budget: float) -> DataFrame:
    """Spend of the month of `now`, its projection to the month's end, and whether that is over the budget.

    `now` and the month's ends are in UTC, whatever the session's zone is; ts is a timestamp.
    """
    at = F.to_timestamp_ntz(F.lit(now))
    month = F.date_trunc("month", at).cast("timestamp_ntz")
    utc = lambda t: F.convert_timezone(F.lit("UTC"), F.current_timezone(), t).cast("timestamp")
    start, end = utc(month), utc(F.add_months(month, 1).cast("timestamp_ntz"))
    seconds = lambda a, b: (F.unix_timestamp(b) - F.unix_timestamp(a)).cast("double")
    part = F.least(F.lit(1.0), seconds(start, utc(at)) / seconds(start, end))
    spent = costs.where((F.col("ts") >= start) & (F.col("ts") < end)).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent"))
    return spent.withColumn("projected", F.coalesce(F.try_divide(F.col("spent"), part), F.col("spent"))).withColumn("over", F.col("projected") > budget)


def newest(runs: DataFrame, n: int) -> DataFrame:
    """The last n runs, newest first."""
    return runs.orderBy(F.desc("ts"), F.desc("ord")).limit(n)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key by ts, ord."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("ord")))).where("_n = 1").drop("_n")


def bootstrap_counts(plan: DataFrame) -> DataFrame:
    """run_id, counts: planned, authored and skipped pages of each bootstrap (run_id, state)."""
    counted = plan.groupBy("run_id").agg(F.count("*").alias("planned"), *(F.count_if(F.col("state") == s).alias(s) for s in ("authored", "skipped")))
    return counted.select("run_id", F.create_map(*(x for c in ("planned", "authored", "skipped") for x in (F.lit(c), F.col(c)))).alias("counts"))


def run_counts(pages: DataFrame) -> DataFrame:
    """run_id, counts: impacted, updated and the rest of each run's pages (run_id, applied)."""
    counted = pages.groupBy("run_id").agg(F.count("*").alias("impacted"), F.count_if("applied").alias("updated"))
    return counted.select("run_id", F.create_map(F.lit("impacted"), "impacted", F.lit("updated"), "updated", F.lit("dropped"), F.col("impacted") - F.col("updated")).alias("counts"))
