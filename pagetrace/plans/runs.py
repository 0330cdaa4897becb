"""Run-history, cost and evaluation queries: events stand for runs, documents and labels for golden cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrace.operators import evaluate, history, replies
from pagetrace.sources import events as ci
from pagetrace.sources import history as log
from pagetrace.shared import dealt, folder
from pagetrace.streaming import heads, jobs

from .registry import query, read


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    command = F.when(F.col("event_type").isin("signup", "purchase"), "bootstrap").otherwise("run")
    return e.select(
        "event_id", "user_id", F.col("event_id").alias("ord"), command.alias("command"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        (F.col("event_id") % 4).alias("calls"), ((F.col("event_id") % 11).cast("double") / 10).alias("hit_rate"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("cost"), "event_type",
        F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 5).alias("updated"), (F.col("event_id") % 2).alias("authored"),
    )


_SHOWN = "event_type NOT IN ('signup', 'purchase')"


@query(f"""SELECT count(*) AS runs, count(*) FILTER ({_SHOWN}) AS run_count, count(*) FILTER (NOT {_SHOWN}) AS bootstrap_count,
  CAST(coalesce(sum(CASE WHEN event_id % 3 > 0 THEN event_id % 5 END) FILTER ({_SHOWN}), 0) AS BIGINT) AS updated, CAST(coalesce(sum(event_id % 2) FILTER (NOT {_SHOWN}), 0) AS BIGINT) AS authored, round(sum(value), 2) AS cost, CAST(sum(event_id % 4) AS BIGINT) AS calls,
  round(CAST(count(*) FILTER (event_type <> 'error') AS DOUBLE) / count(*), 6) AS success_rate, round(avg(CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 11 AS DOUBLE) / 10 END), 6) AS mean_hit_rate,
  strftime(min(ts), '%Y-%m-%d %H:%M') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_ts FROM events""")
def dashboard_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = history.overview(_runs(spark, sf_dir))
    return o.select("runs", "run_count", "bootstrap_count", "updated", "authored", F.round("cost", 2).alias("cost"), "calls", F.round("success_rate", 6).alias("success_rate"), F.round("mean_hit_rate", 6).alias("mean_hit_rate"), *(F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("first_ts", "last_ts")))


_NOTES = ["skipped: over the cap", "dropped by validation: structure", "dropped by self-critique", "edit not applicable", "edit generation failed: timeout", "page not found", "unexpected error: x", "no edits", "applied"]
_NOTED = f"(SELECT *, [{', '.join(repr(n) for n in _NOTES)}][event_id % 9 + 1] AS note, event_id % 9 = 8 AS applied, event_id % 9 AS k FROM events)"


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.element_at(F.array(*map(F.lit, _NOTES)), (F.col("event_id") % 9 + 1).cast("int"))
    return _runs(spark, sf_dir).select("event_id", "user_id", "command", note.alias("note"), (F.col("event_id") % 9 == 8).alias("applied"))


@query(f"""SELECT CASE WHEN k = 1 THEN 'validation' WHEN k = 2 THEN 'critique' WHEN k = 3 THEN 'not_applicable' ELSE 'error' END AS reason, count(*) AS n FROM {_NOTED} WHERE {_SHOWN} AND k BETWEEN 1 AND 6 GROUP BY 1""")
def drops_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.drops_by_reason(_noted(spark, sf_dir))


@query(f"""SELECT count(*) AS attempted, count(*) FILTER (k BETWEEN 1 AND 6) AS dropped, round(CAST(count(*) FILTER (k BETWEEN 1 AND 6) AS DOUBLE) / count(*), 6) AS drop_rate FROM {_NOTED} WHERE {_SHOWN} AND k > 0""")
def page_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.page_overview(_noted(spark, sf_dir)).withColumn("drop_rate", F.round("drop_rate", 6))


@query("""SELECT doc_id AS page_path, doc_id % 4 AS edit_count, list_transform(range(0, doc_id % 4), lambda i: 'why ' || i) AS rationales, CASE WHEN doc_id % 5 > 0 THEN ['w'] ELSE [] END AS warnings, doc_id % 3 = 0 AND doc_id % 2 = 0 AS changed FROM documents""")
def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    edit = lambda i: F.struct(F.lit("a").alias("find"), F.lit("b").alias("replace"), F.concat(F.lit("why "), i.cast("string")).alias("rationale"))
    edits = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), k % 4 - 1), edit))
    outcomes = docs.select(k.alias("page_path"), F.lit(True).alias("applied"), F.lit("").alias("note"), edits.alias("edits"), F.lit(True).alias("passed"), F.when(k % 5 > 0, F.array(F.lit("w"))).alias("warnings"), F.when(k % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("new_content"))
    originals = docs.where("doc_id % 2 = 0").select(k.alias("page_path"), "text")
    return history.page_summaries(outcomes, originals).select("page_path", "edit_count", "rationales", "warnings", "changed")


@query("""SELECT user_id AS run_id, event_type AS model, event_id % 100 + event_id % 7 AS tokens FROM events""")
def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    used = F.struct(F.col("event_type").alias("model"), F.lit("edit").alias("stage"), F.lit(1).alias("calls"), (k % 100).alias("prompt_tokens"), (k % 7).alias("output_tokens"), F.col("value").alias("cost_usd"))
    return history.usage_rows(read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.array(used).alias("by_model"))).select("run_id", "model", "tokens")


@query("""SELECT user_id AS run_id, count(*) AS planned, count(*) FILTER (event_id % 3 = 0) AS authored, count(*) FILTER (event_id % 3 = 1) AS skipped FROM events GROUP BY user_id""")
def bootstrap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ["authored", "skipped", "planned"])), (F.col("event_id") % 3 + 1).cast("int"))
    counted = history.bootstrap_counts(read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), state.alias("state")))
    return counted.select("run_id", *(F.col("counts")[c].alias(c) for c in ("planned", "authored", "skipped")))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS cumulative FROM events""")
def cost_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.cost_over_time(_runs(spark, sf_dir), "user_id").select("event_id", F.round("cumulative", 4).alias("cumulative"))


@query("""SELECT event_type AS model, CASE WHEN user_id % 3 > 0 THEN 's' || (user_id % 3) END AS stage, CAST(sum(event_id % 4) AS BIGINT) AS calls, CAST(sum(event_id % 1000) AS BIGINT) AS tokens, round(sum(value), 4) AS cost FROM events GROUP BY 1, 2""")
def model_stage_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = _runs(spark, sf_dir).select(F.col("event_type").alias("model"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string"))).alias("stage"), "calls", (F.col("event_id") % 1000).alias("tokens"), "cost")
    return history.model_stages(usage).withColumn("cost", F.round("cost", 4))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("model"), F.when(F.col("user_id") % 2 == 0, "edit").alias("stage"), F.lit(1).cast("long").alias("calls"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 7).alias("cache_write"), (F.col("event_id") % 300).alias("cache_read"))


@query("""SELECT event_type AS model, CASE WHEN user_id % 2 = 0 THEN 'edit' END AS stage, CAST(grouping(event_type) AS BIGINT) AS is_total, count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(event_id % 7) AS BIGINT) AS cache_write, CAST(sum(event_id % 300) AS BIGINT) AS cache_read,
  round(CAST(sum(event_id % 300) AS DOUBLE) / sum(event_id % 100 + event_id % 7 + event_id % 300), 6) AS hit_rate FROM events GROUP BY GROUPING SETS ((1, 2), ())""")
def usage_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.usage_totals(_usage(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 6))


@query("""SELECT round(CAST(sum(event_id % 300) AS DOUBLE) / sum(event_id % 100 + event_id % 7 + event_id % 300), 6) AS weighted, round(avg(CAST(event_id % 300 AS DOUBLE) / nullif(event_id % 100 + event_id % 7 + event_id % 300, 0)), 6) AS unweighted FROM events""")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.col("input_tokens") + F.col("cache_write") + F.col("cache_read")
    return _usage(spark, sf_dir).agg(
        F.round(F.try_divide(F.sum("cache_read").cast("double"), F.sum(prompt)), 6).alias("weighted"),
        F.round(F.avg(F.try_divide(F.col("cache_read").cast("double"), prompt)), 6).alias("unweighted"),
    )


@query("""WITH p AS (SELECT * FROM (VALUES ('Brand#', 1.0, 5.0), ('Brand#1', 3.0, 15.0), ('Brand#12', 15.0, 75.0)) v(prefix, pin, pout)),
  u AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN 'other' ELSE p_brand END AS model, p_size * 100 AS i, p_size * 10 AS o FROM part),
  b AS (SELECT model, prefix, pin, pout, row_number() OVER (PARTITION BY model ORDER BY length(prefix) DESC NULLS LAST) AS n FROM (SELECT DISTINCT model FROM u) LEFT JOIN p ON starts_with(model, prefix))
  SELECT u.model, any_value(prefix) AS prefix, count(*) AS n, round(sum((i * coalesce(pin, 15.0) + o * coalesce(pout, 75.0)) / 1e6), 6) AS cost FROM u JOIN b ON u.model IS NOT DISTINCT FROM b.model AND b.n = 1 GROUP BY u.model""")
def longest_prefix_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("Brand#", 1.0, 5.0, 0.0, 0.0, False), ("Brand#1", 3.0, 15.0, 0.0, 0.0, False), ("Brand#12", 15.0, 75.0, 0.0, 0.0, False), ("", 15.0, 75.0, 0.0, 0.0, True)], "prefix string, input double, output double, cache_write double, cache_read double, is_fallback boolean")
    k = F.col("p_partkey") % 10
    part = read(spark, sf_dir, "part").select(F.when(k == 0, None).when(k == 1, "other").otherwise(F.col("p_brand")).alias("model"), (F.col("p_size") * 100).alias("input_tokens"), (F.col("p_size") * 10).alias("output_tokens"), F.lit(0).alias("cache_write"), F.lit(0).alias("cache_read"))
    return history.priced(part, prices).groupBy("model").agg(F.max("prefix").alias("prefix"), F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query("""SELECT round(spent, 3) AS spent, round(spent / (19.0::DOUBLE / 31.0::DOUBLE), 3) AS projected, spent / (19.0::DOUBLE / 31.0::DOUBLE) > 1000 AS over FROM (SELECT coalesce(sum(value), 0) AS spent FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01')""")
def month_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = history.month_budget(_runs(spark, sf_dir), "2024-01-20 00:00:00", 1000.0)
    return b.select(F.round("spent", 3).alias("spent"), F.round("projected", 3).alias("projected"), "over")


@query("""SELECT event_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 8) WHERE event_type <> 'error'""")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.newest(_runs(spark, sf_dir), 8).where("status <> 'error'").select("event_id")


@query("""SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def cursor_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(_runs(spark, sf_dir), "user_id").select("user_id", "event_id")


@query("""SELECT user_id AS run_id, count(*) AS impacted, count(*) FILTER (event_type <> 'error') AS updated, count(*) FILTER (event_type = 'error') AS dropped FROM events GROUP BY user_id""")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = history.run_counts(_runs(spark, sf_dir).select(F.col("user_id").alias("run_id"), (F.col("status") == "ok").alias("applied")))
    return counted.select("run_id", *(F.col("counts")[k].alias(k) for k in ("impacted", "updated", "dropped")))


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as lines of a run log, every seventh cut short and every eleventh blank."""
    record = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit("run").alias("command"), F.col("event_type").alias("status"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repo"), F.col("event_id").cast("string").alias("head_sha"), F.struct(F.col("value").alias("cost_usd")).alias("usage")))
    k = F.col("event_id")
    return dealt(read(spark, sf_dir, "events")).select(F.when(k % 7 == 0, F.substring(record, 1, 40)).when(k % 11 == 0, "  ").otherwise(record).alias("value"))


@query("""SELECT event_type AS status, count(*) AS n, round(sum(value), 3) AS cost FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY event_type""")
def log_tolerant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.parse_lines(_log_lines(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("usage.cost_usd"), 3).alias("cost"))


@query("""SELECT head_sha, timestamp FROM (SELECT CAST(event_id AS VARCHAR) AS head_sha, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, ts FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0) ORDER BY ts DESC LIMIT 500""")
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the log's times are whole, so that runs of one second are in order; shown are seconds
    return log.newest(log.parse_lines(_log_lines(spark, sf_dir)), 500).select("head_sha", F.left("timestamp", F.lit(19)).alias("timestamp"))


def _ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    n, k = F.col("event_id").cast("string"), F.col("event_id") % 4
    base = F.when(F.col("event_id") % 3 == 0, "0" * 12).otherwise(F.concat(F.lit("b"), n))
    sent = F.to_json(F.struct(F.struct(F.lit("team/app").alias("repo"), base.alias("base_sha"), F.concat(F.lit("h"), n).alias("head_sha"), F.when(F.col("event_id") % 5 == 0, "").otherwise(n).alias("pr_number")).alias("client_payload")))
    push = F.to_json(F.struct(base.alias("before"), F.concat(F.lit("h"), n).alias("after"), F.struct(F.lit("team/lib").alias("full_name")).alias("repository"), F.struct(F.concat(F.lit("fix "), n, F.lit("\nmore")).alias("message")).alias("head_commit")))
    return e.select("event_id", F.when(k == 0, sent).when(k == 1, push).when(k == 2, F.lit("{\"x\": 1}")).otherwise("not json").alias("value"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'dispatch' WHEN 1 THEN 'push' ELSE 'unknown' END AS kind, CASE event_id % 4 WHEN 0 THEN 'team/app' WHEN 1 THEN 'team/lib' END AS repo,
  CASE WHEN event_id % 4 < 2 THEN CASE WHEN event_id % 3 = 0 THEN 'h' || event_id || '^' ELSE 'b' || event_id END END AS base_sha, CASE WHEN event_id % 4 < 2 THEN 'h' || event_id END AS head_sha,
  CASE WHEN event_id % 4 = 0 AND event_id % 5 <> 0 THEN event_id END AS pr_number, CASE WHEN event_id % 4 = 1 THEN 'fix ' || event_id END AS pr_title FROM events""")
def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ci.parse_events(_ci(spark, sf_dir)).drop("value")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'm' || event_id ELSE 'c' || event_id END AS head_sha, CASE WHEN event_id % 3 = 0 THEN 'b' || event_id ELSE CASE WHEN event_id % 2 = 0 THEN 'm' || event_id ELSE 'c' || event_id END || '^' END AS base_sha FROM events""")
def null_sha_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("event_id").cast("string"), F.col("event_id")
    rows = read(spark, sf_dir, "events").select("event_id", F.lit("g/p").alias("project"), F.when(k % 2 == 0, F.concat(F.lit("m"), n)).otherwise("").alias("mr_head"), F.concat(F.lit("c"), n).alias("commit"), F.lit("").alias("mr_base"), F.when(k % 3 == 0, F.concat(F.lit("b"), n)).when(k % 3 == 1, "0000").alias("before"))
    return ci.from_environment(rows).select("event_id", "head_sha", "base_sha")


_CASES = """e AS (SELECT lang AS case_id, doc_id AS page FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)), a AS (SELECT lang AS case_id, doc_id AS page FROM documents WHERE n_chars % 3 = 0),
  s AS (SELECT coalesce(e.case_id, a.case_id) AS case_id, count(*) FILTER (e.page IS NOT NULL AND a.page IS NOT NULL) AS tp, count(*) FILTER (e.page IS NULL) AS fp, count(*) FILTER (a.page IS NULL) AS fn FROM e FULL OUTER JOIN a ON e.case_id = a.case_id AND e.page = a.page GROUP BY 1)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("case_id"), F.col("doc_id").alias("page_path"), "n_chars")
    good = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("page_path"))
    return evaluate.score_cases(docs.join(good, "page_path", "left_semi"), docs.where("n_chars % 3 = 0"))


@query(f"WITH {_CASES} SELECT * FROM s")
def score_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir)


_MICRO = f"""{_CASES}, t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM s),
  r AS (SELECT *, tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS r FROM t)"""


@query(f"""WITH {_MICRO} SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM r""")
def micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.micro(_cases(spark, sf_dir))
    return m.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""WITH {_MICRO} SELECT metric, round(value, 6) AS value, floor FROM (SELECT 'precision' AS metric, p AS value, 0.99::DOUBLE AS floor FROM r UNION ALL SELECT 'recall', r, 0.01 FROM r UNION ALL SELECT 'f1', 2 * p * r / (p + r), 0.9 FROM r) WHERE value < floor""")
def threshold_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.breaches(evaluate.micro(_cases(spark, sf_dir)), {"precision": 0.99, "recall": 0.01, "f1": 0.9}).withColumn("value", F.round("value", 6))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return jobs.event_stream(spark, f"{sf_dir}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _ran(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result once all that is there has been read; it and the checkpoint lie in the shared folder."""
    at = folder(spark, "stream")
    jobs.run_available(stream, f"{at}/rows", mode, f"{at}/checkpoint").awaitTermination()
    return jobs.current_cursors(spark, f"{at}/rows")


@query("""SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def stream_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark, jobs.cursors(_stream(spark, sf_dir), "user_id", "ts", "event_id"), "complete")


@query("""SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1""")
def stream_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _ran(spark, jobs.month_totals(_stream(spark, sf_dir), "ts", "value"), "complete")
    return totals.select(F.date_format("month", "yyyy-MM").alias("month"), "n", F.round("total", 3).alias("total"))


@query("""SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500""")
def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "stream")
    jobs.retained(_stream(spark, sf_dir).select("ts", "event_id"), "ts", 500, f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return jobs.current_cursors(spark, f"{at}/rows").select("event_id")


@query("""SELECT event_type AS status, count(*) AS n, round(sum(value), 3) AS cost FROM events GROUP BY event_type""")
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that a stream appends to a log, read from there."""
    at = folder(spark, "log")
    runs = _stream(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_type").alias("status"), F.struct(F.col("value").alias("cost_usd")).alias("usage"))
    jobs.append_log(runs, f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return log.read_log(spark, f"{at}/rows").groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("usage.cost_usd"), 3).alias("cost"))


@query("""WITH e AS (SELECT event_id // 4 AS h, event_id % 4 AS k, ts FROM events), heads AS (SELECT h, ts FROM e WHERE k = 0),
  whole AS (SELECT h FROM heads WHERE h % 3 = 0 UNION SELECT a.h FROM e a JOIN e b ON a.h = b.h WHERE a.k = 1 AND b.k = 2 AND a.h % 5 <> 0)
  SELECT h % 50 AS repo, max_by('h' || h, (ts, 'h' || h)) AS head_sha FROM heads JOIN whole USING (h) GROUP BY 1""")
def stream_held_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth event is a head of two pages (of none in a third of them), the next two are its pages (one is missing in a fifth of them), and one comes twice."""
    h, k = F.floor(F.col("event_id") / 4), F.col("event_id") % 4
    events = _stream(spark, sf_dir).where(~((h % 5 == 0) & (k == 2))).select(
        (h % 50).cast("string").alias("repo"), F.when(k == 0, "head").otherwise("page").alias("kind"), F.concat(F.lit("h"), h.cast("string")).alias("head_sha"),
        F.when(k == 3, "1").otherwise(k.cast("string")).alias("page_path"), F.when(h % 3 == 0, 0).otherwise(2).alias("pages"), "ts",
    )
    at = folder(spark, "stream")
    released = heads.released_heads(events, 10 * 366 * 24).where("status = 'released'")
    heads.start(lambda: jobs.upsert_cursors(released, "repo", "ts", "head_sha", f"{at}/rows", f"{at}/checkpoint"), spark).awaitTermination()
    return jobs.current_cursors(spark, f"{at}/rows").select(F.col("repo").cast("long").alias("repo"), "head_sha")


# Conversation turns in a reply: reasoning before it, a string with braces and quotes in it, an inner object, and more after it.
_REPLY = """'<think>{ not "this' || chr(10) || '}</think> So: ' || CASE WHEN turn % 3 = 0 THEN '```json' || chr(10) ELSE '\\" ' END || '{"role": "' || role || '", "note": "a } b { \\" c ' || (conv_id % 7) || '", "in": {"turn": ' || turn || '}}'
  || CASE WHEN turn % 3 = 0 THEN chr(10) || '```' ELSE '' END || ' and {"more": 1} }'"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.col(c).cast("string")
    third = F.col("turn") % 3 == 0
    text = F.concat(
        F.lit('<think>{ not "this\n}</think> So: '), F.when(third, "```json\n").otherwise('\\" '), F.lit('{"role": "'), F.col("role"), F.lit('", "note": "a } b { \\" c '), (F.col("conv_id") % 7).cast("string"),
        F.lit('", "in": {"turn": '), n("turn"), F.lit("}}"), F.when(third, "\n```").otherwise(""), F.lit(' and {"more": 1} }'),
    )
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("reply"))


@query(f"""WITH r AS (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations),
  b AS (SELECT conv_id, turn, regexp_replace(reply, '<think>[^<]*</think>', '') AS t FROM r), c AS (SELECT conv_id, turn, CASE WHEN contains(t, '```') THEN string_split(t, '```')[2] ELSE t END AS t FROM b)
  SELECT conv_id, turn, substr(t, CAST(instr(t, '{{') AS BIGINT), CAST(instr(t, '}}}}') + 2 - instr(t, '{{') AS BIGINT)) AS object FROM c""")
def reply_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("conv_id", "turn", replies.first_object(replies.without_reasoning(F.col("reply"))).alias("object"))


@query("""WITH i AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN ['t' || (turn % 4)] END AS tags FROM conversations WHERE role IS NOT NULL),
  u AS (SELECT conv_id, 'p' || turn || '-' || role AS path, role AS title, tags FROM i UNION ALL SELECT conv_id, 'inner', 't', NULL FROM i WHERE turn % 5 = 0)
  SELECT conv_id, path, title, array_to_string(tags, ',') AS tags, count(*) AS n FROM (SELECT DISTINCT * FROM u) GROUP BY ALL""")
def salvaged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each conversation, whose turns lie in invented sections at different depths, with objects that are no items."""
    turn = F.col("turn").cast("string")
    tags = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(', "tags": ["t'), (F.col("turn") % 4).cast("string"), F.lit('"]'))).otherwise(F.lit(', "tags": null'))
    item = F.concat(F.lit('{"path": "p'), turn, F.lit("-"), F.col("role"), F.lit('", "title": "'), F.col("role"), F.lit('"'), tags)
    deep = F.when(F.col("turn") % 5 == 0, F.lit(', "more": {"x": [{"path": "inner", "title": "t"}]}}')).otherwise(F.lit("}"))
    wrong = F.lit('{"path": 3, "title": "t"}, {"title": "only"}, {"path": "p", "title": "t", "tags": "no list"}')
    each = F.concat(F.lit('{"pages": ['), item, deep, F.lit(", "), item, deep, F.lit(", "), wrong, F.lit("]}"))
    rows = read(spark, sf_dir, "conversations").where("role is not null")
    whole = rows.groupBy("conv_id").agg(F.concat(F.lit('{"plan": {"sections": ['), F.array_join(F.array_sort(F.collect_list(each)), ", "), F.lit("]}}")).alias("reply"))
    found = replies.salvaged(whole, "conv_id", {"path": "string", "title": "string"}, {"tags": "strings"})
    return found.groupBy("conv_id", "path", "title", F.array_join("tags", ",").alias("tags")).agg(F.count("*").alias("n"))
