"""Queries of reports, plans and prompt material over documents, labels, parts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.operators import dashboard, reports
from pagetrace.shared import folder

from .registry import query, read


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}\p{Pc}]+')) AS w FROM documents),
  n AS (SELECT doc_id, CAST(('0x' || substr(sha1(w), 1, 8)) AS BIGINT) % 24 AS place, count(*) AS n FROM w GROUP BY 1, 2), s AS (SELECT doc_id, sqrt(sum(n * n)) AS norm, max_by(place, (n, -place)) AS place, max(n) AS n FROM n GROUP BY doc_id)
  SELECT doc_id, coalesce(place, -1) AS place, round(CAST(coalesce(n / norm, 0) AS DOUBLE), 4) AS most FROM documents LEFT JOIN s USING (doc_id)""")
def hashed_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest component of each text's vector and its place."""
    docs = reports.encoded(read(spark, sf_dir, "documents").select("doc_id", "text"))
    most = F.array_max("embedding")
    return docs.select("doc_id", F.when(most > 0, F.array_position("embedding", most) - 1).otherwise(-1).cast("long").alias("place"), F.round(most.cast("double"), 4).alias("most"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars % 50 DESC, doc_id) AS turn FROM documents""")
def edit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_path"), "source", (F.col("n_chars") % 50).alias("confidence"))
    return reports.edit_order(pages, "source").select(F.col("page_path").alias("doc_id"), "turn")


@query("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'planned' WHEN quality = 1 THEN 'authored' ELSE 'skipped' END AS state FROM documents LEFT JOIN labels l USING (doc_id)) GROUP BY state""")
def plan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_path"))
    done = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_path"), (F.col("quality") == 1).alias("applied"), F.lit("").alias("note"), F.lit(2).alias("ord"))
    done = done.unionByName(done.withColumns({"applied": ~F.col("applied"), "ord": F.lit(1)}))  # an earlier outcome of each
    return reports.outcomes_of_plan(plan, done).groupBy("state").agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)""")
def critique_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_path"), F.col("text").alias("find"))
    bad = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_path"))
    return reports.without_rejected(ops, ops.join(bad, "page_path", "left_semi")).select(F.col("page_path").alias("doc_id"))


@query("""SELECT p_brand, array_to_string(s[1:3], ', ') || CASE WHEN len(s) > 3 THEN ' (+' || (len(s) - 3) || ' more)' ELSE '' END AS shown FROM (SELECT p_brand, list_sort(list_distinct(list(p_name))) AS s FROM part GROUP BY p_brand)""")
def symbol_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.heads(read(spark, sf_dir, "part"), "p_brand", "p_name", 3)


@query("""WITH s AS (SELECT source, doc_id, chr(10) || '## file: d' || doc_id || ' (' || CASE WHEN doc_id % 2 = 0 THEN 'added' ELSE 'modified' END || ')' || chr(10) || 'changed symbols: ' || CASE WHEN doc_id % 3 = 0 THEN '(none)' ELSE 'd' || doc_id || ', s' END
    || CASE WHEN doc_id % 5 > 0 THEN chr(10) || '@@ 1 @@' || chr(10) || coalesce(text, '') ELSE '' END AS section FROM documents WHERE source IS NOT NULL),
  b AS (SELECT *, 12000 - length('repo: ' || source || chr(10) || 'pr_title: (none)' || chr(10)) AS room, coalesce(sum(length(section)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s)
  SELECT source, length(text) AS n, md5(text) AS digest FROM (SELECT source, 'repo: ' || source || chr(10) || 'pr_title: (none)' || chr(10) || string_agg(left(section, CAST(greatest(0, room - used) AS BIGINT)), '' ORDER BY doc_id) || CASE WHEN sum(length(section)) > max(room) THEN chr(10) || '... (diff truncated)' ELSE '' END AS text FROM b GROUP BY source)""")
def prompt_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as one diff, its documents as the files."""
    d = read(spark, sf_dir, "documents").where("source is not null")
    name, n = F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("doc_id")
    hunk = F.concat(F.lit("@@ 1 @@\n"), F.coalesce("text", F.lit("")))
    files = d.select(F.col("source").alias("diff_id"), n.alias("ord"), name.alias("path"), F.when(n % 2 == 0, "added").otherwise("modified").alias("status"), F.when(n % 3 > 0, F.array(name, F.lit("s"))).alias("symbols"), F.when(n % 5 > 0, F.array(hunk)).alias("hunks"))
    diffs = d.select(F.col("source").alias("diff_id"), F.col("source").alias("repo"), F.lit("").alias("title")).distinct()
    return reports.rendered_diffs(diffs, files).select(F.col("diff_id").alias("source"), F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("""SELECT 'docs/guide/p' || page_id || '.html' AS path, strlen(coalesce(html, '')) AS n_bytes, md5(coalesce(html, '')) AS digest FROM pages WHERE page_id % 10 > 0 AND page_id % 3 < 2""")
def written_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files, and the files read back."""
    at, n = folder(spark, "site"), F.col("page_id")
    name = F.concat(F.when(n % 10 == 0, ".state/p").otherwise("guide/p"), n.cast("string"), F.lit(".html"))
    reports.write_pages(read(spark, sf_dir, "pages").select(name.alias("page_path"), (n % 3 < 2).alias("applied"), F.col("html").alias("new_content")), at, "docs")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{at}/docs")
    return files.select(F.regexp_extract("path", "docs/guide/[^/]+$", 0).alias("path"), F.col("length").alias("n_bytes"), F.md5("content").alias("digest"))


@query("""SELECT strftime(day, '%Y-%m-%d') AS day, round(CAST(sum(cost) OVER (ORDER BY day) AS DOUBLE), 2) AS cumulative FROM (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS cost FROM orders GROUP BY 1)""")
def dashboard_cost_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = dashboard.cost_curve(read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").cast("double").alias("cost")))
    return curve.select(F.col("day").cast("string").alias("day"), F.round("cumulative", 2).alias("cumulative"))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 8),
  p AS (SELECT o_orderkey AS run_id, l_linenumber AS ord, place, count(*) OVER (PARTITION BY o_orderkey) AS "all", row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) AS n FROM r JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 5)
  SELECT run_id, ord, place, "all" FROM p WHERE n <= 3""")
def dashboard_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("ord"))
    pages = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ord"), (F.col("l_quantity") > 5).alias("applied"))
    return dashboard.recent_changes(runs, pages, most=3).select("run_id", "ord", "place", "all")


@query("""SELECT source, doc_id, CAST(length(left(text, CAST(least(length(text), room) AS BIGINT))) AS BIGINT) AS length FROM (SELECT source, doc_id, text, 5000 - coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM documents) WHERE room > 0""")
def rendered_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), F.col("text").alias("section"))
    return reports.prefix_with_cut(sections, "source", 5000).select("source", F.col("ord").alias("doc_id"), F.length("section").cast("long").alias("length"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS m FROM a WHERE n <= 3) SELECT p_brand, p_partkey FROM b WHERE m <= 10""")
def surface_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_partkey").alias("ord"))
    return reports.two_caps(lines, "p_brand", "p_type", 3, 10).select("p_brand", F.col("ord").alias("p_partkey"))


@query("""SELECT doc_id, greatest(1024, CAST(floor(n_chars * CASE CASE WHEN lang = 'fr' THEN 'light' WHEN lang = 'de' THEN 'high' ELSE 'medium' END WHEN 'light' THEN 0.6::DOUBLE WHEN 'high' THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END) AS BIGINT)) AS tokens FROM documents""")
def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = reports.level_of(F.col("lang"), {"fr": "light", "de": "high"}, "medium")
    return read(spark, sf_dir, "documents").select("doc_id", reports.token_budget(F.col("n_chars"), level).alias("tokens"))


@query("""SELECT page_id, 'sync/' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || '-' || left(md5(url), 8) AS branch, url AS link FROM pages""")
def branch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    said = F.concat(F.lit("opened http://first.example and "), "url", F.lit(" done"))
    return p.select("page_id", reports.branch_name(T.repo_key(T.url_host("url")), F.md5("url"), "sync").alias("branch"), reports.last_url(said).alias("link"))


@query(f"""SELECT p_partkey, sha256('m:1:' || {" || ':' || ".join(f"CAST(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS HUGEINT) AS VARCHAR)" for i in range(4))}) AS content_hash FROM
  (SELECT p_partkey, sha256('0:' || sha256('r/' || p_name || chr(10) || p_brand || ' ' || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'body' ELSE '' END)) AS h FROM part)""")
def code_unit_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagetrace.operators.vectors import content_hash

    part = reports.unit_text(F.lit("r"), F.col("p_name"), F.array("p_brand", "p_type"), F.when(F.col("p_size") % 2 == 0, "body").otherwise(""))
    return content_hash(read(spark, sf_dir, "part").select("p_partkey", F.lit(0).alias("ord"), part.alias("part")), "p_partkey", "m")


@query("""WITH c AS (SELECT user_id, min_by(event_id, event_id) AS head FROM events WHERE event_type = 'view' GROUP BY user_id)
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(head AS VARCHAR) ELSE 'b' || event_id END AS base_sha FROM events LEFT JOIN c USING (user_id)""")
def cursor_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("repo_key", F.col("user_id").cast("string"))
    cursors = e.where("event_type = 'view'").select("repo_key", F.col("event_id").cast("string").alias("head_sha"), F.col("event_id").alias("ord"))
    changes = e.select("event_id", "repo_key", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("b"), F.col("event_id").cast("string"))).alias("base_sha"))
    return reports.base_of(changes, cursors).select("event_id", "base_sha")


@query("""SELECT count(*) AS pages, CAST(sum(len(regexp_extract_all(html, '<p>'))) AS BIGINT) AS anchors FROM pages""")
def health_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.health_panel(read(spark, sf_dir, "pages").select(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0)).alias("sources")))


@query("""WITH m AS (SELECT lang, doc_id, CASE WHEN quality = 1 THEN 'changed' ELSE 'dropped' END AS part, CASE WHEN toxic = 1 THEN ': toxic' ELSE '' END AS note, row_number() OVER (PARTITION BY lang, quality = 1 ORDER BY 'd' || doc_id) AS n FROM labels JOIN documents USING (doc_id)),
  l AS (SELECT lang, part, count(*) AS n, string_agg('- `d' || doc_id || '`' || note, chr(10) ORDER BY n) FILTER (n <= 20) AS lines FROM m GROUP BY lang, part)
  SELECT lang, string_agg('## ' || upper(part[1]) || part[2:] || ' (' || n || ')' || chr(10) || lines, chr(10) || chr(10) ORDER BY part) AS report FROM l GROUP BY lang""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    outcomes = done.select("lang", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("page_path"), (F.col("quality") == 1).alias("applied"), F.when(F.col("toxic") == 1, "toxic").alias("note"))
    return reports.markdown(outcomes, "lang")


@query("""SELECT doc_id, CASE WHEN n_chars % 3 > 0 THEN '~$' || printf('%.4f', n_chars / 10000.0) || ' in ' || n_chars % 9 || ' calls, ' || n_chars % 1000 || ' in / ' || n_chars % 100 || ' out, ' || printf('%.0f', CAST(n_chars % 101 AS DOUBLE)) || '% hit' END AS line FROM documents""")
def cost_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    usage = F.struct((n / 10000.0).alias("cost_usd"), (n % 9).alias("calls"), (n % 1000).alias("input_tokens"), (n % 100).alias("output_tokens"), ((n % 101) / 100).alias("cache_hit_rate"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.when(n % 3 > 0, usage).alias("usage"))
    return rows.select("doc_id", reports.cost_line(F.col("usage")).alias("line"))


@query("""SELECT doc_id FROM documents WHERE doc_id % 3 > 1 AND length(text) >= 16000""")
def cacheable_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(reports.cacheable(F.col("doc_id") % 3, F.col("text"))).select("doc_id")
