"""Planning and rule-health queries: documents stand for planned pages, pages.url for files and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.operators import planning
from pagetrace.sources import dialects, trees

from .registry import query, read

_PATHS = r"(SELECT page_id, ltrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS path, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.ltrim(T.url_path("url"), F.lit("/")).alias("path"), T.url_host("url").alias("host"))


@query("""WITH s AS (SELECT source AS section, min(doc_id) AS first, count(*) AS pages FROM documents GROUP BY source)
  SELECT section, row_number() OVER (ORDER BY CASE section WHEN 'src9' THEN 1 WHEN 'src3' THEN 2 ELSE 4 END, first) AS rank, pages FROM s""")
def ordered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("section"), F.col("doc_id").alias("ord"))
    return planning.ordered_sections(docs, ["src9", "src3", "none"])


@query("""WITH p AS (SELECT doc_id, 'd/' || (n_chars % 700) AS route FROM documents WHERE doc_id % 3 > 0), x AS (SELECT DISTINCT 'd/' || (n_chars % 700) AS route FROM documents WHERE doc_id % 3 = 0)
  SELECT route, min(doc_id) AS ord FROM p WHERE route NOT IN (SELECT route FROM x) AND route NOT IN ('d/1', 'd/2', 'd/3', 'd/4', 'd/5') GROUP BY route ORDER BY ord LIMIT 50""")
def plan_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("./d/"), (F.col("n_chars") % 700).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise("/index.mdx")).alias("page_path"))
    taken = spark.createDataFrame([(f"d/{i}",) for i in range(1, 6)], "route string")
    return planning.first_wins(docs.where("ord % 3 > 0"), docs.where("ord % 3 = 0"), taken, 50).select("route", "ord")


@query(f"""WITH n AS (SELECT DISTINCT path AS route FROM {_PATHS} WHERE page_id % 4 = 0), r AS (SELECT path AS route, host AS group_name, page_id AS ord FROM {_PATHS} WHERE page_id % 4 > 0)
  SELECT route, min_by(group_name, ord) AS group_name, min(ord) AS ord FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.route = r.route) GROUP BY route""")
def nav_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).select(F.col("path").alias("route"), F.col("host").alias("group_name"), F.col("page_id").alias("ord"))
    return planning.nav_additions(f.where("ord % 4 = 0"), f.where("ord % 4 > 0"))


@query("""SELECT source, count(*) AS lines, CAST(max(used) AS BIGINT) AS used FROM (SELECT source, sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 60000 GROUP BY source""")
def digest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), F.col("text").alias("line"))
    return planning.budgeted_prefix(lines, "source", 60000).groupBy("source").agg(F.count("*").alias("lines"), F.max("used").alias("used"))


@query(f"""SELECT host, page_id FROM (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM {_PATHS} WHERE regexp_full_match(path, 'en/.*')) WHERE n <= 6""")
def excerpt_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagetrace.operators.anchors import match_globs

    hits = match_globs(_files(spark, sf_dir), spark.createDataFrame([("en/*",)], "pattern string"))
    return planning.capped(hits.select("host", "page_id", F.col("page_id").alias("ord")), "host", 6).select("host", "page_id")


@query(f"""WITH f AS (SELECT DISTINCT host || '/' || regexp_replace(split_part(path, '.', 1), '/$', '') || '.html' AS path, host, page_id % 5 AS k FROM {_PATHS}), files AS (SELECT DISTINCT path FROM f),
  g AS (SELECT DISTINCT host AS key, path AS pattern, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f WHERE k > 0 OR host < 'm'),
  l AS (SELECT key, dir, count(*) AS listed FROM g GROUP BY ALL HAVING count(*) >= 2)
  SELECT key, dir || '/*.html' AS pattern, listed AS covered FROM l WHERE listed = (SELECT count(*) FROM files WHERE starts_with(files.path, l.dir || '/') AND ends_with(files.path, '.html'))""")
def glob_exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("host", F.lit("/"), F.regexp_replace(F.split_part("path", F.lit("."), F.lit(1)), r"/\z", ""), F.lit(".html"))
    f = _files(spark, sf_dir).select("host", "page_id", path.alias("path"))
    globs = f.where("page_id % 5 > 0 or host < 'm'").select(F.col("host").alias("key"), F.col("path").alias("pattern"))
    return planning.exact_covers(globs, f.select("path"))


_GLOBS = [("a.md", "en/*"), ("b.md", "xx/*"), ("c.md", "*.pdf"), ("d.md", "en/25"), ("e.md", "[!a-z]*"), ("f.md", "??/[0-9]*")]
_GLOB_SQL = "(VALUES ('a.md', 'en/*', 'en/.*'), ('b.md', 'xx/*', 'xx/.*'), ('c.md', '*.pdf', '.*\\.pdf'), ('d.md', 'en/25', 'en/25'), ('e.md', '[!a-z]*', '[^a-z].*'), ('f.md', '??/[0-9]*', '../[0-9].*')) r(page_path, pattern, rx)"


@query(f"SELECT page_path, pattern FROM {_GLOB_SQL} WHERE NOT EXISTS (SELECT 1 FROM {_PATHS} p WHERE regexp_full_match(p.path, r.rx))")
def doctor_dead_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.dead_globs(spark.createDataFrame(_GLOBS, "page_path string, pattern string"), _files(spark, sf_dir)).select("page_path", "pattern")


@query(f"SELECT page_path, pattern FROM {_GLOB_SQL} WHERE EXISTS (SELECT 1 FROM {_PATHS} p WHERE regexp_full_match(p.path, r.rx))")
def infer_live_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.live_globs(spark.createDataFrame(_GLOBS, "page_path string, pattern string"), _files(spark, sf_dir)).select("page_path", "pattern")


@query("""SELECT symbol FROM (VALUES ('password'), ('the'), ('no_such_symbol'), ('ción')) s(symbol) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, symbol))""")
def doctor_missing_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("password",), ("the",), ("no_such_symbol",), ("ción",)], "symbol string")
    return planning.missing_symbols(wanted, read(spark, sf_dir, "documents").select("text"))


@query("""SELECT doc_id AS page_path FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000)""")
def doctor_missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_path"))
    return planning.missing_pages(rules, read(spark, sf_dir, "documents").where("n_chars > 1000").select(F.col("doc_id").alias("page_path")))


@query(f"""SELECT DISTINCT lower(host) AS key FROM {_PATHS} WHERE host <> '' AND lower(host) NOT IN (SELECT lower(host) FROM {_PATHS} WHERE page_id % 10 = 0)""")
def doctor_unmapped_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    rules = f.select(F.concat(F.lit("git://x/"), F.col("host"), F.lit(".git")).alias("repo"))
    return planning.unmapped_repos(rules, f.where("page_id % 10 = 0").select(F.upper("host").alias("repo")))


@query(f"""SELECT *, missing_pages = 0 AND dead_globs = 0 AS ok FROM (SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000)) AS missing_pages,
  (SELECT count(*) FROM {_GLOB_SQL} WHERE NOT EXISTS (SELECT 1 FROM {_PATHS} p WHERE regexp_full_match(p.path, r.rx))) AS dead_globs)""")
def doctor_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.healthy(doctor_missing_pages(spark, sf_dir), doctor_dead_globs(spark, sf_dir))


@query(f"""SELECT count(DISTINCT lower(host)) AS repos, CASE WHEN count(DISTINCT lower(host)) > 1 THEN 'poly' WHEN min(lower(host)) = 'docs' THEN 'mono' ELSE 'single' END AS mode FROM {_PATHS} WHERE host <> ''""")
def repo_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.repo_mode(_files(spark, sf_dir).select(F.col("host").alias("repo")), "git@x/Docs.git")


@query("""SELECT path, min(doc_id) AS ord FROM (SELECT md5(text) AS path, doc_id FROM documents WHERE doc_id >= 300) WHERE path NOT IN (SELECT md5(text) FROM documents WHERE doc_id < 300) GROUP BY path""")
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.md5("text").alias("path"), F.col("doc_id").alias("ord"))
    return planning.merge_manifest(docs.where("ord < 300"), docs.where("ord >= 300"))


@query("""SELECT string_agg(part, '/' ORDER BY i) AS directory FROM (SELECT i, min(p[i]) AS part, sum((i < (SELECT min(j) FROM (SELECT j, count(DISTINCT q[j]) AS k FROM (SELECT string_split('repo/docs/' || lang || '/' || doc_id || '.md', '/') AS q FROM documents), range(1, 4) r(j) GROUP BY j) WHERE k > 1))::INT) AS before
  FROM (SELECT string_split('repo/docs/' || lang || '/' || doc_id || '.md', '/') AS p FROM documents), range(1, 4) r(i) GROUP BY i) WHERE before > 0""")
def docs_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("repo/docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return planning.docs_root(docs)


@query("""SELECT regexp_replace(p, '/[^/]*$', '') AS directory FROM (SELECT source || '/' || lang || CASE WHEN doc_id % 2 = 0 THEN '/x' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN '/docs.json' ELSE '/a.md' END AS p FROM documents) WHERE ends_with(p, 'docs.json') ORDER BY len(string_split(p, '/')), p LIMIT 1""")
def configured_docs_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    path = F.concat("source", F.lit("/"), "lang", F.when(k % 2 == 0, "/x").otherwise(""), F.when(k % 7 == 0, "/docs.json").otherwise("/a.md"))
    return planning.docs_root(read(spark, sf_dir, "documents").select(path.alias("path")))


@query("""WITH l AS (SELECT source, doc_id, sum(length('- ' || doc_id || '  ::  ' || lang) + 1) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents), u AS (SELECT source, count(*) AS units FROM documents GROUP BY source),
  s AS (SELECT source, string_agg('- ' || doc_id || '  ::  ' || lang, chr(10) ORDER BY doc_id) AS lines, count(*) AS n FROM l JOIN documents USING (source, doc_id) WHERE used <= 120 GROUP BY source)
  SELECT source, units, coalesce(lines, '') || CASE WHEN coalesce(n, 0) < units THEN chr(10) || '… (' || units || ' in all; list cut)' ELSE '' END AS lines FROM u LEFT JOIN s USING (source)""")
def marked_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return planning.digests(docs.select("source", F.col("doc_id").alias("ord"), planning.unit_line(F.col("doc_id").cast("string"), F.array("lang")).alias("line")), "source", 120)


@query("""WITH s AS (SELECT source AS section, min(doc_id) AS first FROM documents GROUP BY source), r AS (SELECT section, row_number() OVER (ORDER BY CASE section WHEN 'src9' THEN 1 ELSE 2 END, first) AS section_rank FROM s)
  SELECT doc_id, section_rank, row_number() OVER (PARTITION BY source ORDER BY n_chars % 10, lang, doc_id) AS place FROM documents JOIN r ON source = section""")
def pages_in_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("section"), (F.col("n_chars") % 10).alias("order"), F.col("lang").alias("title"), F.col("doc_id").alias("ord"))
    return planning.pages_in_sections(docs, ["src9"]).select("doc_id", "section_rank", "place")


@query("""WITH f AS (SELECT DISTINCT 'd' || (p_partkey % 50) || '/f' || p_size || '.py' AS path, p_partkey % 50 AS d FROM part), g AS (SELECT path AS pattern, d FROM f WHERE d % 2 = 0 OR path NOT LIKE '%f1.py'),
  c AS (SELECT d, count(*) AS listed, (SELECT count(*) FROM f WHERE f.d = g.d) AS there FROM g GROUP BY d),
  o AS (SELECT d, 'x/*' AS pattern, 0 AS part FROM c UNION ALL SELECT g.d, pattern, 1 FROM g JOIN c USING (d) WHERE listed < 2 OR listed <> there UNION ALL SELECT d, 'd' || d || '/*.py', 2 FROM c WHERE listed >= 2 AND listed = there)
  SELECT d AS key, pattern, row_number() OVER (PARTITION BY d ORDER BY part, pattern) AS place FROM o""")
def collapsed_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("p_partkey") % 50
    f = read(spark, sf_dir, "part").select(d.alias("key"), F.concat(F.lit("d"), d.cast("string"), F.lit("/f"), F.col("p_size").cast("string"), F.lit(".py")).alias("path")).distinct()
    listed = f.where("key % 2 = 0 or path not like '%f1.py'").select("key", F.col("path").alias("pattern"), F.col("path").alias("ord"))
    return planning.collapsed_globs(listed.unionByName(listed.select("key", F.lit("x/*").alias("pattern"), F.lit("z").alias("ord"))), f.select("path"))


@query(f"""WITH u AS (SELECT DISTINCT host, path, min(page_id) OVER (PARTITION BY host, path) AS ord FROM {_PATHS}), h AS (SELECT host AS page_path, path, min((CASE WHEN regexp_full_match(path, 'en/.*') THEN 0 ELSE 1 END, ord)) AS o FROM u WHERE regexp_full_match(path, 'en/.*') OR regexp_full_match(path, '.*5') GROUP BY host, path),
  n AS (SELECT page_path, path, row_number() OVER (PARTITION BY page_path ORDER BY o) AS n FROM h) SELECT page_path, page_path AS repo, path FROM n WHERE n <= 6""")
def planned_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    units = f.groupBy(F.col("host").alias("repo"), "path").agg(F.min("page_id").alias("ord"))
    hosts = f.select(F.col("host").alias("repo")).distinct()
    sources = hosts.select(F.col("repo").alias("page_path"), "repo", F.lit("en/*").alias("pattern"), F.lit(0).alias("source_ord")).unionByName(hosts.select(F.col("repo").alias("page_path"), "repo", F.lit("*5").alias("pattern"), F.lit(1).alias("source_ord")))
    return planning.planned_excerpts(sources, units)


@query(f"""SELECT page_id, 'org/' || lower(host) AS repo FROM {_PATHS} WHERE lower(host) IN (SELECT lower(host) FROM {_PATHS} WHERE page_id % 10 = 0)""")
def inferred_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    repos = f.where("page_id % 10 = 0").select(F.concat(F.lit("org/"), F.lower("host")).alias("repo"))
    return planning.inferred_sources(f.select("page_id", F.concat(F.lit("git@x:"), F.upper("host"), F.lit(".git")).alias("repo")).withColumn("repo", F.replace("repo", F.lit(":"), F.lit("/"))), repos)


@query("""SELECT doc_id AS page_path, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'skipped' ELSE 'work' END AS state FROM documents d""")
def work_and_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.work_and_skipped(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_path")), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'guide' WHEN 1 THEN 'concept' WHEN 2 THEN 'reference' END AS kind, coalesce(doc_id % 4 < 2, false) AS required FROM documents""")
def judge_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "guide").when(k == 1, "concept").when(k == 2, "reference").alias("kind"))
    return docs.withColumn("required", planning.judge_required(F.col("kind")))


@query("""WITH b AS (SELECT doc_id, source, '# head' || chr(10) || text || chr(10) || ' ## tail ' AS body FROM documents)
  SELECT doc_id, md5(trim('t' || chr(10) || source || chr(10) || array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '#')), chr(10)) || chr(10) || left(body, 2000), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS query FROM b""")
def page_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("# head\n"), "text", F.lit("\n ## tail "))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(planning.page_query(F.lit("t"), F.col("source"), body)).alias("query"))


@query("""SELECT page_id, 'guide/intro-' || page_id || CASE WHEN page_id % 2 = 0 THEN '/2024' ELSE '' END AS route FROM pages""")
def unnumbered_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    path = F.concat(F.lit("/01-guide/2."), F.lit("intro-"), n, F.when(F.col("page_id") % 2 == 0, "/2024").otherwise(""), F.lit(".MDX"))
    return read(spark, sf_dir, "pages").select("page_id", planning.unnumbered_route(path).alias("route"))


@query("""SELECT p_brand AS sidebar, 'p' || p_partkey AS route FROM part UNION ALL SELECT p_brand, 'q' || p_partkey FROM part UNION ALL SELECT p_brand, 'deep' || p_partkey FROM part WHERE p_size % 2 = 0""")
def sidebar_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    deep = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"type": "category", "label": "c", "items": [{"type": "category", "items": ["deep'), n, F.lit('"]}]}'))).otherwise('{"type": "link", "href": "x"}')
    items = F.concat(F.lit('["p'), n, F.lit('", {"type": "doc", "id": "q'), n, F.lit('"}, '), deep, F.lit("]"))
    return trees.sidebar_routes(read(spark, sf_dir, "part").select(F.col("p_brand").alias("sidebar"), items.alias("items")), 4)


@query("""SELECT d.doc_id, quality AS max_lines, CASE WHEN l.doc_id IS NOT NULL THEN 'first' END AS note FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their manifest row, of which there are two for each label."""
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.lit(1).alias("ord"), F.col("quality").alias("max_lines"), F.lit("first").alias("note"))
    manifest = rows.unionByName(rows.withColumns({"ord": F.lit(2), "max_lines": F.col("max_lines") + 7, "note": F.lit("second")}))
    found = planning.with_manifest(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_path")), manifest)
    return found.withColumnRenamed("page_path", "doc_id")


@query("""SELECT doc_id, md5(CASE WHEN length(text) > 8000 THEN left(text, 8000) || chr(10) || '... (truncated)' ELSE text END) AS excerpt FROM documents""")
def unit_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(trees.excerpt(F.col("text"))).alias("excerpt"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 14 WHEN 1 THEN 9 ELSE 0 END AS tags, CASE page_id % 3 WHEN 0 THEN 8 ELSE 0 END AS leaves FROM pages""")
def page_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tags and leaves each page's dialect knows."""
    name = F.element_at(F.array(*map(F.lit, dialects.DIALECTS)), (F.col("page_id") % 3 + 1).cast("int"))
    known = F.broadcast(dialects.table(spark))  # a row for each tag
    both = read(spark, sf_dir, "pages").select("page_id", name.alias("dialect")).join(known, "dialect")
    return both.groupBy("page_id").agg(F.count("tag").alias("tags"), F.count_if("leaf").alias("leaves"))
