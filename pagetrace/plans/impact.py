"""Impact queries: pages.url stands for changed paths, part.p_brand for symbols, documents and labels for pages and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.operators import anchors, vectors

from pagetrace.shared import folder

from .registry import query, read

RULES = [
    ("guide/english.md", 0, "/en/*"),
    ("guide/english.md", 1, "/en/6*"),
    ("guide/one.md", 2, "/en/25"),
    ("ref/html.md", 3, "*.html"),
    ("ref/pairs.md", 4, "*/[0-9][0-9]"),
    ("ref/long.md", 5, "/[!e]?/??*"),
]
_RULES = r"""(VALUES ('guide/english.md', 0, '/en/*', '/en/.*'), ('guide/english.md', 1, '/en/6*', '/en/6.*'), ('guide/one.md', 2, '/en/25', '/en/25'),
  ('ref/html.md', 3, '*.html', '.*\.html'), ('ref/pairs.md', 4, '*/[0-9][0-9]', '.*/[0-9][0-9]'), ('ref/long.md', 5, '/[!e]?/??*', '/[^e]./...*')) AS r(page_path, rule_ord, pattern, rx)"""
_PATHS = r"(SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) AS p"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.url_path("url").alias("path"))


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "page_path string, rule_ord int, pattern string")


@query(f"""SELECT page_path, CAST(count(*) AS DOUBLE) AS score FROM {_PATHS} JOIN {_RULES} ON regexp_full_match(p.path, r.rx) GROUP BY page_path""")
def anchor_glob_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.scores(anchors.match_globs(_paths(spark, sf_dir), _rules(spark))).select("page_path", "score")


@query(f"""SELECT page_path, string_agg(pattern || ' x' || n, '; ' ORDER BY rule_ord) AS reason FROM
  (SELECT page_path, rule_ord, pattern, count(*) AS n FROM {_PATHS} JOIN {_RULES} ON regexp_full_match(p.path, r.rx) GROUP BY ALL) GROUP BY page_path""")
def anchor_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.scores(anchors.match_globs(_paths(spark, sf_dir), _rules(spark))).select("page_path", "reason")


@query("""SELECT page_path, count(*) AS hits FROM part JOIN (VALUES ('a.md', 'Brand#2'), ('b.md', 'Brand#1*'), ('c.md', '*'), ('a.md', 'brand#2')) AS r(page_path, pattern)
  ON CASE WHEN ends_with(pattern, '*') THEN starts_with(p_brand, left(pattern, length(pattern) - 1)) ELSE p_brand = pattern END GROUP BY page_path""")
def anchor_symbol_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("a.md", "Brand#2"), ("b.md", "Brand#1*"), ("c.md", "*"), ("a.md", "brand#2")], "page_path string, pattern string")
    symbols = read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"))
    return anchors.match_symbols(symbols, rules).groupBy("page_path").agg(F.count("*").alias("hits"))


@query(f"""SELECT page_path, count(*) AS hits FROM {_PATHS} JOIN (VALUES ('all.md', '', ''), ('spam.md', 'https://git.example/x/Spam-Farm.example.org.git/', 'spam-farm.example.org')) AS r(page_path, rule_repo, key)
  ON rule_repo = '' OR lower(host) = key GROUP BY page_path""")
def anchor_repo_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("all.md", ""), ("spam.md", "https://git.example/x/Spam-Farm.example.org.git/")], "page_path string, rule_repo string")
    changes = read(spark, sf_dir, "pages").select("page_id", T.url_host("url").alias("repo"))
    return anchors.in_scope(changes, rules).groupBy("page_path").agg(F.count("*").alias("hits"))


@query("""WITH c AS (SELECT source AS page_path, 'embedding' AS source, CAST(n_chars % 100 AS DOUBLE) AS score, doc_id AS ord FROM documents
    UNION ALL SELECT d.source, 'anchor', CAST(l.quality AS DOUBLE), 1000000 + l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE d.doc_id % 3 = 0)
  SELECT page_path, source, score, first AS ord FROM (SELECT *, min(ord) OVER (PARTITION BY page_path) AS first,
    row_number() OVER (PARTITION BY page_path ORDER BY (source = 'anchor') DESC, score DESC, ord) AS n FROM c) WHERE n = 1""")
def candidate_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    near = docs.select(F.col("source").alias("page_path"), F.lit("embedding").alias("source"), (F.col("n_chars") % 100).cast("double").alias("score"), F.col("doc_id").alias("ord"))
    anchored = labels.join(docs.where("doc_id % 3 = 0"), "doc_id").select(F.col("source").alias("page_path"), F.lit("anchor").alias("source"), F.col("quality").cast("double").alias("score"), (F.col("doc_id") + 1000000).alias("ord"))
    return anchors.anchor_wins(near.unionByName(anchored))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def recall_net_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_path"))
    return anchors.not_anchored(docs, read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_path"))).select(F.col("page_path").alias("doc_id"))


@query("""SELECT source, judge_required, CASE WHEN source = 'anchor' AND NOT judge_required THEN 'autopass' WHEN coalesce(toxic = 0 AND 0.4 + 0.2 * quality >= 0.5, false) THEN 'kept' ELSE 'dropped' END AS decision, count(*) AS n
  FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'anchor' ELSE 'embedding' END AS source, lang = 'fr' AS judge_required FROM documents) LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def autopass_judge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_path"), F.when(F.col("doc_id") % 4 == 0, "anchor").otherwise("embedding").alias("source"), (F.col("lang") == "fr").alias("judge_required"))
    verdicts = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_path"), (F.col("toxic") == 0).alias("affected"), (F.lit(0.4) + F.lit(0.2) * F.col("quality")).alias("confidence"), F.lit(2).alias("ord"))
    verdicts = verdicts.unionByName(verdicts.withColumns({"affected": F.lit(True), "confidence": F.lit(0.9), "ord": F.lit(1)}))  # an earlier verdict of each
    return anchors.judged(docs, verdicts).groupBy("source", "judge_required", "decision").agg(F.count("*").alias("n"))


@query(f"""SELECT page_id FROM (SELECT *, CASE WHEN page_id % 5 = 0 THEN 'de/' || page_id END AS previous_path FROM {_PATHS})
  WHERE NOT (ltrim(path, '/') = 'en' OR starts_with(ltrim(path, '/'), 'en/')) AND NOT coalesce(previous_path = 'en' OR starts_with(previous_path, 'en/'), false)""")
def docs_subtree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _paths(spark, sf_dir).select("page_id", F.ltrim(F.col("path"), F.lit("/")).alias("path"), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("de/"), F.col("page_id").cast("string"))).alias("previous_path"))
    return anchors.outside_docs(files, "/en/").select("page_id")


@query("""SELECT status, count(*) AS n, min(page_path) AS first FROM (SELECT page_path, confidence, CASE WHEN confidence < 0.5 THEN 'below_floor'
    WHEN row_number() OVER (PARTITION BY confidence >= 0.5 ORDER BY confidence DESC, page_path) <= 25 THEN 'edited' ELSE 'capped' END AS status
  FROM (SELECT 'd' || doc_id AS page_path, CAST(n_chars % 1000 AS DOUBLE) / 1000 AS confidence FROM documents)) GROUP BY status""")
def floor_cap_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("page_path"), ((F.col("n_chars") % 1000).cast("double") / 1000).alias("confidence"))
    return anchors.floor_and_cap(pages, 0.5, 25).groupBy("status").agg(F.count("*").alias("n"), F.min("page_path").alias("first"))


@query(f"""SELECT token, min(ord) AS ord FROM (SELECT regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS token, page_id AS ord FROM {_PATHS})
  WHERE token <> '' AND lower(token) NOT IN ('index', 'readme', '25') GROUP BY token""".replace("\\\\", "\\"))
def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _paths(spark, sf_dir).select(T.stem("path").alias("token"), F.col("page_id").alias("ord"))
    return anchors.query_tokens(tokens, ["index", "readme", "25"])


@query("""WITH last AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS head FROM events GROUP BY user_id)
  SELECT e.event_id FROM events e LEFT JOIN last l ON e.user_id = l.user_id AND e.event_id = l.head WHERE l.head IS NULL""")
def already_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("ts", "event_id", F.concat(F.lit("git.example/Team/U"), F.col("user_id").cast("string")).alias("repo"), F.col("event_id").cast("string").alias("head_sha"))
    last = events.groupBy("repo").agg(F.max(F.struct("ts", "event_id")).alias("x")).select(F.lower(F.concat("repo", F.lit(".git/"))).alias("repo"), F.col("x.event_id").cast("string").alias("head_sha"))
    return anchors.unprocessed(events, last).select("event_id")


@query(f"""WITH t AS (SELECT p_brand AS token, 0 AS part, p_partkey AS ord FROM part UNION ALL SELECT regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', ''), 1, page_id FROM {_PATHS}),
  f AS (SELECT token, min((part, ord)) AS at_ FROM t WHERE token <> '' AND lower(token) NOT IN ('25', 'brand#2') GROUP BY token) SELECT token, CAST(struct_extract(at_, 1) AS INTEGER) AS part, CAST(struct_extract(at_, 2) AS BIGINT) AS ord FROM f""")
def symbol_and_stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.col("p_partkey").cast("long").alias("ord"))
    paths = _paths(spark, sf_dir).select("path", F.col("page_id").cast("long").alias("ord"))
    return anchors.projected_tokens(symbols, paths, ["25", "brand#2"]).select("token", "ord.part", "ord.ord")


@query("""SELECT DISTINCT lang AS case_id, source AS page_path FROM documents WHERE doc_id % 3 = 0 OR n_chars % 5 = 0""")
def mapped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("case_id"), F.col("source").alias("page_path"), "doc_id", "n_chars")
    return anchors.mapped_pages(docs.where("doc_id % 3 = 0"), docs.where("n_chars % 5 = 0"))


_COS = "list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))"


@query(f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE id = 0)
  SELECT id, round({_COS}, 6) AS score FROM v, q WHERE {_COS} >= 0.2 ORDER BY {_COS} DESC, id LIMIT 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("id = 0").first()["embedding"]
    return vectors.top_k(e, list(q), 5, 0.2).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE id = 0)
  SELECT label AS page_path, round(max({_COS}), 6) AS score FROM v, q GROUP BY label""")
def best_chunk_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    scored = e.select(F.col("label").alias("page_path"), T.cosine("embedding", F.array(*map(F.lit, q))).alias("score"))
    return vectors.best_chunk(scored).select("page_path", F.round("score", 6).alias("score"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(e, e)), 5) AS norm, round(e[1] / greatest(sqrt(list_dot_product(e, e)), 1e-12), 5) AS first
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)""")
def l2_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    unit = vectors.normalised(e.withColumn("norm", F.round(T.l2_norm("embedding"), 5)))
    return unit.select("vec_id", "norm", F.round(F.element_at("embedding", 1), 5).alias("first"))


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(rf"""WITH m AS (SELECT page_id, regexp_replace(regexp_replace(html, '<h1>', chr(10) || '# ', 'g'), '<p>', chr(10) || '# ', 'g') AS t FROM pages),
  x AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(t, '\n(\s*#)', chr(1) || '\1', 'g'), chr(1)), lambda c: trim(c, {_WHITE})), lambda c: c <> '') AS c FROM m)
  SELECT page_id, CAST(unnest(range(0, len(c))) AS BIGINT) AS chunk_ord, md5(unnest(c)) AS chunk FROM x""")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = read(spark, sf_dir, "pages").select(F.col("page_id").alias("page_path"), F.regexp_replace(F.regexp_replace("html", "<h1>", "\n# "), "<p>", "\n# ").alias("text"))
    return vectors.sections(marked).select(F.col("page_path").alias("page_id"), "chunk_ord", F.md5("chunk").alias("chunk"))


_HASHED = "SELECT source, doc_id, sha256(doc_id || ':' || sha256(text)) AS h FROM documents"


def _hash_sql(rows: str, model: str) -> str:
    sums = " || ':' || ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS HUGEINT)) AS VARCHAR)" for i in range(4))
    return f"SELECT source, sha256('{model}:' || count(*) || ':' || {sums}) AS content_hash FROM ({rows}) GROUP BY source"


@query(_hash_sql(_HASHED, "hash-24"))
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), F.col("text").alias("part"))
    return vectors.content_hash(rows, "source", "hash-24")


@query("""SELECT count(*) AS chunks, count(DISTINCT label) AS pages FROM embeddings""")
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.index_size(read(spark, sf_dir, "embeddings").select(F.col("label").alias("page_path")))


@query(f"""WITH a AS ({_hash_sql(_HASHED, "m")}), b AS ({_hash_sql(_HASHED + " WHERE doc_id % 1000 <> 7", "m")})
  SELECT a.source FROM a LEFT JOIN b ON a.source = b.source AND a.content_hash = b.content_hash WHERE b.source IS NULL""")
def stale_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), F.col("text").alias("part"))
    return vectors.stale(vectors.content_hash(rows, "source", "m"), vectors.content_hash(rows.where("ord % 1000 <> 7"), "source", "m"), "source").select("source")


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  q AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % 50 = 0),
  s AS (SELECT query_id, vec_id AS id, round(list_dot_product(e, q) / (greatest(sqrt(list_dot_product(e, e)), 1e-12) * greatest(sqrt(list_dot_product(q, q)), 1e-12)), 12) AS score FROM q, v)
  SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE score >= 0.2
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""")
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    at = folder(spark, "index")
    found, cells = vectors.in_cells(rows, 64)
    vectors.save_index(found, at, "code", "m", "h1")
    queries = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    best = vectors.top_k_each(vectors.load_index(spark, at, "code", "m", "h1"), cells, queries, 5, 0.2)
    return best.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("""WITH v AS (SELECT vec_id, vec_id // 4 AS page, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  q AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % 50 = 0),
  s AS (SELECT query_id, page AS id, max(round(list_dot_product(e, q) / (greatest(sqrt(list_dot_product(e, e)), 1e-12) * greatest(sqrt(list_dot_product(q, q)), 1e-12)), 12)) AS score FROM q, v GROUP BY query_id, page)
  SELECT query_id, id, round(score, 6) AS score FROM s WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3""")
def indexed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    found, cells = vectors.in_cells(rows.select(F.floor(F.col("vec_id") / 4).alias("id"), "embedding"), 64)
    best = vectors.top_k_each(found, cells, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 3, 0.2)
    return best.select("query_id", "id", F.round("score", 6).alias("score"))


@query("""SELECT vec_id, 'same' AS kept FROM embeddings""")
def saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that is kept and read again; one of another kind, model or content is not found."""
    at = folder(spark, "index")
    vectors.save_index(read(spark, sf_dir, "embeddings"), at, "docs", "m", "h1")
    missed = [vectors.load_index(spark, *x) for x in ((at, "code", "m", "h1"), (at, "docs", "n", "h1"), (at, "docs", "m", "h2"), (at + "x", "docs", "m", "h1"))]
    return vectors.load_index(spark, at, "docs", "m", "h1").select("vec_id", F.lit("same" if missed == [None] * 4 else "found").alias("kept"))
