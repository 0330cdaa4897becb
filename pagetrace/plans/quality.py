"""Queries of structure, gates and symbols; pages.html and documents.text stand for page text, part rows for code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.operators import gates, structure, symbols
from pagetrace.shared import dealt
from pagetrace.sources import diffs, trees

from .registry import query, read

TAGS = ["article", "b", "br", "div", "h1", "li", "nav", "p", "ul"]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("page_path"), F.col("html").alias("text"))


#: Line breaks of every third page close themselves, and every fifth page has a diagram and a card.
_MARKED_SQL = """(SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(html, '<br>', '<br class="x" />') WHEN page_id % 3 = 1 THEN replace(html, '<br>', '<br/>') ELSE html END
  || CASE WHEN page_id % 5 = 0 THEN chr(10) || '```mermaid' || chr(10) || 'a' || chr(10) || '```' || chr(10) || '<div/>' ELSE '' END AS t FROM pages)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, html = F.col("page_id"), F.col("html")
    closed = F.when(k % 3 == 0, F.replace(html, F.lit("<br>"), F.lit('<br class="x" />'))).when(k % 3 == 1, F.replace(html, F.lit("<br>"), F.lit("<br/>"))).otherwise(html)
    return read(spark, sf_dir, "pages").select(k.alias("page_path"), F.concat(closed, F.when(k % 5 == 0, "\n```mermaid\na\n```\n<div/>").otherwise("")).alias("text"))


_SIGNATURE = f"""SELECT page_id AS page_path, tag, CAST(len(regexp_extract_all(t, '<' || tag || '(\\s[^>]*)?/?>')) AS BIGINT) AS opened,
    CAST(len(regexp_extract_all(t, '</' || tag || '\\s*>')) + len(regexp_extract_all(t, '<' || tag || '(\\s[^>]*)?/>')) AS BIGINT) AS closed
  FROM {_MARKED_SQL}, (VALUES {', '.join(f"('{t}')" for t in TAGS)}) t(tag)
  UNION ALL SELECT page_id, '```', CAST(len(string_split(t, '```')) - 1 AS BIGINT), 0 FROM {_MARKED_SQL} UNION ALL SELECT page_id, 'mermaid', CAST(len(string_split(t, '```mermaid')) - 1 AS BIGINT), 0 FROM {_MARKED_SQL}"""


@query(f"SELECT * FROM ({_SIGNATURE}) WHERE opened + closed > 0")
def structural_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.signature(_marked(spark, sf_dir), TAGS)


@query(f"""WITH s AS ({_SIGNATURE}), a AS (SELECT * FROM s WHERE opened + closed > 0), b AS (SELECT page_path - 1 AS page_path, tag, opened, closed FROM a WHERE page_path > 0)
  SELECT coalesce(a.page_path, b.page_path) AS page_path, coalesce(a.tag, b.tag) AS tag, coalesce(a.opened, 0) AS opened_before, coalesce(a.closed, 0) AS closed_before, coalesce(b.opened, 0) AS opened_after, coalesce(b.closed, 0) AS closed_after
  FROM a FULL OUTER JOIN b ON a.page_path = b.page_path AND a.tag = b.tag
  WHERE NOT ((coalesce(a.opened, 0) = coalesce(b.opened, 0) AND coalesce(a.closed, 0) = coalesce(b.closed, 0))
    OR (coalesce(a.tag, b.tag) IN ('li', 'p') AND coalesce(b.opened, 0) >= coalesce(a.opened, 0) AND coalesce(b.opened, 0) - coalesce(a.opened, 0) = coalesce(b.closed, 0) - coalesce(a.closed, 0)))""")
def structure_delta_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = structure.signature(_marked(spark, sf_dir), TAGS)
    after = before.where("page_path > 0").withColumn("page_path", F.col("page_path") - 1)
    return structure.changed_structure(before, after, ["li", "p"])


#: Tags in a row without their texts; pairs that hold nothing are taken out until none is left.
_NEST_TAGS = ["article", "h1", "li", "nav", "ul"]
_BARE = "regexp_replace(s, '" + "|".join(f"<{t}></{t}>" for t in _NEST_TAGS) + "', '', 'g')"


@query(f"""WITH RECURSIVE t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(html, '</ul>', '') WHEN 1 THEN replace(html, '</h1>', '</h1></li>') ELSE html END AS h FROM pages),
  r AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(h, '</?(?:{'|'.join(_NEST_TAGS)})(?:\\s[^>]*)?>'), lambda x: regexp_replace(x, '\\s.*', '>')), '') AS s, 0 AS n FROM t
    UNION ALL SELECT page_id, {_BARE}, n + 1 FROM r WHERE {_BARE} <> s)
  SELECT page_id AS page_path, min_by(s, -n) = '' AS well FROM r GROUP BY page_id""")
def wellformed_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_path") % 4
    text = F.when(k == 0, F.replace("text", F.lit("</ul>"), F.lit(""))).when(k == 1, F.replace("text", F.lit("</h1>"), F.lit("</h1></li>"))).otherwise(F.col("text"))
    return _pages(spark, sf_dir).select("page_path", structure.nesting_fault(text, _NEST_TAGS).isNull().alias("well"))


@query("""SELECT page_id AS page_path, md5(CASE page_id % 4 WHEN 1 THEN html || '<li></li>' WHEN 2 THEN replace(html, '</ul></nav>', '</nav></ul>') ELSE html END) AS text,
  page_id % 4 <> 2 OR NOT contains(html, '</ul></nav>') AS well FROM pages""")
def repaired_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every four pages, one gets a stray end tag, one a tag that is never closed, and one crossed tags, which stay."""
    k, h = F.col("page_path") % 4, F.col("text")
    text = F.when(k == 0, F.concat(h, F.lit("</nav>"))).when(k == 1, F.concat(h, F.lit("<li>"))).when(k == 2, F.replace(h, F.lit("</ul></nav>"), F.lit("</nav></ul>"))).otherwise(h)
    fixed = structure.repaired(_pages(spark, sf_dir).withColumn("text", text), _NEST_TAGS)
    return fixed.select("page_path", F.md5(F.col("text")).alias("text"), structure.nesting_fault(F.col("text"), _NEST_TAGS).isNull().alias("well"))


@query(r"""WITH l AS (SELECT DISTINCT page_id AS page_path, regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), '#.*$', '') AS target FROM pages)
  SELECT target, page_path FROM l WHERE target <> '' AND NOT regexp_matches(target, '^[a-z][a-z0-9+.-]*:') AND NOT EXISTS (SELECT 1 FROM pages p WHERE '/' || split_part(regexp_extract(p.html, '<h1>([^<]*)', 1), ' ', 1) = l.target)""")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.concat(F.lit("/"), F.split_part(F.regexp_extract("html", "<h1>([^<]*)", 1), F.lit(" "), F.lit(1)))
    existing = read(spark, sf_dir, "pages").select(first.alias("path"))
    return structure.broken(structure.links(_pages(spark, sf_dir)), existing)


@query(r"""SELECT page_id AS page_path, 'title' AS key FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS a, CASE WHEN page_id % 3 = 0 THEN upper(regexp_extract(html, '<h1>([^<]*)', 1)) ELSE regexp_extract(html, '<h1>([^<]*)', 1) END AS b FROM pages)
  WHERE trim(a) IS DISTINCT FROM trim(b)""")
def frontmatter_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    head = lambda t: F.concat(F.lit("---\ntitle: "), F.trim(t), F.lit("\ndescription: same\n---\nbody"))
    h1 = F.regexp_extract("html", "<h1>([^<]*)", 1)
    both = pages.select(F.col("page_id").alias("page_path"), head(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("before"), head(F.when(F.col("page_id") % 3 == 0, F.upper(h1)).otherwise(h1)).alias("after"))
    return structure.frozen_changes(both, ["title", "description"])


@query("""SELECT doc_id, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS how FROM (SELECT doc_id, (length(text) - length(replace(text, ' the ', ''))) // 5 AS n FROM documents)""")
def occurrence_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", gates.find_class(F.col("text"), F.lit(" the ")).alias("how"))


@query("""WITH a AS (SELECT *, (length(text) - length(replace(text, '. ', ''))) // 2 AS n1, replace(text, '. ', '; ') AS t1 FROM documents),
  b AS (SELECT *, (length(CASE WHEN n1 = 1 THEN t1 ELSE text END) - length(replace(CASE WHEN n1 = 1 THEN t1 ELSE text END, '; ', ''))) // 2 AS n2 FROM a)
  SELECT doc_id, md5(CASE WHEN n1 <> 1 THEN text WHEN n2 <> 1 THEN t1 ELSE replace(t1, '; ', '! ') END) AS result,
    CASE WHEN n1 = 0 THEN 'missing: . ' WHEN n1 > 1 THEN 'ambiguous: . ' WHEN n2 = 0 THEN 'missing: ; ' WHEN n2 > 1 THEN 'ambiguous: ; ' END AS failed FROM b""")
def applied_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = lambda a, b: F.struct(F.lit(a).alias("find"), F.lit(b).alias("replace"))
    edits = read(spark, sf_dir, "documents").select("doc_id", "text", F.array(op(". ", "; "), op("; ", "! ")).alias("ops"))
    return gates.applied(edits).select("doc_id", F.md5("result").alias("result"), "failed")


@query(r"""SELECT doc_id, lines, greatest(60, CAST(ceil(0.5 * lines) AS BIGINT)) AS budget, greatest(coalesce(own, 40), CAST(ceil(0.35 * lines) AS BIGINT)) AS own_budget FROM
  (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 5 END AS own, CASE WHEN text = '' THEN 0 ELSE CAST(len(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS BIGINT) END AS lines FROM documents)""")
def diff_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", T.line_count("text").alias("lines"))
    own = F.when(F.col("doc_id") % 7 == 0, 5)
    return docs.select("doc_id", "lines", gates.diff_budget(F.col("lines"), 60, 0.5).alias("budget"), gates.diff_budget(F.col("lines"), 40, 0.35, own).alias("own_budget"))


@query("""SELECT a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE trim(b.text) = '' OR length(b.text) < 0.5 * length(a.text)""")
def truncation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after"))
    return docs.join(after, "doc_id").where(gates.truncated(F.col("text"), F.col("after"))).select("doc_id")


@query("""SELECT doc_id, failure FROM (SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 10 = 0 THEN 'title' END, CASE WHEN lang = 'fr' THEN 'description' END, CASE WHEN length(trim(text)) < 200 THEN 'short' END], lambda x: x IS NOT NULL)) AS failure FROM documents)""")
def new_page_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    failures = gates.new_page_failures(F.when(F.col("doc_id") % 10 != 0, "a title"), F.when(F.col("lang") != "fr", "text").otherwise("  "), F.col("text"))
    return docs.select("doc_id", F.explode(failures).alias("failure"))


@query(r"""SELECT doc_id, 2 * lines AS changed_lines, budget FROM (SELECT doc_id, lines, greatest(CASE WHEN doc_id % 4 = 1 THEN 5 ELSE 40 END, CAST(ceil(0.35 * lines) AS BIGINT)) AS budget FROM
  (SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE CAST(len(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS BIGINT) END AS lines FROM documents)) WHERE 2 * lines > budget""")
def diff_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document is changed; every fourth has a budget of its own, and as many the usual one, which is none."""
    k = F.col("doc_id") % 4
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("before"), F.regexp_replace("text", r"(?m)^", "§").alias("after"), F.when(k == 1, 5).when(k == 2, 60).alias("page_lines"), F.when(k == 2, 0.5).alias("page_share"))
    return gates.oversized(docs, "light").select("doc_id", "changed_lines", "budget")


@query()
def net_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return gates.net_changed_lines(said.withColumnRenamed("text", "before").join(after, ["conv_id", "turn"])).select("conv_id", "turn", "changed_lines")


@query()
def page_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("before"), F.regexp_replace("text", r"(?m)^\w+ ", "New ").alias("after"))
    return gates.page_diff(docs).select("doc_id", F.md5("diff").alias("diff"), F.size(F.split("diff", "\n")).cast("long").alias("lines"))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small module for each part: a definition, a constant, sometimes a class, and a comparison that defines nothing."""
    name = F.regexp_replace("p_name", "[^a-z]", "_")
    n = F.col("p_partkey").cast("string")
    return dealt(read(spark, sf_dir, "part")).select("p_partkey", "p_size", name.alias("name"), n.alias("n"))


_HUNK = """SELECT 'src/b' || (p_partkey % 20) || CASE WHEN p_size % 5 = 0 THEN '.ts' ELSE '.py' END AS file_path, p_partkey AS hunk_ord, regexp_replace(p_name, '[^a-z]', '_', 'g') AS name, p_size, p_partkey % 9 AS k FROM part"""


@query(f"""WITH h AS ({_HUNK}), s AS (SELECT file_path, hunk_ord, 0 AS pos, 'f_' || name AS symbol FROM h UNION ALL SELECT file_path, hunk_ord, 1, 'C' || k FROM h WHERE p_size % 2 = 0 UNION ALL SELECT file_path, hunk_ord, 3, 'LIMIT_' || k FROM h
    UNION ALL SELECT file_path, hunk_ord, 7, unnest(['g' || k, 'H' || k]) FROM h)
  SELECT file_path, symbol, min_by(hunk_ord, (hunk_ord, pos)) AS hunk_ord, CAST(min_by(pos, (hunk_ord, pos)) AS BIGINT) AS pos FROM s WHERE ends_with(file_path, '.py') GROUP BY file_path, symbol""")
def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _code(spark, sf_dir)
    k = (F.col("p_partkey") % 9).cast("string")
    path = F.concat(F.lit("src/b"), (F.col("p_partkey") % 20).cast("string"), F.when(F.col("p_size") % 5 == 0, ".ts").otherwise(".py"))
    hunk = F.concat(
        F.concat(F.lit("@@ -1,4 +1,5 @@ def f_"), "name", F.lit("(x):")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n+class C"), k, F.lit(":"))).otherwise("\n class Old:"),
        F.lit("\n+    inner = 1"), F.lit("\n-LIMIT_"), k, F.lit(": int = 3\n+LIMIT == 4\n--- a/file\n context = 1\n+def g"), k, F.lit("(): subclass Foo; undef bar; class H"), k, F.lit("(x): y = 1"),
    )
    return symbols.changed_symbols(code.select(path.alias("file_path"), F.col("p_partkey").alias("hunk_ord"), hunk.alias("hunk")))


@query("""SELECT 'web/' || p_partkey || '.ts' AS path, unnest(['f_' || regexp_replace(p_name, '[^a-z]', '_', 'g'), 'T' || p_size]) AS symbol FROM part""")
def ts_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("import x from 'y'\nexport async function f_"), "name", F.lit("() {}\nconst hidden = 1\n  export const nested = 2\nexport interface T"), F.col("p_size").cast("string"), F.lit(" {}\n"))
    return symbols.exports(_code(spark, sf_dir).select(F.concat(F.lit("web/"), "n", F.lit(".ts")).alias("path"), text.alias("text")))


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(
        F.lit("import os\n\ndef f_"), "name", F.lit("(a, b=1):\n    \"\"\"Does it.\"\"\"\n    def inner(): pass\n    local = 1\n\nclass C"), F.col("p_size").cast("string"), F.lit(":\n    def method(self): pass\n\nX = Y = 2\nZ: int = 3\n"),
        F.when(F.col("p_size") % 11 == 0, "def broken(:\n").otherwise(""),
    )
    return _code(spark, sf_dir).select(F.concat(F.lit("src/m"), "n", F.lit(".py")).alias("path"), body.alias("text"))


@query("""SELECT 'src/m' || p_partkey || '.py' AS path, unnest(['f_' || regexp_replace(p_name, '[^a-z]', '_', 'g'), 'C' || p_size] || CASE WHEN p_size % 11 = 0 THEN ['broken'] ELSE ['X', 'Y', 'Z'] END) AS symbol FROM part""")
def py_symbols_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.python_symbols(_modules(spark, sf_dir))


@query("""SELECT 'src/m' || p_partkey || '.py' AS path, CAST(unnest(CASE WHEN p_size % 11 = 0 THEN [0, 1, 2] ELSE [0, 1] END) AS INTEGER) AS ord,
  unnest(CASE WHEN p_size % 11 = 0 THEN ['def f_' || regexp_replace(p_name, '[^a-z]', '_', 'g'), 'class C' || p_size, 'def broken'] ELSE ['def f_' || regexp_replace(p_name, '[^a-z]', '_', 'g') || '(a, b=1): Does it.', 'class C' || p_size] END) AS line FROM part""")
def api_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.surface(_modules(spark, sf_dir))


@query("""SELECT p_partkey AS diff_id, CAST(0 AS BIGINT) AS ord, 'src/' || p_size || '.py' AS path, CASE p_partkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'renamed' ELSE 'modified' END AS status,
  CASE WHEN p_partkey % 4 = 2 THEN 'old/' || p_size || '.py' END AS previous_path, CAST(CASE WHEN p_partkey % 4 = 2 THEN 0 ELSE 2 END AS BIGINT) AS hunks FROM part""")
def parsed_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    name = F.concat(F.lit("src/"), size, F.lit(".py"))
    old = F.when(k == 2, F.concat(F.lit("old/"), size, F.lit(".py"))).otherwise(name)
    head = F.when(k == 0, F.concat(F.lit("new file mode 100644\n--- /dev/null\n+++ b/"), name)).when(k == 1, F.concat(F.lit("deleted file mode 100644\n--- a/"), name, F.lit("\n+++ /dev/null"))).when(k == 2, F.concat(F.lit("similarity index 100%\nrename from "), old, F.lit("\nrename to "), name)).otherwise(F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name))
    hunks = F.when(k == 2, "").otherwise("\n@@ -1 +1 @@ def f():\n-a\n+b\n@@ -9 +9 @@\n-c\n+@@d")
    text = F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), name, F.lit("\n"), head, hunks, F.lit("\n"))
    found = diffs.parse_diffs(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("diff_id"), text.alias("text")))
    return found.withColumn("hunks", F.size("hunks").cast("long"))


@query("""SELECT kind, count(*) AS n, CAST(sum(page) AS BIGINT) AS pages FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'typescript' ELSE 'other' END AS kind, CASE WHEN p_size % 4 = 3 THEN 1 ELSE 0 END AS page FROM part) GROUP BY kind""")
def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, [".PY", ".ts", ".tsx", ".Mdx"])), (F.col("p_size") % 4 + 1).cast("int"))
    path = F.concat(F.lit("a/b"), ext)
    return read(spark, sf_dir, "part").select(trees.kind(path).alias("kind"), trees.is_page(path).cast("long").alias("page")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("page").alias("pages"))


@query(r"""WITH p AS (SELECT page_id, 'g' || (page_id % 7) || '/p' || page_id || '.md' AS page, page_id % 7 AS g FROM pages), n AS (SELECT max(page_id) AS top FROM pages),
  l AS (SELECT page, g, unnest(['./p' || (page_id + 7) || '.md', '../g' || (page_id % 7) || '/p' || (page_id - 7), '/abs/x.md', 'https://x.example/y.md', '#top', '../../out.md', 'word']) AS target, page_id FROM p)
  SELECT page AS page_path, target FROM l, n WHERE (starts_with(target, './') AND page_id + 7 > top) OR (starts_with(target, '../g') AND page_id - 7 < 0) OR target = '../../out.md'""")
def broken_relative_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    text = lambda n: n.cast("string")
    pages = read(spark, sf_dir, "pages").select(k, F.concat(F.lit("g"), text(k % 7), F.lit("/p"), text(k), F.lit(".md")).alias("page_path"))
    targets = F.array(F.concat(F.lit("./p"), text(k + 7), F.lit(".md")), F.concat(F.lit("../g"), text(k % 7), F.lit("/p"), text(k - 7)), *map(F.lit, ["/abs/x.md", "https://x.example/y.md", "#top", "../../out.md", "word"]))
    return structure.broken_files(pages.select("page_path", F.explode(targets).alias("target")), pages.select(F.col("page_path").alias("path")))


@query("""SELECT page_id FROM pages WHERE page_id % 3 = 0 AND page_id % 5 <> 0""")
def link_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    line = F.concat(F.when(k == 0, "Broken link: ").when(k == 1, "checking broken links").otherwise("ok "), F.when(k == 1, "").otherwise(F.col("url")), F.when(F.col("page_id") % 5 == 0, " (no broken links)").otherwise(""))
    return read(spark, sf_dir, "pages").where(structure.link_finding(line)).select("page_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND trim(a) <> '' AND length(a) >= 0.5 * length(text) THEN 'after' ELSE 'before' END AS kept FROM (SELECT doc_id, text, left(text, CAST(length(text) * (doc_id % 5) // 4 AS BIGINT)) AS a FROM documents)""")
def polish_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.left("text", F.floor(F.length("text") * (F.col("doc_id") % 5) / 4).cast("int"))
    chosen = gates.polished(F.lit("before"), F.lit("after"), F.col("doc_id") % 3 > 0, F.col("text"), after)
    return read(spark, sf_dir, "documents").select("doc_id", chosen.alias("kept"))
