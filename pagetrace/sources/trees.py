"""Source and documentation trees, manifests, golden sets and navigation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrace import schemas

# Folder names that are never walked.
EXCLUDED = (
    ".git",
    ".github",
    ".idea",
    ".mypy_cache",
    ".next",
    ".pytest_cache",
    ".ruff_cache",
    ".tox",
    ".venv",
    ".vscode",
    "__pycache__",
    "__tests__",
    "build",
    "coverage",
    "dist",
    "htmlcov",
    "migrations",
    "node_modules",
    "site-packages",
    "test",
    "tests",
    "vendor",
    "venv",
)


def excluded(extra: list[str] | None = None) -> list[str]:
    return sorted({*EXCLUDED, *(e.strip() for e in extra or [] if e.strip())})


def kind(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.endswith(".py"), "python").when(p.rlike(r"\.tsx?\z"), "typescript").otherwise("other")


def is_page(path: Column) -> Column:
    return F.lower(path).rlike(r"\.mdx?\z")


def _read(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    full = F.regexp_replace(F.col("_metadata.file_path"), r"\Afile:/+", "/")
    return raw.select(full.alias("full"), F.col("value").alias("text")).withColumn("path", F.substring(F.col("full"), F.lit(len(root.rstrip("/")) + 2), F.length("full"))).select("path", "text")


def source_files(spark: SparkSession, root: str, extra: list[str] | None = None, pattern: str = "*.{py,ts,tsx}", most: int | None = None) -> DataFrame:
    """path, text, kind of the source files below root, the first `most` by path; excluded folders anywhere on the way are left out."""
    files = _read(spark, root, pattern)
    inside = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded(extra))))
    found = files.where(~inside).withColumn("kind", kind(F.col("path")))
    return found.orderBy("path").limit(most) if most is not None else found


def doc_pages(spark: SparkSession, root: str) -> DataFrame:
    """page_path, text of the pages below root, but for its own state folder."""
    return _read(spark, root, "*.{md,mdx}").where("not path like '.state/%'").withColumnRenamed("path", "page_path")


def excerpt(text: Column, most: int = 8000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... (truncated)"))).otherwise(text)


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_ord, label, expected page rows of a golden file: a list, or an object with `cases`."""
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"cases ARRAY<STRUCT<{', '.join(f'{n}: {t}' for n, t in (x.split(' ', 1) for x in schemas.GOLDEN_CASE.split(', ')))}>>")["cases"]
    plain = F.from_json("value", f"ARRAY<STRUCT<{', '.join(f'{n}: {t}' for n, t in (x.split(' ', 1) for x in schemas.GOLDEN_CASE.split(', ')))}>>")
    cases = F.when(F.ltrim("value").startswith("["), plain).otherwise(wrapped)
    return raw.select(F.posexplode(cases).alias("case_ord", "c")).select(F.col("case_ord").cast("long").alias("case_ord"), "c.*")


def anchor_rules(manifest: DataFrame) -> DataFrame:
    """page_path, rule_ord, repo, rule_kind, pattern from nested rows (path, sources: repo, globs, symbols)."""
    src = manifest.select("path", F.posexplode("sources").alias("i", "s"))
    rules = src.select("path", "i", F.posexplode(F.concat(F.transform("s.globs", lambda g: F.struct(F.lit("glob").alias("rule_kind"), g.alias("pattern"))), F.transform("s.symbols", lambda g: F.struct(F.lit("symbol").alias("rule_kind"), g.alias("pattern"))))).alias("j", "r"), F.coalesce("s.repo", F.lit("")).alias("repo"))
    return rules.select(F.col("path").alias("page_path"), F.struct(F.col("i").alias("source"), F.col("j").alias("rule")).alias("rule_ord"), "repo", "r.rule_kind", "r.pattern")


def nav_routes(nav: DataFrame) -> DataFrame:
    """group_name, route, ord of navigation rows (groups: name, pages)."""
    groups = nav.select(F.posexplode("groups").alias("g_ord", "g"))
    return groups.select("g.name", "g_ord", F.posexplode("g.pages").alias("p_ord", "route")).select(F.col("name").alias("group_name"), "route", F.struct("g_ord", "p_ord").alias("ord"))


def sidebar_routes(sidebars: DataFrame, depth: int = 16) -> DataFrame:
    """sidebar, route: the page ids of sidebars (sidebar, items: JSON), those in nested categories too.

    An item is an id, a page ({"type": "doc", "id": ...}) or a category ({"items": [...]}), down to `depth` levels.
    """
    level, found = sidebars.select("sidebar", F.col("items").alias("node")), None
    for _ in range(depth):
        node = level.select("sidebar", F.explode(F.from_json("node", "array<string>")).alias("node"))
        object_ = F.from_json("node", "type STRING, id STRING, items STRING")
        told = node.withColumn("_o", F.when(F.col("node").startswith("{"), object_))
        here = told.select("sidebar", F.when(F.col("_o").isNull(), F.col("node")).when(F.col("_o.type") == "doc", F.col("_o.id")).alias("route")).where("route is not null")
        found = here if found is None else found.unionByName(here)
        level = told.where("_o.items is not null").select("sidebar", F.col("_o.items").alias("node"))
    return found
