"""Reports of runs and plans, prompt material, and small settings that go with them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrace.shared import kept

from .planning import capped


def encoded(texts: DataFrame, dim: int = 24) -> DataFrame:
    """texts with `embedding`: a deterministic hashed bag of words of unit length (zeros for a text without words).

    A word's place follows the first 32 bits of its SHA-1.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    place = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: (F.conv(F.substring(F.sha1(w.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int"))

    def many(i: int) -> Column:
        return F.size(F.filter("_place", lambda p: p == i)).cast("double")

    counted = texts.withColumn("_place", place).withColumn("_n", F.array(*map(many, range(dim))))
    norm = F.sqrt(F.aggregate("_n", F.lit(0.0), lambda a, x: a + x * x))
    return counted.withColumn("_norm", F.greatest(norm, F.lit(1e-12))).withColumn("embedding", F.transform("_n", lambda x: (x / F.col("_norm")).cast("float"))).drop("_place", "_n", "_norm")


def edit_order(pages: DataFrame, by: str) -> DataFrame:
    """Pages of each `by` numbered as they are to be edited: most confident first, then by path.

    Ranges of the whole order are numbered by themselves, after counts of the ranges before.
    """
    order = [F.col(by), F.desc("confidence"), F.col("page_path")]
    dealt = kept(pages.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "order")
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = dealt.groupBy(by, "_range").count().select(F.col(by).alias("_by"), F.col("_range").alias("_of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order[1:]))
    numbered = dealt.withColumn("_own", own).join(base, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")))
    return numbered.select(*pages.columns, (F.col("_base") + F.col("_own")).cast("long").alias("turn"))


def outcomes_of_plan(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Plan rows with the outcome of their page; `planned` where there is none yet.  Of several outcomes the last by `ord` counts, if they have one."""
    own = F.struct("applied", "note")
    outcomes = outcomes.groupBy("page_path").agg((F.max_by(own, "ord") if "ord" in outcomes.columns else F.max(own)).alias("_o")).select("page_path", "_o.*")
    state = F.when(F.col("applied").isNull(), "planned").when(F.col("applied"), "authored").otherwise("skipped")
    return plan.join(outcomes.select("page_path", "applied", "note"), "page_path", "left").withColumn("state", state)


def without_rejected(ops: DataFrame, rejected: DataFrame) -> DataFrame:
    """Edit operations whose find string a reviewer didn't reject on that page."""
    return ops.join(rejected.select("page_path", "find").distinct(), ["page_path", "find"], "left_anti")


def head_and_more(items: Column, most: int) -> Column:
    """The first items, comma-joined, and how many more there are."""
    shown = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(F.size(items) > most, F.concat(shown, F.lit(" (+"), (F.size(items) - most).cast("string"), F.lit(" more)"))).otherwise(shown)


def prefix_with_cut(sections: DataFrame, key: str, budget: int) -> DataFrame:
    """Sections (section, ord) of each key up to the budget of characters; the one that crosses it is cut, later ones go."""
    # every section has a character, so there are no more of a key than the budget has
    sections = capped(sections.where(F.length("section") > 0), key, budget)
    order = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("section")).over(order), F.lit(0))
    return sections.withColumn("_left", F.lit(budget) - used).where("_left > 0").withColumn("section", F.left("section", F.col("_left").cast("int"))).drop("_left")


def rendered_diffs(diffs: DataFrame, files: DataFrame, budget: int = 12_000) -> DataFrame:
    """diff_id, text: what a prompt shows of each diff (diff_id, repo, title), a header and its files in order, up to the budget of characters.

    files: diff_id, ord, path, status, symbols, hunks.  The header is never cut; the
    file that crosses the budget is, later ones go, and a mark tells that they did.
    A diff without files is its header.
    """
    named = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("(none)"))
    header = F.concat(F.lit("repo: "), F.coalesce("repo", F.lit("")), F.lit("\npr_title: "), named(F.col("title")), F.lit("\n"))
    about = F.concat(F.lit("\n## file: "), "path", F.lit(" ("), "status", F.lit(")\nchanged symbols: "), named(F.array_join("symbols", ", ")))
    hunks = F.coalesce("hunks", F.array().cast("array<string>"))
    sections = files.select("diff_id", "ord", F.concat_ws("\n", about, F.when(F.size(hunks) > 0, F.array_join(hunks, "\n"))).alias("section"))
    whole = sections.groupBy("diff_id").agg(F.sum(F.length("section")).alias("_whole"))
    # what is gathered of a diff is no longer than the budget
    begun = prefix_with_cut(sections, "diff_id", budget).groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "section"))), lambda x: x["section"]), "").alias("_begun"))
    both = diffs.select("diff_id", header.alias("_header")).join(whole, "diff_id", "left").join(begun, "diff_id", "left")
    room = F.greatest(F.lit(0), F.lit(budget) - F.length("_header"))
    mark = F.when(F.coalesce("_whole", F.lit(0)) > F.lit(budget) - F.length("_header"), F.when(F.col("_whole").isNotNull(), "\n... (diff truncated)"))
    return both.select("diff_id", F.concat("_header", F.left(F.coalesce("_begun", F.lit("")), room), F.coalesce(mark, F.lit(""))).alias("text"))


def heads(rows: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """key, shown: the first of each key's different items, comma-joined, and how many more there are; no key's items are gathered beyond `most`, and null keys are left out."""
    each = rows.select(key, F.col(item).alias("ord")).where("ord is not null").distinct()
    first = capped(each, key, most).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("ord")), ", ").alias("_first"))
    more = F.col("_n") - most
    told = each.groupBy(key).agg(F.count("*").alias("_n")).join(first, key)
    return told.select(key, F.when(more > 0, F.concat("_first", F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(F.col("_first")).alias("shown"))


def two_caps(lines: DataFrame, key: str, inner: str, per_inner: int, per_key: int) -> DataFrame:
    """At most per_inner lines of each inner group, and of those at most per_key of each key, by ord."""
    return capped(capped(lines, F.struct(key, inner), per_inner), key, per_key)


def token_budget(base: Column, level: Column) -> Column:
    """Output tokens for a level of thoroughness; 1024 at least."""
    share = F.when(level == "light", 0.6).when(level == "high", 1.6).otherwise(1.0)
    return F.greatest(F.lit(1024).cast("long"), F.floor(base * share).cast("long"))


def level_of(kind: Column, by_kind: dict[str, str], general: str) -> Column:
    """A kind's own level, else the general one."""
    out = F.lit(general)
    for k, level in by_kind.items():
        out = F.when(kind == k, level).otherwise(out)
    return out


def branch_name(repo_key: Column, sha: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + "/"), repo_key, F.lit("-"), F.left(sha, F.lit(8)))


def last_url(text: Column) -> Column:
    """The last web address in a text; the trimmed text if there is none."""
    found = F.regexp_extract_all(text, F.lit(r"https?://\S+"), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(F.trim(text))


def unit_text(repo: Column, path: Column, symbols: Column, excerpt: Column) -> Column:
    """What a code unit is searched by: its place, its symbols and an excerpt if there is one."""
    return F.trim(F.concat_ws("\n", F.concat_ws("/", repo, path), F.array_join(symbols, " "), F.nullif(excerpt, F.lit(""))))


def base_of(changes: DataFrame, cursors: DataFrame) -> DataFrame:
    """Changes (repo_key, base_sha) with base_sha filled from the first cursor of the repository where there is none."""
    first = cursors.groupBy("repo_key").agg(F.min_by("head_sha", "ord").alias("_cursor"))
    return changes.join(first, "repo_key", "left").withColumn("base_sha", F.coalesce(F.nullif("base_sha", F.lit("")), "_cursor")).drop("_cursor")


def health_panel(manifest: DataFrame) -> DataFrame:
    """One row: pages and anchors (all sources of all pages)."""
    return manifest.agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.size("sources")), F.lit(0)).alias("anchors"))


def markdown(outcomes: DataFrame, by: str, usage: DataFrame | None = None) -> DataFrame:
    """A report for each `by`: numbers of changed and dropped pages and the first pages of each, in order, and what the run cost.

    Lists are cut at 20 pages before they are gathered, so a report's size does
    not follow the run's.  usage: by, usage (see cost_line); a run without has no
    section on costs.
    """
    marked = outcomes.select(by, F.when(F.col("applied"), "changed").otherwise("dropped").alias("_part"), F.col("page_path").alias("ord"), "note")
    line = F.struct("ord", F.concat(F.lit("- `"), "ord", F.lit("`"), F.coalesce(F.concat(F.lit(": "), "note"), F.lit(""))).alias("line"))
    shown = capped(marked, F.struct(by, "_part"), 20).select(by, "_part", line.alias("_line"), F.lit(0).cast("long").alias("_n"))
    both = shown.unionByName(marked.groupBy(by, "_part").agg(F.count("*").alias("_n")), allowMissingColumns=True)
    lists = both.groupBy(by, "_part").agg(F.sum("_n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("_line")), lambda x: x["line"]), "\n").alias("lines"))
    text = F.concat(F.lit("## "), F.initcap("_part"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), F.col("lines"))
    told = lists.select(by, "_part", text.alias("t"))
    if usage is not None:
        told = told.unionByName(usage.select(by, F.lit("~").alias("_part"), F.concat(F.lit("## Cost\n"), cost_line(F.col("usage"))).alias("t")).where("t is not null").join(marked.select(by).distinct(), by, "left_semi"))
    return told.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "t"))), lambda x: x["t"]), "\n\n").alias("report"))


def cost_line(usage: Column) -> Column:
    """A report's line of a run's usage (cost_usd, calls, input_tokens, output_tokens, cache_hit_rate); null without one."""
    number = lambda c: F.format_number(usage[c], 0)
    line = F.concat(F.lit("~$"), F.format_string("%.4f", usage["cost_usd"]), F.lit(" in "), number("calls"), F.lit(" calls, "), number("input_tokens"), F.lit(" in / "), number("output_tokens"), F.lit(" out, "), F.format_string("%.0f", usage["cache_hit_rate"] * 100), F.lit("% hit"))
    return F.when(usage.isNotNull(), line)


def cacheable(pages: Column, rendered: Column, least: int = 16_000) -> Column:
    """Whether a diff is worth caching for the prompts of a run: several pages and a long enough text."""
    return F.coalesce((pages > 1) & (F.length(rendered) >= least), F.lit(False))


def write_pages(outcomes: DataFrame, root: str, docs_root: str = "") -> DataFrame:
    """Writes every applied page (page_path, applied, new_content) to its file below root; path and n_bytes of each file.

    path is page_path below docs_root.  Pages of the tool's own state folder stay
    unwritten.  Of several outcomes of a page that with the greatest text counts; a
    null text is an empty file.  A path that would leave the root fails the job.
    Tasks write to a draft and move it into place, so one that runs again does no harm.
    """
    pages = outcomes.where("applied and page_path is not null and not page_path like '.state/%'").groupBy("page_path").agg(F.coalesce(F.max("new_content"), F.lit("")).alias("content"))
    outside = F.col("page_path").startswith("/") | F.array_contains(F.split("page_path", "/"), "..")
    path = F.when(outside, F.raise_error(F.concat(F.lit("outside the root: "), "page_path"))).otherwise(F.concat_ws("/", F.lit(docs_root.strip("/") or None), "page_path"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                at, data = f"{base}/{name}", content.as_buffer()
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                draft = f"{at}.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as out:
                    out.write(data)
                fs.move(draft, at)
                sizes.append(data.size)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], ["path", "n_bytes"])

    return kept(pages.select(path.alias("path"), "content").mapInArrow(write, "path string, n_bytes long"), "pages")
