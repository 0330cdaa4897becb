"""Planning pages and keeping the rule table healthy."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.shared import kept, numbered

from .anchors import in_blocks, match_globs


def route_of(path: Column) -> Column:
    """Route of a page: no leading ./ or /, no page suffix, no trailing /index."""
    bare = F.regexp_replace(path, r"\A(\./|/)+", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.mdx?\z", ""), r"(/|\A)index\z", "")


def first_wins(planned: DataFrame, existing: DataFrame, taken: DataFrame, cap: int | None = None) -> DataFrame:
    """Planned pages (page_path, ord) whose path doesn't exist and whose route is free, the first of each route; then the first `cap`."""
    routed = planned.withColumn("route", route_of(F.col("page_path")))
    free = routed.join(existing.select(route_of(F.col("page_path")).alias("route")).distinct(), "route", "left_anti").join(taken.select("route").distinct(), "route", "left_anti")
    first = free.withColumn("_n", F.row_number().over(Window.partitionBy("route").orderBy("ord"))).where("_n = 1").drop("_n")
    return first.orderBy("ord").limit(cap) if cap is not None else first


def nav_additions(nav: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes (group_name, route, ord) to append: in no group of nav yet, the first of each."""
    free = routes.join(nav.select("route").distinct(), "route", "left_anti")
    return free.withColumn("_n", F.row_number().over(Window.partitionBy("route").orderBy("ord"))).where("_n = 1").drop("_n")


def merge_manifest(manifest: DataFrame, added: DataFrame) -> DataFrame:
    """Rows of added whose path is new, the first of each path; merging twice adds nothing."""
    fresh = added.join(manifest.select("path").distinct(), "path", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("ord"))).where("_n = 1").drop("_n")


def unit_line(path: Column, symbols: Column, most: int = 12) -> Column:
    """A digest's line of a code unit: its path and the first symbols."""
    shown = F.array_join(F.slice(symbols, 1, most), ", ")
    return F.concat(F.lit("- "), path, F.when(shown != "", F.concat(F.lit("  ::  "), shown)).otherwise(""))


def digests(lines: DataFrame, key: str, budget: int) -> DataFrame:
    """key, lines, units: the budgeted prefix of each key's lines (line, ord) joined, with a last line that says so if some are left out."""
    units = lines.groupBy(key).agg(F.count("*").alias("units"))
    shown = budgeted_prefix(lines, key, budget).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("s"))  # no longer than the budget
    both = units.join(shown, key, "left").withColumn("s", F.coalesce("s", F.array().cast(shown.schema["s"].dataType)))
    text = F.array_join(F.concat(F.transform("s", lambda x: x["line"]), F.when(F.size("s") < F.col("units"), F.array(F.concat(F.lit("… ("), F.col("units").cast("string"), F.lit(" in all; list cut)")))).otherwise(F.array().cast("array<string>"))), "\n")
    return both.select(key, text.alias("lines"), "units")


def budgeted_prefix(lines: DataFrame, key: str, budget: int) -> DataFrame:
    """Lines (line, ord) of each key while their lengths plus one each stay within the budget."""
    lines = capped(lines, key, budget)  # each uses one at least
    order = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("used", F.sum(F.length("line") + 1).over(order)).where(F.col("used") <= budget)


def capped(rows: DataFrame, key: Column | str, per_key: int) -> DataFrame:
    """The first per_key rows of each key by ord; groups too large for one task are cut in parts first."""
    part = F.pmod(F.xxhash64("ord"), F.lit(32))
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, part).orderBy("ord"))).where(F.col("_n") <= per_key)
    return once.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where(F.col("_n") <= per_key).drop("_n")


def ordered_sections(pages: DataFrame, canonical: list[str]) -> DataFrame:
    """section, rank, pages: known sections in canonical order, then others by first appearance."""
    seen = pages.groupBy("section").agg(F.min("ord").alias("first"), F.count("*").alias("pages"))
    known = F.array_position(F.array(*map(F.lit, canonical)), F.col("section"))
    order = Window.orderBy(F.when(known > 0, known).otherwise(F.lit(len(canonical) + 1)), "first")  # a row for each section
    return seen.withColumn("rank", F.row_number().over(order).cast("long")).select("section", "rank", "pages")


def pages_in_sections(pages: DataFrame, canonical: list[str]) -> DataFrame:
    """Pages (section, order, title, ord) with section_rank and, within their section, place by order and title."""
    ranked = pages.join(ordered_sections(pages, canonical).select(F.col("section").alias("_s"), F.col("rank").alias("section_rank")), F.col("section").eqNullSafe(F.col("_s"))).drop("_s")
    placed = kept(numbered(ranked, "section", "order", "title", "ord"), "places")
    first = placed.groupBy(F.col("section").alias("_s")).agg(F.min("number").alias("_first"))
    return placed.join(first, F.col("section").eqNullSafe(F.col("_s"))).withColumn("place", F.col("number") - F.col("_first") + 1).drop("number", "_s", "_first")


def collapsed_globs(globs: DataFrame, files: DataFrame) -> DataFrame:
    """key, pattern, place: a key's globs (key, pattern, ord), literal siblings that are all there is replaced by their cover.

    Patterns with wildcards come first, then the literal ones that are left, then covers.
    """
    literal = T.is_literal("pattern")
    first = globs.groupBy("key", "pattern").agg(F.min("ord").alias("ord"))
    directory, ext = r"\A(.*)/[^/]*\z", r"(\.[^./]*)\z"
    own = first.where(literal).withColumn("cover", F.concat(F.regexp_extract("pattern", directory, 1), F.lit("/*"), F.regexp_extract("pattern", ext, 1)))
    covers = exact_covers(first.where(literal).select("key", "pattern"), files).select("key", F.col("pattern").alias("cover"))
    used = own.join(covers, ["key", "cover"], "left_semi")
    rows = first.where(~literal).select("key", "pattern", F.lit(0).alias("part"), "ord")
    rows = rows.unionByName(own.join(used.select("key", "pattern"), ["key", "pattern"], "left_anti").select("key", "pattern", F.lit(1).alias("part"), "ord"))
    rows = rows.unionByName(used.groupBy("key", F.col("cover").alias("pattern")).agg(F.min("ord").alias("ord")).select("key", "pattern", F.lit(2).alias("part"), "ord"))
    return rows.select("key", "pattern", F.row_number().over(Window.partitionBy("key").orderBy("part", "ord")).cast("long").alias("place"))


def planned_excerpts(sources: DataFrame, units: DataFrame, per_page: int = 6) -> DataFrame:
    """page_path, repo, path: the first units (repo, path, ord) that a page's sources (page_path, repo, pattern, source_ord) match in their repository, each once."""
    hits = match_globs(units.select(F.concat("repo", F.lit("\u0001"), "path").alias("path"), F.col("ord").alias("unit_ord")), sources.select("page_path", F.concat(F.replace(F.replace("repo", F.lit("["), F.lit("[[]")), F.lit("*"), F.lit("[*]")), F.lit("\u0001"), "pattern").alias("pattern"), "source_ord"))
    once = hits.groupBy("page_path", "path").agg(F.min(F.struct("source_ord", "unit_ord")).alias("ord"))
    parts = F.split("path", "\u0001")
    return capped(once, "page_path", per_page).select("page_path", parts[0].alias("repo"), parts[1].alias("path"))


def inferred_sources(sources: DataFrame, repos: DataFrame) -> DataFrame:
    """sources (repo, ...) of repositories that are there, named as repos (repo) names them; repositories compare by key."""
    known = repos.groupBy(T.repo_key("repo").alias("_key")).agg(F.min("repo").alias("_repo"))
    return sources.join(known, T.repo_key("repo") == F.col("_key")).withColumn("repo", F.col("_repo")).drop("_key", "_repo")


def with_manifest(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """Candidates (page_path) with the columns of the first manifest row (path, ord, ...) of their page; nulls where there is none."""
    own = [c for c in manifest.columns if c not in ("path", "ord")]
    first = manifest.groupBy(F.col("path").alias("_path")).agg(F.min_by(F.struct(*own), "ord").alias("_page"))
    return candidates.join(first, F.col("page_path") == F.col("_path"), "left").select(*candidates.columns, "_page.*")


def work_and_skipped(existing: DataFrame, manifest: DataFrame) -> DataFrame:
    """existing (page_path) with `state`: skipped if the manifest (path) has the page, else work."""
    known = manifest.select(F.col("path").alias("_path")).distinct().withColumn("_known", F.lit(True))
    return existing.join(known, F.col("page_path") == F.col("_path"), "left").withColumn("state", F.when(F.col("_known"), "skipped").otherwise("work")).drop("_path", "_known")


def judge_required(kind: Column) -> Column:
    """Whether pages of a kind are never passed without a judgement."""
    return F.coalesce(kind.isin("concept", "guide"), F.lit(False))


def normal_path(path: Column, suffix: str = ".mdx") -> Column:
    """A page's path without leading slashes and with a suffix."""
    bare = F.regexp_replace(F.trim(path), r"\A/+", "")
    return F.when(F.lower(bare).rlike(r"\.(mdx|md|markdown)\z"), bare).otherwise(F.concat(bare, F.lit(suffix)))


def unnumbered_route(path: Column) -> Column:
    """A page's route without its suffix and without the numbers that order its parts (01-intro is intro)."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\A/+", ""), r"(?i)\.(mdx|md|markdown)\z", "")
    return F.array_join(F.transform(F.split(bare, "/"), lambda part: F.regexp_replace(part, r"\A\d+\s*[-_.]+\s*(?=[^-_.\s])", "")), "/")


def page_query(title: Column, description: Column, body: Column, most: int = 2000) -> Column:
    """What a page is searched by: title, description, headings and the first characters of its body."""
    headings = F.filter(F.transform(F.split(body, "\n"), lambda line: F.trim(line)), lambda line: line.startswith("#"))
    return F.regexp_replace(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), headings, F.left(body, F.lit(most))), r"\A\s+|\s+\z", "")


def docs_root(paths: DataFrame) -> DataFrame:
    """One row: the folder of the highest docs.json (else mint.json) among paths (path), else the one that all pages lie in, else `.`."""
    rank = F.when(F.col("path").rlike(r"(\A|/)docs\.json\z"), 0).when(F.col("path").rlike(r"(\A|/)mint\.json\z"), 1)
    named = paths.withColumn("_rank", rank).where("_rank is not null").agg(F.min(F.struct("_rank", F.size(F.split("path", "/")).alias("n"), "path")).alias("m"))
    named = named.select(F.regexp_replace(F.col("m.path"), r"/?[^/]*\z", "").alias("_named"))
    pages = common_directory(paths.where(F.lower("path").rlike(r"\.mdx?\z")))
    both = named.select(F.lit(0).alias("n"), F.col("_named").alias("directory")).unionByName(pages.select(F.lit(1).alias("n"), "directory")).where("directory is not null")
    found = F.coalesce(F.min(F.struct("n", "directory"))["directory"], F.lit(""))
    return both.agg(F.when(found == "", ".").otherwise(found).alias("directory"))


def exact_covers(globs: DataFrame, files: DataFrame) -> DataFrame:
    """key, pattern, covered: dir/*.ext for each key whose two or more literal siblings are all there is.

    globs: key, pattern (a literal path); files: path.  As * crosses /, files in
    folders below count too: any of them not listed breaks the cover.
    """
    directory, ext = r"\A(.*)/[^/]*\z", r"(\.[^./]*)\z"
    own = globs.distinct().select("key", "pattern", F.regexp_extract("pattern", directory, 1).alias("dir"), F.regexp_extract("pattern", ext, 1).alias("ext")).where("dir <> '' and ext <> ''")
    listed = own.groupBy("key", "dir", "ext").agg(F.count("*").alias("listed")).where("listed >= 2")
    wide = listed.select("key", "dir", "ext", "listed", F.concat("dir", F.lit("/*"), "ext").alias("pattern"))
    there = match_globs(files.select("path").distinct(), wide).groupBy("key", "pattern").agg(F.count("*").alias("there"))
    real = own.join(files.select(F.col("path").alias("pattern")).distinct(), "pattern", "left_semi").groupBy("key", "dir", "ext").agg(F.count("*").alias("real"))
    both = wide.join(there, ["key", "pattern"]).join(real, ["key", "dir", "ext"])
    return both.where("there = real and real = listed").select("key", "pattern", F.col("there").alias("covered"))


def dead_globs(rules: DataFrame, paths: DataFrame) -> DataFrame:
    """Rules (page_path, pattern) that match no path."""
    alive = match_globs(paths.select("path").distinct(), rules.select("pattern").distinct()).select("pattern").distinct()
    return rules.join(alive, "pattern", "left_anti")


def live_globs(rules: DataFrame, paths: DataFrame) -> DataFrame:
    alive = match_globs(paths.select("path").distinct(), rules.select("pattern").distinct()).select("pattern").distinct()
    return rules.join(alive, "pattern", "left_semi")


def missing_symbols(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """Symbols (symbol) that no text contains: a pass over the texts for each block of symbols."""
    left = symbols
    for block in in_blocks(symbols.select("symbol").distinct()):
        seen = texts.join(F.broadcast(block), F.contains(F.col("text"), F.col("symbol"))).select("symbol").distinct()
        left = left.join(seen, "symbol", "left_anti")
    return left


#: Symbols that a text is searched for at once, and bytes of texts that one group of them is searched in.
NEEDLES, SEARCHED = 32_768, 16 << 20


def found_needles(texts: DataFrame) -> DataFrame:
    """path, needle of the needles that each text contains, from path, text, needles (an array without empty ones).

    An automaton over a row's needles reads its text once, whatever they are.
    """
    import ahocorasick

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[list, ahocorasick.Automaton] | None = None
        for batch in batches:
            paths, found = [], []
            for path, text, needles in zip(*(batch.column(c).to_pylist() for c in ("path", "text", "needles"))):
                if not needles:
                    continue
                if known is None or known[0] != needles:
                    automaton = ahocorasick.Automaton()
                    for n in needles:
                        automaton.add_word(n, n)
                    automaton.make_automaton()
                    known = needles, automaton
                hits = sorted({n for _, n in known[1].iter(text)})
                paths += [path] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.string())], ["path", "needle"])

    return texts.select("path", "text", "needles").mapInArrow(search, "path string, needle string")


def found_in_classes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """_class, needle of the needles (wanted: _class, needle) that any text of their class contains (texts: _class, path, text).

    A class's needles and texts are dealt into parts, and each part of the needles
    meets each part of the texts in one group, so that no group grows with the
    input and needles are not repeated for each text.
    """
    import ahocorasick

    parts = wanted.groupBy("_class").agg(F.ceil(F.count("*") / NEEDLES).alias("_parts"))
    sizes = texts.groupBy("_class").agg(F.ceil((F.sum(F.octet_length("text")) + 1) / SEARCHED).alias("_salts"))
    counts = kept(parts.join(sizes, "_class"), "parts")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = texts.join(counts, "_class").select("_class", each("_parts").alias("_part"), F.pmod(F.xxhash64("path"), "_salts").alias("_salt"), "text")
    right = wanted.join(counts, "_class").select("_class", F.pmod(F.xxhash64("needle"), "_parts").alias("_part"), each("_salts").alias("_salt"), "needle")

    def search(key: tuple, texts: pa.Table, needles: pa.Table) -> pa.Table:
        found: set[str] = set()
        if needles.num_rows:
            automaton = ahocorasick.Automaton()
            for n in needles.column("needle").to_pylist():
                automaton.add_word(n, n)
            automaton.make_automaton()
            for chunk in texts.select(["text"]).to_batches(max_chunksize=1000):
                for text in chunk.column(0).to_pylist():
                    found.update(n for _, n in automaton.iter(text))
        return pa.table({"_class": pa.array([key[0].as_py()] * len(found), pa.string()), "needle": pa.array(sorted(found), pa.string())})

    keys = ["_class", "_part", "_salt"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "_class string, needle string").distinct()


def missing_rule_symbols(sources: DataFrame, files: DataFrame) -> DataFrame:
    """page_path, source_ord, repo, symbol of each source's symbols that none of its own files contains.

    sources: page_path, source_ord, repo, globs, symbols (arrays); files: repo, path,
    text.  A source's files are those of its repository (by key) that one of its
    globs matches; a symbol that ends in * stands for what comes before.  Symbols
    that are then empty are never missing; those of a source whose globs match no
    file all are.  Sources of repositories without files are left out, as are null
    texts.
    """
    files = files.select(T.repo_key("repo").alias("key"), "path", "text")
    there = files.select(F.col("key").alias("_key")).distinct()
    own = kept(sources.withColumn("_source", F.sha2(F.to_json(F.struct("page_path", "source_ord", "repo")), 256)).withColumn("_repo", T.repo_key("repo")).join(there, F.col("_repo") == F.col("_key"), "left_semi"), "sources")
    # a repository is the beginning of its files' paths, its wildcards taken literally
    escaped = F.regexp_replace("_repo", r"([\[*?])", "[$1]")
    globs = own.select("_source", F.explode("globs").alias("glob"), escaped.alias("_repo")).select("_source", F.concat("_repo", F.lit("\u0001"), "glob").alias("pattern"))
    full = files.select(F.concat("key", F.lit("\u0001"), "path").alias("path"), "text")
    hits = match_globs(full.select("path").distinct(), globs.select("pattern").distinct())
    symbol = own.select("_source", F.explode("symbols").alias("symbol")).distinct()
    needles = kept(symbol.withColumn("needle", F.regexp_replace("symbol", r"\*\z", "")).where("needle <> ''"), "needles")
    # what each of a source's globs is asked for; many sources share a glob
    asked = kept(globs.distinct().join(needles.select("_source", "needle").distinct(), "_source"), "asked")
    # files that the same globs match are of one class, and are searched for what any of these is asked for
    listed = hits.groupBy("path").agg(F.sort_array(F.collect_set("pattern")).alias("_globs"))
    member = kept(listed.withColumn("_class", F.sha2(F.to_json("_globs"), 256)), "matched")
    classes = kept(member.groupBy("_class").agg(F.first("_globs").alias("_globs")).select("_class", F.explode("_globs").alias("pattern")), "classes")
    wanted = kept(classes.join(asked.select("pattern", "needle").distinct(), "pattern").select("_class", "needle").distinct(), "wanted")
    found = found_in_classes(full.where("text is not null").join(member.select("path", "_class"), "path").select("_class", "path", "text"), wanted)
    # a symbol is alive for a glob if a file of any of the glob's classes has it
    there = found.join(classes, "_class").select("pattern", "needle").distinct()
    alive = asked.join(there, ["pattern", "needle"]).select("_source", "needle").distinct()
    missing = needles.join(alive, ["_source", "needle"], "left_anti")
    return own.select("_source", "page_path", "source_ord", "repo").join(missing, "_source").select("page_path", "source_ord", "repo", "symbol")


def missing_pages(rules: DataFrame, pages: DataFrame) -> DataFrame:
    return rules.join(pages.select("page_path").distinct(), "page_path", "left_anti")


def unmapped_repos(rules: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Distinct repository keys of rules without a checkout; the empty (any) repository needs none."""
    used = rules.where("repo <> ''").select(T.repo_key("repo").alias("key")).distinct()
    return used.join(checkouts.select(T.repo_key("repo").alias("key")).distinct(), "key", "left_anti")


def healthy(missing: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: counts and ok; symbols that are missing only warn."""
    both = missing.select(F.lit(1).alias("m"), F.lit(0).alias("d")).unionByName(dead.select(F.lit(0).alias("m"), F.lit(1).alias("d")))
    counts = both.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("missing_pages"), F.coalesce(F.sum("d"), F.lit(0)).alias("dead_globs"))
    return counts.withColumn("ok", (F.col("missing_pages") == 0) & (F.col("dead_globs") == 0))


def repo_mode(sources: DataFrame, docs_repo: str) -> DataFrame:
    """One row: mode poly if there are several distinct repositories, mono if the only one is the docs', else single."""
    keys = sources.where("repo <> ''").select(T.repo_key("repo").alias("key"))
    found = keys.agg(F.countDistinct("key").alias("repos"), F.min("key").alias("only"))
    return found.select("repos", F.when(F.col("repos") > 1, "poly").when(F.col("only") == T.repo_key(F.lit(docs_repo)), "mono").otherwise("single").alias("mode"))


def common_directory(paths: DataFrame) -> DataFrame:
    """One row: the longest directory that all paths (path) lie in; the least and greatest path decide."""
    ends = paths.agg(F.min(F.split("path", "/")).alias("a"), F.max(F.split("path", "/")).alias("b"))
    both = F.least(F.size("a"), F.size("b")) - 1
    same = F.filter(F.sequence(F.lit(0), both), lambda n: F.slice("a", 1, n) == F.slice("b", 1, n))
    return ends.select(F.array_join(F.slice("a", 1, F.array_max(same)), "/").alias("directory"))
