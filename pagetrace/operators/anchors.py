"""Which pages a change touches: pattern joins between changes and rules, candidates, gates."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.shared import kept


def in_blocks(rows: DataFrame, size: int = 5000) -> Iterator[DataFrame]:
    """A stated set in blocks of at most `size` rows, each small enough to broadcast."""
    held: list = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield rows.sparkSession.createDataFrame(held, rows.schema)
            held = []
    if held:
        yield rows.sparkSession.createDataFrame(held, rows.schema)


#: Columns that match_globs makes for itself.
RESERVED = ("_rx", "_dir", "_level", "_up", "_gram", "_grams")
#: Longest run of literal characters that paths are looked up by.
GRAM = 3
#: Pairs of a path and a pattern with one piece that are tested in one part.
TESTED = 1_000_000


def literal_runs(pattern: Column) -> Column:
    """The runs of a glob that stand for themselves: what lies between its wildcards and sets."""
    return F.split(F.regexp_replace(pattern, r"\[!?\]?[^\]]*\]", "*"), r"[*?]+")


def _grams(runs: Column, longest: int = GRAM) -> Column:
    """All pieces of `longest` characters of the runs; shorter runs are pieces as they are."""
    cut = F.transform(F.filter(runs, lambda r: r != ""), lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - longest + 1)), lambda i: F.substring(r, i, F.lit(longest))))
    return F.array_distinct(F.flatten(cut))


def _by_gram(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """path, pattern of the pairs that match, for distinct paths and for patterns (pattern, _rx) with a literal run.

    A path that a pattern matches has all pieces of the pattern's runs, so each
    pattern looks only at the paths that have its rarest piece.
    """
    pieces = patterns.select("pattern", "_rx", F.explode(_grams(literal_runs(F.col("pattern")))).alias("_gram"))
    wanted = pieces.select("_gram").distinct()
    whole = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("path") - n + 1)), lambda i: F.substring(F.col("path"), i, n))))
    index = kept(paths.select("path", F.explode(F.array_distinct(whole)).alias("_gram")).join(wanted, "_gram", "left_semi"), "grams")
    often = index.groupBy("_gram").agg(F.count("*").alias("_n"))
    # a pattern with a piece that no path has matches none
    rarest = pieces.join(often, "_gram", "left").groupBy("pattern", "_rx").agg(F.min_by("_gram", F.coalesce("_n", F.lit(0))).alias("_gram"))
    rarest = kept(rarest, "rarest")
    # a piece that many paths and many patterns have is tested in parts of its paths
    loads = often.join(rarest.groupBy("_gram").agg(F.count("*").alias("_asked")), "_gram").select("_gram", F.ceil(F.col("_n") * F.col("_asked") / TESTED).alias("_salts"))
    dealt = index.join(loads, "_gram").select("_gram", F.pmod(F.xxhash64("path"), "_salts").alias("_salt"), "path")
    asked = rarest.join(loads, "_gram").select("_gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt"), "pattern", "_rx")
    return dealt.join(asked, ["_gram", "_salt"]).where(F.rlike(F.col("path"), F.col("_rx"))).select("path", "pattern")


def match_globs(paths: DataFrame, rules: DataFrame, depth: int = 8) -> DataFrame:
    """All (path row, rule row) pairs whose path matches the rule's pattern; rows of both sides.

    paths: path, ...; rules: pattern, ...; no other column in common, and none of
    the names in RESERVED.  Rules are dealt to joins, each into one: a pattern
    without wildcards is an equality; one with a literal directory meets the paths
    below that directory by equality and is then tested; one without meets the
    paths that have its rarest piece of literal text.  Only patterns without any
    literal character are tested against every path, in blocks of a size that can
    be broadcast; distinct ones of those are few.
    """
    both = {c.lower() for c in paths.columns} & {c.lower() for c in rules.columns} | {c for x in (paths, rules) for c in x.columns if c.lower() in RESERVED}
    if both:
        raise ValueError(f"columns of both sides, or reserved: {sorted(both)}")
    out = [*paths.columns, *rules.columns]
    rules = rules.withColumn("_rx", T.glob_regex("pattern"))
    directory = F.regexp_extract(T.literal_prefix("pattern"), r"\A(.+)/", 1)
    level = F.when(directory == "", 0).otherwise(F.size(F.split(directory, "/")))
    rules = rules.withColumn("_dir", directory).withColumn("_level", F.when(T.is_literal("pattern"), -1).when(level > depth, 0).otherwise(level))
    equal = paths.join(rules.where("_level = -1"), F.col("path") == F.col("pattern"))
    parts = F.split("path", "/")
    above = paths.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(depth), F.size(parts) - 1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    below = above.join(rules.where("_level > 0"), (F.col("_up") == F.col("_dir")) & F.rlike(F.col("path"), F.col("_rx")))
    found = equal.select(*out).unionByName(below.select(*out))
    rest = kept(rules.where("_level = 0").select("pattern", "_rx").distinct(), "patterns")
    literal = F.exists(literal_runs(F.col("pattern")), lambda r: r != "")
    only = paths.select("path").distinct()
    pairs = None if rest.where(literal).isEmpty() else _by_gram(only, rest.where(literal))
    for block in in_blocks(rest.where(~literal)):
        tested = only.join(F.broadcast(block), F.rlike(F.col("path"), F.col("_rx"))).select("path", "pattern")
        pairs = tested if pairs is None else pairs.unionByName(tested)
    if pairs is not None:
        # nulls of either side match nothing, so plain equality joins the rows again
        pairs = pairs.select(F.col("path").alias("_up"), F.col("pattern").alias("_dir"))
        own = rules.select(*rules.columns[: len(out) - len(paths.columns)])
        found = found.unionByName(pairs.join(paths, F.col("_up") == F.col("path")).join(own, F.col("_dir") == F.col("pattern")).select(*out))
    return found


def glob_hits(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (pattern, ...) that match any of paths (path), with `hits`: how many rows they match.

    Equal patterns are matched once, and so are equal paths: pairs of rows are
    counted and never made, so that a pattern of many rules is no hot key.
    """
    many = paths.groupBy("path").agg(F.count("*").alias("_many"))
    told = match_globs(many, rules.select("pattern").distinct()).groupBy("pattern").agg(F.sum("_many").alias("hits"))
    return rules.join(told, "pattern")


def match_symbols(symbols: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a symbol and a rule: equality for exact rules, common beginnings for those ending in *."""
    out = [*symbols.columns, *rules.columns]
    wild = F.col("pattern").endswith("*")
    exact = symbols.join(rules.where(~wild), F.col("symbol") == F.col("pattern"))
    found = exact.select(*out)
    for block in in_blocks(rules.where(wild)):
        found = found.unionByName(symbols.join(F.broadcast(block), T.symbol_matches("symbol", "pattern")).select(*out))
    return found


def in_scope(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a change (repo, ...) and a rule (rule_repo, ...): an empty rule_repo takes all, others equal keys."""
    out = [*changes.columns, *rules.columns]
    keyed = changes.withColumn("_key", T.repo_key("repo")).join(rules.where("rule_repo <> ''").withColumn("_rule_key", T.repo_key("rule_repo")), F.col("_key") == F.col("_rule_key"))
    found = keyed.select(*out)
    for block in in_blocks(rules.where("rule_repo = ''")):
        found = found.unionByName(changes.join(F.broadcast(block), F.col("rule_repo") == "").select(*out))
    return found


def scores(hits: DataFrame) -> DataFrame:
    """page_path, score, reason from hits (page_path, rule_ord, pattern): every hit counts, also of one path twice.

    The reason lists each rule with its hits in rule order, so its length is
    that of the page's rules, not of the change.
    """
    each = hits.groupBy("page_path", "rule_ord", "pattern").agg(F.count("*").alias("n"))
    line = F.concat_ws(" x", "pattern", F.col("n").cast("string"))
    return each.groupBy("page_path").agg(
        F.sum("n").cast("double").alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_ord", line.alias("line")))), lambda x: x["line"]), "; ").alias("reason"),
    )


def outside_docs(changes: DataFrame, root: str) -> DataFrame:
    """Changes of which neither the path nor the previous path lies in the documentation tree."""
    return changes.where(~T.under("path", root) & ~T.under("previous_path", root))


def anchor_wins(candidates: DataFrame) -> DataFrame:
    """One candidate for each page_path: an anchor before an embedding, then the higher score, then the earlier.

    candidates: page_path, source, score, ord.  `ord` of the result is the page's first.
    """
    order = Window.partitionBy("page_path").orderBy((F.col("source") == "anchor").desc(), F.desc("score"), "ord")
    first = F.min("ord").over(Window.partitionBy("page_path"))
    return candidates.withColumn("_first", first).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").withColumn("ord", F.col("_first")).drop("_rank", "_first")


def not_anchored(hits: DataFrame, anchored: DataFrame) -> DataFrame:
    return hits.join(anchored.select("page_path").distinct(), "page_path", "left_anti")


def judged(candidates: DataFrame, verdicts: DataFrame, threshold: float = 0.5, autopass: bool = True) -> DataFrame:
    """Candidates with `decision`: autopass, kept or dropped.

    An anchor passes unjudged unless judge_required; others are kept if their
    verdict says affected with at least the threshold.  No verdict: dropped.  Of
    several verdicts on a page the last by `ord` counts (verdicts without an `ord`
    have one each).
    """
    own = F.struct("affected", "confidence")
    verdicts = verdicts.groupBy("page_path").agg((F.max_by(own, "ord") if "ord" in verdicts.columns else F.max(own)).alias("_v")).select("page_path", "_v.*")
    passes = F.lit(autopass) & (F.col("source") == "anchor") & ~F.coalesce("judge_required", F.lit(False))
    keeps = F.coalesce(F.col("affected") & (F.col("confidence") >= threshold), F.lit(False))
    return candidates.join(verdicts.select("page_path", "affected", "confidence"), "page_path", "left").withColumn("decision", F.when(passes, "autopass").when(keeps, "kept").otherwise("dropped"))


def floor_and_cap(pages: DataFrame, floor: float, cap: int) -> DataFrame:
    """Pages with `status`: below floor, edited (the `cap` most confident, ties by path) or capped."""
    eligible = pages.where(F.col("confidence") >= floor)
    best = eligible.orderBy(F.desc("confidence"), "page_path").limit(cap).select("page_path").withColumn("_in", F.lit(True))
    marked = pages.join(F.broadcast(best), "page_path", "left")  # at most `cap` rows
    status = F.when(F.coalesce(F.col("confidence") < floor, F.lit(True)), "below_floor").when(F.col("_in"), "edited").otherwise("capped")
    return marked.withColumn("status", status).drop("_in")


def query_tokens(tokens: DataFrame, stopwords: list[str]) -> DataFrame:
    """First-seen distinct tokens (token, ord) that are not empty nor, in any case, a stopword."""
    kept = tokens.where((F.col("token") != "") & ~F.lower("token").isin(*stopwords))
    return kept.groupBy("token").agg(F.min("ord").alias("ord"))


def unprocessed(changes: DataFrame, cursors: DataFrame) -> DataFrame:
    """Changes whose head is not their repository's cursor (repositories compare by key)."""
    done = cursors.select(T.repo_key("repo").alias("_key"), F.col("head_sha").alias("_sha"))
    return changes.join(done, (T.repo_key("repo") == F.col("_key")) & (F.col("head_sha") == F.col("_sha")), "left_anti")


def projected_tokens(symbols: DataFrame, paths: DataFrame, stopwords: list[str]) -> DataFrame:
    """token, ord of a change's query: its symbols (symbol, ord), then the stems of its paths (path, ord); see query_tokens."""
    both = symbols.select(F.col("symbol").alias("token"), F.struct(F.lit(0).alias("part"), "ord").alias("ord")).unionByName(paths.select(T.stem("path").alias("token"), F.struct(F.lit(1).alias("part"), "ord").alias("ord")))
    return query_tokens(both, stopwords)


def mapped_pages(anchored: DataFrame, near: DataFrame) -> DataFrame:
    """case_id, page_path of either way, each once."""
    return anchored.select("case_id", "page_path").unionByName(near.select("case_id", "page_path")).distinct()
