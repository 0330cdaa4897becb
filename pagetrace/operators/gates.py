"""Row-level quality gates of edited and new pages; all failures are listed, none hides another."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrace.functions import text as T


def diff_budget(lines: Column, level_lines: int, level_share: float, page_lines: Column | None = None, page_share: Column | None = None) -> Column:
    """Lines that an edit may change: the greater of a number and a share of the page's lines; a page's own values (not null) win."""
    most = F.lit(level_lines) if page_lines is None else F.coalesce(page_lines, F.lit(level_lines))
    share = F.lit(float(level_share)) if page_share is None else F.coalesce(page_share, F.lit(float(level_share)))
    return F.greatest(most.cast("long"), F.ceil(share * lines).cast("long"))


def truncated(before: Column, after: Column, least: float = 0.5) -> Column:
    """Whether an edit left a page empty or under a share of its length."""
    return (F.trim(after) == "") | (F.length(after) < least * F.length(before))


def new_page_failures(title: Column, description: Column, body: Column, shortest: int = 200) -> Column:
    """Names of the gates that a new page fails."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    fences = F.regexp_count(body, F.lit(r"(?m)^\s*```"))
    return F.array_compact(
        F.array(
            F.when(blank(title), F.lit("title")),
            F.when(blank(description), F.lit("description")),
            F.when(fences % 2 == 1, F.lit("fences")),
            F.when(F.length(F.trim(body)) < shortest, F.lit("short")),
        )
    )


def find_class(text: Column, needle: Column) -> Column:
    """How a find string meets a text: missing, unique or ambiguous."""
    n = T.occurrences(text, needle)
    return F.when(n == 0, "missing").when(n == 1, "unique").otherwise("ambiguous")


def applied(edits: DataFrame) -> DataFrame:
    """Rows with `result`, `failed`: ops (find, replace) of each row's array run one after another over its text.

    Every find must occur exactly once in the text as it then is; from the first
    that doesn't on, nothing more is replaced, and `failed` names it.
    """

    def step(acc: Column, op: Column) -> Column:
        how = find_class(acc["text"], op["find"])
        go = acc["failed"].isNull() & (how == "unique")
        return F.struct(
            F.when(go, F.replace(acc["text"], op["find"], op["replace"])).otherwise(acc["text"]).alias("text"),
            F.coalesce(acc["failed"], F.when(how != "unique", F.concat_ws(": ", how, op["find"]))).alias("failed"),
        )

    start = F.struct(F.col("text").alias("text"), F.lit(None).cast("string").alias("failed"))
    done = F.aggregate("ops", start, step)
    return edits.withColumn("_done", done).withColumn("result", F.col("_done.text")).withColumn("failed", F.col("_done.failed")).drop("_done")


def net_changed_lines(pairs: DataFrame) -> DataFrame:
    """pairs (before, after) with changed_lines: added and removed lines of their unified diff."""

    def count(a: str, b: str) -> int:
        changed = difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="", n=0)
        return sum(x[0] in "+-" and x[:3] not in ("+++", "---") for x in changed)

    @F.pandas_udf("long")
    def counted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([count(x, y) for x, y in zip(a, b)], dtype="int64")

    return pairs.withColumn("changed_lines", counted("before", "after"))


def page_diff(pairs: DataFrame, most: int = 120) -> DataFrame:
    """pairs with diff: the unified diff, its first `most` lines and a marker if there are more."""

    def show(a: str, b: str) -> str:
        lines = list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm=""))
        return "\n".join(lines[:most] + [f"... {len(lines) - most} more lines"] * (len(lines) > most))

    @F.pandas_udf("string")
    def shown(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([show(x, y) for x, y in zip(a, b)], dtype=object)

    return pairs.withColumn("diff", shown("before", "after"))


#: Lines and share of a page that an edit may change, by level.  Fixed values.
LEVELS = {"light": (40, 0.35), "medium": (60, 0.5), "high": (100, 0.7)}


def oversized(pairs: DataFrame, level: str = "medium") -> DataFrame:
    """pairs (before, after, page_lines, page_share) whose net changed lines exceed the budget, with changed_lines and budget.

    A page's own value counts unless it is null or the medium level's.
    """
    lines, share = LEVELS.get(level, LEVELS["medium"])
    own = lambda c, usual: F.when(F.col(c) != usual, F.col(c))
    most = diff_budget(T.line_count("before"), lines, share, own("page_lines", LEVELS["medium"][0]), own("page_share", LEVELS["medium"][1]))
    return net_changed_lines(pairs.withColumn("budget", most)).where("changed_lines > budget")


def polished(before: Column, after: Column, same_head: Column, body_before: Column, body_after: Column, least: float = 0.5) -> Column:
    """The polished text, or the one before if its front matter differs or less than a share of its body is left."""
    good = same_head & (F.trim(body_after) != "") & (F.length(body_after) >= least * F.length(body_before))
    return F.when(F.coalesce(good, F.lit(False)), after).otherwise(before)
