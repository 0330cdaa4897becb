"""CI events: one change (repo, base, head) from each, whatever sent it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrace import schemas


def is_null_sha(sha: Column) -> Column:
    """Zeros only, of any length but none."""
    return F.coalesce(sha.rlike(r"\A0+\z"), F.lit(False))


def real_base(base: Column, head: Column) -> Column:
    """The base, or head^ where there was none before."""
    return F.when(is_null_sha(base), F.concat(head, F.lit("^"))).otherwise(base)


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_events(events: DataFrame) -> DataFrame:
    """repo, base_sha, head_sha, pr_number, pr_title, kind of raw events (value: JSON).

    A dispatched payload comes before a push; what is neither, or isn't JSON, is
    `unknown` with nulls.  A pr_number that is no number is null.
    """
    e = events.withColumn("_e", F.from_json("value", schemas.CI_EVENT))
    p = F.col("_e.client_payload")
    dispatched = _given(p["repo"]).isNotNull() & _given(p["head_sha"]).isNotNull()
    pushed = _given(F.col("_e.after")).isNotNull() & _given(F.col("_e.repository.full_name")).isNotNull()
    pick = lambda a, b: F.when(dispatched, a).when(pushed, b)
    none = F.lit(None).cast("string")
    rows = e.select(
        *events.columns,
        F.when(dispatched, "dispatch").when(pushed, "push").otherwise("unknown").alias("kind"),
        pick(p["repo"], F.col("_e.repository.full_name")).alias("repo"),
        pick(p["base_sha"], F.col("_e.before")).alias("base_sha"),
        pick(p["head_sha"], F.col("_e.after")).alias("head_sha"),
        pick(p["pr_number"], none).try_cast("long").alias("pr_number"),
        pick(p["pr_title"], F.substring_index(F.col("_e.head_commit.message"), "\n", 1)).alias("pr_title"),
    )
    return rows.withColumn("base_sha", real_base(F.col("base_sha"), F.col("head_sha")))


def from_environment(rows: DataFrame) -> DataFrame:
    """The same from CI variables (columns project, mr_head, commit, mr_base, before): a merge request's come first; '' is missing."""
    head = F.coalesce(_given(F.col("mr_head")), _given(F.col("commit")))
    base = F.coalesce(_given(F.col("mr_base")), _given(F.col("before")), F.lit("0" * 40))
    other = [c for c in rows.columns if c not in ("project", "mr_head", "commit", "mr_base", "before", "repo", "base_sha", "head_sha")]
    return rows.select(*other, F.col("project").alias("repo"), real_base(base, head).alias("base_sha"), head.alias("head_sha"))
