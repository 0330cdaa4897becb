"""The dashboard: small aggregates of the run log, written as one page of HTML without scripts or links to elsewhere."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .history import drops_by_reason, model_stages, month_budget, newest, overview
from .planning import capped

#: A table's rows on the page, runs on its time line, runs whose changes it shows, and pages of each of those.
TABLE, TIMELINE, RECENT, PAGES = 200, 50, 8, 100


def cost_curve(runs: DataFrame) -> DataFrame:
    """day, cumulative: what all runs (ts, cost) up to the end of each day with a run have cost; a null cost is 0, runs without a time are left out."""
    days = runs.where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.coalesce("cost", F.lit(0.0))).alias("_cost"))
    order = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each day
    return days.select("day", F.sum("_cost").over(order).alias("cumulative"))


def recent_changes(runs: DataFrame, pages: DataFrame, recent: int = RECENT, most: int = PAGES) -> DataFrame:
    """The applied pages (run_id, ord, page_path, applied, ...) of the `recent` newest runs (run_id, ts, ord), the first `most` of each, with place (1 is the newest run) and all (how many the run has)."""
    last = newest(runs.select("run_id", "ts", "ord"), recent)
    last = last.select(F.col("run_id").alias("_run"), F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("ord"))).cast("long").alias("place"))
    own = pages.where("applied").join(F.broadcast(last), F.col("run_id") == F.col("_run")).drop("_run")  # `recent` rows
    counts = own.groupBy(F.col("run_id").alias("_run")).agg(F.count("*").alias("all"))
    return capped(own, "run_id", most).join(F.broadcast(counts), F.col("run_id") == F.col("_run")).drop("_run")


def _text(value: object) -> str:
    if value is None:
        return ""
    return escape(f"{value:,.4f}" if isinstance(value, float) else str(value))


def _table(rows: list[Row], caption: str) -> str:
    if not rows:
        return f"<h2>{escape(caption)}</h2><p>None.</p>"
    head = "".join(f"<th>{escape(c)}</th>" for c in rows[0].__fields__)
    body = "".join("<tr>" + "".join(f"<td>{_text(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<h2>{escape(caption)}</h2><table><tr>{head}</tr>{body}</table>"


def _curve(rows: list[Row], width: int = 1000, height: int = 100) -> str:
    """An area from the first day to the last, as high as the greatest sum."""
    if not rows:
        return ""
    first, span = rows[0]["day"], max(1, (rows[-1]["day"] - rows[0]["day"]).days)
    top = max(r["cumulative"] for r in rows) or 1.0
    spots = [f"{(r['day'] - first).days * width / span:.1f} {height - r['cumulative'] * height / top:.1f}" for r in rows]
    return f'<svg viewBox="0 0 {width} {height}" role="img"><title>Cost so far: ${top:,.2f}</title><path d="M0 {height} L{" L".join(spots)} V{height} Z"/></svg>'


def _patch(diff: str | None) -> str:
    kinds = (("+++", "name"), ("---", "name"), ("@@", "place"), ("+", "new"), ("-", "old"))
    lines = (diff or "").splitlines()
    return "<pre>" + "\n".join(f'<span class="{next((k for start, k in kinds if line.startswith(start)), "same")}">{escape(line)}</span>' for line in lines) + "</pre>" if lines else ""


def _changes(rows: list[Row]) -> str:
    out: list[str] = []
    for place in sorted({r["place"] for r in rows}):
        own = sorted((r for r in rows if r["place"] == place), key=lambda r: r["ord"])
        notes = ["".join(f"<li>{escape(n)}</li>" for n in [*(r["rationales"] or []), *(r["warnings"] or [])]) for r in own]
        each = "".join(f"<h3>{_text(r['page_path'])}</h3>" + (f"<ul>{n}</ul>" if n else "") + _patch(r["diff"]) for r, n in zip(own, notes))
        more = f"<p>{own[0]['all'] - len(own)} more.</p>" if own[0]["all"] > len(own) else ""
        out.append(f"<details><summary>{_text(own[0]['run_id'])}: {own[0]['all']} pages</summary>{each}{more}</details>")
    return "<h2>Changes</h2>" + ("".join(out) or "<p>None.</p>")


def html(runs: DataFrame, pages: DataFrame, usage: DataFrame, health: DataFrame, now: str, budget: float) -> str:
    """The page: overview, month, cost curve, models and stages, dropped pages, newest runs and their changes, health.

    runs: run_id, ts, ord, command, status, repo, calls, hit_rate, cost, updated,
    authored; pages: run_id, ord, command, page_path, applied, note, rationales,
    warnings, diff; usage: model, stage, calls, tokens, cost; health: a few rows of
    any columns.  The driver gets aggregates and newest rows, each of a bounded
    number; every value is escaped.
    """
    listed = newest(runs, TIMELINE).select("ts", "command", "repo", "run_id", "status", "cost").collect()
    return "".join((
        '<!doctype html><meta charset="utf-8"><title>Runs</title>',
        "<style>td,th{text-align:left;padding:2px 9px}svg{width:100%;fill:#9bc}.new{color:#171}.old{color:#a11}.place,.name{color:#57a}</style>",
        _table(overview(runs).collect(), "Overview"),
        _table(month_budget(runs, now, budget).collect(), "Month"),
        _curve(cost_curve(runs).orderBy(F.desc("day")).limit(4000).orderBy("day").collect()),
        _table(model_stages(usage).orderBy(F.desc("cost"), "model", "stage").limit(TABLE).collect(), "Models and stages"),
        _table(drops_by_reason(pages).orderBy("reason").limit(TABLE).collect(), "Dropped pages"),
        _table(listed, "Newest runs"),
        _changes(recent_changes(runs, pages).collect()),
        _table(health.limit(TABLE).collect(), "Health"),
    ))
