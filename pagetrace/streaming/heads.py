"""Heads that are held back until their pages are committed: state for each repository."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RELEASED = "repo string, head_sha string, micros long, status string"


class HeldHeads(StatefulProcessor):
    """Releases a head once as many distinct pages of it are committed as it announced.

    State of a repository: the open heads, the pages committed to heads that are
    open or not known yet, and the last head released.  Pages may come before their
    head, and any event may come again: a page counts once, and a head not later
    than the last released one is done with.  A released head makes all earlier
    ones obsolete.  What is still there when the watermark is `hours` later than it
    goes; a head that goes so is told as expired.
    """

    def __init__(self, hours: int):
        self.hours = hours

    def _until(self, micros: int) -> int:
        """Milliseconds, in whole hours, so that there are few timers."""
        return (-(-micros // 3_600_000_000) + self.hours) * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getMapState("heads", "head_sha string", "micros long, pages int, until long")
        self.pages = handle.getMapState("pages", "head_sha string, page_path string", "until long")
        self.last = handle.getValueState("last", "micros long, head_sha string")

    def _drop(self, heads: set[str]) -> None:
        for sha in heads:
            self.heads.removeKey((sha,))
        for key in [k for k in self.pages.keys() if k[0] in heads]:
            self.pages.removeKey(tuple(key))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        last = tuple(self.last.get()) if self.last.exists() else None
        # what the rows bring; only what is left of it in the end becomes state
        heads: dict[str, tuple] = {}
        pages: dict[str, dict[str, int]] = {}
        for r in rows:
            until = max(self._until(r["micros"]), now + 1)
            if r["kind"] == "page":
                pages.setdefault(r["head_sha"], {})[r["page_path"]] = until
            elif last is None or (r["micros"], r["head_sha"]) > last:
                heads[r["head_sha"]] = (r["micros"], r["pages"] or 0, until)
        before = {k[0]: tuple(v) for k, v in self.heads.iterator()}
        committed = {sha: len(paths) for sha, paths in pages.items()}
        stored = set(before)
        for sha, path in self.pages.keys():
            stored.add(sha)
            if path not in pages.get(sha, ()):
                committed[sha] = committed.get(sha, 0) + 1
        held = before | heads
        whole = max(((ts, sha) for sha, (ts, n, _) in held.items() if committed.get(sha, 0) >= n), default=None)
        done: set[str] = set()
        if whole:
            self.last.update(whole)
            done = {sha for sha, (ts, _, _) in held.items() if (ts, sha) <= whole}
            self._drop(done & stored)
        timers = set()
        for sha, head in heads.items():
            if sha not in done:
                self.heads.updateValue((sha,), head)
                timers.add(head[2])
        for sha, paths in pages.items():
            if sha not in done:
                for path, until in paths.items():
                    self.pages.updateValue((sha, path), (until,))
                    timers.add(until)
        for until in timers:
            self.handle.registerTimer(until)
        if whole:
            yield Row(repo=key[0], head_sha=whole[1], micros=whole[0], status="released")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = [(k[0], v[0]) for k, v in self.heads.iterator() if v[2] <= now]
        self._drop({sha for sha, _ in gone})
        for k in [k for k, v in self.pages.iterator() if v[0] <= now]:
            self.pages.removeKey(tuple(k))
        for sha, ts in sorted(gone):
            yield Row(repo=key[0], head_sha=sha, micros=ts, status="expired")

    def close(self) -> None:
        pass


def released_heads(events: DataFrame, hours: int = 7 * 24) -> DataFrame:
    """repo, head_sha, ts, status from a stream of events (repo, kind, head_sha, page_path, pages, ts).

    kind: head (with the number of pages that it changes) or page (a page of that
    head is committed); other kinds, and rows without a ts, are left out.  status:
    released or expired; see HeldHeads.  Events may be late by as many hours as heads
    are held.  The query needs the state store PROVIDER.
    """
    kinds = events.where("kind in ('head', 'page') and ts is not null").select("repo", "kind", "head_sha", "page_path", "pages", "ts", F.unix_micros("ts").alias("micros")).withWatermark("ts", f"{hours} hours")
    told = kinds.groupBy("repo").transformWithState(statefulProcessor=HeldHeads(hours), outputStructType=RELEASED, outputMode="append", timeMode="EventTime")
    return told.select("repo", "head_sha", F.timestamp_micros("micros").alias("ts"), "status")


def start(query: Callable[[], StreamingQuery], spark: SparkSession) -> StreamingQuery:
    """Start a query with the state store that it needs; the session's own setting is put back, as a query keeps what it was started with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        return query()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
