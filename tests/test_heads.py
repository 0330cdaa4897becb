import datetime

import pytest

from pagetrace.streaming import heads, jobs

SCHEMA = "repo string, kind string, head_sha string, page_path string, pages int, ts timestamp"


def at(hour):
    return datetime.datetime(2024, 5, 1) + datetime.timedelta(hours=hour)


def head(repo, sha, pages, hour):
    return (repo, "head", sha, None, pages, at(hour))


def page(repo, sha, path, hour):
    return (repo, "page", sha, path, None, at(hour))


class Job:
    """A stream of batches of events, each run to its end from the checkpoint of the one before."""

    def __init__(self, spark, path, hours=48):
        self.spark, self.path, self.hours = spark, str(path), hours

    def run(self, *rows, sink=None):
        if rows:
            self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        stream = heads.released_heads(self.spark.readStream.schema(SCHEMA).parquet(f"{self.path}/in"), self.hours)
        sink = sink or (lambda s: jobs.upsert_cursors(s.where("status = 'released'"), "repo", "ts", "head_sha", f"{self.path}/out", f"{self.path}/mark"))
        heads.start(lambda: sink(stream), self.spark).awaitTermination(120)
        found = jobs.current_cursors(self.spark, f"{self.path}/out")
        return {} if found is None else {r["repo"]: r["head_sha"] for r in found.collect()}


def test_heads_wait_for_their_pages(spark, tmp_path):
    job = Job(spark, tmp_path)
    assert job.run(head("a", "a1", 2, 1), page("a", "a1", "p", 1), head("b", "b1", 0, 1), page("c", "c1", "p", 1)) == {"b": "b1"}
    # a page again, and a head after its page
    assert job.run(page("a", "a1", "p", 2), head("c", "c1", 1, 1)) == {"b": "b1", "c": "c1"}
    # a later head overtakes; the earlier one is done with
    assert job.run(head("a", "a2", 1, 3), page("a", "a2", "p", 3)) == {"a": "a2", "b": "b1", "c": "c1"}
    assert job.run(page("a", "a1", "q", 4), head("a", "a1", 0, 1), head("b", "b1", 0, 1)) == {"a": "a2", "b": "b1", "c": "c1"}


def test_failure_between_pages_and_cursor(spark, tmp_path):
    job, failing = Job(spark, tmp_path), [True]

    def sink(stream):
        def write(batch, batch_id):
            batch.collect()
            if failing:
                failing.pop()
                raise RuntimeError("lost after the pages, before the cursor")

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{job.path}/mark").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost after the pages"):
        job.run(head("a", "a1", 1, 1), page("a", "a1", "p", 1), sink=sink)
    assert job.run() == {"a": "a1"}
    assert job.run() == {"a": "a1"}


def test_heads_that_wait_too_long_expire(spark, tmp_path):
    job = Job(spark, tmp_path, hours=2)
    seen = []

    def sink(stream):
        return stream.writeStream.foreachBatch(lambda b, _: seen.extend((r["repo"], r["head_sha"], r["status"]) for r in b.collect())).option("checkpointLocation", f"{job.path}/mark").trigger(availableNow=True).start()

    job.run(head("a", "a1", 1, 1), sink=sink)
    job.run(head("b", "b1", 0, 30), sink=sink)
    assert seen == [("b", "b1", "released"), ("a", "a1", "expired")]


class Kept(dict):
    """A map state that counts its writes."""

    writes = 0

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)


class Last(list):
    def exists(self):
        return bool(self)

    def get(self):
        return self[-1]

    def update(self, value):
        self.append(value)


def test_state_is_written_only_for_what_a_batch_leaves():
    proc = heads.HeldHeads(48)
    proc.heads, proc.pages, proc.last = Kept(), Kept(), Last()
    timers = []
    proc.handle = type("H", (), {"registerTimer": staticmethod(timers.append)})
    clock = type("T", (), {"getCurrentWatermarkInMs": staticmethod(lambda: 0)})

    def run(*rows):
        keys = ("kind", "head_sha", "page_path", "pages", "micros")
        return [(r["head_sha"], r["micros"]) for r in proc.handleInputRows(("r",), iter([dict(zip(keys, x)) for x in rows]), clock)]

    rows = [r for i in range(500) for r in (("head", f"h{i}", None, 1, i), ("page", f"h{i}", "p", None, i))]
    assert run(*rows, ("head", "late", None, 2, 900), ("page", "late", "p", None, 900)) == [("h499", 499)]
    assert (proc.heads.writes, proc.pages.writes, len(timers)) == (1, 1, 1)
    # the stored page comes again, and then the other one
    assert run(("page", "late", "p", None, 901)) == []
    assert run(("page", "late", "q", None, 902)) == [("late", 900)]
    assert not proc.heads and not proc.pages and proc.last.get() == (900, "late")
