import json

from pyspark.sql import functions as F

from pagetrace.plans import runs
from pagetrace.sources import diffs, events, history, trees
from pagetrace.streaming import jobs

DIFF = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -1 +1 @@ def f():
-x
+y
@@ -9 +9 @@
+z
diff --git a/old.py b/new.py
similarity index 90%
rename from old.py
rename to new.py
diff --git a/n.py b/n.py
new file mode 100644
--- /dev/null
+++ b/n.py
@@ -0,0 +1 @@
+n
diff --git a/g.py b/g.py
deleted file mode 100644
--- a/g.py
+++ /dev/null
@@ -1 +0,0 @@
-g
"""


def test_unified_diffs(spark, tmp_path):
    (tmp_path / "one.diff").write_text(DIFF)
    got = [(r["path"], r["status"], r["previous_path"], len(r["hunks"])) for r in diffs.read_diffs(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [("src/a.py", "modified", None, 2), ("new.py", "renamed", "old.py", 0), ("n.py", "added", None, 1), ("g.py", "removed", None, 1)]
    paths = diffs.changed_paths(diffs.read_diffs(spark, str(tmp_path)))
    assert "old.py" in {r["path"] for r in paths.collect()}


def test_compare_responses(spark, tmp_path):
    files = [{"filename": "a", "status": "changed", "patch": "junk\n@@ -1 @@\n+x"}, {"filename": "b", "status": "copied", "previous_filename": "a"}, {"filename": "c", "status": "renamed", "previous_filename": "d"}, {"filename": "e", "status": "odd"}]
    (tmp_path / "c.json").write_text(json.dumps({"files": files}, indent=1))
    got = [(r["path"], r["status"], r["previous_path"], r["hunks"]) for r in diffs.read_compare(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [("a", "modified", None, ["@@ -1 @@\n+x"]), ("b", "added", None, []), ("c", "renamed", "d", []), ("e", "modified", None, [])]


def test_null_shas(spark):
    d = spark.createDataFrame([("0000",), ("abc123",), ("",), (None,)], "s string").select(events.is_null_sha(F.col("s")))
    assert [r[0] for r in d.collect()] == [True, False, False, False]


def test_retention_within_one_second(spark, tmp_path):
    rows = spark.range(1300).selectExpr("id as event_id", "timestamp_micros(1700000000000000 + (id * 7919) % 1300) as ts", "1L as user_id", "'view' as event_type", "1.0D as value")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    left = sorted(((i * 7919) % 1300, str(i)) for i in range(1300) if i % 7 and i % 11)[-500:]
    got = runs.log_retention(spark, str(tmp_path)).collect()
    assert [r["head_sha"] for r in got] == [i for _, i in left]
    assert {r["timestamp"] for r in got} == {"2023-11-14T22:13:20"}


def test_events(spark):
    raw = [{"client_payload": {"repo": "r", "base_sha": "000", "head_sha": "h", "pr_number": "7"}}, {"before": "b", "after": "a", "repository": {"full_name": "x"}}, {"odd": 1}]
    rows = events.parse_events(spark.createDataFrame([(json.dumps(x),) for x in raw] + [("no json",), (None,)], "value string")).collect()
    assert [(r["kind"], r["repo"], r["base_sha"], r["pr_number"]) for r in rows] == [("dispatch", "r", "h^", 7), ("push", "x", "b", None)] + [("unknown", None, None, None)] * 3


def test_log_is_read_tolerantly_appended_and_trimmed(spark, tmp_path):
    run = lambda i: json.dumps({"schema_version": 1, "timestamp": f"2024-06-0{i}T00:00:00", "command": "run", "repo": "r", "head_sha": f"h{i}", "pages": [{"page_path": "p", "applied": True}]})
    (tmp_path / "runs.jsonl").write_text("\n".join([run(1), "{broken", "", run(3), run(2)]))
    log = history.read_log(spark, str(tmp_path))
    assert log.count() == 3
    assert [r["head_sha"] for r in history.newest(log, 2).collect()] == ["h2", "h3"]
    assert history.latest_cursors(log).first()["head_sha"] == "h3"
    assert history.pages_of(log).count() == 3
    history.append(log.limit(1), str(tmp_path))
    assert history.read_log(spark, str(tmp_path)).count() == 4


def test_trees(spark, tmp_path):
    for p in ("src/a.py", "src/node_modules/b.ts", "web/c.tsx", "d.txt", "docs/p.mdx"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert {(r["path"], r["kind"]) for r in trees.source_files(spark, str(tmp_path)).collect()} == {("src/a.py", "python"), ("web/c.tsx", "typescript")}
    assert {r["path"] for r in trees.source_files(spark, str(tmp_path), ["web "]).collect()} == {"src/a.py"}
    assert [r["page_path"] for r in trees.doc_pages(spark, str(tmp_path)).collect()] == ["docs/p.mdx"]


def test_golden_cases_come_as_list_or_object(spark, tmp_path):
    case = {"repo": "r", "base": "b", "head": "h", "label": "l", "expected_pages": ["p"]}
    (tmp_path / "a.json").write_text(json.dumps([case]))
    (tmp_path / "b.json").write_text(json.dumps({"cases": [case, case]}))
    assert trees.golden_cases(spark, str(tmp_path / "a.json")).count() == 1
    assert [r["case_ord"] for r in trees.golden_cases(spark, str(tmp_path / "b.json")).collect()] == [0, 1]


def test_rules_and_routes(spark):
    m = spark.createDataFrame([("p", [("r", ["a/*"], ["S"]), (None, ["b"], [])])], "path string, sources array<struct<repo:string,globs:array<string>,symbols:array<string>>>")
    got = [(r["repo"], r["rule_kind"], r["pattern"]) for r in trees.anchor_rules(m).orderBy("rule_ord").collect()]
    assert got == [("r", "glob", "a/*"), ("r", "symbol", "S"), ("", "glob", "b")]
    nav = spark.createDataFrame([([("g", ["x", "y"])],)], "groups array<struct<name:string,pages:array<string>>>")
    assert [(r["group_name"], r["route"]) for r in trees.nav_routes(nav).orderBy("ord").collect()] == [("g", "x"), ("g", "y")]


def test_cursor_stream_twice_changes_nothing(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = [("r", "2024-01-01", "h1"), ("r", "2024-01-02", "h2"), ("s", "2024-01-01", "k")]
    spark.createDataFrame(rows, "repo string, ts string, sha string").coalesce(1).write.parquet(src)
    run = lambda: jobs.upsert_cursors(spark.readStream.schema("repo string, ts string, sha string").parquet(src), "repo", "ts", "sha", out, mark).awaitTermination()
    run()
    spark.createDataFrame([("s", "2024-01-03", "k3")], "repo string, ts string, sha string").write.mode("append").parquet(src)
    run()
    want = {("r", "h2"), ("s", "k3")}
    assert {(r["repo"], r["sha"]) for r in jobs.current_cursors(spark, out).collect()} == want
    run()
    assert {(r["repo"], r["sha"]) for r in jobs.current_cursors(spark, out).collect()} == want


def test_duplicate_events_arrive_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("r", "h", "2024-01-01 00:00:00")] * 3, "repo string, sha string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = jobs.once(spark.readStream.schema("repo string, sha string, ts timestamp").parquet(src), ["repo", "sha"], "ts", "1 hour")
    jobs.run_available(stream, str(tmp_path / "out"), "append", str(tmp_path / "mark")).awaitTermination()
    assert jobs.current_cursors(spark, str(tmp_path / "out")).count() in (0, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_retention_keeps_the_newest(spark, tmp_path):
    src, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    for day in (1, 2, 3):
        spark.createDataFrame([(f"h{day}{i}", f"2024-01-0{day} 00:0{i}:00") for i in range(4)], "sha string, ts string").write.mode("append").parquet(src)
        jobs.retained(spark.readStream.schema("sha string, ts string").parquet(src), "ts", 5, out, mark).awaitTermination()
    assert sorted(r["sha"] for r in jobs.current_cursors(spark, out).collect()) == ["h23", "h30", "h31", "h32", "h33"]


def test_source_tree_skips_folders_and_takes_the_first(spark, tmp_path):
    from pagetrace.sources import trees

    for at in ("a/x.py", "a/tests/t.py", "vendor/v.ts", "b/migrations/m.py", "b/y.ts", "coverage/c.py", "c.tsx"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text("x")
    assert sorted(r["path"] for r in trees.source_files(spark, str(tmp_path)).collect()) == ["a/x.py", "b/y.ts", "c.tsx"]
    assert [r["path"] for r in trees.source_files(spark, str(tmp_path), ["a"], most=1).collect()] == ["b/y.ts"]
