import pytest
from pyspark.sql import functions as F

from pagetrace.operators import dashboard, history, reports


def first(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_encoder_is_deterministic_and_of_unit_length(spark):
    t = spark.createDataFrame([("a b",), ("B A!",), ("",), (None,)], "text string")
    a, b, empty, none = (r["embedding"] for r in reports.encoded(t).collect())
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and empty == none == [0.0] * 24


def test_heads_urls_and_names(spark):
    items = F.array(*map(F.lit, "abcd"))
    r = first(spark, reports.head_and_more(items, 2).alias("h"), reports.head_and_more(items, 9).alias("all"), reports.last_url(F.lit("x http://a y https://b/c")).alias("u"), reports.last_url(F.lit("  none ")).alias("n"), reports.branch_name(F.lit("app"), F.lit("0123456789"), "sync").alias("b"))
    assert tuple(r) == ("a, b (+2 more)", "a, b, c, d", "https://b/c", "none", "sync/app-01234567")


def test_budgets_by_level(spark):
    r = first(spark, reports.token_budget(F.lit(8000), F.lit("light")), reports.token_budget(F.lit(8000), F.lit("high")), reports.token_budget(F.lit(100), F.lit("medium")), reports.level_of(F.lit("guide"), {"guide": "high"}, "light"), reports.level_of(F.lit("x"), {"guide": "high"}, "light"))
    assert tuple(r) == (4800, 12800, 1024, "high", "light")


def test_last_section_is_cut(spark):
    s = spark.createDataFrame([("k", 0, "abcd"), ("k", 1, "efgh"), ("k", 2, "ijkl")], "key string, ord int, section string")
    assert [r["section"] for r in reports.prefix_with_cut(s, "key", 6).orderBy("ord").collect()] == ["abcd", "ef"]


def test_plan_states_and_rejected_edits(spark):
    plan = spark.createDataFrame([("a",), ("b",), ("c",)], "page_path string")
    done = spark.createDataFrame([("a", True, ""), ("b", False, "error")], "page_path string, applied boolean, note string")
    assert {r["page_path"]: r["state"] for r in reports.outcomes_of_plan(plan, done).collect()} == {"a": "authored", "b": "skipped", "c": "planned"}
    ops = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "page_path string, find string")
    assert {tuple(r) for r in reports.without_rejected(ops, ops.limit(1)).collect()} == {("a", "y"), ("b", "x")}


def test_base_comes_from_the_first_cursor(spark):
    c = spark.createDataFrame([("r", ""), ("r", "b"), ("s", None)], "repo_key string, base_sha string")
    k = spark.createDataFrame([("r", "new", 1), ("r", "old", 0)], "repo_key string, head_sha string, ord int")
    assert sorted((r["repo_key"], r["base_sha"] or "") for r in reports.base_of(c, k).collect()) == [("r", "b"), ("r", "old"), ("s", "")]


def test_report(spark):
    rows = [("r", f"p{i:02}", i % 2 == 0, None if i else "note") for i in range(60)]
    text = reports.markdown(spark.createDataFrame(rows, "run string, page_path string, applied boolean, note string"), "run").first()["report"]
    assert text.startswith("## Changed (30)\n- `p00`: note\n- `p02`") and "## Dropped (30)" in text and text.count("- `") == 40


def test_dashboard(spark):
    runs = spark.sql("""SELECT concat('r', id) AS run_id, timestamp '2024-05-01 00:00:00' + make_dt_interval(CAST(id AS INT)) AS ts, id AS ord, IF(id = 0, 'bootstrap', 'run') AS command, IF(id = 3, 'error', 'ok') AS status,
        '<script>' AS repo, id AS calls, 0.5D AS hit_rate, IF(id = 4, NULL, 1.25D) AS cost, id AS updated, 7L AS authored FROM range(12)""")
    pages = spark.sql("""SELECT concat('r', id % 12) AS run_id, id AS ord, 'run' AS command, concat('p', id, '&.md') AS page_path, id % 12 <> 9 AS applied, IF(id % 12 = 9, 'edit not applicable', '') AS note,
        IF(id = 11, array('why <b>'), NULL) AS rationales, CAST(NULL AS array<string>) AS warnings, IF(id = 11, '@@ -1 @@\\n-a\\n+<b>\\n c', NULL) AS diff FROM range(1500)""")
    usage = spark.sql("SELECT 'm' AS model, 'edit' AS stage, 2L AS calls, 30L AS tokens, 0.5D AS cost")
    page = dashboard.html(runs, pages, usage, reports.health_panel(spark.sql("SELECT array('a', 'b') AS sources")), "2024-05-07 00:00:00", 10.0)
    assert "<script>" not in page and "&lt;script&gt;" in page and "<b>" not in page and "<li>why &lt;b&gt;</li>" in page
    assert page.count("<details>") == 7 and "<summary>r11: 125 pages</summary>" in page and page.count("<p>25 more.</p>") == 7  # r9 has none applied
    assert '<span class="place">@@ -1 @@</span>\n<span class="old">-a</span>\n<span class="new">+&lt;b&gt;</span>\n<span class="same"> c</span>' in page
    assert "Cost so far: $13.75" in page and page.count(" L") == 12 and "<td>not_applicable</td><td>125</td>" in page
    empty = dashboard.html(runs.limit(0), pages.limit(0), usage.limit(0), runs.limit(0).select("ord"), "2024-05-07 00:00:00", 10.0)
    assert "<svg " not in empty and empty.count("<p>None.</p>") == 5


def test_pages_are_written_as_files_outside_the_state_folder(spark, tmp_path):
    o = spark.createDataFrame([("a.md", True, "é\n"), ("a.md", True, "a"), ("deep/er/c.md", True, None), (".state/y", True, "y"), ("b.md", False, "z"), (None, True, "n")], "page_path string, applied boolean, new_content string")
    for _ in range(2):  # again over what is there
        got = {tuple(r) for r in reports.write_pages(o, f"file://{tmp_path}", "docs/").collect()}
        assert got == {("docs/a.md", 3), ("docs/deep/er/c.md", 0)}
        assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {"docs/a.md": "é\n", "docs/deep/er/c.md": ""}
    assert reports.write_pages(o.limit(0), f"file://{tmp_path}").count() == 0
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(Exception, match="outside the root"):
            reports.write_pages(spark.createDataFrame([(bad, True, "x")], o.schema), f"file://{tmp_path}")


def test_rendered_diffs(spark):
    diffs = spark.createDataFrame([("a", "r", "t"), ("b", "r", None), ("c", "r", ""), ("d", "r" * 40, "t")], "diff_id string, repo string, title string")
    files = spark.createDataFrame([("a", 0, "x.py", "added", ["f", "g"], ["@@ 1", "@@ 2"]), ("a", 1, "y.py", "removed", None, None), ("b", 0, "x", "modified", [], ["@" * 100]), ("d", 0, "x", "added", None, None)], "diff_id string, ord int, path string, status string, symbols array<string>, hunks array<string>")
    whole = {r["diff_id"]: r["text"] for r in reports.rendered_diffs(diffs, files).collect()}
    a = "repo: r\npr_title: t\n\n## file: x.py (added)\nchanged symbols: f, g\n@@ 1\n@@ 2\n## file: y.py (removed)\nchanged symbols: (none)"
    assert whole["a"] == a and whole["c"] == "repo: r\npr_title: (none)\n"
    for budget in (len(a) - 1, len(a), 50, 1):
        got = {r["diff_id"]: r["text"] for r in reports.rendered_diffs(diffs, files, budget).collect()}
        for k, text in whole.items():
            head = text.index("\n", text.index("pr_title")) + 1
            assert got[k] == (text if len(text) <= budget or len(text) == head else text[: max(budget, head)] + "\n... (diff truncated)")


def test_heads_of_hot_keys(spark):
    rows = [("hot", f"n{i % 300:03}") for i in range(3000)] + [("one", "x"), ("one", None), (None, "y")]
    got = {tuple(r) for r in reports.heads(spark.createDataFrame(rows, "k string, item string"), "k", "item", 2).collect()}
    assert {("hot", "n000, n001 (+298 more)"), ("one", "x")} <= got


def test_report_with_costs(spark):
    rows = [("a", "p", True, None), ("a", "q", False, "dropped: x"), ("b", "p", True, None)]
    usage = spark.sql("SELECT 'a' AS run, struct(1.5D AS cost_usd, 3L AS calls, 1200L AS input_tokens, 50L AS output_tokens, 0.25D AS cache_hit_rate) AS usage UNION ALL SELECT 'b', NULL UNION ALL SELECT 'c', struct(1.0D, 1L, 1L, 1L, 0.0D)")
    got = {r["run"]: r["report"] for r in reports.markdown(spark.createDataFrame(rows, "run string, page_path string, applied boolean, note string"), "run", usage).collect()}
    assert got == {"a": "## Changed (1)\n- `p`\n\n## Dropped (1)\n- `q`: dropped: x\n\n## Cost\n~$1.5000 in 3 calls, 1,200 in / 50 out, 25% hit", "b": "## Changed (1)\n- `p`"}


def test_running_costs_over_many_ranges(spark):
    rows = [("hot" if i % 3 else None, i // 2, i, float(i % 7) if i % 5 else None) for i in range(400)]
    got = history.cost_over_time(spark.createDataFrame(rows, "user string, ts int, ord int, cost double").repartition(7), "user").collect()
    total, want = {}, set()
    for user, _, i, cost in rows:
        total[user] = total.get(user, 0) + (cost or 0)
        want.add((i, total[user]))
    assert {(r["ord"], r["cumulative"]) for r in got} == want and len(got) == 400
