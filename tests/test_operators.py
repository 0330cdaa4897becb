import hashlib
import math

import pytest
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.operators import evaluate, gates, history, planning, structure, symbols, vectors


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_counts_of_a_case(spark):
    e = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "c"), ("k", "a")], "case_id string, page_path string")
    a = spark.createDataFrame([("k", "a"), ("k", "z")], "case_id string, page_path string")
    assert values(evaluate.score_cases(e, a), "tp", "fp", "fn") == [(1, 1, 2)]


def test_micro_rates(spark):
    c = spark.createDataFrame([(1, 1, 2), (2, 0, 0)], "tp long, fp long, fn long")
    r = evaluate.micro(c).first()
    assert (r["precision"], r["recall"]) == (0.75, 0.6)
    none = evaluate.micro(c.where("tp > 9")).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_breaches_are_strict_and_skip_unset_floors(spark):
    m = spark.createDataFrame([(0.75, 0.6)], "precision double, recall double")
    assert values(evaluate.breaches(m, {"precision": 0.75, "recall": 0.7}), "metric") == [("recall",)]
    assert evaluate.breaches(m, {"precision": None}).count() == 0


def test_dashboard_shares(spark):
    shape = "command string, status string, calls int, hit_rate double, cost double, updated int, authored int, ts string"
    r = spark.createDataFrame([("run", "ok", 2, 0.5, 0.25, 3, 9, "2024-06-01"), ("bootstrap", "ok", 0, 0.9, 0.5, 9, 4, "2024-06-02"), ("run", "error", 1, 0.1, None, None, None, "2024-06-03")], shape).withColumn("ts", F.to_timestamp("ts"))
    o = history.overview(r).first()
    assert (o["updated"], o["authored"], o["cost"], o["calls"]) == (3, 4, 0.75, 3)
    assert o["success_rate"] == pytest.approx(2 / 3) and o["mean_hit_rate"] == pytest.approx(0.3) and o["run_count"] == 2
    assert history.overview(r.where("calls > 99")).first()["success_rate"] == 0.0


def test_drops_leave_out_skips_and_other_commands(spark):
    notes = ["dropped by validation: structure", "dropped by self-critique", "edit not applicable: x", "edit generation failed", "page not found", "unexpected error: y", "skipped: cap", "no edits"]
    rows = [("run", n, False) for n in notes] + [("run", "dropped by validation", True), ("run", "applied", True), ("bootstrap", "page not found", False)]
    p = spark.createDataFrame(rows, "command string, note string, applied boolean")
    assert values(history.drops_by_reason(p), "reason", "n") == [("critique", 1), ("error", 3), ("not_applicable", 1), ("validation", 1)]
    o = history.page_overview(p).first()
    assert (o["attempted"], o["dropped"], o["drop_rate"]) == (9, 6, 6 / 9)


def test_longest_prefix_and_fallback_prices(spark):
    prices = spark.createDataFrame([("m-large", 15.0, 75.0, 18.75, 1.5, False), ("m-", 1.0, 5.0, 1.25, 0.1, False), ("", 15.0, 75.0, 18.75, 1.5, True)], "prefix string, input double, output double, cache_write double, cache_read double, is_fallback boolean")
    m = 1_000_000
    usage = spark.createDataFrame([("m-large-1", m, m, 0, 0), ("m-small", m, m, 0, 0), ("what", m, m, 0, 0), (None, 0, 0, m, m)], "model string, input_tokens long, output_tokens long, cache_write long, cache_read long")
    got = {r["model"]: r["cost"] for r in history.priced(usage, prices).collect()}
    assert got == {"m-large-1": 90.0, "m-small": 6.0, "what": 90.0, None: 20.25}


def test_hit_rate_of_totals(spark):
    u = spark.createDataFrame([("m", None, 1, 100, 0, 300)], "model string, stage string, calls long, input_tokens long, cache_write long, cache_read long")
    assert {(r["is_total"], r["hit_rate"]) for r in history.usage_totals(u).collect()} == {(0, 0.75), (1, 0.75)}


def test_month_budget_leaves_out_other_months_and_rolls_december(spark):
    c = spark.createDataFrame([("2023-12-02 00:00:00", 1.0), ("2023-11-30 23:59:59", 5.0), ("2024-01-01 00:00:00", 7.0)], "ts string, cost double").withColumn("ts", F.to_timestamp("ts"))
    b = history.month_budget(c, "2023-12-16 12:00:00", 1.5).first()
    assert b["spent"] == 1.0 and b["projected"] == pytest.approx(2.0) and b["over"]


def test_recent_runs_are_taken_before_filtering(spark):
    r = spark.createDataFrame([(i, i) for i in range(5)], "ts int, ord int")
    assert values(history.newest(r, 2).where("ts < 4"), "ts") == [(3,)]


def test_sections(spark):
    p = spark.createDataFrame([("a", "intro\n# One\ntext\n  ## Two\nmore"), ("b", "# Only"), ("c", ""), ("d", "\n\n"), ("e", None)], "page_path string, text string")
    assert values(vectors.sections(p), "page_path", "chunk_ord", "chunk") == [("a", 0, "intro"), ("a", 1, "# One\ntext"), ("a", 2, "## Two\nmore"), ("b", 0, "# Only")]


def test_content_hash_minds_model_and_order(spark):
    a = spark.createDataFrame([("k", 0, "x"), ("k", 1, "y")], "key string, ord int, part string")
    b = spark.createDataFrame([("k", 1, "x"), ("k", 0, "y")], "key string, ord int, part string")
    h = lambda df, m: vectors.content_hash(df, "key", m).first()["content_hash"]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [digest(f"{i}:" + digest(x)) for i, x in enumerate("xy")]
    assert h(a, "m") == digest(":".join(["m", "2", *(str(sum(int(r[15 * i : 15 * i + 15], 16) for r in rows)) for i in range(4))]))
    assert h(a.repartition(3), "m") == h(a, "m") and len({h(a, "m"), h(b, "m"), h(a, "n")}) == 3
    assert vectors.stale(vectors.content_hash(a, "key", "m"), vectors.content_hash(b, "key", "m"), "key").count() == 1


def test_top_k_floor_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, embedding array<double>")
    assert [r["id"] for r in vectors.top_k(v, [1.0, 0.0], 1, 0.2).collect()] == [1]
    assert vectors.top_k(v, [1.0, 0.0], 5, 1.1).count() == 0
    assert [r["id"] for r in vectors.top_k(v, [1.0, 0.0], 5, 0.2).collect()] == [1, 2]


def test_unit_vectors(spark):
    v = vectors.normalised(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "embedding array<double>")).collect()
    assert [math.hypot(*r["embedding"]) for r in v] == [1.0, 0.0]


def test_structure_of_a_page(spark):
    text = "<Card>a</Card>\n<Card x='1'>b</Card><Note>n</Note>\n```\nx\n```\n<Bogus>"
    p = spark.createDataFrame([("p", text), ("q", "<Card/>")], "page_path string, text string")
    assert values(structure.signature(p, ["Card", "Note"]), "page_path", "tag", "opened", "closed") == [("p", "Card", 2, 2), ("p", "Note", 1, 1), ("p", "```", 2, 0), ("q", "Card", 1, 1)]


@pytest.mark.parametrize("after, faults", [("<Card>a</Card><Card>b</Card>", 0), ("", 1), ("<Card>a</Card><Card>", 1), ("<Card>a</Card><Steps></Steps>", 1), ("<Card>a</Card>\n```", 1), ("<Card>a</Card><Card x/>", 0), ("<Card>a</Card>\n```mermaid\na\n```", 2)])
def test_structure_may_grow_by_whole_leaves_only(spark, after, faults):
    sign = lambda t: structure.signature(spark.createDataFrame([("p", t)], "page_path string, text string"), ["Card", "Steps"])
    assert structure.changed_structure(sign("<Card>a</Card>"), sign(after), ["Card"]).count() == faults


@pytest.mark.parametrize("text, fault", [("<A><B></B></A>", None), ("<A>", "unclosed A"), ("</A>", "stray A"), ("<A><B></A></B>", "crossed A"), ("<A/>", None), ("```\n<A>\n```", None), ("`<A>`", None)])
def test_nesting(spark, text, fault):
    p = spark.createDataFrame([(text,)], "text string").select(structure.nesting_fault(F.col("text"), ["A", "B"]).alias("f"))
    assert p.first()["f"] == fault


def test_repair_is_idempotent_and_leaves_crossed_tags(spark):
    p = spark.createDataFrame([("<A>x",), ("x</A>",), ("<A><B></A></B>",), ("<A></A>",), (None,)], "text string")
    once = structure.repaired(p, ["A", "B"])
    assert [r["text"] for r in once.collect()] == ["<A>x</A>", "x", "<A><B></A></B>", "<A></A>", None]
    assert once.collect() == structure.repaired(once, ["A", "B"]).collect()


def test_broken_links(spark):
    p = spark.createDataFrame([("p", "[a](./x.md#h) [b](https://y) [c](#top) <a href=\"z.md\">z</a>")], "page_path string, text string")
    there = spark.createDataFrame([("z.md",)], "path string")
    assert values(structure.broken(structure.links(p), there), "target") == [("./x.md",)]


def test_frozen_front_matter(spark):
    rows = [("same", "---\ntitle: 'A'\n---\nx", "---\ntitle: A\n---\ny"), ("gone", "---\ntitle: A\n---\n", "x"), ("new", "---\ntitle: A\n---\n", "---\ntitle: B\n---\n")]
    p = spark.createDataFrame(rows, "page_path string, before string, after string")
    assert values(structure.frozen_changes(p, ["title"]), "page_path", "key") == [("gone", "title"), ("new", "title")]


def test_edits_fold_and_stop(spark):
    op = "ops array<struct<find:string,replace:string>>"
    rows = [("a b", [("a", "c"), ("c b", "d")]), ("a a", [("a", "c")]), ("x", [("a", "c")]), ("a b", [("b", "aa"), ("a", "z")]), ("k", [])]
    got = [(r["result"], r["failed"]) for r in gates.applied(spark.createDataFrame(rows, f"text string, {op}")).collect()]
    assert got == [("d", None), ("a a", "ambiguous: a"), ("x", "missing: a"), ("a aa", "ambiguous: a"), ("k", None)]


def test_diff_budget_levels(spark):
    d = spark.createDataFrame([(200, None, None), (200, 500, 1.0)], "lines long, own int, share double")
    b = d.select(gates.diff_budget(F.col("lines"), 40, 0.35, F.col("own"), F.col("share")).alias("light"), gates.diff_budget(F.col("lines"), 100, 0.7).alias("high"))
    assert [tuple(r) for r in b.collect()] == [(70, 140), (500, 140)]


def test_net_changed_lines_and_diffs(spark):
    p = spark.createDataFrame([("a\nb", "a\nc"), ("a", "a"), (None, "x")], "before string, after string")
    assert [r["changed_lines"] for r in gates.net_changed_lines(p).collect()] == [2, 0, 1]
    long = spark.createDataFrame([("\n".join(map(str, range(300))), "")], "before string, after string")
    assert gates.page_diff(long, 10).first()["diff"].split("\n")[-1].startswith("... ")


def test_truncation_and_new_pages(spark):
    d = spark.createDataFrame([("x" * 100, "x" * 49), ("x" * 100, "x" * 50), ("x", " ")], "a string, b string")
    assert [r[0] for r in d.select(gates.truncated(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    n = spark.createDataFrame([(None, " ", "```\nshort")], "t string, d string, b string").select(gates.new_page_failures(F.col("t"), F.col("d"), F.col("b")).alias("f"))
    assert n.first()["f"] == ["title", "description", "fences", "short"]


def test_changed_symbols_in_order(spark):
    hunk = "@@ -1 +1 @@ def foo(a):\n+x = 1\n-    inner = 2\n+CONST == other\n+y: int = 3\n+async def bar():\n+++ b/file\n context = 4\n+class Foo:"
    h = spark.createDataFrame([("a.py", 0, hunk), ("a.py", 1, "@@ def foo(a):\n-x = 1"), ("a.ts", 0, "@@\n+def no():"), ("b.py", 0, None)], "file_path string, hunk_ord int, hunk string")
    got = [r["symbol"] for r in symbols.changed_symbols(h).orderBy("hunk_ord", "pos").collect()]
    assert got == ["foo", "x", "y", "bar", "Foo"]


def test_python_and_typescript_names(spark):
    code = "import os\ndef f():\n    def inner(): pass\nasync def g(): pass\nclass C:\n    def m(self): pass\nX = Y = 1\nZ: int = 2\n"
    f = spark.createDataFrame([("a.py", code), ("b.py", "def broken(:\nclass K:\n"), ("c.ts", "export function a() {}\nexport const b = 1\nclass No {}\nexport default class C {}"), ("d.py", None)], "path string, text string")
    assert values(symbols.python_symbols(f), "path", "symbol") == [("a.py", s) for s in ("C", "X", "Y", "Z", "f", "g")] + [("b.py", "K"), ("b.py", "broken")]
    assert values(symbols.exports(f), "symbol") == [("C",), ("a",), ("b",)]
    assert values(symbols.surface(f.where("path = 'a.py'")), "ord", "line") == [(0, "def f()"), (1, "def g()"), (2, "class C")]


def test_plan_keeps_only_new_routes(spark):
    plan = spark.createDataFrame([(0, "a.mdx"), (1, "./b.md"), (2, "c.mdx"), (3, "c/index.md"), (4, "d.md")], "ord int, page_path string")
    disk = spark.createDataFrame([("a.md",)], "page_path string")
    nav = spark.createDataFrame([("b",)], "route string")
    assert values(planning.first_wins(plan, disk, nav), "page_path") == [("c.mdx",), ("d.md",)]
    assert values(planning.first_wins(plan, disk, nav, 1), "page_path") == [("c.mdx",)]


def test_nav_routes_in_any_group_stay(spark):
    nav = spark.createDataFrame([("g", "a")], "group_name string, route string")
    new = spark.createDataFrame([("h", "a", 0), ("h", "b", 1), ("k", "b", 2)], "group_name string, route string, ord int")
    assert values(planning.nav_additions(nav, new), "group_name", "route") == [("h", "b")]


def test_merging_a_manifest_twice_adds_nothing(spark):
    m = spark.createDataFrame([("a", 0)], "path string, ord int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "path string, ord int")
    added = planning.merge_manifest(m, new)
    assert values(added, "path", "ord") == [("b", 2)]
    assert planning.merge_manifest(m.unionByName(added), new).count() == 0


def test_sections_in_canonical_order(spark):
    p = spark.createDataFrame([("Reference", 0), ("Getting Started", 1), ("Zed", 2), ("Architecture", 3)], "section string, ord int")
    got = planning.ordered_sections(p, ["Getting Started", "Architecture", "Reference"]).orderBy("rank").collect()
    assert [r["section"] for r in got] == ["Getting Started", "Architecture", "Reference", "Zed"]


@pytest.mark.parametrize("files, cover", [(["src/r/a.py", "src/r/b.py"], [("src/r/*.py",)]), (["src/r/a.py", "src/r/b.py", "src/r/c.py"], []), (["src/r/a.py", "src/r/b.py", "src/r/x/c.py"], [])])
def test_exact_cover(spark, files, cover):
    g = spark.createDataFrame([("p", "src/r/a.py"), ("p", "src/r/b.py")], "key string, pattern string")
    assert values(planning.exact_covers(g, spark.createDataFrame([(f,) for f in files], "path string")), "pattern") == cover


def test_doctor(spark):
    rules = spark.createDataFrame([("a", "src/*", "x/app"), ("b", "gone/*", ""), ("c", "src/f.py", "lib")], "page_path string, pattern string, repo string")
    paths = spark.createDataFrame([("src/f.py",)], "path string")
    dead = planning.dead_globs(rules, paths)
    assert values(dead, "page_path") == [("b",)]
    missing = planning.missing_pages(rules, spark.createDataFrame([("a",), ("b",)], "page_path string"))
    assert values(missing, "page_path") == [("c",)]
    assert not planning.healthy(missing, dead).first()["ok"]
    assert planning.healthy(missing.limit(0), dead.limit(0)).first()["ok"]
    assert values(planning.unmapped_repos(rules, spark.createDataFrame([("APP.git",)], "repo string")), "key") == [("lib",)]
    wanted = spark.createDataFrame([("foo",), ("bar",)], "symbol string")
    assert values(planning.missing_symbols(wanted, spark.createDataFrame([("a foo b",), (None,)], "text string")), "symbol") == [("bar",)]


def test_repo_mode_and_docs_root(spark):
    s = lambda *r: spark.createDataFrame([(x,) for x in r], "repo string")
    assert planning.repo_mode(s("x/docs.git", ""), "y/Docs").first()["mode"] == "mono"
    assert planning.repo_mode(s("a", "b"), "a").first()["mode"] == "poly"
    assert planning.repo_mode(s("a"), "b").first()["mode"] == "single"
    p = spark.createDataFrame([("r/docs/a.md",), ("r/docs/x/b.md",)], "path string")
    assert planning.common_directory(p).first()["directory"] == "r/docs"


def test_budgeted_prefix_and_caps(spark):
    rows = spark.createDataFrame([("k", i, "x" * 4) for i in range(5)], "key string, ord int, line string")
    assert planning.budgeted_prefix(rows, "key", 12).count() == 2
    assert values(planning.capped(rows, "key", 3), "ord") == [(0,), (1,), (2,)]


def test_line_counts_and_escape(spark):
    d = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",), ("\n",)], "t string")
    assert [r[0] for r in d.select(T.line_count("t")).collect()] == [0, 1, 1, 2, 1]
    assert spark.createDataFrame([("<a&'\">",)], "t string").select(T.html_escape("t")).first()[0] == "&lt;a&amp;&#x27;&quot;&gt;"


def test_symbols_need_boundaries_and_all_of_a_line_count(spark):
    hunk = "@@ -1,2 +1,2 @@ async def head(x):\n+subclass Foo\n+undef bar\n+class A: pass; class B(A): pass\n-  inner = 1\n-top: int = 2\n+other == 3\n+more += 1\n+x: y == z\n+été = 1\n+++ b/def no\n context = 2"
    found = symbols.changed_symbols(spark.createDataFrame([("a.py", 0, hunk), ("b.PY", 0, hunk), ("c.ts", 0, hunk)], "file_path string, hunk_ord int, hunk string"))
    assert values(found, "file_path", "symbol") == [("a.py", s) for s in sorted(["head", "A", "B", "top", "été"])]
    text = "export default async function go() {}\nexport abstract class K<T> {}\nexport { x }\nexport * from 'y'\n export const no = 1\nexported const no = 2\nexport const $v = 1, w = 2\nexport enum E {}"
    assert values(symbols.exports(spark.createDataFrame([("a.tsx", text), ("a.js", text)], "path string, text string")), "symbol") == [("$v",), ("E",), ("K",), ("go",)]


def test_last_verdict_and_outcome_count(spark):
    from pagetrace.operators import anchors, reports

    c = spark.createDataFrame([("p", "embedding", False), ("q", "embedding", False)], "page_path string, source string, judge_required boolean")
    v = spark.createDataFrame([("p", True, 0.9, 1), ("p", False, 0.9, 2), ("q", True, 0.6, 1)], "page_path string, affected boolean, confidence double, ord int")
    assert values(anchors.judged(c, v), "page_path", "decision") == [("p", "dropped"), ("q", "kept")]
    o = spark.createDataFrame([("p", False, "", 1), ("p", True, "", 2)], "page_path string, applied boolean, note string, ord int")
    assert values(reports.outcomes_of_plan(c.select("page_path"), o), "page_path", "state") == [("p", "authored"), ("q", "planned")]


def test_prices_without_a_fallback(spark):
    u = spark.createDataFrame([("model-a-1", 10), ("other", 10), (None, 10), ("", 10)], "model string, input_tokens long").withColumns({c: F.lit(0) for c in ("output_tokens", "cache_write", "cache_read")})
    p = spark.createDataFrame([("model", 1e5, False), ("model-a", 2e5, False)], "prefix string, input double, is_fallback boolean").withColumns({c: F.lit(0.0) for c in ("output", "cache_write", "cache_read")})
    assert sorted(((r["model"] or "", r["prefix"], r["cost"]) for r in history.priced(u, p).collect()), key=str) == [("", None, None), ("", None, None), ("model-a-1", "model-a", 2.0), ("other", None, None)]


def test_repair_takes_out_strays_and_closes_what_is_open(spark):
    rows = [("<b>x</b></i>y", "<b>x</b>y"), ("<b><i>x", "<b><i>x</i></b>"), ("<b><i>x</b></i>", "<b><i>x</b></i>"), ("<b/>x<i/></i>", "<b/>x<i/>"), ("none", "none"), ("", ""), (None, None)]
    got = structure.repaired(spark.createDataFrame(rows, "text string, want string"), ["b", "i"]).collect()
    assert all(r["text"] == r["want"] for r in got) and len(got) == 7


def test_relative_links(spark):
    files = spark.createDataFrame([("a/one.md",), ("a/two/index.mdx",), ("b.md",)], "path string")
    targets = ["one.md", "./one", "../b.md", "two/", "./two", "../../b.md", "gone.md", "./gone", "/abs.md", "http://x/y.md", "#top", "word", ""]
    page = spark.createDataFrame([("a/page.md", t) for t in targets], "page_path string, target string")
    assert values(structure.broken_files(page, files), "target") == [("../../b.md",), ("./gone",), ("gone.md",)]
    lines = spark.createDataFrame([("broken link /x",), ("no broken links in /x",), ("checking broken links",), ("404 https://x",), (None,)], "line string")
    assert values(lines.where(structure.link_finding(F.col("line"))), "line") == [("404 https://x",), ("broken link /x",)]


def test_addresses_tell_no_problem(spark):
    rows = [("ok https://x.org/en/40425.html", False), ("ok https://x.org/missing/success", False), ("ok a/404/broken.md", False), ("Broken link: https://x.org/success/1", True), ("404: /a", True), ("docs/a.md:12: broken", True), ("[404](http://x:8080/y)", True), ("http://x:8080/404 ok", False)]
    lines = spark.createDataFrame(rows, "line string, want boolean")
    assert [r["line"] for r in lines.where(structure.link_finding(F.col("line")) != F.col("want")).collect()] == []


def test_paths_and_roots(spark):
    route = lambda p: spark.range(1).select(planning.unnumbered_route(F.lit(p)).alias("r")).first()["r"]
    assert [route(p) for p in ("/01-intro/2. first_steps.MDX", "2024/x.md", "3d.md", "01-.md")] == ["intro/first_steps", "2024/x", "3d", "01-"]
    path = lambda p: spark.range(1).select(planning.normal_path(F.lit(p)).alias("r")).first()["r"]
    assert [path(p) for p in ("/a/b", " c.md ", "d.MARKDOWN")] == ["a/b.mdx", "c.md", "d.MARKDOWN"]
    root = lambda *paths: planning.docs_root(spark.createDataFrame([(p,) for p in paths], "path string")).first()["directory"]
    assert [root("x/y/a.md", "x/y/z/b.md"), root("a.md"), root("x/z/docs.json", "x/mint.json", "q/a.md"), root("docs.json"), root("a.txt"), root("x/a.md", "y/b.md")] == ["x/y", ".", "x/z", ".", ".", "."]


def test_excerpts_stay_in_their_repository(spark):
    units = spark.createDataFrame([("r1", "src/a.py", 1), ("r1", "src/b.py", 2), ("r2", "src/a.py", 3)], "repo string, path string, ord int")
    sources = spark.createDataFrame([("p", "r1", "src/*", 0), ("p", "r1", "*a.py", 1), ("p", "r2", "none*", 2), ("q", "r2", "src/*.py", 0)], "page_path string, repo string, pattern string, source_ord int")
    assert values(planning.planned_excerpts(sources, units), "page_path", "repo", "path") == [("p", "r1", "src/a.py"), ("p", "r1", "src/b.py"), ("q", "r2", "src/a.py")]
    assert values(planning.planned_excerpts(sources, units, 1), "page_path", "path") == [("p", "src/a.py"), ("q", "src/a.py")]


def test_edit_order_numbers_a_large_group_in_ranges(spark):
    from pagetrace.operators import reports

    rows = [(f"p{i:03}", "hot" if i % 3 else "x", i % 7) for i in range(200)]
    got = reports.edit_order(spark.createDataFrame(rows, "page_path string, source string, confidence int").repartition(5), "source").collect()
    for s in ("hot", "x"):
        want = [p for p, x, c in sorted(rows, key=lambda r: (-r[2], r[0])) if x == s]
        assert [r["page_path"] for r in sorted((r for r in got if r["source"] == s), key=lambda r: r["turn"])] == want and {r["turn"] for r in got if r["source"] == s} == set(range(1, len(want) + 1))


def test_modules_of_one_file_are_read_by_several_tasks(spark, sf_dir):
    from pagetrace.plans import quality

    assert quality.api_surface(spark, sf_dir).rdd.getNumPartitions() > 1 and quality.py_symbols_ast(spark, sf_dir).rdd.getNumPartitions() > 1


def test_symbols_live_in_the_rules_own_files(spark, monkeypatch):
    monkeypatch.setattr(planning, "NEEDLES", 2)
    files = spark.createDataFrame([("org/App.git", "src/a.py", "def run_all(): pass"), ("app", "src/b.py", "LIMIT = 1"), ("app", "lib/c.py", "only_here"), ("app", "src/n.py", None), ("x[1]", "src/a.py", "other")], "repo string, path string, text string")
    sources = [
        ("p.md", 0, "app", ["src/*.py"], ["run_all", "run_*", "LIMIT", "only_here", "*", "", "run_all"]),
        ("p.md", 1, "app", ["lib/*", "src/a.py"], ["only_here", "LIMIT"]),
        ("q.md", 0, "app", ["none/*"], ["run_all", "*"]),
        ("q.md", 1, "gone", ["src/*"], ["run_all"]),
        ("r.md", 0, "x[1]", ["*.py"], ["other", "run_all"]),
        ("s.md", 0, "app", [], ["run_all"]),
        ("t.md", 0, "app", ["*"], []),
    ]
    got = planning.missing_rule_symbols(spark.createDataFrame(sources, "page_path string, source_ord int, repo string, globs array<string>, symbols array<string>"), files)
    assert sorted(map(tuple, got.collect())) == [("p.md", 0, "app", "only_here"), ("p.md", 1, "app", "LIMIT"), ("q.md", 0, "app", "run_all"), ("r.md", 0, "x[1]", "run_all"), ("s.md", 0, "app", "run_all")]


def test_symbols_of_many_rules_are_not_repeated_for_each_file(spark, monkeypatch):
    def repeated(*_):
        raise AssertionError("needles are listed for each file")

    monkeypatch.setattr(planning, "found_needles", repeated)
    monkeypatch.setattr(planning, "NEEDLES", 3)
    monkeypatch.setattr(planning, "SEARCHED", 40)
    files = spark.createDataFrame([("app", f"{'src' if i % 2 else 'lib'}/{i}.py", f"x has_{i} y") for i in range(40)], "repo string, path string, text string")
    sources = [(f"p{i}", 0, "app", ["src/*"] if i % 3 else ["src/*", "lib/*", "*"], [f"has_{i}", "has_*", f"none_{i}*"]) for i in range(60)]
    got = planning.missing_rule_symbols(spark.createDataFrame(sources, "page_path string, source_ord int, repo string, globs array<string>, symbols array<string>"), files)
    want = []
    for page, _, _, globs, _ in sources:
        i = int(page[1:])
        texts = [f"x has_{k} y" for k in range(40) if k % 2 or len(globs) > 1]
        want += [(page, s) for s in (f"has_{i}", f"none_{i}*") if not any(s.removesuffix("*") in t for t in texts)]
    assert values(got, "page_path", "symbol") == sorted(want)


def test_needles_that_lie_in_one_another(spark):
    rows = spark.createDataFrame([("a", "abcabcd", ["abc", "bc", "abcd", "bcd", "zz"]), ("b", "", ["x"]), ("c", "x", [])], "path string, text string, needles array<string>")
    assert sorted(map(tuple, planning.found_needles(rows).collect())) == [("a", "abc"), ("a", "abcd"), ("a", "bc"), ("a", "bcd")]
