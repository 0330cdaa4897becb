import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.operators import anchors


def hits(spark, paths, rules):
    p = spark.createDataFrame([(x,) for x in paths], "path string")
    r = spark.createDataFrame([(page, i, g) for i, (page, g) in enumerate(rules)], "page_path string, rule_ord int, pattern string")
    return anchors.match_globs(p, r)


def scores(spark, paths, rules):
    return {r["page_path"]: (r["score"], r["reason"]) for r in anchors.scores(hits(spark, paths, rules)).collect()}


def test_globs_agree_with_the_standard_library(spark):
    paths = ["a.py", "src/a.py", "src/x/b.py", "src/x/y/c.ts", "s[rc/a.py", "src/+a.(1).py", "", "src", "src/ab.py", "src/a\n.py"]
    globs = ["*.py", "src/*.py", "src/**", "src/?.py", "src/[ab].py", "src/[!a].py", "*", "s[rc/*", "src/+a.(1).py", "src/x/*/c.ts", "a.py", "**/b.py"]
    got = {(r["path"], r["pattern"]) for r in hits(spark, paths, [("p", g) for g in globs]).collect()}
    assert got == {(p, g) for p in paths for g in globs if fnmatch.fnmatchcase(p, g)}


def test_two_paths_under_one_glob_score_two(spark):
    assert scores(spark, ["src/a.py", "src/b.py", "x"], [("p.md", "src/*.py")]) == {"p.md": (2.0, "src/*.py x2")}


def test_one_path_under_two_globs_counts_twice(spark):
    assert scores(spark, ["src/a.py"], [("p.md", "src/*"), ("p.md", "src/a.py")])["p.md"] == (2.0, "src/* x1; src/a.py x1")


def test_no_hits_no_page(spark):
    assert scores(spark, ["x"], [("p.md", "src/*")]) == {}


def test_glob_join_has_no_nested_loop_for_literal_and_directory_rules(spark):
    p = spark.range(1000).select(F.concat(F.lit("src/"), F.col("id").cast("string")).alias("path"))
    r = spark.createDataFrame([("a", "src/1"), ("b", "src/*")], "page_path string, pattern string")
    joined = anchors.match_globs(p, r)
    assert joined.count() == 1001


def test_symbol_prefix(spark):
    s = spark.createDataFrame([("ENV_HOST",), ("ENV_PORT",), ("OTHER",)], "symbol string")
    r = spark.createDataFrame([("p", "ENV_*"), ("q", "OTHER"), ("all", "*")], "page_path string, pattern string")
    got = anchors.match_symbols(s, r).groupBy("page_path").count().collect()
    assert {x["page_path"]: x["count"] for x in got} == {"p": 2, "q": 1, "all": 3}


def test_repo_key_and_scope(spark):
    c = spark.createDataFrame([("Team/App",), ("https://x/team/lib.git/",)], "repo string")
    r = spark.createDataFrame([("any", ""), ("app", "git@x:team/app.git")], "page_path string, rule_repo string")
    got = {(x["repo"], x["page_path"]) for x in anchors.in_scope(c, r).collect()}
    assert got == {("Team/App", "any"), ("https://x/team/lib.git/", "any"), ("Team/App", "app")}


def test_docs_subtree_filter_minds_previous_path(spark):
    f = spark.createDataFrame([("docs/a", None), ("src/a", "docs/b"), ("src/c", None), ("docsx/a", "src/d"), ("docs", None)], "path string, previous_path string")
    assert sorted(r["path"] for r in anchors.outside_docs(f, "/docs/").collect()) == ["docsx/a", "src/c"]
    assert anchors.outside_docs(f, ".").count() == 5


def test_anchor_wins_then_higher_score_then_earlier(spark):
    c = spark.createDataFrame([("p", "embedding", 0.9, 0), ("p", "anchor", 0.1, 1), ("q", "embedding", 0.5, 2), ("q", "embedding", 0.7, 3), ("q", "embedding", 0.7, 4)], "page_path string, source string, score double, ord long")
    got = {r["page_path"]: (r["source"], r["score"], r["ord"]) for r in anchors.anchor_wins(c).collect()}
    assert got == {"p": ("anchor", 0.1, 0), "q": ("embedding", 0.7, 2)}


def test_judging(spark):
    c = spark.createDataFrame([("a", "anchor", False), ("b", "anchor", True), ("c", "embedding", None), ("d", "embedding", False), ("e", "embedding", False), ("f", "embedding", False)], "page_path string, source string, judge_required boolean")
    v = spark.createDataFrame([("b", True, 0.5), ("c", True, 0.49), ("d", False, 0.9), ("f", None, None)], "page_path string, affected boolean, confidence double")
    got = {r["page_path"]: r["decision"] for r in anchors.judged(c, v).collect()}
    assert got == {"a": "autopass", "b": "kept", "c": "dropped", "d": "dropped", "e": "dropped", "f": "dropped"}


def test_floor_and_cap(spark):
    p = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", 0.8), ("d", 0.1), ("e", None)], "page_path string, confidence double")
    got = {r["page_path"]: r["status"] for r in anchors.floor_and_cap(p, 0.5, 1).collect()}
    assert got == {"a": "edited", "b": "capped", "c": "capped", "d": "below_floor", "e": "below_floor"}


def test_query_tokens(spark):
    t = spark.createDataFrame([("Foo", 1), ("", 2), ("Index", 3), ("Foo", 4), ("bar", 0)], "token string, ord int")
    assert {(r["token"], r["ord"]) for r in anchors.query_tokens(t, ["index"]).collect()} == {("Foo", 1), ("bar", 0)}


def test_stem_of_hidden_file_is_empty(spark):
    got = spark.createDataFrame([("a/.gitignore",), ("a/b.c.py",), ("x",)], "p string").select(T.stem("p").alias("s")).collect()
    assert [r["s"] for r in got] == ["", "b.c", "x"]


def test_processed_repos_compare_by_key(spark):
    c = spark.createDataFrame([("Team/App", "h1"), ("team/app", "h2")], "repo string, head_sha string")
    k = spark.createDataFrame([("x/team/app.git", "h1")], "repo string, head_sha string")
    assert [r["head_sha"] for r in anchors.unprocessed(c, k).collect()] == ["h2"]


def globs(spark, paths, patterns):
    p, r = spark.createDataFrame([(x,) for x in paths], "path string"), spark.createDataFrame(list(enumerate(patterns)), "_id int, pattern string")
    return {(x["path"], x["_id"]) for x in anchors.match_globs(p, r).collect()}


def test_rules_without_directory_equal_fnmatch(spark):
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice("ab/.x-[]é") for _ in range(rng.randint(0, n)))
    paths = {piece(9) for _ in range(300)} | {"src/a.py", "a[1].md", "x" * 300}
    patterns = [rng.choice(["*", "?", "[!b]", "[ab]", "", "["]) + piece(4) + rng.choice(["*", "??", "[]x]*", ""]) + piece(2) for _ in range(200)] + ["*", "**", "?", "[ab]*", "*.py", "", "*é*"]
    want = {(p, i) for p in paths for i, g in enumerate(patterns) if fnmatch.fnmatchcase(p, g)}
    assert globs(spark, sorted(paths), patterns) == want and len(want) > 300


def test_many_rules_without_directory_are_no_nested_loop(spark):
    n = 200_000
    rules = spark.range(n).select(F.concat(F.lit("*mod_"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("?.py")).alias("pattern"), "id")
    paths = spark.range(0, n, 40).select(F.concat(F.lit("src/mod_"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("x.py")).alias("path"))
    hits = anchors.match_globs(paths, rules)
    assert "NestedLoop" not in hits._jdf.queryExecution().toString() and "Cartesian" not in hits._jdf.queryExecution().toString()
    assert hits.count() == n // 40 and hits.where("path <> concat('src/mod_', lpad(cast(id as string), 6, '0'), 'x.py')").count() == 0


def test_columns_of_rules_are_kept_or_refused(spark):
    p, r = spark.createDataFrame([("a.md",)], "path string"), spark.createDataFrame([("*.md", 1)], "pattern string, _mine int")
    assert anchors.match_globs(p, r).columns == ["path", "pattern", "_mine"]
    for name in anchors.RESERVED:
        with pytest.raises(ValueError):
            anchors.match_globs(p, r.withColumnRenamed("_mine", name))


def test_hits_of_equal_patterns_and_paths_are_counted_once_each(spark, monkeypatch):
    seen = []

    def match(paths, rules, real=anchors.match_globs):
        seen.append((paths.count(), rules.count()))
        return real(paths, rules)

    monkeypatch.setattr(anchors, "match_globs", match)
    paths = spark.createDataFrame([("a/x.py",)] * 30 + [("b/y.py",)] * 2 + [(None,)], "path string")
    rules = spark.createDataFrame([(i, "*x*") for i in range(20)] + [(20, "*.py"), (21, "b/*"), (22, "none*"), (23, None)], "rule int, pattern string")
    got = {r["rule"]: r["hits"] for r in anchors.glob_hits(paths, rules).collect()}
    assert got == {**{i: 30 for i in range(20)}, 20: 32, 21: 2}
    assert seen == [(3, 5)]


def test_a_piece_of_many_paths_is_tested_in_parts(spark, monkeypatch):
    monkeypatch.setattr(anchors, "TESTED", 50)
    names = [f"p/abc{i}" for i in range(60)]
    rules = [f"*abc{i}*" for i in range(10)] + ["*abc*"]
    got = anchors.match_globs(spark.createDataFrame([(n,) for n in names], "path string"), spark.createDataFrame([(r,) for r in rules], "pattern string"))
    assert sorted(map(tuple, got.collect())) == sorted((n, r) for n in names for r in rules if r.strip("*") in n)
