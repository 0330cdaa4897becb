import json

import pytest
from pyspark.sql import functions as F

from pagetrace.operators import navigation, structure

SIDEBARS = "nav string, sidebar_ord int, sidebar string, items string"


def bars(spark, *rows):
    return spark.createDataFrame([(n, i, s, x if isinstance(x, str) else json.dumps(x)) for n, i, s, x in rows], SIDEBARS)


def routes(spark, *rows):
    return [(r["nav"], r["sidebar"], r["route"]) for r in navigation.routes(navigation.nodes(bars(spark, *rows))).orderBy("nav", "sidebar_ord", "at").collect()]


def deep(levels):
    node = ["end"]
    for i in range(levels):
        node = [f"before{i}", {"type": "category", "label": f"c{i}", "items": node}, f"after{i}"]
    return node


def test_routes_of_every_depth_in_reading_order(spark):
    want = [f"before{i}" for i in reversed(range(40))] + ["end"] + [f"after{i}" for i in range(40)]
    assert [r for _, _, r in routes(spark, ("n", 0, "s", deep(40)))] == want


def test_very_deep_sidebars_are_read_in_one_pass(spark):
    n = 700
    text = "".join(f'["before{i}", {{"type": "category", "label": "c", "items": ' for i in range(n)) + '["end"]' + "}]" * n
    assert [r for _, _, r in routes(spark, ("n", 0, "s", text))] == [f"before{i}" for i in range(n)] + ["end"]


def test_sidebars_deeper_than_the_json_reader_goes_are_whole(spark):
    n = 6_000
    text = "".join(f'["b{i}", {{"type": "category", "label": "c", "items": ' for i in range(n)) + '["end", {"type": "link", "custom": ' + "[" * n + '{"b": [1.50, "\\u00e9"], "a": null}' + "]" * n + "}]" + "}]" * n
    tree = navigation.nodes(bars(spark, ("n", 0, "s", text), ("n", 1, "broken", text[:-1]), ("n", 2, "after", ["p"])))
    got = navigation.routes(tree).select("sidebar", "route", F.size("at").alias("depth")).orderBy("sidebar", "depth").collect()
    assert [tuple(r) for r in got] == [("after", "p", 1), *(("s", f"b{i}", i + 1) for i in range(n)), ("s", "end", n + 1)]
    [link] = tree.where("fields['type'] = '\"link\"'").collect()
    assert link["fields"]["custom"] == "[" * n + '{"a":null,"b":[1.50,"é"]}' + "]" * n


def test_deep_json_is_read_as_json_is():
    texts = ['[]', ' {} ', '[1, -2.50e3, true, false, null, "a\\n\\u00e9", [], {}]', '{"a": [{"b": {}}, []], "c": "d"}', '"x"', "7"]
    broken = ["", "[", "]", "[1,]", "[1 2]", '{"a"}', '{"a": 1,}', '{"a": 1, "a": 2}', "[1]]", "{1: 2}", "[NaN]", "[-Infinity]", '["a', '[tru]', '{"a": 1]', '["a\tb"]'.replace("\\t", "\t")]
    for text in texts:
        assert navigation._json(navigation._deep(text)) == navigation._json(json.loads(text, parse_int=navigation._Number, parse_float=navigation._Number))
    for text in broken:
        with pytest.raises(ValueError):
            navigation._deep(text)


def test_a_part_has_as_many_categories_as_its_size(spark, sf_dir):
    from pagetrace.plans import trees

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    assert part.agg(F.max("p_size")).first()[0] > 14
    got = trees.nested_routes(spark, sf_dir).groupBy("sidebar").agg((F.count("*") - 2).alias("n"))
    want = part.select(F.concat(F.lit("s"), "p_partkey").alias("sidebar"), F.col("p_size").cast("long").alias("n"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_sidebars_of_one_file_are_read_by_several_tasks(spark, sf_dir):
    from pagetrace.plans import trees

    assert trees.nested_routes(spark, sf_dir).rdd.getNumPartitions() > 1


def test_odd_items(spark):
    rows = [
        ("n", 0, "a", ["p", {"type": "doc", "id": "q"}, {"type": "doc", "id": 7}, {"type": "link", "id": "no"}, {"type": "doc", "id": "r", "items": ["s"]}, 3, None, ["t"], {"items": "one"}, {"items": {"type": "doc", "id": "two"}}, {"items": []}]),
        ("n", 1, "b", "no json"),
        ("n", 2, "c", []),
        ("n", 3, "d", "[\"x\ty\"]".replace("\t", "\\t")),
    ]
    # arrays within arrays are no nodes of a navigation
    assert [r for _, _, r in routes(spark, *rows)] == ["p", "q", "r", "s", "one", "two", "x\ty"]


def rewritten(spark, rows, added=()):
    sidebars = bars(spark, *rows)
    tree = navigation.nodes(sidebars)
    if added:
        tree = navigation.with_routes(tree, sidebars, spark.createDataFrame(list(added), "nav string, section string, route string, ord int"))
    return {(r["nav"], r["sidebar"]): json.loads(r["items"]) for r in navigation.written(tree, sidebars).collect()}


def test_round_trip(spark):
    rows = [("n", 0, "s", deep(9)), ("n", 1, "t", ["a", {"type": "link", "href": "x", "custom": {"b": [1, {"c": None}], "a": 1.5, "é\"": "\n"}}, {"type": "category", "label": "empty", "items": []}, 3, True]), ("m", 0, "s", [])]
    assert rewritten(spark, rows) == {(n, s): x for n, _, s, x in rows}


def test_routes_are_appended_to_their_sections(spark):
    rows = [
        ("n", 0, "s", ["intro", {"type": "category", "label": "Guides", "items": ["g1", {"type": "category", "label": "Deep", "items": ["g2"]}]}]),
        ("n", 1, "t", [{"type": "category", "label": "Guides", "items": ["other"]}, {"type": "category", "label": "API", "link": {"type": "generated-index"}}]),
        ("m", 0, "s", []),
    ]
    added = [("n", "Guides", "g3", 0), ("n", "Guides", "g2", 1), ("n", "API", "a1", 2), ("n", "New", "n2", 4), ("n", "New", "n1", 3), ("n", "Deep", "d", 5), ("n", "API", "g3", 6), ("n", "Void", None, 7), ("m", "Guides", "g1", 0), ("gone", "x", "y", 0)]
    want = {
        ("n", "s"): ["intro", {"type": "category", "label": "Guides", "items": ["g1", {"type": "category", "label": "Deep", "items": ["g2"]}, "g3"]}, {"type": "category", "label": "New", "items": ["n1", "n2"]}, {"type": "category", "label": "Deep", "items": ["d"]}, {"type": "category", "label": "Void", "items": []}],
        ("n", "t"): [{"type": "category", "label": "Guides", "items": ["other"]}, {"type": "category", "label": "API", "link": {"type": "generated-index"}, "items": ["a1"]}],
        ("m", "s"): [{"type": "category", "label": "Guides", "items": ["g1"]}],
    }
    got = rewritten(spark, rows, added)
    assert got == want
    again = [(n, 0 if s == "s" else 1, s, x) for (n, s), x in got.items()]
    assert rewritten(spark, again, added) == want


def told(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "page_path int, text string")
    rows = df.select("page_path", structure.container_fault(F.col("text")).alias("fault"), structure.repaired_containers(F.col("text")).alias("fixed")).orderBy("page_path").collect()
    return [(r["fault"], r["fixed"]) for r in rows], {tuple(r) for r in structure.container_signature(df, ["note", "tip"]).collect()}


def test_containers(spark):
    texts = [
        ":::note\nx\n:::\n",
        "  ::::TIP Title\n:::note[t]\nx\n:::\n::::  \nend",
        "a\n:::\nb\n:::note\nc  \n\n",
        "```\n:::note\n```\n:::\n",
        ":::custom\n:::note\n:::",
        "text ::: no\n:::{x}\n:: \n",
        "",
        "```js\n:::\n",
        ":::note\r\nx\r\n:::\r\n:::\r\ny",
    ]
    got, signature = told(spark, *texts)
    assert got == [
        (None, texts[0]),
        (None, texts[1]),
        ("stray :::", "a\nb\n:::note\nc\n\n:::\n"),
        ("stray :::", "```\n:::note\n```\n"),
        ("unclosed :::custom", ":::custom\n:::note\n:::\n\n:::\n"),
        (None, texts[5]),
        (None, ""),
        (None, texts[7]),
        ("stray :::", ":::note\r\nx\r\n:::\r\ny"),
    ]
    assert signature == {(0, "note", 1, 1), (1, "tip", 1, 1), (1, "note", 1, 1), (2, "_unmatched", 0, 1), (2, "note", 1, 0), (3, "_unmatched", 0, 1), (4, "note", 1, 1), (8, "note", 1, 1), (8, "_unmatched", 0, 1)}


def test_long_texts_are_repaired_in_one_pass(spark):
    import time

    n = 30_000
    text = ":::a\n" * n + ":::\n" * (n - 1) + "x"
    began = time.time()
    [(fault, fixed)], signature = told(spark, text)
    assert fault == "unclosed :::a" and fixed == text + "\n\n:::\n" and signature == set()
    assert time.time() - began < 60


def test_repair_leaves_nothing_to_repair(spark):
    got, _ = told(spark, ":::\n:::a\n```\n:::\n```\n:::b\n", ":::a\n:::b\nx", ":::\n:::\n")
    again, _ = told(spark, *(x for _, x in got))
    assert [f for f, _ in again] == [None] * 3 and [x for _, x in again] == [x for _, x in got]
