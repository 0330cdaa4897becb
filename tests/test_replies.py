import json

import pytest
from pyspark.sql import functions as F

from pagetrace.operators import history, replies, structure

REPLIES = {
    '{"a": 1} tail } {': '{"a": 1}',
    'say {"a": "} \\" {", "b": {"c": "\\\\"}} {"d": 2}': '{"a": "} \\" {", "b": {"c": "\\\\"}}',
    "```json\n{\"x\": 1}\n``` {\"y\": 2}": '{"x": 1}',
    "``` {\"x\": [1, {}]} ```": '{"x": [1, {}]}',
    "{ no end": None,
    "none": None,
    "": None,
    '{"open": "}': None,
    '\\{"a": 1}': '{"a": 1}',
    '{"a": \\"}"}': '{"a": \\"}"}',
    "}{}": "{}",
}


def by_hand(text):
    start = text.find("{")
    depth, string, i = 0, False, start
    while 0 <= i < len(text):
        c = text[i]
        if string and c == "\\":
            i += 1
        elif c == '"':
            string = not string
        elif not string and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
        i += 1
    return None


def test_first_object(spark):
    extra = ['{' + "".join(x) for x in ('"\\\\"}', "\\\\}", '"a\\"}"}x', '\\"}"}', "{{}}}", '""}')]
    texts = [*REPLIES, *extra]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", replies.first_object(F.col("t")).alias("o")).orderBy("i").collect()
    want = [*REPLIES.values(), *map(by_hand, extra)]
    assert [r["o"] for r in got] == want


@pytest.mark.parametrize("text,want", [("<think>{</think> a ", "a"), (" <THINKING>x", ""), ("<think>a</think>b<thinking>c</thinking>d", "bd"), ("a <think>b", "a <think>b")])
def test_reasoning_goes(spark, text, want):
    assert spark.range(1).select(replies.without_reasoning(F.lit(text))).first()[0] == want


def test_items_are_found_wherever_they_are(spark):
    item = {"path": "a", "title": "A"}
    rows = [
        ("nested", json.dumps({"x": {"y": [{"z": [[item, {"path": "b", "title": "B", "tags": ["t"], "extra": {"path": "c", "title": "C", "tags": []}}]]}]}, "n": 2})),
        ("twice", json.dumps([item, item, {**item, "tags": None}, {**item, "tags": ["x"]}])),
        ("wrong", json.dumps([{"path": 1, "title": "A"}, {"path": "a"}, {**item, "tags": "no list"}, {**item, "tags": [1]}, "path", None])),
        ("broken", "{"),
        ("null", None),
    ]
    got = replies.salvaged(spark.createDataFrame(rows, "k string, reply string"), "k", {"path": "string", "title": "string"}, {"tags": "strings"})
    assert sorted(((r["k"], r["ord"], r["path"], r["tags"]) for r in got.collect()), key=repr) == sorted([("nested", 0, "a", None), ("nested", 1, "b", ["t"]), ("nested", 2, "c", []), ("twice", 0, "a", None), ("twice", 1, "a", ["x"])], key=repr)


HEAD = """---
title: "A: b"  # remark
draft: true
empty:
seo:
  og:
    image: /x.png # remark
    size: 'big # no remark'
  tags:
  - one
  - "two"
authors:
  - name: Ann
    links: [a, "b"]
  - name: Bo
text: |
  first
    second
after: >-
  joined
  lines
# remark
last: a:b
---
body
"""


def test_nested_front_matter(spark):
    want = {
        "title": "A: b", "draft": "true", "empty": None, "seo/og/image": "/x.png", "seo/og/size": "big # no remark", "seo/tags/0": "one", "seo/tags/1": "two",
        "authors/0/name": "Ann", "authors/0/links/0": "a", "authors/0/links/1": "b", "authors/1/name": "Bo", "text": "first\nsecond", "after": "joined lines", "last": "a:b",
    }
    texts = [("lf", HEAD), ("crlf", HEAD.replace("\n", "\r\n")), ("none", "title: x"), ("open", "---\ntitle: x\n"), ("broken", "---\ntitle: x\nno key\n---\n"), ("quote", "---\na: 'x\n---\n"), ("empty", "---\n---\n"), ("null", None)]
    got = {}
    for r in structure.front_matter_values(spark.createDataFrame(texts, "page_path string, text string")).collect():
        got.setdefault(r["page_path"], {})["/".join(r["path"])] = r["value"]
    assert got == {"lf": want, "crlf": want}


def test_months_are_in_utc(spark):
    costs = spark.sql("SELECT timestamp'2024-02-01 00:30:00+00:00' AS ts, 1.0D AS cost UNION ALL SELECT timestamp'2024-01-31 23:30:00+00:00', 5.0D")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            r = history.month_budget(costs, "2024-02-15 12:00:00", 2.0).first()
            assert (r["spent"], round(r["projected"], 6)) == (1.0, 2.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
