"""Replies of language models as tables: the JSON object in a text, and the items in a reply of another shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrace.shared import kept

#: What a field of an item may be: its name in a variant's schema, and its type as a column.
TYPES = {"string": ("STRING", "string"), "long": ("BIGINT", "long"), "boolean": ("BOOLEAN", "boolean"), "strings": ("ARRAY<STRING>", "array<string>")}


def without_reasoning(text: Column) -> Column:
    """A reply without its <think> or <thinking> blocks; nothing is left of one that only begins such a block."""
    bare = F.regexp_replace(text, r"(?is)<(think|thinking)>.*?</\1>", "")
    return F.when(bare.rlike(r"(?is)\A\s*<(think|thinking)>"), F.lit("")).otherwise(F.regexp_replace(bare, r"\A\s+|\s+\z", ""))


def first_object(text: Column) -> Column:
    """The first whole JSON object of a text, or of its first code fence if there is one; null if none begins or it has no end.

    Braces within strings don't count, nor do quotes after a backslash there.  A
    fold over the braces, quotes and escapes from the first brace on, with the
    depth, whether a string is open, and the length so far as its state.
    """
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(text.rlike(r"(?s)```(?:json)?\s*.*?```"), fenced).otherwise(text)
    rest = F.regexp_extract(body, r"(?s)\{.*", 0)
    tokens = F.regexp_extract_all(rest, F.lit(r'(?s)[^{}"\\]+|\\.|[{}"\\]'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("string"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def step(acc: Column, token: Column) -> Column:
        escape = token.startswith("\\")
        # outside of a string a backslash is a character like others
        mark = F.when(escape & acc["string"], F.lit("")).when(escape, F.substring(token, 2, 1)).otherwise(token)
        depth = acc["depth"] + F.when(acc["string"], 0).when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
        string = F.when(mark == '"', ~acc["string"]).otherwise(acc["string"])
        done = acc["done"] | (~acc["string"] & (mark == "}") & (depth == 0))
        go = ~acc["done"]
        return F.struct(
            F.when(go, depth).otherwise(acc["depth"]).alias("depth"),
            F.when(go, string).otherwise(acc["string"]).alias("string"),
            (acc["length"] + F.when(go, F.length(token)).otherwise(0)).alias("length"),
            done.alias("done"),
        )

    end = F.aggregate(tokens, start, step)
    return F.when(end["done"], F.substring(rest, F.lit(1), end["length"]))


def objects(replies: DataFrame, key: str, step: int = 2) -> DataFrame:
    """key, at, value of every object in replies (key, reply: JSON), the outer ones before those in them; nothing of a reply that isn't JSON.

    at: places from the top down, those of an object's members in the order of
    their names.  Jobs go `step` levels down each, until there are none.
    """
    v = F.col("_v")
    level = replies.select(key, F.array().cast("array<int>").alias("at"), F.try_parse_json("reply").alias("_v")).where(v.isNotNull())
    found: list[DataFrame] = []
    while True:
        levels = [level]
        for _ in range(step):
            kind = F.schema_of_variant(v)
            inner = F.when(kind.startswith("OBJECT"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))).when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
            inside = levels[-1].select(key, "at", F.posexplode(inner).alias("_place", "_inner"))
            below = F.schema_of_variant(F.col("_inner"))
            levels.append(inside.where(below.startswith("OBJECT") | below.startswith("ARRAY")).select(key, F.concat("at", F.array("_place")).alias("at"), F.col("_inner").alias("_v")))
        told = kept(reduce(DataFrame.unionByName, [x.select(key, "at", F.to_json("_v").alias("value"), F.lit(i).alias("_level")) for i, x in enumerate(levels)]), "objects")
        found.append(told.where((F.col("_level") < step) & F.col("value").startswith("{")).drop("_level"))
        last = told.where(F.col("_level") == step)
        if last.isEmpty():
            break
        level = last.select(key, "at", F.parse_json("value").alias("_v"))
    return reduce(DataFrame.unionByName, found)


def salvaged(replies: DataFrame, key: str, required: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """key, ord, and the fields of each distinct item anywhere in replies (key, reply: JSON text).

    An item is an object that has all required fields in their type (of TYPES), and
    optional ones, if it has them and they aren't null, in theirs; other members
    don't matter.  Items that agree in all fields are one, the first by `at` (see
    objects); ord counts a reply's items from 0.
    """
    optional = optional or {}
    got = objects(replies, key).withColumn("_v", F.parse_json("value"))

    def field(name: str) -> Column:
        return F.try_variant_get("_v", f'$["{name}"]', "variant")

    def fits(name: str, kind: str) -> Column:
        told = F.schema_of_variant(field(name))
        return told.isin(TYPES[kind][0], "ARRAY<VOID>") if kind == "strings" else told == TYPES[kind][0]

    whole = reduce(Column.__and__, [F.coalesce(fits(n, k), F.lit(False)) for n, k in required.items()], F.lit(True))
    whole = reduce(Column.__and__, [F.coalesce(fits(n, k) | (F.schema_of_variant(field(n)) == "VOID"), F.lit(True)) for n, k in optional.items()], whole)
    fields = {**required, **optional}
    items = got.where(whole).select(key, "at", *(F.try_variant_get("_v", f'$["{n}"]', TYPES[k][1]).alias(n) for n, k in fields.items()))
    first = items.groupBy(key, *fields).agg(F.min("at").alias("at"))
    order = Window.partitionBy(key).orderBy("at")  # of one reply
    return first.withColumn("ord", F.row_number().over(order) - 1).select(key, "ord", *fields)
