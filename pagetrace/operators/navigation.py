"""Nested navigation: sidebars as rows, and rows as sidebars, however deep they are.

A node is a row with `at`, its places from the top down, so rows of all levels
sort in reading order.  Reading is one pass over the sidebars, however deep they
are; writing is one aggregation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from json.scanner import NUMBER_RE

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrace.shared import kept

KEYS = ["nav", "sidebar_ord", "sidebar"]


#: Nodes, and places of them, that are handed over at once.
_BATCH, _PLACES = 50_000, 2_000_000
_NODE = "at array<int>, route string, label string, category boolean, fields map<string,string>, other string, has_items boolean"


class _Number(str):
    """A number as it is written."""


def _whole(s: str) -> str:
    """A string that can be written: what is no character becomes ?."""
    return s.encode("utf-8", "replace").decode() if not s.isascii() else s


def _object(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a name occurs twice")
    return found


def _json(v) -> str:
    """JSON without blanks, names in order, numbers as they were, however deep it is."""
    out, rest = [], [(v, False)]
    while rest:
        x, done = rest.pop()
        if done or isinstance(x, _Number):
            out.append(x)
        elif isinstance(x, dict):
            rest.append(("}", True))
            for i, k in reversed(list(enumerate(sorted(x)))):
                rest += [(x[k], False), (f"{',' if i else ''}{_json(k)}:", True)]
            rest.append(("{", True))
        elif isinstance(x, list):
            rest.append(("]", True))
            for i, y in reversed(list(enumerate(x))):
                rest += [(y, False), ("," if i else "", True)]
            rest.append(("[", True))
        else:
            out.append(_whole(json.dumps(x, ensure_ascii=False)))
    return "".join(out)


def _no_number(name: str) -> None:
    raise ValueError(name)


_BLANK = re.compile(r"[ \t\n\r]*")
_WORDS = {"true": True, "false": False, "null": None}


def _deep(text: str):
    """What json.loads gives, with a stack of its own: for texts that are nested deeper than that goes."""
    found: list = []
    stack, i = [found], _BLANK.match(text).end()
    while True:
        holder, name = stack[-1], None
        if isinstance(holder, dict):
            if text[i : i + 1] != '"':
                raise ValueError("no name")
            name, i = scanstring(text, i + 1, True)
            i = _BLANK.match(text, i).end()
            if name in holder or text[i : i + 1] != ":":
                raise ValueError("a name occurs twice or has no value")
            i = _BLANK.match(text, i + 1).end()
        c, inner = text[i : i + 1], None
        if c == "[" or c == "{":
            v = inner = [] if c == "[" else {}
            i = _BLANK.match(text, i + 1).end()
        elif c == '"':
            v, i = scanstring(text, i + 1, True)
        elif number := NUMBER_RE.match(text, i):
            v, i = _Number(number.group()), number.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, i)), None)
            if word is None:
                raise ValueError("no value")
            v, i = _WORDS[word], i + len(word)
        if name is None:
            holder.append(v)
        else:
            holder[name] = v
        if inner is not None:
            stack.append(inner)
            if text[i : i + 1] != ("]" if c == "[" else "}"):
                continue
        while True:  # what ends here
            i = _BLANK.match(text, i).end()
            c = text[i : i + 1]
            if stack[-1] is found:
                if c:
                    raise ValueError("more than a value")
                return found[0]
            if c == ",":
                i = _BLANK.match(text, i + 1).end()
                break
            if c != ("}" if isinstance(stack[-1], dict) else "]"):
                raise ValueError("no end")
            stack.pop()
            i += 1


def _read(text: str | None) -> list:
    """A sidebar's items; none if it isn't JSON."""
    try:
        found = json.loads(text or "", object_pairs_hook=_object, parse_int=_Number, parse_float=_Number, parse_constant=_no_number)
    except RecursionError:
        try:
            found = _deep(text)
        except ValueError:
            return []
    except ValueError:
        return []
    return found if isinstance(found, list) else [found]


def _nodes(text: str | None) -> Iterator[tuple]:
    """A sidebar's nodes in reading order, by a stack of what is still to be read."""
    string = lambda v: _whole(v) if isinstance(v, str) and not isinstance(v, _Number) else None
    stack = [((), enumerate(_read(text)))]
    while stack:
        above, rest = stack[-1]
        place, v = next(rest, (None, None))
        if place is None:
            stack.pop()
            continue
        at = (*above, place)
        if not isinstance(v, dict):
            route = string(v)
            yield at, route, None, False, None, _json(v) if route is None else None, False
            continue
        kind, holds = string(v.get("type")), "items" in v
        fields = [(_whole(k), _json(x)) for k, x in v.items() if k != "items"]
        yield at, string(v.get("id")) if kind == "doc" else None, string(v.get("label")), kind == "category", fields, None, holds
        if holds:
            inner = v["items"]
            stack.append((at, enumerate(inner if isinstance(inner, list) else [inner])))


def nodes(sidebars: DataFrame) -> DataFrame:
    """KEYS, at, route, label, category, fields, other, has_items of every node of sidebars (KEYS, items: JSON).

    A node is a page's id, or an object; route is the id of a page, be it plain or
    an object of type doc.  fields: an object's JSON values by name, but for its
    items; null for a plain id.  Items that are no array count as an array of one.
    Sidebars that aren't JSON, or have an object with one name twice, have no nodes.
    Each sidebar's text is read once, whatever its depth.
    """
    rows = sidebars.select(*KEYS, "items")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.list_(pa.int32()), pa.string(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.string(), pa.bool_()]

        def handed(batch: pa.RecordBatch, of: list[int], found: list[tuple]) -> pa.RecordBatch:
            keys = [batch.column(k).take(pa.array(of, pa.int64())) for k in KEYS]
            return pa.RecordBatch.from_arrays([*keys, *(pa.array(c, t) for c, t in zip(zip(*found), types))], [*KEYS, *(x.split()[0] for x in _NODE.split(", "))])

        for batch in batches:
            of, found, places = [], [], 0
            for i, text in enumerate(batch.column("items").to_pylist()):
                for node in _nodes(text):
                    of.append(i)
                    found.append(node)
                    places += len(node[0])
                    if len(found) >= _BATCH or places >= _PLACES:
                        yield handed(batch, of, found)
                        of, found, places = [], [], 0
            if found:
                yield handed(batch, of, found)

    return rows.mapInArrow(read, f"{', '.join(f'{k} {t}' for k, t in rows.dtypes if k in KEYS)}, {_NODE}")


def routes(tree: DataFrame) -> DataFrame:
    """KEYS, route, at of the pages of nodes."""
    return tree.where("route is not null").select(*KEYS, "route", "at")


def _quoted(s: Column) -> Column:
    """A string as JSON."""
    inside = F.to_json(F.array(s))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def written(tree: DataFrame, sidebars: DataFrame) -> DataFrame:
    """KEYS, items: nodes as JSON again, for each of sidebars (KEYS); an object's names are in alphabetical order, its items last.

    A sidebar is a value of one row, and so are its nodes in reading order: what
    lies between two of them follows from how deep they are.
    """
    own = F.array_join(F.transform(F.array_sort(F.map_keys("fields")), lambda k: F.concat(_quoted(k), F.lit(":"), F.element_at("fields", k))), ",")
    begin = F.concat(F.lit("{"), F.concat_ws(",", F.when(own != "", own), F.when(F.col("has_items"), F.lit('"items":['))))
    text = F.when(F.col("fields").isNotNull(), F.concat(begin, F.when(F.col("has_items"), F.lit("")).otherwise(F.lit("}")))).otherwise(F.coalesce("other", _quoted(F.col("route"))))
    listed = tree.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("at", "has_items", text.alias("text")))).alias("_nodes"))

    def closed(x: Column, depth: Column | int) -> Column:
        """What ends a node and all above it down to that depth."""
        return F.repeat(F.lit("]}"), F.size(x["at"]) - depth + x["has_items"].cast("int"))

    def piece(x: Column, i: Column) -> Column:
        before = F.get("_nodes", i - 1)
        inside = F.size(x["at"]) > F.size(before["at"])
        return F.concat(F.when((i == 0) | inside, F.lit("")).otherwise(F.concat(closed(before, F.size(x["at"])), F.lit(","))), x["text"])

    items = F.concat(F.lit("["), F.array_join(F.transform("_nodes", piece), ""), closed(F.element_at("_nodes", -1), 1), F.lit("]"))
    return sidebars.select(*KEYS).join(listed.select(*KEYS, items.alias("_list")), KEYS, "left").select(*KEYS, F.coalesce("_list", F.lit("[]")).alias("items"))


def with_routes(tree: DataFrame, sidebars: DataFrame, added: DataFrame) -> DataFrame:
    """Nodes with pages appended to their sections: added (nav, section, route, ord).

    A section is the first category of that label at the top of any sidebar of the
    navigation; one that is missing is made at the end of its first sidebar, in the
    order of `added`.  Routes that any sidebar has already, at any depth, are left
    out, and so are repeated ones and null ones; adding twice changes nothing.
    """
    tree = kept(tree, "nav")  # used several times
    tops = tree.where(F.size("at") == 1)
    place = F.struct("sidebar_ord", "sidebar", "at")
    known = tops.where("category and label is not null").groupBy("nav", F.col("label").alias("section")).agg(F.min(place).alias("_known"))
    first = sidebars.groupBy("nav").agg(F.min(F.struct("sidebar_ord", "sidebar")).alias("_first"))
    ends = first.select("nav", "_first.sidebar_ord", "_first.sidebar").join(tops, KEYS, "left").groupBy(*KEYS).agg((F.coalesce(F.max(F.element_at("at", 1)), F.lit(-1)) + 1).alias("_end"))
    sections = added.groupBy("nav", "section").agg(F.min("ord").alias("_ord")).join(known, ["nav", "section"], "left").join(first.select("nav"), "nav", "left_semi")
    missing = sections.where("_known is null").withColumn("_n", F.row_number().over(Window.partitionBy("nav").orderBy("_ord", "section")) - 1)
    made = missing.join(ends, "nav").select("nav", "sidebar_ord", "sidebar", "section", F.array((F.col("_end") + F.col("_n")).cast("int")).alias("at"))
    new = made.select(
        *KEYS,
        "at",
        F.lit(None).cast("string").alias("route"),
        F.col("section").alias("label"),
        F.lit(True).alias("category"),
        F.create_map(F.lit("type"), F.lit('"category"'), F.lit("label"), _quoted(F.col("section"))).alias("fields"),
        F.lit(None).cast("string").alias("other"),
        F.lit(True).alias("has_items"),
    )
    target = kept(sections.where("_known is not null").select("nav", "_known.sidebar_ord", "_known.sidebar", "section", "_known.at").unionByName(made.select("nav", "sidebar_ord", "sidebar", "section", "at")), "nav")
    free = added.where("route is not null").join(tree.where("route is not null").select("nav", "route").distinct(), ["nav", "route"], "left_anti")
    once = free.groupBy("nav", "route").agg(F.min(F.struct("ord", "section")).alias("_o")).select("nav", "route", "_o.ord", "_o.section")
    child = tree.where(F.size("at") == 2).groupBy(*KEYS, F.slice("at", 1, 1).alias("at")).agg((F.max(F.element_at("at", 2)) + 1).alias("_end"))
    put = once.join(target, ["nav", "section"]).join(child, [*KEYS, "at"], "left")
    nth = F.row_number().over(Window.partitionBy(*KEYS, "at").orderBy("ord", "route")) - 1
    pages = put.withColumn("_n", nth).select(
        *KEYS,
        F.concat("at", F.array((F.coalesce("_end", F.lit(0)) + F.col("_n")).cast("int"))).alias("at"),
        "route",
        F.lit(None).cast("string").alias("label"),
        F.lit(False).alias("category"),
        F.lit(None).cast("map<string,string>").alias("fields"),
        F.lit(None).cast("string").alias("other"),
        F.lit(False).alias("has_items"),
    )
    grown = pages.select(*KEYS, F.slice("at", 1, 1).alias("at")).distinct().withColumn("_grown", F.lit(True))
    old = tree.join(grown, [*KEYS, "at"], "left").withColumn("has_items", F.col("has_items") | F.coalesce("_grown", F.lit(False))).drop("_grown")
    return old.unionByName(new).unionByName(pages)
