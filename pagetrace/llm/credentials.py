"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns are reported wherever they match.  Weak ones (a user or client
name, a bare token, an address) mean little alone: they are reported only where
the parts of a credential come together, that is, where an interval join of
access identifiers, secrets and endpoints finds a complementary part in the same
scope, the `reach` code points before and after.  As an interval join only has to
say whether a partner exists, it is a sweep over the parts of a text in order,
once from either end: the last end before and the first start after of each role.
No pair of parts is made and no row is moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
NAME = r"""(?i:client_?id|access_?key_?id|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}+={0,2}"
ENDPOINT = r"""(?:https?|ftp|ssh|redis|amqp|mysql|mongodb|postgres(?:ql)?)://[^\s"'<>]+"""
#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "name", "token", "endpoint")
#: Role -> kinds that have it.
ROLES = {"identifier": (1, 3), "secret": (0, 2, 4), "endpoint": (5,)}
_SPAN = "array<struct<start:int,end:int>>"
_PART = "start:int,kind:int,end:int"
_FAR = 1 << 30
_BLOCK = 512


def _running(items: Column, state: Column, state_type: str, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The elements that step(state, item) -> (state, element) gives from left to right.

    Folded in blocks, as each element is appended to an array: that keeps thousands of items affordable.
    """
    none = F.array().cast(f"array<{out_type}>")

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        return F.struct(after.cast(state_type).alias("state"), F.concat(acc["out"], F.array(out.cast(out_type))).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        at = F.when(F.size(acc) > 0, F.element_at(acc, -1)["state"]).otherwise(state.cast(state_type))
        return F.concat(acc, F.array(F.aggregate(F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)), F.struct(at.alias("state"), none.alias("out")), one)))

    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")))
    return F.aggregate(blocks, F.array().cast(f"array<struct<state:{state_type},out:array<{out_type}>>>"), block, lambda acc: F.flatten(F.transform(acc, lambda x: x["out"])))


def spans(text: Column, pattern: str, group: int = 0, ok: Callable[[Column], Column] = lambda x: F.lit(True)) -> Column:
    """Code-point (start, end) of the leftmost non-overlapping matches whose group is ok.

    Between matches lie the pieces that split() leaves, so positions are running
    sums of lengths.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    each = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), F.length).alias("gap"),
        F.transform(hits, F.length).alias("hit"),
        F.transform(sized, ok).alias("ok"),
    )

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        start = pos + x["gap"]
        return start + x["hit"], F.struct(start.alias("start"), (start + x["hit"]).alias("end"), x["ok"].alias("ok"))

    found = _running(each, F.lit(0), "int", "struct<start:int,end:int,ok:boolean>", step)
    found = F.transform(F.filter(found, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _swept(parts: Column, groups: dict[str, tuple[int, ...]]) -> Column:
    """Sorted parts with, for each group of kinds, the greatest end among the parts before (name_past) and the least start among those after (name_next)."""

    def sweep(items: Column, have: str, suffix: str, edge: str, none: int, pick: Callable[..., Column]) -> Column:
        def step(state: Column, x: Column) -> tuple[Column, Column]:
            after = F.struct(*(F.when(x["kind"].isin(*kinds), pick(state[g], x[edge])).otherwise(state[g]).alias(g) for g, kinds in groups.items()))
            own = [x[f.split(":")[0]].alias(f.split(":")[0]) for f in have.split(",")]
            return after, F.struct(*own, *(state[g].alias(g + suffix) for g in groups))

        kind = f"struct<{have},{','.join(g + suffix + ':int' for g in groups)}>"
        return _running(items, F.struct(*(F.lit(none).alias(g) for g in groups)), f"struct<{','.join(g + ':int' for g in groups)}>", kind, step)

    ahead = sweep(parts, _PART, "_past", "end", -_FAR, F.greatest)
    back = sweep(F.reverse(ahead), f"{_PART},{','.join(g + '_past:int' for g in groups)}", "_next", "start", _FAR, F.least)
    return F.reverse(back)


def _part(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))


def linked(parts: Column, reach: int) -> Column:
    """The weak ones of the parts (sorted, apart from strong ones) that lie within `reach` of a complementary part."""

    def near(s: Column, role: str) -> Column:
        return (s["start"] - s[role + "_past"] <= reach) | (s[role + "_next"] - s["end"] <= reach)

    def kept(s: Column) -> Column:
        own = {r: s["kind"].isin(*kinds) for r, kinds in ROLES.items()}
        identifier, secret, endpoint = (near(s, r) for r in ROLES)
        return (s["kind"] > 2) & ((own["identifier"] & secret) | (own["secret"] & (identifier | endpoint)) | (own["endpoint"] & secret & identifier))

    return F.transform(F.filter(_swept(parts, ROLES), kept), _part)


def _apart(parts: Column) -> Column:
    """The parts (sorted) without the weak ones that overlap a strong one."""
    swept = _swept(parts, {"strong": (0, 1, 2)})
    return F.transform(F.filter(swept, lambda s: (s["kind"] <= 2) | (s["strong_past"] <= s["start"]) & (s["strong_next"] >= s["end"])), _part)


def _listed(found: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _tagged(column: Column, kind: str) -> Column:
    return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def _scanned(docs: DataFrame, reach: int) -> DataFrame:
    """row (all columns of docs), text, base (strong spans) and found (all spans); spans are (start, kind, end) in order."""
    each = {
        "assign": (ASSIGN, 2, lambda x: F.length(x) >= 12), "access": (ACCESS,), "hex": (HEX,), "name": (NAME,),
        "token": (TOKEN, 0, lambda x: x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]")), "endpoint": (ENDPOINT,),
    }
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("row", "text", *(spans(F.col("text"), *each[k]).alias(k) for k in KINDS))
    rows = rows.select("row", "text", F.array_sort(F.concat(*(_tagged(F.col(k), k) for k in KINDS[:3]))).alias("base"), F.concat(*(_tagged(F.col(k), k) for k in KINDS[3:])).alias("weak"))
    # only where a weak part may have a partner
    multipart = (F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)
    none = F.array().cast(f"array<struct<{_PART}>>")
    rows = rows.select("row", "text", "base", F.when(multipart, _apart(F.array_sort(F.concat("base", "weak")))).otherwise(none).alias("parts"))
    return rows.select("row", "text", "base", F.when(F.size("parts") > 0, F.array_sort(F.concat("base", linked(F.col("parts"), reach)))).otherwise(F.col("base")).alias("found"))


def scan(docs: DataFrame, reach: int = 256) -> DataFrame:
    """doc_id, base (strong spans) and found (all spans) of every row; spans are (start, kind, end) in order.

    A null text counts as empty and has no spans.  Rows equal in doc_id and text
    have equal results; null doc_ids are rows like any other.
    """
    return _scanned(docs, reach).select("row.doc_id", "base", "found")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scan(docs).select("doc_id", *map(count, KINDS[:3]), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, reach: int = 256) -> DataFrame:
    """docs with every span replaced by its kind in brackets; all rows and columns stay, null texts stay null."""

    def step(pos: Column, s: Column) -> tuple[Column, Column]:
        before = F.substring(F.col("text"), pos + 1, s["start"] - pos)
        mark = F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit("]"))
        return F.greatest(pos, s["end"]), F.when(s["start"] >= pos, F.concat(before, mark)).otherwise(F.lit(""))  # spans may overlap

    pieces = F.array_join(_running(F.col("found"), F.lit(0), "int", "string", step), "")
    rest = F.substring(F.col("text"), F.array_max(F.transform("found", lambda s: s["end"])) + 1, F.length("text"))
    new = F.when(F.size("found") == 0, F.col("row")["text"]).otherwise(F.concat(pieces, rest))
    return _scanned(docs, reach).select(*(new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
