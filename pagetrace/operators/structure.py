"""Structure of page text: tag counts, nesting, links, front matter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SUFFIXES = (".md", ".mdx", ".markdown")


def _tag(tags: list[str]) -> str:
    return rf"</?(?:{'|'.join(tags)})(?:\s[^>]*)?/?>"


def _name(hit: Column) -> Column:
    return F.regexp_extract(hit, r"</?([A-Za-z0-9]+)", 1)


def signature(pages: DataFrame, tags: list[str]) -> DataFrame:
    """page_path, tag, opened, closed, for each known tag that the text has.

    <x/> counts as opened and as closed.  Code fences count as the tag ```, those
    of mermaid also as the tag mermaid.  Every tag of a text is extracted once.
    """
    hits = pages.select("page_path", F.regexp_extract_all("text", F.lit(_tag(tags)), F.lit(0)).alias("hits"), F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*```[ \t]*(\w*)"), F.lit(1)).alias("fences"))
    each = F.transform("hits", lambda h: F.struct(_name(h).alias("tag"), (~h.startswith("</")).alias("opens"), (h.startswith("</") | h.endswith("/>")).alias("closes")))
    told = hits.select("page_path", each.alias("found"), "fences")
    many = lambda a, f: F.size(F.filter(a, f)).cast("long")
    def row(t: str) -> Column:
        return F.struct(F.lit(t).alias("tag"), many("found", lambda x: (x["tag"] == t) & x["opens"]).alias("opened"), many("found", lambda x: (x["tag"] == t) & x["closes"]).alias("closed"))

    rows = [row(t) for t in tags]
    none = F.lit(0).cast("long").alias("closed")
    rows += [F.struct(F.lit("```").alias("tag"), F.size("fences").cast("long").alias("opened"), none), F.struct(F.lit("mermaid").alias("tag"), many("fences", lambda f: f == "mermaid").alias("opened"), none)]
    return told.select("page_path", F.explode(F.array(*rows)).alias("x")).select("page_path", "x.*").where("opened + closed > 0")


def changed_structure(before: DataFrame, after: DataFrame, leaves: list[str]) -> DataFrame:
    """page_path, tag and both counts where a page's structure was not left as it was.

    Leaf tags may grow, by as many openings as closings; all else stays.
    before, after: what signature() gives.
    """
    a = before.select("page_path", "tag", F.col("opened").alias("opened_before"), F.col("closed").alias("closed_before"))
    b = after.select("page_path", "tag", F.col("opened").alias("opened_after"), F.col("closed").alias("closed_after"))
    both = a.join(b, ["page_path", "tag"], "full_outer").na.fill(0, ["opened_before", "closed_before", "opened_after", "closed_after"])
    more = F.col("opened_after") - F.col("opened_before")
    grown = F.col("tag").isin(*leaves) & (more >= 0) & (more == F.col("closed_after") - F.col("closed_before"))
    same = (more == 0) & (F.col("closed_after") == F.col("closed_before"))
    return both.where(~(same | grown))


def nesting_fault(text: Column, tags: list[str]) -> Column:
    """Null if the known tags nest well, else what is wrong first: `stray x`, `crossed x` or `unclosed x`.

    A fold over the text's tags with the stack as its state; code is left out first.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?(```|\z)", ""), r"`[^`\n]*`", "")
    found = F.filter(F.regexp_extract_all(bare, F.lit(_tag(tags)), F.lit(0)), lambda t: ~t.endswith("/>"))

    def step(acc: Column, t: Column) -> Column:
        top, n = F.get(acc["stack"], F.size(acc["stack"]) - 1), _name(t)
        opening = ~t.startswith("</")
        fault = F.when(opening | (top == n), F.lit(None).cast("string")).when(top.isNull(), F.concat(F.lit("stray "), n)).otherwise(F.concat(F.lit("crossed "), n))
        stack = F.when(opening, F.concat(acc["stack"], F.array(n))).when(top == n, F.slice(acc["stack"], 1, F.size(acc["stack"]) - 1)).otherwise(acc["stack"])
        return F.struct(stack.alias("stack"), F.coalesce(acc["fault"], fault).alias("fault"))

    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(None).cast("string").alias("fault"))
    return F.aggregate(found, start, step, lambda a: F.coalesce(a["fault"], F.when(F.size(a["stack"]) > 0, F.concat(F.lit("unclosed "), F.element_at(a["stack"], -1)))))


def repaired(pages: DataFrame, tags: list[str]) -> DataFrame:
    """Pages with stray closing tags taken out and unclosed ones closed at the end; crossed ones stay as they are.

    A fold over the text's tags, with the stack and what is kept of each tag as its state.
    """
    hits, between = F.regexp_extract_all("text", F.lit(_tag(tags)), F.lit(0)), F.split("text", _tag(tags), -1)

    def step(acc: Column, t: Column) -> Column:
        size, n = F.size(acc["stack"]), _name(t)
        opens, alone = ~t.startswith("</"), t.endswith("/>")
        closes = F.get(acc["stack"], size - 1) == n
        stray = ~opens & ~F.coalesce(closes, F.lit(False))
        stack = F.when(alone, acc["stack"]).when(opens, F.concat(acc["stack"], F.array(n))).when(~stray, F.slice(acc["stack"], 1, size - 1)).otherwise(acc["stack"])
        kept = F.when(stray & ~alone, F.lit("")).otherwise(t)
        return F.struct(stack.alias("stack"), F.concat(acc["kept"], F.array(kept)).alias("kept"), (acc["crossed"] | (stray & ~alone & F.array_contains(acc["stack"], n))).alias("crossed"))

    none = F.array().cast("array<string>")
    told = pages.withColumn("_state", F.aggregate(hits, F.struct(none.alias("stack"), none.alias("kept"), F.lit(False).alias("crossed")), step)).withColumn("_between", between)
    mended = F.array_join(F.zip_with("_between", "_state.kept", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    ends = F.array_join(F.transform(F.reverse(F.col("_state.stack")), lambda t: F.concat(F.lit("</"), t, F.lit(">"))), "")
    return told.withColumn("text", F.when(F.col("_state.crossed"), F.col("text")).otherwise(F.concat(mended, ends))).drop("_state", "_between")


#: Beginnings of the lines that container blocks are made of; a bare closing line is matched whole.
_CONTAINER = r"(?m)^[ \t]*(?:```|:{3,}[ \t]*(?:[A-Za-z]+|\r?\n|\z))"


def _nested(marks: list[str]) -> tuple[list[tuple[str | None, bool]], list[str], list[bool]]:
    """found, stack, stray of a text's container lines; see _containers."""
    fence, stack, found, stray = False, [], [], []
    for line in marks:
        mark = line.strip(" \t\r\n")
        lost = False
        if mark.startswith("`"):
            fence = not fence
        elif not fence:
            kind = mark.lstrip(":").strip(" \t").lower()
            if kind:
                stack.append(kind)
                found.append((kind, True))
            else:
                lost = not stack
                found.append((None if lost else stack.pop(), False))
        stray.append(lost)
    return found, stack, stray


def _containers(text: Column) -> Column:
    """What a text's container lines outside of code fences come to, in one pass over them.

    found (kind, opens of each opening and
    closing line; the kind of a closing line is the one that it closes, null if it is
    stray); stack (kinds open at the end); stray (whether a matched line is one).
    """
    found = pa.struct([("kind", pa.string()), ("opens", pa.bool_())])
    kind = pa.struct([("found", pa.list_(found)), ("stack", pa.list_(pa.string())), ("stray", pa.list_(pa.bool_()))])

    @F.arrow_udf("found array<struct<kind:string,opens:boolean>>, stack array<string>, stray array<boolean>")
    def nested(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for each in lists:
            told = [None if marks is None else _nested(marks) for marks in each.to_pylist()]
            yield pa.array([None if t is None else {"found": [{"kind": k, "opens": o} for k, o in t[0]], "stack": t[1], "stray": t[2]} for t in told], kind)

    return nested(_lines(text))


def _lines(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_CONTAINER), F.lit(0))


def container_signature(pages: DataFrame, kinds: list[str]) -> DataFrame:
    """page_path, kind, opened, closed of the container blocks (:::kind ... :::) of each page.

    Other kinds than `kinds` take part in the nesting but are not told; closing
    lines without an opening one are of kind _unmatched.
    """
    each = pages.select("page_path", F.explode(_containers(F.col("text"))["found"]).alias("f"))
    named = each.select("page_path", F.coalesce("f.kind", F.lit("_unmatched")).alias("kind"), "f.opens").where(F.col("kind").isin("_unmatched", *kinds))
    return named.groupBy("page_path", "kind").agg(F.count_if("opens").alias("opened"), F.count_if(~F.col("opens")).alias("closed"))


def container_fault(text: Column) -> Column:
    """Null if container blocks are closed as often as opened, else what is wrong first: `stray :::` or `unclosed :::kind` (the innermost)."""
    state = _containers(text)
    stray = F.exists(state["found"], lambda f: f["kind"].isNull())
    return F.when(stray, F.lit("stray :::")).when(F.size(state["stack"]) > 0, F.concat(F.lit("unclosed :::"), F.element_at(state["stack"], -1)))


def repaired_containers(text: Column) -> Column:
    """The text without stray closing lines, and with a closing line at its end for each block that is open there."""
    state = _containers(text)
    kept = F.zip_with(_lines(text), state["stray"], lambda line, stray: F.when(stray, F.lit("")).otherwise(line))
    # the last part has no line after it
    whole = F.array_join(F.zip_with(F.split(text, _CONTAINER, -1), kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    depth = F.size(state["stack"])
    return F.when(depth == 0, whole).otherwise(F.concat(F.regexp_replace(whole, r"\s+\z", ""), F.lit("\n"), F.repeat(F.lit("\n:::"), depth), F.lit("\n")))


def links(pages: DataFrame) -> DataFrame:
    """page_path, target of every link ([text](target) or href), cut at its #; outside addresses are left out."""
    found = F.concat(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r'href="([^"]*)"'), F.lit(1)))
    target = F.regexp_replace(F.col("link"), r"#.*\z", "")
    return pages.select("page_path", F.explode(found).alias("link")).select("page_path", target.alias("target")).where("target <> '' and not target rlike '^[a-z][a-z0-9+.-]*:'")


def broken(page_links: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct links whose target is not among existing (path)."""
    return page_links.distinct().join(existing.select(F.col("path").alias("target")).distinct(), "target", "left_anti")


def checkable(target: Column) -> Column:
    """Whether a link's target is clearly a file relative to its page: no anchor, no absolute route, no scheme, and a page's suffix or a leading ./ or ../."""
    relative = ~target.rlike(r"\A(#|/|[A-Za-z][A-Za-z0-9+.-]*:)") & (target != "")
    named = F.lower(target)
    return relative & (target.startswith("./") | target.startswith("../") | named.endswith(PAGE_SUFFIXES[0]) | named.endswith(PAGE_SUFFIXES[1]) | named.endswith(PAGE_SUFFIXES[2]))


def resolved(page_path: Column, target: Column) -> Column:
    """The path that a relative target means, seen from a page; null if it leaves the tree."""
    parts = F.split(page_path, "/")
    whole = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.split(target, "/"))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(False).alias("left"))

    def step(acc: Column, part: Column) -> Column:
        up, size = part == "..", F.size(acc["path"])
        path = F.when(part.isin("", "."), acc["path"]).when(up & (size > 0), F.slice(acc["path"], F.lit(1), size - 1)).when(up, acc["path"]).otherwise(F.concat(acc["path"], F.array(part)))
        return F.struct(path.alias("path"), (acc["left"] | (up & (size == 0))).alias("left"))

    return F.aggregate(whole, start, step, lambda acc: F.when(~acc["left"], F.array_join(acc["path"], "/")))


def broken_files(page_links: DataFrame, files: DataFrame) -> DataFrame:
    """page_path, target of the distinct checkable links that lead to none of files (path).

    A target without a page's suffix may also mean that page or the index of that folder.
    """
    each = page_links.where(checkable(F.col("target"))).select("page_path", "target").distinct()
    at = each.withColumn("_at", resolved(F.col("page_path"), F.col("target")))
    more = F.array("_at", *(F.concat("_at", F.lit(s)) for s in PAGE_SUFFIXES), *(F.concat(F.col("_at"), F.lit("/index" + s)) for s in PAGE_SUFFIXES))
    full = F.lower("target").rlike(r"\.(md|mdx|markdown)\z")
    meant = at.select("page_path", "target", F.explode(F.when(full, F.array("_at")).otherwise(more)).alias("path"))
    there = meant.join(files.select("path").distinct(), "path", "left_semi").select("page_path", "target").distinct()
    return each.join(there, ["page_path", "target"], "left_anti")


#: An address or a path, as far as it tells where something is and not what is wrong with it.
_ADDRESS = r"(?i)https?://[^\s:<>()\[\]\"']*(?::\d+(?=/)[^\s:<>()\[\]\"']*)?|[^\s:<>()\[\]\"']*/[^\s:<>()\[\]\"']*|[^\s:<>()\[\]\"']*\.mdx?\b"


def link_finding(line: Column) -> Column:
    """Whether a line of a link checker's output tells of a broken link: a problem, what it is about, and no word of success.

    Words and numbers that are part of an address tell neither a problem nor a success.
    """
    # fixed values: the words that tell a problem, a target and a success
    problem, about, fine = r"(?i)broken|not found|404|missing|unreachable", r"(?i)https?://|/|\.mdx?\b", r"(?i)no broken|0 broken|success|all links|no issues|no problems|✓|✔"
    said = F.regexp_replace(line, _ADDRESS, " ")
    return F.coalesce(said.rlike(problem) & line.rlike(about) & ~said.rlike(fine), F.lit(False))


def front_matter(text: Column, key: str) -> Column:
    """Value of a flat key of the block between the --- lines that a text begins with; null if there is none."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(\n|\z)", 1)
    value = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*([^\n]*)$", 1)
    return F.when(head.rlike(rf"(?m)^{key}:"), F.regexp_replace(F.trim(value), "\\A[\"']|[\"']\\z", ""))


def _scalar(value: str) -> str | None:
    """A value as it is meant: without quotes, or without the remark after it; null stays null."""
    if value[:1] in ("'", '"'):
        end = value.find(value[0], 1)
        if end < 0:
            raise ValueError(value)
        return value[1:end]
    value = re.sub(r"(\A|\s)#.*", "", value).strip()
    return None if value in ("", "~", "null") else value


def _entries(head: str) -> list[tuple[list[str], str | None]]:
    """(path, value) of a head's values, by a stack of indentations; list items are numbered from 0.  ValueError if a line is none of what a head may have."""
    out: list[tuple[list[str], str | None]] = []
    stack: list[tuple[int, list[str]]] = []  # indentation, path
    counts: dict[tuple, int] = {}
    parents: set[tuple] = set()
    block: tuple[int, list[str], str, list[str]] | None = None  # indentation, path, joint, lines

    def close() -> None:
        nonlocal block
        if block:
            out.append((block[1], block[2].join(x.strip() for x in block[3]).strip()))
            block = None

    for line in re.split(r"\r?\n", head):
        content, indent = line.strip(), len(line) - len(line.lstrip(" "))
        if block and (not content or indent > block[0]):
            block[3].append(line)
            continue
        close()
        if not content or content.startswith("#"):
            continue
        item = content == "-" or content.startswith("- ")
        # a list may begin at the indentation of its key
        while stack and (stack[-1][0] > indent or (stack[-1][0] == indent and not item)):
            stack.pop()
        above = stack[-1][1] if stack else []
        if item:
            n = counts.get(tuple(above), 0)
            counts[tuple(above)] = n + 1
            parents.add(tuple(above))
            above = [*above, str(n)]
            stack.append((indent + 1, above))
            indent, content = indent + 2, content[1:].strip()
            if not content:
                continue
        found = re.match(r"([^\s:'\"\[{][^:]*?|'[^']*'|\"[^\"]*\")\s*:(?:\s+(.*))?\Z", content)
        if not found:
            if not item:
                raise ValueError(content)
            out.append((above, _scalar(content)))
            continue
        path, value = [*above, found[1].strip("'\"")], (found[2] or "").strip()
        parents.add(tuple(above))
        if re.fullmatch(r"[|>][+-]?", value):
            block = (indent, path, "\n" if value[0] == "|" else " ", [])
        elif value.startswith("[") and value.endswith("]"):
            out += [([*path, str(i)], _scalar(v.strip())) for i, v in enumerate(x for x in value[1:-1].split(",") if x.strip())]
        elif value and not value.startswith("#"):
            out.append((path, _scalar(value)))
        else:
            out.append((path, None))
            stack.append((indent, path))
    close()
    # a key whose value follows below it has none of its own
    return [(p, v) for p, v in out if v is not None or tuple(p) not in parents]


def front_matter_values(pages: DataFrame) -> DataFrame:
    """page_path, path, value of every value in the block between the --- lines that a text begins with.

    path: names of nested maps, and numbers of list items from 0.  Quotes go, a
    remark after a value too; a name without a value has a null; | and > begin
    texts of several lines.  A text without such a block, or whose block has a line
    that is none of these, has no rows.  Line ends may be those of any system.
    """
    head = F.regexp_extract("text", r"(?s)\A---[ \t]*\r?\n(.*?\r?\n)?---[ \t]*(\r?\n|\z)", 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, values = [], [], []
            for i, h in enumerate(batch.column("_head").to_pylist()):
                try:
                    found = _entries(h or "")
                except ValueError:
                    continue
                at += [i] * len(found)
                paths += [p for p, _ in found]
                values += [v for _, v in found]
            yield pa.RecordBatch.from_arrays([batch.column("page_path").take(pa.array(at, pa.int64())), pa.array(paths, pa.list_(pa.string())), pa.array(values, pa.string())], ["page_path", "path", "value"])

    return pages.select("page_path", head.alias("_head")).where("_head <> ''").mapInArrow(rows, f"page_path {dict(pages.dtypes)['page_path']}, path array<string>, value string")


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---(\n|\z)", "")


def frozen_changes(pages: DataFrame, keys: list[str]) -> DataFrame:
    """page_path, key where a frozen front-matter key differs (null-safe) between `before` and `after`."""
    each = F.array(*(F.when(~front_matter(F.col("before"), k).eqNullSafe(front_matter(F.col("after"), k)), F.lit(k)) for k in keys))
    return pages.select("page_path", F.explode(F.array_compact(each)).alias("key"))
