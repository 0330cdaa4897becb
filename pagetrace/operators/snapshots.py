"""What changed between two snapshots of a tree, renames with and without edits included."""

from __future__ import annotations

from collections import defaultdict
from heapq import heapify, heappop, heappush, heapreplace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrace.shared import kept, numbered

#: Pairs of this similarity are taken before less similar contents are compared.
_FIRST = 0.875


def _nth(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with `nth`, from 0, within their key, in that order; no task holds a whole key."""
    placed = kept(numbered(rows, key, order), "nth")
    first = placed.groupBy(key).agg(F.min("number").alias("_first"))
    return placed.join(first, key).withColumn("nth", F.col("number") - F.col("_first")).drop("number", "_first")


def _lines(texts: DataFrame) -> DataFrame:
    """content, line (a hash), many, bytes of the distinct lines of each content; a line feed counts as its line's last byte."""
    each = texts.select("content", F.explode(F.split("text", "\n")).alias("_line"))
    return each.groupBy("content", F.xxhash64("_line").alias("line")).agg(F.count("*").alias("many"), F.first(F.octet_length("_line") + 1).cast("long").alias("bytes"))


def _ranked(lines: DataFrame, frequency: DataFrame) -> DataFrame:
    """lines with the `size` of their content, and `before`: how many of its bytes are in lines that are rarer."""
    bytes_, own = F.col("many") * F.col("bytes"), Window.partitionBy("content")
    before = F.sum(bytes_).over(own.orderBy("n", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - bytes_
    told = lines.join(frequency, "line").withColumn("size", F.sum(bytes_).over(own)).withColumn("before", before)
    return kept(told.drop("n"), "ranked")


def ranked_lines(removed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of both sides' contents (content, text), ranked by how many of all contents have them."""
    a, b = kept(_lines(removed), "lines"), kept(_lines(added), "lines")
    frequency = kept(a.select("line").unionByName(b.select("line")).groupBy("line").agg(F.count("*").alias("n")), "frequency")
    return _ranked(a, frequency), _ranked(b, frequency)


def _rare(ranked: DataFrame, contents: DataFrame, least: float) -> DataFrame:
    """content, line, size of these contents' rarest lines that hold more than 1 - least of their bytes: two contents as similar as `least` share one."""
    return ranked.where(F.col("before") <= (1 - least) * F.col("size") + 0.5).join(contents, "content", "left_semi").select("content", "line", "size")


def similar_contents(a: DataFrame, b: DataFrame, removed: DataFrame, added: DataFrame, least: float) -> DataFrame:
    """old, new, similarity of contents (content) that share at least that part of the larger one's bytes, by their ranked lines.

    A line counts as often as both have it.  Only contents that share one of their
    rarest lines are compared, which loses no pair; lines that many have are never
    the meeting point unless they are most of a text.  Half a byte is allowed for
    rounding where pairs are left out unseen.
    """
    rare_a, rare_b = _rare(a, removed, least).toDF("old", "line", "size_old"), _rare(b, added, least).toDF("new", "line", "size_new")
    sized = F.least("size_old", "size_new") + 0.5 >= least * F.greatest("size_old", "size_new")
    near = rare_a.join(rare_b, "line").where(sized).select("old", "new", "size_old", "size_new").distinct()
    both = near.join(a.select(F.col("content").alias("old"), "line", F.col("many").alias("many_old"), "bytes"), "old").join(b.select(F.col("content").alias("new"), "line", F.col("many").alias("many_new")), ["new", "line"])
    shared = both.groupBy("old", "new", "size_old", "size_new").agg(F.sum(F.least("many_old", "many_new") * F.col("bytes")).alias("shared"))
    told = shared.select("old", "new", (F.col("shared") / F.greatest("size_old", "size_new")).alias("similarity"))
    return told.where(F.col("similarity") >= least)


def _base(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _stars(edges: DataFrame) -> DataFrame:
    """u, v: v is the smallest node that u is connected with, for all u but these smallest; edges are pairs u, v of numbers.

    Neighbours are linked to the smallest of them, first the larger, then the
    smaller ones, until nothing changes: about the logarithm of the longest chain in rounds.
    """
    seen, edges = None, kept(edges.distinct(), "edges")
    while True:
        each = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = each.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
        large = each.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(least.withColumnRenamed("m", "v").unionByName(small).distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return edges
        seen = now


def _grouped(rows: DataFrame) -> DataFrame:
    """rows with `group`: equal for rows that are connected by their files (others may have the same by chance)."""
    ends = rows.withColumn("u", F.xxhash64(F.lit("old"), "old")).withColumn("v", F.xxhash64(F.lit("new"), "new"))
    stars = _stars(ends.select("u", "v")).toDF("u", "_star")
    return ends.join(stars, "u", "left").withColumn("group", F.coalesce("_star", "u")).drop("u", "v", "_star")


class _Files:
    """Files of one side that haven't been taken, by the file that stands for them, and by base name too."""

    def __init__(self) -> None:
        self.taken: set[str] = set()
        self.copies: defaultdict[str, list[str]] = defaultdict(list)
        self.named: dict[str, dict[str, list[str]]] = {}
        self.queues: dict[tuple, list] = {}

    def queue(self, of: str, renamed: bool, base: str) -> tuple:
        key = (of, renamed, base)
        if key not in self.queues:
            paths = self.copies.get(of, [of])
            if not renamed and of not in self.named:
                self.named[of] = defaultdict(list)
                for path in paths:
                    self.named[of][path.rsplit("/", 1)[-1]].append(path)
            paths = paths if renamed else self.named[of].get(base, [])
            self.queues[key] = [0, sorted(paths)]
        return key

    def first(self, key: tuple) -> str | None:
        queue = self.queues[key]
        while queue[0] < len(queue[1]) and queue[1][queue[0]] in self.taken:
            queue[0] += 1
        return queue[1][queue[0]] if queue[0] < len(queue[1]) else None


def _in_turn(rows: pa.Table) -> pa.Table:
    """The pairs of a group taken one after the other, each path once on its side.

    Equal files are queues.  At each similarity, with equal base names first, the
    first file of the old ones goes with the first of the new ones it may go with.
    If the group has more rows than these, the last one is told (_cut), and so is
    the first of the old files behind it of the same similarity (_next): what
    they could come before is left for later.
    """
    old, new, levels, out = _Files(), _Files(), defaultdict(lambda: defaultdict(list)), []
    cut, behind = (rows[c][0].as_py() for c in ("_cut", "_next")) if len(rows) else (None, None)
    table = list(zip(*(rows[c].to_pylist() for c in ("old", "new", "similarity", "renamed", "base", "o", "p"))))
    for q, r, s, _, _, o, p in table:
        if s is None:
            (old.copies[q] if q is not None else new.copies[r]).append(o if q is not None else p)
    last = None
    for q, r, s, renamed, base, o, p in table:
        if s is not None:
            key = old.queue(q, renamed, base)
            levels[-s, renamed][key].append(new.queue(r, renamed, base))
            if cut and (-s, renamed, o) == (cut["s"], cut["renamed"], cut["o"]):
                last = key
    del table
    for level in sorted(levels):
        ends = cut and level == (cut["s"], cut["renamed"])
        candidates = [(q, [(p, r) for r in others if (p := new.first(r)) is not None]) for q, others in levels.pop(level).items()]
        for _, others in candidates:
            heapify(others)
        files = [(o, i) for i, (q, _) in enumerate(candidates) if (o := old.first(q)) is not None]
        heapify(files)
        while files:
            o, i = files[0]
            q, others = candidates[i]
            now = old.first(q)
            if now is None:
                heappop(files)
                continue
            if now != o:
                heapreplace(files, (now, i))
                continue
            if ends and behind is not None and o > behind:
                break
            while others and (p := new.first(others[0][1])) != others[0][0]:
                if p is None:
                    heappop(others)
                else:
                    heapreplace(others, (p, others[0][1]))
            if ends and q == last and (not others or others[0][0] > cut["p"]):
                break
            if not others:
                heappop(files)
                continue
            p = others[0][0]
            old.taken.add(o)
            new.taken.add(p)
            out.append((o, p, -level[0]))
        if ends:
            break
    columns = zip(*out) if out else ([], [], [])
    return pa.table([pa.array(c, x) for c, x in zip(columns, (pa.string(), pa.string(), pa.float64()))], ["previous_path", "path", "similarity"])


def _copies(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """old, o and new, p: the files of both sides that another stands for, this one included."""
    return (
        pairs.where("copy_of is not null and previous_path is not null").select(F.col("copy_of").alias("old"), F.col("previous_path").alias("o")),
        pairs.where("copy_of is not null and path is not null").select(F.col("copy_of").alias("new"), F.col("path").alias("p")),
    )


def _ranked_rows(pairs: DataFrame, copies: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """old, new, similarity, renamed, base, o, p, _rank of pairs: o and p are the first files that old and new stand for.

    Where one of them stands for several, there is a row for each base name that
    both have (renamed is false, o and p are the first of that name), and one for the others.
    """
    edges = pairs.where("similarity is not null").select(F.col("previous_path").alias("old"), F.col("path").alias("new"), "similarity")
    columns = ["old", "new", "similarity", "renamed", "base", "o", "p"]
    single = lambda x: x.withColumn("renamed", _base("old") != _base("new")).withColumn("base", F.when(F.col("renamed"), "").otherwise(_base("old"))).withColumn("o", F.col("old")).withColumn("p", F.col("new"))
    if copies is None:
        return _with_rank(single(edges).select(*columns, F.lit(True).alias("single")))
    a, b = copies
    told = edges.join(a.groupBy("old").agg(F.count("*").alias("many_old")), "old", "left").join(b.groupBy("new").agg(F.count("*").alias("many_new")), "new", "left")
    told = kept(told, "pairs")
    both = single(told.where("many_old is null and many_new is null")).select(*columns, F.lit(True).alias("single"))
    many = told.where("many_old is not null or many_new is not null")
    names = lambda x, side, file, known: x.unionByName(known.select(side, F.col(side).alias(file)).distinct()).groupBy(side, _base(file).alias("base")).agg(F.min(file).alias(file))
    a, b = names(a, "old", "o", many.where("many_old is null")), names(b, "new", "p", many.where("many_new is null"))
    # the side with fewer files says which base names are looked for
    fewer = F.coalesce("many_old", F.lit(1)) <= F.coalesce("many_new", F.lit(1))
    same = many.where(fewer).join(a, "old").join(b, ["new", "base"]).unionByName(many.where(~fewer).join(b, "new").join(a, ["old", "base"]))
    rows = same.withColumn("renamed", F.lit(False)).unionByName(many.select("*", F.lit("").alias("base"), F.col("old").alias("o"), F.col("new").alias("p"), F.lit(True).alias("renamed")))
    return _with_rank(both.unionByName(rows.select(*columns, F.lit(False).alias("single"))))


def _with_rank(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_rank", F.struct((-F.col("similarity")).alias("s"), "renamed", "o", "p", "single"))


def _after(rows: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """rows whose files are left, by the files (old, o and new, p) that are, with the first of them."""
    for files, side, file in ((old, "old", "o"), (new, "new", "p")):
        all_ = files.groupBy(side).agg(F.min(file).alias(file)).select(side, F.lit(True).alias("renamed"), F.lit("").alias("base"), file)
        named = files.groupBy(side, _base(file).alias("base")).agg(F.min(file).alias(file)).select(side, F.lit(False).alias("renamed"), "base", file)
        rows = rows.drop(file).join(all_.unionByName(named), [side, "renamed", "base"])
    return _with_rank(rows.drop("_rank"))


def matched(pairs: DataFrame, rounds: int = 2, block: int = 200_000) -> DataFrame:
    """previous_path, path, similarity: pairs, the most similar first, each path once on its side.

    Ties: equal base names first, then by previous_path and path.  The first of
    equal files stands for all of them: if pairs has `copy_of`, rows where it isn't
    null tell one of these files each, on its side, that one included, and a pair
    of two such files stands for all pairs of theirs.  Pairs that are
    the best of both their paths are what taking one after the other would take;
    the others go on without those paths.  Equally similar files wait for each
    other, so after these rounds the connected pairs that are left are taken in
    turn within a task, the best `block` of each group at a time; so are those of
    equal files, which are never made into pairs of each with each.
    """
    copies, found = None, None
    if "copy_of" in pairs.columns:
        pairs = kept(pairs, "pairs")
        if not pairs.where("copy_of is not null").isEmpty():
            copies = _copies(pairs)
    left = kept(_ranked_rows(pairs, copies), "pairs")
    while not left.isEmpty() and rounds:
        best = left.groupBy("old").agg(F.min("_rank").alias("_rank")).join(left.groupBy("new").agg(F.min("_rank").alias("_rank")).select("_rank"), "_rank")
        best = best.where("_rank.single").select(F.col("_rank.o").alias("previous_path"), F.col("_rank.p").alias("path"), (-F.col("_rank.s")).alias("similarity"))
        best = kept(best, "matched")
        found = best if found is None else found.unionByName(best)
        left = kept(left.join(best.select(F.col("previous_path").alias("old")), "old", "left_anti").join(best.select(F.col("path").alias("new")), "new", "left_anti"), "pairs")
        rounds -= 1
    files = None
    if not left.isEmpty():
        left = kept(_grouped(left), "pairs")
    while not left.isEmpty():
        none = F.lit(None).cast(left.schema["_rank"].dataType)
        first = left.withColumn("_cut", none).withColumn("_next", F.lit(None).cast("string"))
        big = left.groupBy("group").count().where(F.col("count") > block).select("group")
        more = not big.isEmpty()
        if more:
            big = kept(big, "groups")
            placed = kept(_nth(left.join(big, "group", "left_semi"), "group", "_rank"), "nth")
            cut = placed.where(F.col("nth") == block - 1).select("group", F.col("_rank").alias("_cut"))
            level = "_rank.s = _cut.s and _rank.renamed = _cut.renamed and o > _cut.o"
            behind = placed.where(F.col("nth") >= block).join(cut, "group").where(level).groupBy("group").agg(F.min("o").alias("_next"))
            ends = cut.join(behind, "group", "left")
            first = first.join(big, "group", "left_anti").unionByName(placed.where(F.col("nth") < block).drop("nth").join(ends, "group"))
            first = kept(first, "first")
        each = first.select("group", "old", "new", "similarity", "renamed", "base", "o", "p", "_cut", "_next")
        if copies is not None:
            old, new = files or copies
            ends = first.select("group", "_cut", "_next").distinct()
            told = old.join(first.select("old", "group").distinct(), "old").unionByName(new.join(first.select("new", "group").distinct(), "new"), allowMissingColumns=True).join(ends, "group")
            each = each.unionByName(told, allowMissingColumns=True)
        best = kept(each.groupBy("group").applyInArrow(_in_turn, "previous_path string, path string, similarity double"), "matched")
        found = best if found is None else found.unionByName(best)
        if not more:
            break
        left = left.join(big, "group", "left_semi")
        if files is None:
            none = pairs.sparkSession.createDataFrame([], "old string, o string"), pairs.sparkSession.createDataFrame([], "new string, p string")
            # those that stand for themselves alone as well
            files = tuple(x.unionByName(left.select(side).distinct().join(x, side, "left_anti").select(side, F.col(side).alias(file))) for x, side, file in zip(copies or none, ("old", "new"), ("o", "p")))
        old, new = files
        files = kept(old.join(best.select(F.col("previous_path").alias("o")), "o", "left_anti"), "files"), kept(new.join(best.select(F.col("path").alias("p")), "p", "left_anti"), "files")
        left = kept(_after(left, *files), "pairs")
    return found if found is not None else left.select(F.col("o").alias("previous_path"), F.col("p").alias("path"), "similarity")


def _of_files(near: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of the files (old, previous_path and new, path) of similar contents, for matched."""
    first_a = a.groupBy("old").agg(F.min("previous_path").alias("previous_path"), F.count("*").alias("n"))
    first_b = b.groupBy("new").agg(F.min("path").alias("path"), F.count("*").alias("n"))
    pairs = near.join(first_a.drop("n"), "old").join(first_b.drop("n"), "new").select("previous_path", "path", "similarity")
    more_a = a.join(first_a.where("n > 1").select("old", F.col("previous_path").alias("copy_of")), "old").select("previous_path", "copy_of")
    more_b = b.join(first_b.where("n > 1").select("new", F.col("path").alias("copy_of")), "new").select("path", "copy_of")
    return pairs.unionByName(more_a, allowMissingColumns=True).unionByName(more_b, allowMissingColumns=True)


def snapshot_changes(before: DataFrame, after: DataFrame, least: float = 0.5) -> DataFrame:
    """path, status, previous_path, similarity of what differs between two snapshots (path, text).

    status: added, removed, modified (similarity null) or renamed.  A removed and
    an added file are a rename if their contents are equal (similarity 1), else if
    they share at least `least` of the larger one's bytes by lines; the most similar
    pair comes first, and each file is in one pair at most.  A null text counts as
    empty; empty files are only renamed as equal ones.  A path occurs once in each
    snapshot, the least text counts if it doesn't.
    """
    whole = F.coalesce("text", F.lit(""))
    once = lambda x: x.groupBy("path").agg(F.min(whole).alias("text")).withColumn("content", F.sha2("text", 256))
    old, new = kept(once(before), "before"), kept(once(after), "after")
    paths = old.select("path", F.col("content").alias("a")).join(new.select("path", F.col("content").alias("b")), "path", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    told = kept(paths.withColumn("status", status).where("status is not null"), "changes")
    removed, added = told.where("status = 'removed'").select("path", F.col("a").alias("content")), told.where("status = 'added'").select("path", F.col("b").alias("content"))

    # equal contents: first those of one base name, then the others in order
    exact = None
    for key in (F.concat("content", F.lit("/"), _base("path")), F.col("content")):
        a = _nth(removed.withColumn("_key", key), "_key", "path").select("_key", "nth", F.col("path").alias("previous_path"))
        b = _nth(added.withColumn("_key", key), "_key", "path").select("_key", "nth", "path")
        pairs = kept(a.join(b, ["_key", "nth"]).select("previous_path", "path", F.lit(1.0).alias("similarity")), "renames")
        exact = pairs if exact is None else exact.unionByName(pairs)
        removed = kept(removed.join(pairs.select(F.col("previous_path").alias("path")), "path", "left_anti"), "removed")
        added = kept(added.join(pairs.select("path"), "path", "left_anti"), "added")

    # equal contents are compared once, for all their files
    texts = lambda rows, side: side.join(rows.select("content").distinct(), "content", "left_semi").groupBy("content").agg(F.first("text").alias("text")).where("text <> ''")
    lines_a, lines_b = ranked_lines(texts(removed, old), texts(added, new))
    a = removed.select(F.col("content").alias("old"), F.col("path").alias("previous_path"))
    b = added.select(F.col("content").alias("new"), "path")
    # the most similar come first, so files that have found theirs needn't be compared with the less similar
    renamed = exact
    for step in [_FIRST, least] if least < _FIRST else [least]:
        near = similar_contents(lines_a, lines_b, a.select(F.col("old").alias("content")), b.select(F.col("new").alias("content")), step)
        pairs = matched(_of_files(near, a, b))
        renamed = renamed.unionByName(pairs)
        if step > least:
            a, b = kept(a.join(pairs, "previous_path", "left_anti"), "left"), kept(b.join(pairs, "path", "left_anti"), "left")

    rest = told.join(renamed.select("path"), "path", "left_anti").join(renamed.select(F.col("previous_path").alias("path")), "path", "left_anti")
    none = rest.select("path", "status", F.lit(None).cast("string").alias("previous_path"), F.lit(None).cast("double").alias("similarity"))
    # a path that was left and one that came may be the same only if it is modified, so these are apart
    return none.unionByName(renamed.select("path", F.lit("renamed").alias("status"), "previous_path", "similarity"))
