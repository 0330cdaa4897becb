"""Packing whole documents into few sequences: dominance reduction, then best fit.

How documents are packed depends on how many pieces there are of each length, and
lengths are at most a window: the driver sees that histogram and no more.

The reduction is that of Martello and Toth.  For a piece, largest first, a set of
at most three pieces that holds it dominates all others if any solution can be
turned into one with that set as a sequence, without more sequences:
  the piece alone, if nothing fits beside it;
  the piece and the largest that fits, if that fills the window, or if no two fit;
  if no three fit: the piece and the largest that fits, if that is as long as the
    best two together; or the piece and the best two, if one of them is the largest
    that fits and no two others are both longer than the second.
Such sets are sequences for good, and the rest is smaller; passes over the lengths
go on until none is found.  What remains goes by best fit, longest first.  Both
work on whole runs of equal pieces and of equally filled sequences, of which there
are a few thousand at most.  Each run says which pieces of a length, by their rank,
go to which sequences and where.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .bytebpe import ByteEncoder
from .common import in_batches, stash
from .wordbpe import encoding

#: Rows that are joined by broadcast at most.
FEW = 500_000
PIECE = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"
#: Equal sequences: how many, and their pieces in order as (length, how many).
Runs = list[tuple[int, list[tuple[int, int]]]]


class Lengths:
    """How many pieces there are of each length; lengths in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n > 0}
        self.lengths = sorted(self.counts)

    def take(self, length: int, many: int) -> None:
        self.counts[length] -= many
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)

    def least(self, many: int, beside: int, above: int = 0, other: int = 0) -> list[int]:
        """The `many` smallest pieces longer than `above` that are there beside one of length `beside`; none of length `other`."""
        out: list[int] = []
        for s in self.lengths[bisect.bisect_right(self.lengths, above) :]:
            if s != other:
                out += [s] * min(many - len(out), self.counts[s] - (s == beside))
            if len(out) == many:
                break
        return out

    def largest(self, room: int, beside: int) -> int:
        """The largest piece of at most `room` beside one of length `beside`; 0 if there is none."""
        i = bisect.bisect_right(self.lengths, room) - 1
        if i >= 0 and self.lengths[i] == beside and self.counts[beside] < 2:
            i -= 1
        return self.lengths[i] if i >= 0 else 0

    def best_two(self, room: int, beside: int) -> tuple[int, int]:
        """Two pieces, the longer first, that fill `room` best beside one of length `beside`; there are two that fit."""
        have = lambda s: self.counts[s] - (s == beside)
        best, low, high = (0, 0), 0, len(self.lengths) - 1
        while low <= high:
            a, b = self.lengths[high], self.lengths[low]
            if a + b > room or have(a) < 1:
                high -= 1
            elif have(b) < 1 or (a == b and have(a) < 2):
                low += 1
            else:
                if a + b > sum(best):
                    best = (a, b)
                low += 1
        return best


def dominating(left: Lengths, longest: int, window: int) -> list[int]:
    """A set with one piece of length `longest`, itself the first, that dominates all others; empty if none is known."""
    room = window - longest
    fits = left.least(3, longest)
    if not fits or fits[0] > room:
        return [longest]
    most = left.largest(room, longest)
    if most == room or len(fits) < 2 or sum(fits[:2]) > room:
        return [longest, most]
    if len(fits) > 2 and sum(fits) <= room:
        return []
    a, b = left.best_two(room, longest)
    if most >= a + b:
        return [longest, most]
    between = left.least(2, longest, above=b, other=a)
    if a == most and (len(between) < 2 or sum(between) > room):
        return [longest, a, b]
    return []


def reduced(left: Lengths, window: int) -> Runs:
    """Sequences that an optimal packing may have; their pieces leave `left`."""
    out: Runs = []
    changed = True
    while changed:
        changed = False
        for length in reversed(list(left.lengths)):
            while length in left.counts and (found := dominating(left, length, window)):
                need = {s: found.count(s) for s in found}
                if len(found) == 1:
                    many = left.counts[length]
                elif len(found) == 2:  # stays so while both are there
                    many = max(1, min(left.counts[s] // n for s, n in need.items()))
                else:  # stays so while there is more than one of each
                    many = max(1, min((left.counts[s] - 3) // n for s, n in need.items()))
                out.append((many, [(s, 1) for s in found]))
                for s, n in need.items():
                    left.take(s, n * many)
                changed = True
    return out


def best_fit(left: Lengths, window: int) -> Runs:
    """The longest pieces first, each into the sequence with the least room that has enough; equal sequences go together."""
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def add(room: int, many: int, held: list[tuple[int, int]]) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((many, held))

    for length in reversed(left.lengths):
        n, filled = left.counts[length], []
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = window // length
                whole, rest = divmod(n, each)
                filled += [(whole, window - each * length, [(length, each)])] * bool(whole) + [(1, window - rest * length, [(length, rest)])] * bool(rest)
                break
            room = rooms[i]
            many, held = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            each = room // length  # a sequence takes what it can before the next has less room
            whole = min(many, n // each)
            rest = min(n - whole * each, each - 1) if whole < many else 0
            n -= whole * each + rest
            filled += [(whole, room - each * length, [*held, (length, each)])] * bool(whole) + [(1, room - rest * length, [*held, (length, rest)])] * bool(rest)
            if many - whole - bool(rest):
                add(room, many - whole - bool(rest), held)
        for many, room, held in filled:
            add(room, many, held)
    return [run for room in rooms for run in open_[room]]


def packed(counts: dict[int, int], window: int) -> Runs:
    left = Lengths(counts)
    fixed = reduced(left, window)
    return fixed + best_fit(left, window)


def places(runs: Runs) -> np.ndarray:
    """Rows (length, first rank, sequence, each, offset) in order of length and rank: from that rank on, `each` pieces of that length go to a sequence, one after the other from that offset."""
    out, ranks, sequence = [], {}, 0
    for many, held in runs:
        offset = 0
        for length, each in held:
            out.append((length, ranks.get(length, 0), sequence, each, offset))
            ranks[length] = ranks.get(length, 0) + many * each
            offset += length * each
        sequence += many
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _pieces(docs: DataFrame, vocabulary: str, end: int, window: int) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian), width, part, nth of every piece; nth counts the pieces of one length in one input partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch, ids, at in encoding(vocabulary, batches, ByteEncoder):
            sizes = np.diff(at) + 1
            out = np.full(int(sizes.sum()), end, "<u2" if max(end, int(ids.max(initial=0))) < 1 << 16 else "<u4")
            begin = np.cumsum(sizes) - sizes
            out[textscan.ragged(begin, sizes - 1)] = ids
            many = -(-sizes // window)
            doc = np.repeat(np.arange(len(sizes)), many)
            piece = textscan.ragged(np.zeros(len(many), np.int64), many)
            short = (sizes - (many - 1) * window)[doc]  # the first
            length = np.where(piece == 0, short, window)
            start = np.where(piece == 0, 0, short + (piece - 1) * window)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - np.searchsorted(ranked, ranked) + met[ranked]
            met += np.bincount(length, minlength=window + 1)
            cuts = np.r_[begin[doc] + start, len(out)] * out.itemsize
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)])
            n = len(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data.cast(pa.binary()), pa.array(np.full(n, out.itemsize, np.int32)), pa.array(np.full(n, part, np.int64)), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids", "width", "part", "nth"],
            )

    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, piece int, start long, length long, ids binary, width int, part long, nth long")


def pack(docs: DataFrame, vocabulary: str, end: int = 2, window: int = 1024) -> DataFrame:
    """The pieces of all documents in their sequences: PIECE; ids are little-endian unsigned 32-bit integers.

    A document is its text's ids and the end id, and one piece unless it is longer
    than a window: then all its pieces are a window long but the first, which may be
    shorter.  A null text counts as empty.  Repeated and null doc_ids are rows like
    any other.  An empty table gives no rows.  Other columns are ignored.
    """
    pieces = stash(_pieces(docs, vocabulary, end, window))
    each = stash(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length, `window` at most
    table = places(packed(counts, window))
    # the rank of a piece is that of its partition's first, and nth
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each input partition
    base = each.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    few = each.limit(FEW + 1).count() <= FEW
    ranked = pieces.join(F.broadcast(base) if few else base, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids", "width", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(table[:, 0], np.arange(window + 2))
        for batch in textscan.slices(batches, "ids"):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.empty(len(length), np.int64)
            for s in np.unique(length):
                of = np.flatnonzero(length == s)
                run[of] = first[s] + np.searchsorted(table[first[s] : first[s + 1], 1], rank[of], "right") - 1
            _, begin, sequence, many, offset = table[run].T
            ids = [x if w == 4 else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length")), pa.array(sequence + (rank - begin) // many), pa.array(offset + (rank - begin) % many * length), pa.array(ids, pa.binary())],
                [f.split()[0] for f in PIECE.split(", ")],
            )

    return ranked.mapInArrow(place, PIECE)
