"""Benchmark decontamination by SimHash of item-sized windows.

Windows of the documents begin at every `stride`-th word, and each item has
windows of one size at all of its offsets.  Each window has a 64-bit SimHash of
its five-word shingles.  A multi-index over four 16-bit blocks finds all pairs
of windows within RADIUS = 3 bits (two fingerprints that differ in at most three
bits agree in one of four blocks).  Every candidate is then verified by the
exact weighted Jaccard similarity of the whole item's shingles with those of the
passages of the document around it; only 0.8 or more is reported.

The size follows from that: a similarity of 0.8 leaves only so many changes, and
between them a run of `unbroken` words stays whole, so a size is taken of which
one window on the documents' grid fits into such a run wherever it begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import in_batches, stash

WORDS, RADIUS, BLOCKS, THRESHOLD = 5, 3, 4, 0.8
#: Row numbers that are broadcast at most.
NARROW = 500_000
#: Window sizes in words; under five words there is one shingle of them all.
GRID = (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 19, 24, 30, 37, 46, 58)


def stride(size: int) -> int:
    return max(1, size // 4)


def unbroken(n: int) -> int:
    """Words in a row that an item of n words has in common with every passage of similarity THRESHOLD or more.

    Of the item's m shingles and e others, THRESHOLD allows to lose l with
    l + THRESHOLD * e <= (1 - THRESHOLD) * m.  Every break within the passage loses
    WORDS - 1 and adds as many at least; c breaks leave c + 1 runs.
    """
    if n < WORDS:
        return n
    m, least = n - WORDS + 1, WORDS - 1
    most = int((1 - THRESHOLD) * m / (least * (1 + THRESHOLD)) + 1e-9)
    kept = min((THRESHOLD * m + THRESHOLD * least * c) / (c + 1) for c in range(most + 1))
    return int(np.ceil(kept - 1e-9)) + WORDS - 1


def _largest(fits) -> int | None:
    return max((w for w in GRID if fits(w)), default=None)


def simhashes(words: np.ndarray, size: int, starts: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of the windows of `size` words from each start on."""
    if size < WORDS:
        out = words[starts].copy()
        for i in range(1, size):
            out = out * np.uint64(0x9FB21C651E98DF25) + words[starts + i]
        return textscan.mix(out)
    sums = bit_sums(words) if sums is None else sums
    count = size - WORDS + 1
    ones = sums[starts + count] - sums[starts]  # of at most 54 shingles: no byte overflows but for wrapping, which cancels
    return np.packbits(ones * 2 > count, axis=1).view(np.uint64)[:, 0]


def bit_sums(words: np.ndarray) -> np.ndarray:
    """How many of the shingles before each place have each bit set, modulo 256."""
    grams = textscan.shingles(words, WORDS)
    bits = np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(grams) + 1, 64), np.uint8)
    np.cumsum(bits, axis=0, dtype=np.uint8, out=out[1:])
    return out


@dataclass
class Probes:
    """Windows of one size of all items."""

    size: int
    prints: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    any_block: list[np.ndarray] = field(default_factory=list)
    order: list[np.ndarray] = field(default_factory=list)
    blocks: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        for b in range(BLOCKS):
            value = ((self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            hit = np.zeros(1 << 16, bool)
            hit[value] = True
            self.any_block.append(hit)
            self.order.append(order)
            self.blocks.append(value[order])

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, probe) pairs within the radius."""
        windows, probes = [], []
        halves = prints.view(np.uint16).reshape(-1, 4) if len(prints) else np.empty((0, 4), np.uint16)  # little-endian: block b is half b
        for b in range(BLOCKS):
            some = np.flatnonzero(self.any_block[b][halves[:, b]])
            value = halves[some, b].astype(np.int64)
            first = np.searchsorted(self.blocks[b], value, "left")
            many = np.searchsorted(self.blocks[b], value, "right") - first
            w, p = np.repeat(some, many), self.order[b][textscan.ragged(first, many)]
            near = np.bitwise_count(prints[w] ^ self.prints[p]) <= RADIUS
            windows.append(w[near])
            probes.append(p[near])
        return np.concatenate(windows), np.concatenate(probes)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two bags of shingles."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def _bag(words: np.ndarray) -> np.ndarray:
    return textscan.shingles(words, min(WORDS, max(1, len(words))))


class Index:
    """Multi-index over the windows of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str | None]):
        words, at = textscan.words(pa.array(texts, pa.large_string()))
        self.ids = ids
        self.words = [words[at[i] : at[i + 1]] for i in range(len(ids))]
        self.bags = [_bag(w) for w in self.words]
        found: dict[int, set[tuple[int, int]]] = {}
        for i, w in enumerate(self.words):
            n = len(w)
            run = unbroken(n)
            if (size := _largest(lambda s: s + stride(s) - 1 <= run)) is not None:
                found.setdefault(size, set()).update((i, o) for o in range(n - size + 1))
        self.probes = []
        for size, pairs in sorted(found.items()):
            items, offsets = np.array(sorted(pairs)).T
            prints = np.concatenate([simhashes(self.words[i], size, offsets[items == i]) for i in np.unique(items)])
            self.probes.append(Probes(size, prints, items, offsets))

    def verify(self, item: int, words: np.ndarray, start: int) -> tuple[float, int, int]:
        """Greatest similarity of the item with a passage that meets it at `start`, and that passage (0 if it is under THRESHOLD for sure)."""
        n, bag, best = len(self.words[item]), self.bags[item], (0.0, 0, 0)
        size = min(n, WORDS)
        # a passage has at most 1 / THRESHOLD of the item's shingles, and may hold the item's parts in another order
        most = int(len(bag) / THRESHOLD + 1e-9) + WORDS - 1 if n >= WORDS else 0
        low, high = max(0, start - most), min(len(words), start + n + most)
        if high - low < size:
            return best
        kinds, has = np.unique(bag, return_counts=True)
        grams = textscan.shingles(words[low:high], size)
        kind = np.minimum(np.searchsorted(kinds, grams), len(kinds) - 1)
        of_item = np.flatnonzero(kinds[kind] == grams)
        kind = kind[of_item]
        if np.minimum(np.bincount(kind, minlength=len(kinds)), has).sum() < THRESHOLD * len(bag) - 1e-9:
            return best
        order = np.argsort(kind, kind="stable")
        by_kind = np.searchsorted(kind[order], np.arange(len(kinds)))
        place = np.empty(len(kind), np.int64)
        place[order] = np.arange(len(kind)) - by_kind[kind[order]]  # how often the shingle has come before
        # What a start can reach at most: the item's shingles from there on.  A best passage begins with one of them.
        left = np.bincount(kind, minlength=len(kinds))[kind] - place  # how often the shingle comes from here on
        reach = np.zeros(len(grams) + 1, np.int64)
        reach[of_item] = left <= has[kind]
        reach = np.cumsum(reach[::-1])[::-1] / len(bag)
        begins = np.zeros(len(grams), bool)
        begins[of_item] = True
        for a in sorted(range(low, min(start + n if most else start, high - size) + 1), key=lambda a: abs(a - start)):
            first = a - low
            if not begins[first] or reach[first] < THRESHOLD - 1e-9 or reach[first] <= best[0]:
                continue
            later = of_item >= first
            before = np.bincount(kind[~later], minlength=len(kinds))
            counts = np.zeros(len(grams) - first, np.int64)
            counts[of_item[later] - first] = place[later] - before[kind[later]] < has[kind[later]]
            both, many = np.cumsum(counts), np.arange(1, len(counts) + 1)
            if n < WORDS:  # only n words have a shingle of n
                both, many = both[:1], many[:1]
            s = both / (len(bag) + many - both)
            k = int(s.argmax())
            if s[k] > best[0]:
                best = (float(s[k]), a, k + size)
            if best[0] == 1.0:
                break
        return best

    def search(self, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of the best passage of each row and item it holds."""
        words, at = textscan.words(texts)
        sizes, out = np.diff(at), {}
        if not len(words):
            return []
        sums = bit_sums(words) if len(words) >= WORDS else None
        seen: set[tuple[int, int, int]] = set()
        for probes in self.probes:
            step = stride(probes.size)
            many = np.maximum(0, (sizes - probes.size) // step + 1)
            rows = np.repeat(np.arange(len(sizes)), many)
            starts = at[rows] + step * textscan.ragged(np.zeros(len(sizes), np.int64), many)
            if probes.size >= WORDS and sums is None:
                continue
            w, p = probes.within(simhashes(words, probes.size, starts, sums))
            for row, item, start in zip(rows[w].tolist(), probes.items[p].tolist(), (starts[w] - probes.offsets[p]).tolist()):
                if (row, item, start) in seen:
                    continue
                seen.add((row, item, start))
                if out.get((row, item), (0,))[0] == 1.0:
                    continue
                own = words[at[row] : at[row + 1]]
                got = self.verify(item, own, start - int(at[row]))
                if got[0] >= THRESHOLD and got[0] > out.get((row, item), (0,))[0]:
                    out[row, item] = got
        return [(row, item, *got) for (row, item), got in sorted(out.items())]


def indexes(benchmark: DataFrame, block: int = 4 << 20) -> Iterator[Index]:
    """The benchmark's items in blocks of at most `block` characters (one item at least); each block is one pass over the documents."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        own = len(r["text"] or "") + 16
        if ids and size + own > block:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += own
    if ids:
        yield Index(ids, texts)


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of the best passage of each row for each item it holds.

    All rows of docs are searched; a row with a null or empty text, an item with
    none, and empty tables give no rows.  Repeated rows give their own results.
    """
    out, docs = None, in_batches(docs)
    for index in indexes(benchmark):

        def rows(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for part in textscan.slices(batches):
                found = index.search(part.column("text"))
                if found:
                    row, item, similarity, first, many = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(row)), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(similarity, pa.float64()), pa.array(first, pa.int64()), pa.array(many, pa.int64())],
                        ["doc_id", "item_id", "similarity", "first_word", "n_words"],
                    )

        got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, first_word long, n_words long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, block: int = 4 << 20) -> DataFrame:
    """The rows of docs that hold no benchmark passage, unchanged.

    A benchmark of one block filters the rows on their way, without a shuffle.  Of
    a larger one, each block is a job of its own that tells the numbers of the rows
    that hold its passages, so no task and not the driver has two blocks; the rows
    are written once, with their numbers, to the shared folder.
    """
    docs, blocks = in_batches(docs), indexes(benchmark, block)
    size = benchmark.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 16)).first()[0]
    if size is None:
        return docs
    if size <= block:
        index = next(blocks)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in textscan.slices(batches):
                keep = np.ones(part.num_rows, bool)
                keep[[f[0] for f in index.search(part.column("text"))]] = False
                yield part.filter(pa.array(keep))

        return docs.mapInArrow(rows, docs.schema)
    number = "_row"
    while number in map(str.lower, docs.columns):
        number += "_"
    numbered, hits = stash(docs.withColumn(number, F.monotonically_increasing_id())), None
    for found in blocks:
        told = stash(numbered.select(number, "text").mapInArrow(_holders(found, number), f"{number} long"))
        hits = told if hits is None else hits.unionByName(told)
    hits = hits.distinct()
    few = hits.count() <= NARROW
    return numbered.join(F.broadcast(hits) if few else hits, number, "left_anti").drop(number)


def _holders(index: Index, number: str):
    """Finds the numbers of the rows that hold a passage of the index."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textscan.slices(batches):
            found = sorted({f[0] for f in index.search(part.column("text"))})
            yield pa.RecordBatch.from_arrays([part.column(number).take(pa.array(found, pa.int64()))], [number])

    return rows
