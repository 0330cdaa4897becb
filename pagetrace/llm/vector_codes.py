"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

The nearest entry is searched by slices: along every dimension the entries'
coordinates are sorted, and each place of that order carries the mask of the
entries before it (64 entries a word).  The entries whose coordinate is within a
radius are the difference of two masks, and those within it along every dimension
are the masks' intersection, which holds every entry of that Euclidean radius.
Candidates are compared exactly.  The first radius is the median distance between
neighbouring entries; a part whose best candidate is farther away than its radius
is searched again with that distance, one without any with twice the radius.

Codebooks are refined in rounds: tasks add their parts up by entry, Spark adds
those sums, and the driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Pairs of a part and a candidate that are compared at once.
PAIRS = 1 << 18
#: Rows that are joined by broadcast at most.
FEW = 500_000


class Slices:
    """A codebook (entries x dimensions, integers) to be searched for nearest entries."""

    def __init__(self, book: np.ndarray):
        self.book, k = book, len(book)
        order = np.argsort(book, axis=0, kind="stable").T
        self.sorted = np.sort(book, axis=0).T.copy()
        bit = np.zeros((k, -(-k // 64)), np.uint64)
        bit[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        self.prefix = np.zeros((len(order), k + 1, bit.shape[1]), np.uint64)
        for d, o in enumerate(order):
            self.prefix[d, 1:] = np.bitwise_or.accumulate(bit[o], axis=0)
        apart = np.stack([((book - e) ** 2).sum(1) for e in book])
        nearest = np.where(apart > 0, apart, np.iinfo(np.int64).max).min(1)  # equal entries are one
        told = nearest[nearest < np.iinfo(np.int64).max]
        self.radius = int(np.sqrt(np.median(told))) + 1 if len(told) else 1

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within radius of x along every dimension."""
        mask = np.full((len(x), self.prefix.shape[2]), ~np.uint64(0))
        for values, prefix, column in zip(self.sorted, self.prefix, x.T):
            mask &= prefix[np.searchsorted(values, column + radius, "right")] ^ prefix[np.searchsorted(values, column - radius, "left")]
        return mask

    def _closest(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x its nearest candidate (the lowest of equals, -1 without any) and their squared distance."""
        held = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little", count=len(self.book)).view(bool)
        entry, least = np.full(len(x), -1, np.int64), np.full(len(x), np.iinfo(np.int64).max)
        i, j = np.nonzero(held)
        if not len(i):
            return entry, least
        width = np.int32 if x.shape[1] * (2 * max(np.abs(x).max(initial=0), np.abs(self.book).max(initial=0)) + 1) ** 2 < 1 << 31 else np.int64
        gap = x.astype(width)[i] - self.book.astype(width)[j]
        far = np.einsum("ij,ij->i", gap, gap).astype(np.int64)
        begin = np.flatnonzero(np.diff(i, prepend=-1))
        low = np.minimum.reduceat(far, begin)
        row = i[begin]
        # the first of the least: j ascends within a row
        hit = np.flatnonzero(far == np.repeat(low, np.diff(np.r_[begin, len(i)])))
        first = hit[np.searchsorted(hit, begin)]
        entry[row], least[row] = j[first], low
        return entry, least

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x (ties: the lowest) and their squared distance."""
        entry, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        step = max(1, PAIRS // max(1, len(self.book)))
        for k in range(0, len(x), step):
            rest, radius = np.arange(k, min(k + step, len(x))), np.full(min(step, len(x) - k), self.radius, np.int64)
            while len(rest):
                entry[rest], least[rest] = self._closest(x[rest], self.candidates(x[rest], radius))
                none, far = entry[rest] < 0, least[rest].astype(np.float64)
                open_ = none | (far > radius.astype(np.float64) ** 2)
                radius = np.where(none, 2 * radius, np.ceil(np.sqrt(np.where(none, 0, far))).astype(np.int64) + 1)[open_]
                rest = rest[open_]
        return entry, least


def _integers(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """The vectors in integers, each followed by zeros up to the width."""
    many = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < many[:, None]] = np.floor(scale * np.asarray(column.flatten(), np.float64)).astype(np.int64)
    return out


def fit(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int, width: int) -> list[np.ndarray]:
    """A codebook for each part: entries x (width / parts)."""
    first = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).toArrow().combine_chunks()
    start = first.column("embedding").combine_chunks()
    books = [x.copy() for x in np.split(_integers(start, scale, width), parts, axis=1)]
    for _ in range(rounds):
        sums, counts = _sums(rows, books, scale, width)
        for p, book in enumerate(books):
            used = counts[p] > 0
            book[used] = sums[p][used] // counts[p][used, None]  # floors go down
    return books


def _sums(rows: DataFrame, books: list[np.ndarray], scale: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each part and entry the sum of the parts that are nearest to it, and how many they are."""
    parts, entries, size = len(books), len(books[0]), width // len(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: list[Slices] = []
        total, count = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            slices = slices or [Slices(b) for b in books]
            for p, x in enumerate(np.split(_integers(batch.column("embedding"), scale, width), parts, axis=1)):
                at = slices[p].nearest(x)[0] + p * entries
                np.add.at(total, at, x)
                count += np.bincount(at, minlength=len(count))
        used = np.flatnonzero(count)
        # a row for each sum, and the counts as one more place
        place = np.tile(np.arange(size + 1), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, size + 1)), pa.array(place), pa.array(np.c_[total[used], count[used]].ravel())], ["entry", "place", "n"])

    got = rows.select("embedding").mapInArrow(add, "entry long, place long, n long").groupBy("entry", "place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((parts * entries, size + 1), np.int64)
    out[got.column("entry").to_numpy(), got.column("place").to_numpy()] = got.column("n").to_numpy()
    out = out.reshape(parts, entries, size + 1)
    return out[:, :, :size], out[:, :, size]


def sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error of every vector, and the codebooks.

    Components x count as floor(scale * x).  code: the numbers of the nearest
    entries in part order, two hexadecimal digits each; error: the squared
    distances to them, added up.  The codebooks begin with the parts of the
    `entries` smallest vec_ids (nulls last, ties by vector; all rows, if there are
    fewer) and are refined in `rounds` rounds.

    Rows whose vector is null, or holds null or non-finite components, go.  Vectors
    shorter than the longest, and those whose length the parts don't divide, are
    read as if zeros followed.  Repeated and null vec_ids and labels are rows like
    any other.  An empty table gives no rows and empty codebooks.  Other columns are
    ignored.  Components so large that distances may not fit a long raise ValueError.
    """
    if entries > 256:
        raise ValueError("an entry's number has two hexadecimal digits")
    x = F.col("embedding")
    good = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = stash(embeddings.where(good).select("vec_id", "label", "embedding"))
    most = rows.agg(F.max(F.size("embedding")).alias("size"), F.max(F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))).alias("value")).first()
    width = parts * max(1, -(-(most["size"] or 0) // parts))
    if width * (2 * scale * (most["value"] or 0.0) + 2) ** 2 >= 1 << 62:
        raise ValueError("components are so large that distances may not fit a long")
    books = fit(rows, parts, entries, rounds, scale, width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: list[Slices] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            slices = slices or [Slices(b) for b in books]
            found = [s.nearest(x) for s, x in zip(slices, np.split(_integers(batch.column("embedding"), scale, width), parts, axis=1))]
            digits = np.stack([f[0] for f in found], 1).astype(np.uint8).tobytes().hex()
            code = [digits[2 * parts * i : 2 * parts * (i + 1)] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(sum(f[1] for f in found))], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(assign, f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded (label, error, ...) with label_error: the errors of equal labels added up, nulls being equal."""
    coded = stash(coded)
    sums = stash(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    few = sums.limit(FEW + 1).count() <= FEW
    return coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
