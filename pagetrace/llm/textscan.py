"""Vectorised scans of the words of many texts at once (numpy over Arrow buffers).

Words are maximal runs of ASCII letters, digits, underscores and non-ASCII
characters after lower-casing; all other ASCII characters separate them.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
#: Bytes of text that are worked on at once (one row at least).
SLICE = 1 << 19
_LIBC = ctypes.CDLL(None)
_TRIM, _OPTION = getattr(_LIBC, "malloc_trim", None), getattr(_LIBC, "mallopt", None)  # of the GNU library only
_B = 0x9E3779B97F4A7C15 | 1
_POW = np.cumprod(np.r_[np.uint64(1), np.full(BLOCK - 1, _B, np.uint64)], dtype=np.uint64)
_INV = np.cumprod(np.r_[np.uint64(1), np.full(BLOCK - 1, pow(_B, -1, 1 << 64), np.uint64)], dtype=np.uint64)

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
#: Same bytes, ASCII letters in lower case, from 1 on.
LOWER = np.arange(1, 257, dtype=np.uint64)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes; all bits of the input reach all bits of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by a line feed, and where each begins (one more entry: the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ended = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(ended, pa.ChunkedArray):
        ended = ended.combine_chunks()
    if not len(ended):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = ended.buffers()
    at = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of the bytes of each run, by differences of a prefix polynomial."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        base = starts[i]
        j = int(np.searchsorted(ends, base + BLOCK - 1, "right"))
        if j <= i:  # one run that is longer than a block
            digest = hashlib.blake2b(values[data[base : ends[i]]].tobytes(), digest_size=8).digest()
            out[i] = np.frombuffer(digest, np.uint64)[0]
            i += 1
            continue
        part = values[data[base : ends[j - 1]]]
        part *= _POW[: len(part)]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        s = starts[i:j] - base
        out[i:j] = (sums[ends[i:j] - base] - sums[s]) * _INV[s]
        i = j
    return mix(out)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more entry: the end)."""
    data, at = joined(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends = runs(WORD[data])
    return run_hashes(data, starts, ends), np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Hash of the n words from each place on (also across texts; callers mind the ends)."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[i : i + count]
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    ends = np.cumsum(lengths)[:-1]
    step[ends] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def trim() -> None:
    """Give freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean() -> None:
    """Have large arrays go back to the system once they are freed, Arrow's too."""
    pa.set_memory_pool(pa.system_memory_pool())
    if _OPTION is not None:
        _OPTION(-3, 1 << 20)  # M_MMAP_THRESHOLD; a set one no longer grows


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `limit` bytes of text (one row at least)."""
    lean()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, i = np.cumsum(sizes), 0
        while i < len(sizes):
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(i, j - i)
            i = j
        del batch
        trim()
