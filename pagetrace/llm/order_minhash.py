"""Near-duplicates by Order MinHash and banded alignment.

A document's k-mers (k words) are labelled with their occurrence number.  Each
sketch draws the `picked` least k-mers under its own hash and retains them in
text order, so two documents agree in a sketch only if they share those k-mers
in the same order: the sketch follows edit similarity, not just overlap.
Documents that agree in a sketch are candidates; a banded alignment of their
words verifies that 1 - edits / words of the longer is at least the threshold.
Two documents with a share r of edited words share s = (1 - r) ** k of their
k-mers and agree in a sketch with about (s / (2 - s)) ** picked, so SKETCHES = 60
find nine of ten pairs at a similarity of 0.8 and nearly all from 0.85 on.  Short
texts vary more around that and have more sketches, and in the shortest few
k-mers or none outlive the edits: those have sketches of pairs of words besides.

Equal word sequences are one class from the start.  Buckets of up to SMALL
classes give all their pairs, larger ones a star around their least member.  The
members of large buckets that are then not all connected go through an exact
join: of two texts that similar, one of the rarest two fifths of the word pairs
(and two more) of each is common to both.  A large component takes part in it as
one; its members and those that it may take in are aligned together, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import in_batches, release, stash
from .components import components

K, SKETCHES, PICKED, SMALL, THRESHOLD = 5, 60, 2, 16, 0.8
#: Texts of up to so many words have so many sketches.
SHORT, SHORT_SKETCHES = 128, 180
#: Texts of 3 words to so many have so many more, of k-mers of two words.
TINY, TINY_K, TINY_SKETCHES = 30, 2, 64
#: Counters by which word pairs are told rare or frequent, each for all of one hash.  Only speed depends on them.
COUNTERS = 1 << 22
#: Components of more open members than this take part in the exact join as one.
HUB = 32
#: Wanted rows of up to this number are broadcast to the texts, more are joined with a shuffle.
FEW_ROWS = 500_000
#: Bits of a bag, for words and for pairs of words in a row: which of so many bins of their hashes hold at least 1, 2 ... up to so many levels.
BAGS = ((1, 512, 4), (2, 1024, 2))


def _occurrences(keys: np.ndarray) -> np.ndarray:
    """For each key, how often it has come before."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]] if len(keys) else np.empty(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - begin
    return out


def sketch(words: np.ndarray, k: int = K, sketches: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """One 64-bit key for each sketch of a word-hash sequence (of fewer than k words: one k-mer of all)."""
    grams = textscan.shingles(words, min(k, max(1, len(words))))
    grams = textscan.mix(grams + _occurrences(grams).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    seeds = textscan.mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    short, salt = (grams >> np.uint64(32)).astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32)
    n, width = min(picked, len(grams)), max(1, (1 << 18) // len(grams))
    least = np.empty((sketches, n), np.int64)
    for s in range(0, sketches, width):
        ranked = (short[None, :] ^ salt[s : s + width, None]) * np.uint32(0x85EBCA6B)
        ranked ^= ranked >> np.uint32(15)
        ranked *= np.uint32(0xC2B2AE35)
        row = np.arange(len(ranked))
        for i in range(n):
            least[s : s + width, i] = at = ranked.argmin(1)
            ranked[row, at] = 0xFFFFFFFF
    drawn, out = grams[np.sort(least, axis=1)], seeds.copy()
    for i in range(n):
        out = (out ^ drawn[:, i]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out


def keys_of(words: np.ndarray) -> np.ndarray:
    """All sketches of a text of that many words; the first SKETCHES are of every text."""
    if len(words) > SHORT:
        return sketch(words)
    own = sketch(words, sketches=SHORT_SKETCHES)
    return np.r_[own, sketch(words, TINY_K, TINY_SKETCHES)] if 3 <= len(words) <= TINY else own


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, where each begins, and two 64-bit digests of each text's word sequence."""
    words, at = textscan.words(texts)
    place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
    out = np.zeros((len(at) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(at))
    for d, odd in enumerate((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))):
        each = textscan.mix(words + textscan.mix(place.astype(np.uint64) * odd + odd))
        if len(full):
            out[full, d] = np.add.reduceat(each, at[full])
    return words, at, out


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the words that both begin and end with; they need no edits."""
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[:least] != b[:least])
    head = int(differ[0]) if len(differ) else least
    a, b = a[head:], b[head:]
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - least :][::-1] != b[len(b) - least :][::-1])
    tail = int(differ[0]) if len(differ) else least
    return a[: len(a) - tail], b[: len(b) - tail]


def _binned(a: np.ndarray, b: np.ndarray, bins: int = 1024) -> int:
    """An upper bound of the words in common, by bins of their hashes."""
    x, y = (np.bincount((c & np.uint64(bins - 1)).astype(np.int64), minlength=bins) for c in (a, b))
    return int(np.minimum(x, y).sum())


def _unlike(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edits: words of the longer that the other lacks."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return max(len(a), len(b)) - int(np.minimum(ca[i], cb[j]).sum())


def bags(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits of the BAGS of each text, as bytes.

    Of each of the BAGS, the bits that two texts share, and the least of how many
    n-grams each has beyond its bits, add up to no less than what they have in common.
    """
    count, out = len(at) - 1, []
    text = np.repeat(np.arange(count), np.diff(at))
    for n, bins, levels in BAGS:
        grams = textscan.shingles(words, n)
        own = text[: len(grams)] == text[n - 1 :]  # not across texts
        many = np.bincount((text[: len(grams)] * bins + (grams >> np.uint64(40)).astype(np.int64) % bins)[own], minlength=count * bins).reshape(count, bins)
        out += [many >= level for level in range(1, levels + 1)]
    return np.packbits(np.concatenate(out, axis=1), axis=1)


def may_align(bits: np.ndarray, n_words: np.ndarray, x: np.ndarray, y: np.ndarray, pairs: int = 1 << 15) -> np.ndarray:
    """Which pairs (x, y) of texts may have a similarity of THRESHOLD by their bags (rows of 64-bit words).

    Never denied wrongly: an edit changes at most n of the n-grams of the longer.
    """
    out, begin = np.ones(len(x), bool), 0
    for n, bins, levels in BAGS:
        part = np.ascontiguousarray(bits[:, begin : begin + bins * levels // 64])
        begin += bins * levels // 64
        grams = np.maximum(n_words - n + 1, 0)
        rest = grams - np.bitwise_count(part).sum(1, dtype=np.int64)
        left = np.flatnonzero(out)
        for i in range(0, len(left), pairs):
            k = left[i : i + pairs]
            a, b = x[k], y[k]
            common = np.bitwise_count(part[a] & part[b]).sum(1, dtype=np.int64) + np.minimum(rest[a], rest[b])
            most = ((1 - THRESHOLD) * np.maximum(n_words[a], n_words[b]) + 1e-9).astype(np.int64)
            out[k] = np.maximum(grams[a], grams[b]) - common <= n * most
    return out


def within(a: list, b: list, most: int) -> int:
    """Insertions, deletions and substitutions that turn a into b, or -1 if that takes more than `most`.

    Banded alignment in bits: a row of the band of 2 * most + 2 diagonals is one
    number for each kind of step (up, down) between its cells.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return -1
    most = min(most, len(a))
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    width = 2 * most + 2
    full, corner, edge = (1 << width) - 1, 1 << width - 1, 1 << width - 2
    up, down, score, start = full << width - most - 1 & full, 0, most, most + 1 - width
    for i, word in enumerate(b):
        same = places.get(word, 0)
        if same:
            same = (same >> start if start >= 0 else same << -start) & full
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right_up, right_down = down | (full & ~(diagonal | up)), diagonal & up
        if i < len(a) - most:  # the lowest diagonal, which only grows
            if not diagonal & corner:
                score += 1
                if score > 2 * most + len(b) - len(a):
                    return -1
        else:  # the last row
            score += bool(right_up & edge) - bool(right_down & edge)
            edge >>= 1
        diagonal >>= 1
        up, down = right_down | (full & ~(diagonal | right_up)), diagonal & right_up
        start += 1
    return score if score <= most else -1


def edits(pairs: list[tuple[np.ndarray, np.ndarray]], most: list[int]) -> np.ndarray:
    """Insertions, deletions and substitutions that turn a into b, for each pair; -1 if more than its `most`.

    A band not much wider than the words that differ first, four times as wide for what it leaves open.
    """
    out = np.full(len(pairs), -1, np.int64)
    for k, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > most[k]:
            continue
        a, b = _trimmed(a, b)
        longer = max(len(a), len(b))
        if not len(a) or not len(b):
            out[k] = longer if longer <= most[k] else -1
        elif longer - _binned(a, b) <= most[k] and (least := _unlike(a, b)) <= most[k]:
            x, y, band = a.tolist(), b.tolist(), min(least + least // 4 + 16, most[k])
            while (found := within(x, y, band)) < 0 and band < most[k]:
                band = min(4 * band, most[k])
            out[k] = found
    return out


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], threshold: float = THRESHOLD) -> np.ndarray:
    """1 - edits / words of the longer for each pair, or -1 if that is under the threshold."""
    longer = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    found = edits(pairs, ((1 - threshold) * longer + 1e-9).astype(int).tolist())
    return np.where(found >= 0, 1 - found / np.maximum(longer, 1), -1.0)


def _text_hash() -> Column:
    return F.xxhash64("text")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), "text")


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, d1, d2, n_words, sketches of every row that has a text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textscan.slices(batches):
            words, at, digest = digests(part.column("text"))
            sizes = np.diff(at)
            for i in np.flatnonzero(sizes == 0):  # no words: the text itself
                digest[i] = np.frombuffer(textscan.hashlib.blake2b((part.column("text")[int(i)].as_py() or "").encode(), digest_size=16).digest(), np.uint64)
            each = [keys_of(words[at[i] : at[i + 1]]) if sizes[i] else np.empty(0, np.uint64) for i in range(len(sizes))]
            keys = np.concatenate([*each, np.empty(0, np.uint64)])
            cuts = np.r_[0, np.cumsum([len(e) for e in each])].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys.view(np.int64)))],
                ["doc_id", "text_hash", "d1", "d2", "n_words", "sketches"],
            )

    return _rows(in_batches(docs).where(F.col("text").isNotNull())).mapInArrow(rows, "doc_id long, text_hash long, d1 long, d2 long, n_words int, sketches array<long>")


def _near(x: str, y: str) -> str:
    return f"least({x}, {y}) >= {THRESHOLD} * greatest({x}, {y}) - 1e-9"


def _candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: key, id, n_words.  Pairs (a, b) with a < b, and the rows of buckets that gave only a star."""
    # written first, so that a large bucket's rows can be dealt to several tasks
    count = stash(rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "n_words")).alias("first")).where("n > 1"))
    held = stash(rows.join(count, "key").select("key", "id", "n_words", "n", F.col("first.id").alias("centre"), F.col("first.n_words").alias("centre_words")))
    star = held.where(f"id <> centre and {_near('n_words', 'centre_words')}").select(F.col("centre").alias("a"), F.col("id").alias("b"))
    few = held.where(f"n > 2 and n <= {SMALL} and id <> centre").select("key", "id", "n_words")
    other = few.select("key", F.col("id").alias("b"), F.col("n_words").alias("w"))
    pairs = few.join(other, "key").where(f"id < b and {_near('n_words', 'w')}").select(F.col("id").alias("a"), "b")
    return star.union(pairs).distinct(), held.where(f"n > {SMALL}").select("key", "id", "n_words")


def _texts(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of one row of each class in ids (id)."""
    wanted = stash(classes.join(ids, "id", "left_semi").select("id", F.col("least.doc_id").alias("_doc_id"), F.col("least.text_hash").alias("_text_hash")))
    side = F.broadcast(wanted) if wanted.count() <= FEW_ROWS else wanted
    rows = _rows(in_batches(docs).where(F.col("text").isNotNull()))
    return rows.join(side, (F.col("text_hash") == F.col("_text_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))).select("id", "text")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, similarity of those pairs of classes that align."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textscan.slices(batches):
            words, at = textscan.words(part.column("text"))
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(words)])
            yield pa.RecordBatch.from_arrays([part.column("id"), data.cast(pa.binary())], ["id", "words"])

    packed = _texts(docs, classes, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()).mapInArrow(pack, "id long, words binary")
    packed = packed.groupBy("id").agg(F.first("words").alias("words"))  # of repeated rows
    sides = pairs.join(packed.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(packed.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textscan.slices(batches, "x", 4 << 20):
            x, y = part.column("x"), part.column("y")
            got = similar([(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(x, y)])
            keep = pa.array(got >= 0)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep), pa.array(got[got >= 0], pa.float64())], ["a", "b", "similarity"])

    return stash(sides.select("a", "b", "x", "y").mapInArrow(align, "a long, b long, similarity double"))


def _pairs(words: np.ndarray) -> np.ndarray:
    """Pairs of neighbouring words with their occurrence number; a text's are all different."""
    pairs = textscan.shingles(words, 2)
    return textscan.mix(pairs + _occurrences(pairs).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _counter(pairs: np.ndarray) -> np.ndarray:
    return (pairs >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _levels(texts: DataFrame) -> np.ndarray:
    """Of each counter, how often its word pairs occur in texts: 0 for once or never, then in eighths of a doubling."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.uint32)
        for part in textscan.slices(batches):
            words, at = textscan.words(part.column("text"))
            if len(words):
                own, n = np.unique(_counter(np.concatenate([_pairs(words[i:j]) for i, j in zip(at, at[1:])])), return_counts=True)
                seen[own] += n.astype(np.uint32)
        some = np.flatnonzero(seen)
        for i in range(0, len(some), 1 << 18):
            own = some[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(seen[own].astype(np.int64))], ["counter", "n"])

    found = texts.mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).where("n > 1")
    told = found.select("counter", F.least(F.lit(255), F.ceil(F.log2("n") * 8)).cast("short").alias("level")).toArrow()  # COUNTERS rows at most
    out = np.zeros(COUNTERS, np.uint8)
    out[told.column("counter").to_numpy()] = told.column("level").to_numpy()
    return out


def rarest(words: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The word pairs, labelled, of which two different texts have one in common if THRESHOLD of the longer's words agree.

    Those of the lowest levels; any order would do that is the same for all texts.
    An edit costs two pairs at most, and the longer text may allow one edit more.
    """
    own = _pairs(words)
    first = np.lexsort((own, levels[_counter(own)]))
    return own[first[: 2 * int((1 - THRESHOLD) * len(words) + 1e-9) + 2]].view(np.int64)


def _halves(rows: DataFrame) -> DataFrame:
    """rows (unit, parts) sent to every pair of blocks (first, second) of their group."""
    cut = rows.withColumn("block", F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int"))
    return cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("other", "parts")


def _meetings(told: DataFrame, block: int = 2048) -> DataFrame:
    """a, a_hub, b, b_hub: units of two components that may align, each a row or, if it is a hub, a component.

    told: id, n_words, component, size, keys, bag.  Rows meet at each of their
    rarest word pairs, those of large components as one unit of the component.
    Large groups are cut into pairs of blocks.  A
    pair of rows counts where it meets first, at the rarest pair that both have.
    """
    hub = F.col("size") > HUB
    keyed = told.select(F.when(hub, F.col("component")).otherwise(F.col("id")).alias("unit"), hub.alias("hub"), "component", "n_words", F.posexplode("keys").alias("place", "key"))
    keyed = keyed.groupBy("key", "unit", "hub").agg(F.first("component").alias("component"), F.min("n_words").alias("low"), F.max("n_words").alias("high"), F.min("place").alias("place"))
    keyed = stash(keyed)
    marks = (F.count("*").alias("n"), F.min("component").alias("first"), F.max("component").alias("last"))
    parts = stash(keyed.groupBy("key").agg(*marks).where("first <> last").select("key", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    rows = stash(keyed.join(parts, "key"))
    # a row's own keys that are left, those before each with it: as many as it has rarest pairs at most
    own = rows.where("not hub").groupBy("unit").agg(F.first("component").alias("component"), F.first("low").alias("low"), F.first("high").alias("high"), F.sort_array(F.collect_list(F.struct("place", "key", "parts"))).alias("left"))
    own = own.select("unit", "component", "low", "high", F.transform("left", lambda x: x["key"]).alias("all"), F.posexplode("left").alias("n", "x"))
    own = own.select("x.key", "unit", F.lit(False).alias("hub"), "component", "low", "high", "x.parts", F.slice("all", F.lit(1), F.col("n")).alias("before"))
    own = own.join(told.where(~hub).select(F.col("id").alias("unit"), "bag"), "unit")
    sent = _halves(own.unionByName(rows.where("hub").drop("place").withColumns({"bag": F.lit(None).cast("binary"), "before": F.lit(None).cast("array<long>")})))

    def meet(group: pa.Table) -> pa.Table:
        unit, hub, component, low, high, at = (group.column(c).to_numpy() for c in ("unit", "hub", "component", "low", "high", "block"))
        width = sum(bins * levels for _, bins, levels in BAGS) // 8
        bits = np.frombuffer(b"".join(b or b"\0" * width for b in group.column("bag").to_pylist()), np.uint64).reshape(len(unit), -1)
        low, high, first, second = low.astype(np.int64), high.astype(np.int64), group.column("first")[0].as_py(), group.column("second")[0].as_py()
        left, right, out, column, seen = np.flatnonzero(at == first), np.flatnonzero(at == second), [], group.column("before"), {}

        def before(i: int) -> set:
            if i not in seen:
                seen[i] = set(column[i].as_py())
            return seen[i]

        for i in range(0, len(left), 64):
            a, b = left[i : i + 64, None], right[None, :]
            near = (component[a] != component[b]) & (high[a] >= THRESHOLD * low[b] - 1e-9) & (high[b] >= THRESHOLD * low[a] - 1e-9)
            if first == second:
                near &= a < b
            x, y = np.nonzero(near)
            x, y = left[i + x], right[y]
            keep = hub[x] | hub[y]
            keep[~keep] = may_align(bits, high, x[~keep], y[~keep])
            for k in np.flatnonzero(keep & ~hub[x] & ~hub[y]).tolist():
                keep[k] = before(int(x[k])).isdisjoint(before(int(y[k])))
            out.append((x[keep], y[keep]))
        x, y = (np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out) if out else ((), ())))
        # a hub takes in rows; of two hubs, that with the greater number takes in the other
        turn = np.where(hub[x] != hub[y], hub[x], unit[x] > unit[y])
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        return pa.table({"a": unit[x], "a_hub": hub[x], "b": unit[y], "b_hub": hub[y]})

    return sent.groupBy("key", "first", "second").applyInArrow(meet, "a long, a_hub boolean, b long, b_hub boolean").distinct()


def _taken_in(visits: DataFrame, told: DataFrame, texts: DataFrame, block: int = 512) -> DataFrame:
    """a, b: a link for each row of visits (hub, id) that aligns with a member of the component hub.

    Members and visitors of a hub meet in pairs of blocks; there, a visitor is
    aligned with the members most like it first and is done with the first that aligns.
    """
    members = told.where(F.col("size") > HUB).select(F.col("component").alias("hub"), "id").join(visits.select("hub").distinct(), "hub", "left_semi").withColumn("member", F.lit(True))
    rows = members.unionByName(visits.select("hub", "id").withColumn("member", F.lit(False)))
    counts = stash(rows.groupBy("hub").agg(F.ceil(F.count_if("member") / block).cast("int").alias("member_parts"), F.ceil(F.count_if(~F.col("member")) / block).cast("int").alias("visitor_parts")))
    dealt = rows.join(counts, "hub").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("member"), F.col("member_parts")).otherwise(F.col("visitor_parts"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("visitor_parts")).otherwise(F.col("member_parts")) - 1)))
    dealt = dealt.select("hub", "id", "member", F.when(F.col("member"), F.col("own")).otherwise(F.col("other")).alias("m"), F.when(F.col("member"), F.col("other")).otherwise(F.col("own")).alias("v"))

    def align(group: pa.Table) -> pa.Table:
        ids, member = group.column("id").to_numpy(), group.column("member").to_numpy()
        words, at = textscan.words(group.column("text").combine_chunks())
        own, n, bits = [words[i:j] for i, j in zip(at, at[1:])], np.diff(at).astype(np.int64), bags(words, at).view(np.uint64)
        inside, out = np.flatnonzero(member), []
        for v in np.flatnonzero(~member).tolist():
            near = inside[np.minimum(n[inside], n[v]) >= THRESHOLD * np.maximum(n[inside], n[v]) - 1e-9]
            near = near[may_align(bits, n, near, np.full(len(near), v))]
            alike = np.bitwise_count(bits[near] & bits[v]).sum(1, dtype=np.int64) / np.maximum(n[near], n[v])
            near, done = near[np.argsort(-alike, kind="stable")], 0
            while done < len(near):
                some = near[done : done + 4 + done]
                got = np.flatnonzero(similar([(own[v], own[m]) for m in some.tolist()]) >= 0)
                if len(got):
                    out.append((ids[v], ids[some[got[0]]]))
                    break
                done += len(some)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return dealt.join(texts, "id").select("hub", "m", "v", "id", "member", "text").groupBy("hub", "m", "v").applyInArrow(align, "a long, b long")


def _opened(docs: DataFrame, classes: DataFrame, wide: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """a, b: links between components (found: node, component) of rows in buckets with several."""
    known = wide.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    unsettled = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    left = known.join(unsettled, "key", "left_semi").groupBy("id").agg(F.first("n_words").alias("n_words"), F.first("component").alias("component"))
    left = stash(left)
    if left.isEmpty():
        return left.select(F.col("id").alias("a"), F.col("id").alias("b"))
    texts = stash(_texts(docs, classes, left.select("id")).groupBy("id").agg(F.first("text").alias("text")))
    levels = docs.sparkSession.sparkContext.broadcast(_levels(texts))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textscan.slices(batches):
            words, at = textscan.words(part.column("text"))
            keys = [rarest(words[i:j], levels.value) for i, j in zip(at, at[1:])]
            cuts = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(keys))), pa.array([b.tobytes() for b in bags(words, at)], pa.binary())], ["id", "keys", "bag"])

    sizes = left.groupBy("component").agg(F.count("*").alias("size"))
    told = stash(texts.mapInArrow(tell, "id long, keys array<long>, bag binary").join(left, "id").join(stash(sizes), "component"))
    met = stash(_meetings(told))
    release(docs.sparkSession)
    single = met.where("not b_hub").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(pairs, ["a", "b"], "left_anti")
    links = _verified(single, docs, classes).select("a", "b")
    release(docs.sparkSession)
    visits = met.where("b_hub and not a_hub").select(F.col("b").alias("hub"), F.col("a").alias("id"))
    merged = met.where("b_hub and a_hub").select(F.col("b").alias("hub"), F.col("a").alias("component"))
    visits = visits.unionByName(merged.join(told.select("component", "id"), "component").select("hub", "id"))
    return links.unionByName(_taken_in(stash(visits), told, texts))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class_id, kept, copies for every different row of doc_id and text.

    class_id is the least doc_id of the row's class: equal word sequences (or
    equal texts, if they have no words) and rows linked by a verified similarity
    of THRESHOLD or more, directly or through others.  One row of a class is kept,
    that with the least doc_id (null last; of rows with one doc_id that with the
    least text_hash).  copies counts rows equal in both.  A row with a null text
    is a class of its own and kept; its text_hash is null.  An empty table gives no
    rows.  Columns other than doc_id and text are ignored.
    """
    rows = stash(_sketches(docs))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    # classes have numbers of their own, as doc_ids need not be unique
    classes = rows.groupBy("d1", "d2").agg(least, F.first("n_words").alias("n_words"), F.first("sketches").alias("sketches"))
    classes = stash(classes.withColumn("id", F.monotonically_increasing_id()))
    release(docs.sparkSession)
    pairs, wide = _candidates(classes.select("id", "n_words", F.explode("sketches").alias("key")))
    pairs, wide = stash(pairs), stash(wide)
    release(docs.sparkSession)
    found = stash(components(_verified(pairs, docs, classes).select("a", "b")))
    release(docs.sparkSession)
    links = stash(_opened(docs, classes, wide, pairs, found))
    release(docs.sparkSession)
    if not links.isEmpty():
        found = stash(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)))
    tied = classes.select("id", "d1", "d2", "least").join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = tied.groupBy("component").agg(F.min("least").alias("first"))
    told = stash(tied.join(first, "component").select("d1", "d2", "first"))
    seen = stash(rows.groupBy("doc_id", "text_hash", "d1", "d2").agg(F.count("*").alias("copies")))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    named = seen.join(told, ["d1", "d2"]).select("doc_id", "text_hash", F.col("first.doc_id").alias("class_id"), kept.alias("kept"), "copies")
    blank = docs.where(F.col("text").isNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("copies"))
    return named.unionByName(blank.select("doc_id", F.lit(None).cast("long").alias("text_hash"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), "copies"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near_duplicates; rows with a null text all stay."""
    kept = stash(near_duplicates(docs).where("kept and text_hash is not null").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), "copies"))
    one, more = kept.where("copies = 1").drop("copies"), kept.where("copies > 1").drop("copies")
    texts = docs.where(docs["text"].isNotNull())
    same = lambda k: (F.xxhash64(docs["text"]) == k["kept_hash"]) & docs["doc_id"].eqNullSafe(k["kept_id"])
    repeated = texts.join(more, same(more), "left_semi").dropDuplicates(["doc_id", "text"])
    return texts.join(one, same(one), "left_semi").unionByName(repeated).unionByName(docs.where(docs["text"].isNull()))
