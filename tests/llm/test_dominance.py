import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagetrace.llm import bytebpe, dominance

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def whole():
    return Tokenizer.from_file(VOCABULARY)


def filled(runs):
    """Every sequence as a list of lengths."""
    return [[s for s, each in held for _ in range(each)] for many, held in runs for _ in range(many)]


def optimum(items, window):
    """Fewest sequences, by search over all ways to place the items in turn."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) + max(0, -(-(sum(items[i:]) - sum(window - b for b in bins)) // window)) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in sorted({b for b in bins if b + items[i] <= window}, reverse=True):
            rest = list(bins)
            rest.remove(b)
            place(i + 1, [*rest, b + items[i]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def counted(items):
    return {s: items.count(s) for s in set(items)}


@pytest.mark.parametrize("low,high,n", [(1, 20, 10), (6, 20, 12), (5, 12, 12), (6, 9, 12), (7, 10, 12)])
def test_reduction_keeps_the_optimum(low, high, n):
    rng, fixed = random.Random(low * 100 + n), 0
    for _ in range(60):
        items = [rng.randint(low, high) for _ in range(n)]
        left = dominance.Lengths(counted(items))
        runs = dominance.reduced(left, 20)
        rest = [s for s, k in left.counts.items() for _ in range(k)]
        assert sorted([s for b in filled(runs) for s in b] + rest) == sorted(items)
        assert all(sum(b) <= 20 for b in filled(runs))
        fixed += len(items) - len(rest)
        assert len(filled(runs)) + (optimum(rest, 20) if rest else 0) == optimum(items, 20)
    assert fixed > 60


def by_hand(items, window):
    bins = []
    for s in sorted(items, reverse=True):
        fits = [b for b in range(len(bins)) if sum(bins[b]) + s <= window]
        if fits:
            bins[max(fits, key=lambda b: sum(bins[b]))].append(s)
        else:
            bins.append([s])
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_best_fit_by_hand(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, rng.choice([5, 30, 100])) for _ in range(300)]
    got = filled(dominance.best_fit(dominance.Lengths(counted(items)), 100))
    assert sorted(s for b in got for s in b) == sorted(items)
    # of sequences with the same room any may be taken
    assert sorted(map(sum, got)) == sorted(map(sum, by_hand(items, 100)))


def test_large_counts_stay_few_runs():
    rng = random.Random(1)
    counts = {s: rng.randint(1, 10**9) for s in range(1, 1025)}
    runs = dominance.packed(counts, 1024)
    assert len(runs) < 10_000
    made = {}
    for many, held in runs:
        assert sum(s * each for s, each in held) <= 1024
        for s, each in held:
            made[s] = made.get(s, 0) + many * each
    assert made == counts
    assert sum(m for m, _ in runs) <= -(-sum(s * n for s, n in counts.items()) // 1024) * 1.02


def test_places_give_each_rank_one_place():
    runs = dominance.packed({3: 7, 5: 4, 2: 11, 10: 2}, 10)
    table, taken = dominance.places(runs), {}
    for length, n in {3: 7, 5: 4, 2: 11, 10: 2}.items():
        own = table[table[:, 0] == length]
        for rank in range(n):
            _, first, sequence, each, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            taken.setdefault(sequence + (rank - first) // each, []).append((offset + (rank - first) % each * length, length))
    for held in taken.values():
        ends = 0
        for offset, length in sorted(held):
            assert offset == ends
            ends += length
        assert ends <= 10


HOSTILE = ["", " ", "\n", "a", " a", "a b  c   d\n\ne \n f\t\tg \r\n h", "it's we'll I'D 'S don 't", "x<|endoftext|>y <|endoftext|> z<|endoftext|>", "<|endoftext", " a   b  ", "a b   c d", "é è　ü 日本 語", "1 22 333 a1b2", "\x1c a\x1f b \x85c", "😀 😀😀  👩‍👩‍👧", "a​b ​ c", "ᚁ  a᠎ b", "word " * 400, "ab" * 3000, " " * 500 + "x" + "\n" * 300, "\x00 a \x00"]


def test_chunked_ids_are_those_of_the_library():
    rng = random.Random(2)
    alphabet = [" ", " ", "\n", "\t", "\r", "a", "Bc", "é", "1", "'s", ".", ",", " ", " ", "　", "\u0085", "日", "<|endoftext|>", "<|", "😀", "\x1d", "​", "’", "-"]
    texts = HOSTILE + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    encoder = bytebpe.ByteEncoder(VOCABULARY)
    assert encoder.by_chunk
    for part in (texts, texts[::-1], [None, "", *texts[:50]]):
        ids, at = encoder.encode(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == whole().encode(t or "", add_special_tokens=False).ids, repr(t)


def test_chunks_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr("pagetrace.llm.textscan.run_hashes", lambda data, starts, ends, values=None: np.zeros(len(starts), np.uint64))
    text = " ".join(["different", "chunkings", "of length", "nine here", "different"] * 3)
    ids, _ = bytebpe.ByteEncoder(VOCABULARY).encode(pa.array([text]))
    assert ids.tolist() == whole().encode(text, add_special_tokens=False).ids


def check(got, docs, window, end=2):
    """Pieces against the library's ids; returns the sequences as lists of lengths."""
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append([*whole().encode(t or "", add_special_tokens=False).ids, end])
    pieces, sequences = {}, {}
    for r in got:
        x = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(x) == r["length"] <= window and (r["piece"] == 0 or r["length"] == window)
        pieces.setdefault((r["doc_id"], r["piece"], r["start"]), []).append(x)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for d, lists in ids.items():
        for x in lists:
            first = (len(x) - 1) % window + 1
            for k, a in enumerate([0, *range(first, len(x), window)]):
                want.setdefault((d, k, a), []).append(x[a : first if k == 0 else a + window])
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for held in sequences.values():
        ends = 0
        for offset, length in sorted(held):
            assert offset == ends
            ends += length
        assert ends <= window
    return [[n for _, n in held] for held in sequences.values()]


@pytest.mark.parametrize("window", [16, 1024])
def test_packed_documents(spark, window, monkeypatch):
    docs = [(i, t) for i, t in enumerate(HOSTILE)] + [(3, "again"), (3, "again"), (None, "no id"), (50, None), (51, "one two three " * 700)]
    df = spark.createDataFrame([(d, t, 7, "x", "z") for d, t in docs], "doc_id long, text string, piece int, rank string, ids string").repartition(3)
    got = dominance.pack(df, VOCABULARY, window=window).collect()
    sequences = check(got, docs, window)
    assert len(sequences) <= len(by_hand([n for s in sequences for n in s], window))
    monkeypatch.setattr(dominance, "FEW", 0)
    assert len({r["sequence_id"] for r in dominance.pack(df, VOCABULARY, window=window).collect()}) == len(sequences)


def test_sf_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sequences = check(dominance.pack(docs, VOCABULARY).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 1024)
    tokens = sum(map(sum, sequences))
    assert len(sequences) <= 1.02 * -(-tokens // 1024)


def test_no_documents(spark):
    assert dominance.pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


def test_query_gives_the_contracts_columns(spark, sf_dir):
    from pagetrace.llm import queries

    got = queries.QUERIES["op12_dominance_packing"](spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in got.where("start = 0").limit(40).collect():
        ids = [*whole().encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 2][: r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
