import re

import numpy as np
import pyarrow as pa
import pytest

from pagetrace.llm import order_minhash as om
from pagetrace.llm import textscan


def brute_edits(a, b):
    row = np.arange(len(b) + 1)
    for x in a:
        step = np.r_[row[0] + 1, np.minimum(row[:-1] + (b != x), row[1:] + 1)]
        row = np.minimum.accumulate(step - np.arange(len(step))) + np.arange(len(step))
    return int(row[-1])


def test_alignment_equals_dynamic_programming():
    draw = np.random.default_rng(3)
    pairs, most = [], []
    for i in range(600):
        a = draw.integers(0, 5 if i % 2 else 60, draw.integers(0, 150)).astype(np.uint32)
        b = a.copy() if i % 3 else draw.integers(0, 5, draw.integers(0, 40)).astype(np.uint32)
        for _ in range(draw.integers(0, 50)):
            if len(b):
                at = draw.integers(0, len(b))
                b = (np.delete(b, at), np.insert(b, at, 7), np.r_[b[:at], np.uint32(3), b[at + 1 :]].astype(np.uint32))[draw.integers(0, 3)]
        pairs.append((a, b.astype(np.uint32)))
        most.append(int(draw.integers(0, 70)))
    want = [brute_edits(a, b) for a, b in pairs]
    assert om.edits(pairs, most).tolist() == [w if w <= m else -1 for w, m in zip(want, most)]


def test_word_hashes_follow_words():
    texts = ["The cat, the CAT!", None, "", "é É", "x" * 600_000 + " x", "a\tb\nthe"]
    hashes, at = textscan.words(pa.array(texts))
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len({(w, int(h)) for w, h in zip(flat, hashes)}) == len(set(flat)) == len(set(hashes.tolist()))


def test_sketches_follow_order():
    words = textscan.mix(np.arange(1, 200, dtype=np.uint64))
    swapped = np.r_[words[100:], words[:100]]
    edited = words.copy()
    edited[90] += np.uint64(1)
    agree = lambda x: int((om.sketch(words) == om.sketch(x)).sum())
    assert agree(words) == om.SKETCHES and agree(edited) > agree(swapped)
    repeated = np.tile(words[:10], 5)
    assert len(set(om._occurrences(textscan.shingles(repeated)).tolist())) == 5


def texts(n, seed):
    draw = np.random.default_rng(seed)
    return [" ".join("w%d" % w for w in draw.integers(0, 50_000, draw.integers(80, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    base = texts(40, 1)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, t.upper().replace(" ", ",  ")) for i, t in enumerate(base[:5])]  # equal words
    out += [(200 + i, t + " one more") for i, t in enumerate(base[5:10])]  # near
    out += [(1000 + i, base[20].replace(base[20].split()[10 + i % 60], "changed%d" % i)) for i in range(60)]  # a large group
    shared = " ".join(f"s{i}" for i in range(60))
    out += [(2000 + i, shared + " " + t[:400]) for i, t in enumerate(texts(60, 2))]  # a passage that clean documents share
    out += [(3000, None), (3001, None), (None, base[0]), (None, base[0]), (3002, ""), (3003, ""), (3004, "!!!"), (3005, "ab"), (3006, "AB."), (3007, base[39]), (3007, base[39])]
    return out


def test_classes(spark, rows):
    rows = rows + [(3008, "one text of this number"), (3008, "another text, of the same number"), (3009, "another text of the same number"), (None, "nobody's words")]
    found = om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {r["doc_id"]: r for r in found if r["doc_id"] not in (None, 3008)}
    cls = {d: r["class_id"] for d, r in got.items()}
    assert all(cls[100 + i] == i for i in range(5)) and all(cls[200 + i] == 5 + i for i in range(5))
    assert {cls[1000 + i] for i in range(60)} == {20}
    assert all(cls[2000 + i] == 2000 + i for i in range(60))
    assert cls[3000] == 3000 and cls[3001] == 3001 and cls[3003] == 3002 and cls[3004] == 3004 and cls[3006] == 3005 and cls[3007] == 39
    assert got[3007]["copies"] == 2 and len(found) == len(set(rows)) and sum(r["copies"] for r in found) == len(rows)
    # two texts of one number are two rows, one of them a copy of 3009; rows without a number are like any other
    assert sorted((r["class_id"], r["kept"]) for r in found if r["doc_id"] == 3008) == [(3008, True), (3008, True)] and cls[3009] == 3008 and not got[3009]["kept"]
    assert sorted(((r["class_id"], r["kept"], r["copies"]) for r in found if r["doc_id"] is None), key=str) == [(0, False, 2), (None, True, 1)]
    assert all(sum(r["kept"] for r in found if r["class_id"] == c) == 1 for c in cls.values() if c != 3008)


def test_deduplicate_keeps_one_of_each(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 7, 1) for d, t in rows] + [(4000, "lone words here for once", "x", 1, 1)] * 2, "doc_id long, text string, id string, copies int, kept_id int")
    got = om.deduplicate(df)
    assert got.columns == df.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(None) == 0 and ids.count(4000) == 1 and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert not {i for i in ids if i is not None and (100 <= i < 300 or 1000 <= i < 1060)}
    assert om.near_duplicates(df.limit(0)).count() == 0 and om.deduplicate(df.limit(0)).count() == 0


def test_recall_at_word_shingle_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cls = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(docs).collect()}
    sets, inverse = {}, {}
    for r in docs.collect():
        w = re.findall(r"\w+", r["text"].lower())
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for s in sets[r["doc_id"]]:
            inverse.setdefault(s, []).append(r["doc_id"])
    pairs = {(a, b) for v in inverse.values() for a in v for b in v if a < b}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    far = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) < 0.1 * len(sets[a] | sets[b])]
    assert len(near) > 20 and all(cls[a] == cls[b] for a, b in near)
    assert not [p for p in far if cls[p[0]] == cls[p[1]]]


def test_longer_copies_do_not_part_base_and_shorter_copy(spark):
    base = texts(1, 11)[0].split()[:80]
    tail = [" ".join(f"t{i}x{j}" for j in range(16)) for i in range(60)]
    rows = [(i, " ".join(base) + " " + t) for i, t in enumerate(tail)] + [(100, " ".join(base)), (101, " ".join(base[:68]))]
    got = om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


@pytest.mark.parametrize("hub", [2, 32, 1000])
def test_large_buckets_equal_brute_force(spark, hub, monkeypatch):
    """Classes are those of all pairs that agree in a sketch and align, whichever components take part as one."""
    monkeypatch.setattr(om, "HUB", hub)
    draw, rows = np.random.default_rng(5), []
    for family in range(3):
        base = [f"f{family}x{i}" for i in range(90)]
        for _ in range(60):  # prefixes and suffixes of many lengths, with other words beyond them
            a, b = int(draw.integers(0, 14)), int(draw.integers(76, 91))
            rows.append((len(rows), " ".join([*(f"n{x}" for x in draw.integers(0, 10**6, draw.integers(0, 25))), *base[a:b], *(f"n{x}" for x in draw.integers(0, 10**6, draw.integers(0, 12)))])))
    words, at = textscan.words(pa.array([t for _, t in rows]))
    words = [words[at[i] : at[i + 1]] for i in range(len(rows))]
    keys, parent = [om.sketch(w) for w in words], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if (keys[i] == keys[j]).any()]
    alike = om.similar([(words[i], words[j]) for i, j in pairs])
    for (i, j), s in zip(pairs, alike):
        if s >= 0:
            i, j = sorted((root(i), root(j)))
            parent[j] = i
    bits, n_words = om.bags(np.concatenate(words), at).view(np.uint64), np.diff(at)
    assert om.may_align(bits, n_words, *np.array(pairs)[alike >= 0].T).all()
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: root(i) for i in range(len(rows))} and 3 < len(set(got.values())) < 100


def test_rarest_word_pairs_of_similar_texts_meet():
    draw = np.random.default_rng(8)
    levels = draw.integers(0, 40, om.COUNTERS).astype(np.uint8)
    for n in [5, 6, 8, 9, 10, 11, 14, 50, 199, 400]:
        for _ in range(20):
            a = draw.integers(0, 300, n).astype(np.uint64)
            b = a.copy()
            for _ in range(int(0.2 * n)):
                at = draw.integers(0, len(b))
                b = (np.delete(b, at), np.insert(b, at, draw.integers(0, 10**9)), np.r_[b[:at], np.uint64(draw.integers(0, 10**9)), b[at + 1 :]])[draw.integers(0, 3)]
            if om.similar([(a, b)])[0] >= 0:
                assert np.intersect1d(om.rarest(a, levels), om.rarest(b, levels)).size


def edited(words, share, draw):
    """words with that share of them replaced, dropped or followed by others, at random places."""
    out = list(words)
    for at in sorted(draw.choice(len(words), int(share * len(words)), replace=False).tolist(), reverse=True):
        new = f"n{draw.integers(0, 10**9)}"
        out[at : at + 1] = ([new], [], [out[at], new])[draw.integers(0, 3)]
    return out


def test_recall_at_alignment_similarity(spark):
    """Nine of ten pairs with a similarity of 0.8 or more, at each share of edits from 5 to 20 %."""
    draw, rows, shares = np.random.default_rng(9), [], (0.05, 0.1, 0.15, 0.17, 0.19)
    for i, share in enumerate(np.repeat(shares, 60)):
        words = [f"w{x}" for x in draw.integers(0, 5000, int(draw.integers(120, 500)))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(words, share, draw)))]
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    ids = {w: i for i, w in enumerate({w for _, t in rows for w in t.split()})}
    words = [np.array([ids[w] for w in t.split()], np.uint64) for _, t in rows]
    for n, share in enumerate(shares):
        true = [i for i in range(60 * n, 60 * n + 60) if 1 - brute_edits(words[2 * i], words[2 * i + 1]) / max(len(words[2 * i]), len(words[2 * i + 1])) >= 0.8]
        assert len(true) > 30 and sum(got[2 * i] == got[2 * i + 1] for i in true) >= 0.9 * len(true), share
    assert not [i for i in range(300) if got[2 * i] not in (2 * i,)]


def changed(words, edits, draw):
    """The words with that many edits: replaced, left out or put in."""
    out = list(words)
    for e, at in enumerate(sorted(draw.choice(len(words), edits, replace=False), reverse=True)):
        kind = int(draw.integers(0, 3))
        out[at : at + (kind != 2)] = [f"new{e}x{draw.integers(1 << 30)}"] * (kind != 1)
    return out


@pytest.mark.parametrize("n", [5, 10, 15, 20, 30, 45, 60, 100])
def test_recall_of_short_texts(n):
    """Nine of ten pairs at similarities of 0.80 to 0.85 agree in a sketch, at every length."""
    draw = np.random.default_rng(n)
    of = lambda ws: set(om.keys_of(textscan.words(pa.array([" ".join(ws)]))[0]).tolist())
    met = tried = 0
    while tried < 150:
        words = [f"w{draw.integers(1 << 30)}" for _ in range(n)]
        other = changed(words, max(1, int(0.2 * n)), draw)
        similarity = 1 - brute_edits(words, np.array(other)) / max(len(words), len(other))
        if 0.8 - 1e-9 <= similarity <= 0.85:
            tried += 1
            met += bool(of(words) & of(other))
    assert met >= 0.9 * tried, met / tried


def test_classes_of_tiny_texts_equal_brute_force(spark):
    draw = np.random.default_rng(9)
    rows = []
    for g in range(60):
        words = [f"g{g}w{k}" for k in range(int(draw.integers(1, 25)))]
        rows.append((len(rows), " ".join(words)))
        rows += [(len(rows) + c, " ".join(changed(words, int(0.15 * len(words)), draw))) for c in range(2)]
    links = [(a, b) for a, x in rows for b, y in rows if a < b and a // 3 == b // 3 and 1 - brute_edits(x.split(), np.array(y.split())) / max(len(x.split()), len(y.split()), 1) >= 0.8 - 1e-9]
    of = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(of[a] == of[b] for a, b in links) >= 0.97 * len(links)
    assert all(of[a] != of[b] for a in of for b in of if a // 3 != b // 3)


def test_recall_of_all_aligned_pairs_of_the_table(spark):
    """Every pair of a source's documents that shares a word in twenty, aligned by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cls = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(docs).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words, at = textscan.words(pa.array([t for _, t in rows]))
    words = [words[i:j] for i, j in zip(at, at[1:])]
    levels = np.zeros(om.COUNTERS, np.uint8)
    seen, pairs = {}, set()
    for i, w in enumerate(words):
        for k in om.rarest(w, levels).tolist() if len(w) else []:
            for j in seen.setdefault(k, []):
                if min(len(w), len(words[j])) >= 0.8 * max(len(w), len(words[j])):
                    pairs.add((j, i))
            seen[k].append(i)
    pairs = sorted(pairs)
    alike = [p for p, s in zip(pairs, om.similar([(words[i], words[j]) for i, j in pairs])) if s >= 0]
    assert len(alike) > 50 and sum(cls[rows[i][0]] == cls[rows[j][0]] for i, j in alike) >= 0.9 * len(alike)
