import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrace.llm import negatives, queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, _row string, rank int, code string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def vectors(n, size, labels, seed=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 0.4, (n, size)), 1).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], int(rng.integers(0, labels))) for i in range(n)]
    rows += [(7 * n, rows[0][1], 1), (7 * n, rows[0][1], 1), (8 * n, rows[0][1], 2)]  # repeated and equal rows
    odd = [None, [math.nan] * size, [math.inf] * size, [None] * size]
    return rows + [(9 * n + i, v, 1) for i, v in enumerate(odd)] + [(9 * n + 9, rows[1][1], None)]


def floors(v, scale):
    return [math.floor(scale * float(c)) for c in v]


def brute_negatives(rows, every):
    kept = [(i, v, floors(e, 256), y) for i, (v, e, y) in enumerate(rows) if e is not None and y is not None and all(c is not None and math.isfinite(c) for c in e)]
    out = []
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for i, v, e, y in kept:
        if v is None or v % every:
            continue
        scored = [(sum(a * b for a, b in zip(e, f)), w, z) for j, w, f, z in kept if j != i and len(f) == len(e)]
        for ps, p, _ in sorted([x for x in scored if x[2] == y], key=key)[:5]:
            inside = sorted([x for x in scored if x[2] != y and 80 * ps <= 100 * x[0] <= 100 * ps], key=key)[:5]
            out += [(v, p, k + 1, n, ps, s) for k, (s, n, _) in enumerate(inside)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,tile", [(8192, 256), (16, 2)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(negatives, "TILE", tile)
    rows = vectors(120, 6, 3) + [(None, [0.5] * 6, 1), (1000, [0.5, 0.5], 1), (1001, [0.5, 0.5], 1), (1002, [0.4, 0.5], 2), (2000, [], 1), (2001, [], 1), (2002, [], 2)]
    got = negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 10)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 50


def test_no_anchors_and_no_rows(spark):
    rows = table(spark, vectors(10, 4, 2))
    assert negatives.hard_negatives(rows, F.lit(False)).collect() == []
    assert negatives.hard_negatives(rows.limit(0), F.lit(True)).collect() == []


def test_vectors_out_of_range_are_told(spark):
    with pytest.raises(ValueError):
        negatives.hard_negatives(table(spark, [(0, [1e9, 1e9], 1)]), F.lit(True))
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(0, [1e9, 1e9], 1)]))


@pytest.mark.parametrize("width,most", [(1, 3), (64, 300), (65, 5_000), (200, 1_000_000), (3, 1 << 26)])
def test_residue_products_are_exact(width, most):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-most, most + 1, (9, width)), rng.integers(-most, most + 1, (7, width))
    a[0], b[0], b[1] = most, most, -most  # as large as they get
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert negatives.scores(a, b, width * most * most).tolist() == want


def test_as_many_primes_as_scores_need():
    assert [len(negatives.primes_for(b)) for b in (510, 511, 520_000, 530_000)] == [1, 2, 2, 3]
    assert all((p // 2) ** 2 * 64 < 1 << 24 and all(p % d for d in range(2, 32)) for p in negatives.PRIMES)


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(v, floors(e, 1024), y) for v, e, y in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    width = parts * -(-max(len(e) for _, e, _ in kept) // parts)
    kept = [(v, np.array(e + [0] * (width - len(e))).reshape(parts, -1), y) for v, e, y in kept]
    books = [[e[p].copy() for _, e, _ in sorted(kept, key=lambda x: (x[0] is None, x[0] or 0))[:entries]] for p in range(parts)]
    near = lambda p, x: min(((int(((x - c) ** 2).sum()), k) for k, c in enumerate(books[p])))
    for _ in range(rounds):
        for p in range(parts):
            at = {}
            for _, e, _ in kept:
                at.setdefault(near(p, e[p])[1], []).append(e[p])
            for k, x in at.items():
                books[p][k] = np.array([sum(int(r[d]) for r in x) // len(x) for d in range(len(x[0]))])
    out = []
    for v, e, y in kept:
        found = [near(p, e[p]) for p in range(parts)]
        out.append((v, y, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


@pytest.mark.parametrize("n,size,entries", [(150, 8, 256), (150, 8, 70), (90, 6, 20), (3, 4, 256)])
def test_codes_equal_brute_force(spark, n, size, entries):
    rows = vectors(n, size, 4)[:-9 if n == 3 else None]
    rows += [(-1, [0.25] * (size - 2), 9), (-2, [], None)]  # shorter, and empty
    coded, books = vector_codes.compress(table(spark, rows), entries=entries)
    want, brute = brute_codes(rows, entries=entries)
    assert sorted(map(tuple, coded.select("vec_id", "label", "code", "error").collect()), key=repr) == sorted(want, key=repr)
    assert [b.tolist() for b in books] == [[c.tolist() for c in b] for b in brute]
    sums = {}
    for _, y, _, e in want:
        sums[y] = sums.get(y, 0) + e
    assert {(r["label"], r["label_error"]) for r in vector_codes.with_label_errors(coded).collect()} == set(sums.items())


def test_no_vectors_to_code(spark):
    for rows in (table(spark, []), table(spark, [(1, None, 1)])):
        coded, books = vector_codes.compress(rows)
        assert vector_codes.with_label_errors(coded).collect() == [] and all(len(b) == 0 for b in books)


def test_slices_hold_every_entry_within_the_radius():
    rng = np.random.default_rng(3)
    book, x = rng.integers(-50, 50, (130, 5)), rng.integers(-60, 60, (40, 5))
    book[7] = book[90]
    s = vector_codes.Slices(book)
    for radius in (0, 9, 30, 500):
        mask = s.candidates(x, np.full(len(x), radius))
        for v, m in zip(x, mask):
            held = {64 * w + b for w, b in itertools.product(range(3), range(64)) if int(m[w]) >> b & 1}
            assert held == {k for k, e in enumerate(book) if (np.abs(e - v) <= radius).all()}
    entry, far = s.nearest(np.r_[x, book])
    d = ((np.r_[x, book][:, None] - book[None]) ** 2).sum(2)
    assert (entry == d.argmin(1)).all() and (far == d.min(1)).all()


@pytest.mark.parametrize("name", ["op11_residue_negatives", "op13_sliced_codes"])
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    df, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
