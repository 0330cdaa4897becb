import os

import numpy as np
import pytest

from pagetrace.operators import vectors


def brute(rows, queries, k, floor):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    out = {}
    for q, v in queries:
        best = {}
        for i, e in rows:
            best[i] = max(best.get(i, -2), round(float(unit(v) @ unit(e)), 10))
        out[q] = sorted(((-s, i) for i, s in best.items() if s >= floor))[:k]
    return {(q, i, round(-s, 6), n + 1) for q, x in out.items() for n, (s, i) in enumerate(x)}


def searched(spark, rows, queries, k, floor, cells, probes=2, block=8192):
    found, held = vectors.in_cells(spark.createDataFrame(rows, "id long, embedding array<double>"), cells)
    got = vectors.top_k_each(found, held, spark.createDataFrame(queries, "query_id long, embedding array<double>"), k, floor, probes, block)
    return {(r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in got.collect()}


@pytest.mark.parametrize("cells,probes,block", [(1, 1, 8192), (12, 1, 16), (40, 3, 5)])
def test_search_equals_brute_force(spark, cells, probes, block):
    rng = np.random.default_rng(cells)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 300)] + rng.normal(0, 0.3, (300, 8))
    rows = [(i // 2, [float(c) for c in v]) for i, v in enumerate(x)]  # two vectors of an id
    rows += [(500 + i, rows[0][1]) for i in range(30)] + [(900, [0.0] * 8)]  # ties, and a zero vector
    queries = [(i, rows[i][1]) for i in range(0, 300, 7)] + [(1000, [0.0] * 8), (1001, [-c for c in rows[3][1]])]
    assert searched(spark, rows, queries, 5, 0.3, cells, probes, block) == brute(rows, queries, 5, 0.3)


def test_odd_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, 0.1])]
    assert {x[1] for x in searched(spark, rows, [(0, [1.0, 0.0]), (1, None)], 5, 0.0, 4)} == {1, 4}
    assert searched(spark, [], [(0, [1.0, 0.0])], 5, 0.0, 4) == set() and searched(spark, rows, [], 5, 0.0, 4) == set()


def saved(spark, at, rows, content="h"):
    vectors.save_index(spark.createDataFrame(rows, "id long, embedding array<double>"), at, "docs", "m", content)


def test_a_new_index_replaces_the_old_one(spark, tmp_path):
    at = str(tmp_path / "index")
    saved(spark, at, [(1, [1.0])])
    saved(spark, at, [(2, [2.0])], "h2")
    assert vectors.load_index(spark, at, "docs", "m", "h") is None
    assert [r["id"] for r in vectors.load_index(spark, at, "docs", "m", "h2").collect()] == [2]


def test_until_the_description_is_there_the_old_index_stays(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "index")
    saved(spark, at, [(1, [1.0])])
    monkeypatch.setattr(vectors, "_checksum", lambda v: 1 / 0)  # the writer dies after its vectors
    with pytest.raises(ZeroDivisionError):
        saved(spark, at, [(2, [2.0])], "h2")
    monkeypatch.undo()
    assert [r["id"] for r in vectors.load_index(spark, at, "docs", "m", "h").collect()] == [1]
    assert vectors.load_index(spark, at, "docs", "m", "h2") is None


@pytest.mark.parametrize("damage", ["cut", "gone", "other", "meta"])
def test_a_damaged_index_is_none(spark, tmp_path, damage):
    at = str(tmp_path / "index")
    saved(spark, at, [(i, [float(i)]) for i in range(50)])
    folder = next(d for d in os.listdir(at) if d.startswith("vectors-"))
    part = next(f for f in os.listdir(f"{at}/{folder}") if f.endswith(".parquet"))
    if damage == "cut":
        with open(f"{at}/{folder}/{part}", "r+b") as f:
            f.truncate(40)
    elif damage == "gone":
        os.remove(f"{at}/{folder}/{part}")
    elif damage == "other":
        spark.createDataFrame([(7, [1.0])], "id long, embedding array<double>").write.mode("append").parquet(f"{at}/{folder}")
    else:
        for f in os.listdir(f"{at}/meta"):
            if f.endswith(".json"):
                with open(f"{at}/meta/{f}", "w") as out:
                    out.write("{no json")
                os.path.exists(f"{at}/meta/.{f}.crc") and os.remove(f"{at}/meta/.{f}.crc")
    assert vectors.load_index(spark, at, "docs", "m", "h") is None
