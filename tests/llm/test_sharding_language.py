import heapq
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetrace.llm import language, sharding

SCHEMA = "doc_id long, text string, shard string, _group int"  # names that clash with the operator's own


def by_hand(sizes, shards):
    """Loads after every single group went to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    for n in sorted(sizes, reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + n, s))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


def test_longest_first_is_least_loaded():
    assert sharding.longest_first([(7, 1), (5, 1), (4, 1), (3, 1), (1, 1)], 2) == ([7, 5, 4, 3, 1], [1] * 5, [0, 1, 1, 0, 1])
    assert sharding.longest_first([], 3) == ([], [], [])


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_placed_as_the_heap_places_single_groups(seed):
    draw = random.Random(seed)
    sizes = [draw.choice([8, 9, 10, 50, draw.randint(8, 90), draw.randint(8, 40000)]) for _ in range(50000)] + [10**7] * (seed % 3)
    runs = list(Counter(sizes).items())
    for shards in (1, 5, 24):
        loads, last = [0] * shards, {}
        for size, end, shard in zip(*sharding.longest_first(runs, shards)):
            loads[shard] += size * (end - last.get(size, 0))
            last[size] = end
        assert last == dict(runs) and loads == by_hand(sizes, shards)


@pytest.mark.parametrize("most", [sharding.NARROW, 0])
def test_many_groups_are_placed_as_by_the_heap(spark, monkeypatch, most):
    """20,000 groups, one with a third of all rows, and most of one size; with groups broadcast and moved."""
    monkeypatch.setattr(sharding, "NARROW", most)
    monkeypatch.setattr(sharding, "HOT", 8)
    df = spark.range(0, 30000, numPartitions=7).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.repeat(F.lit("x"), F.when(F.col("id") % 5 == 0, (F.col("id") % 700).cast("int")).otherwise(0)))).alias("text"))
    bytes_ = Counter()
    for r in df.collect():
        bytes_[r["text"]] += len(r["text"]) + 8
    got = sharding.shard_documents(df).collect()
    loads, slots = Counter(), {}
    for r in got:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 30000 and [loads[s] for s in range(24)] == by_hand(bytes_.values(), 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({(r["shard"]) for r in got if r["doc_id"] % 3 == 0}) == 1


@pytest.mark.parametrize("rows", [[], [(None, None, "x", 1)] * 3 + [(1, "", "", 0), (1, "a", "", 0), (1, "a", "", 0), (2, "é" * 5000, "", 0)] + [(i, "same", "", 0) for i in range(50)] + [(i, f"t{i}" * (i % 7 + 1), "", 0) for i in range(200)]])
def test_every_row_has_a_shard_and_groups_stay_together(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard_documents(df, shards=5).collect()
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got)) == sorted((d is not None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    of = {}
    for r in got:
        assert of.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
    for s in range(5):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))


def test_shards_are_near_equal_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    loads = [r["b"] for r in sharding.shard_documents(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    mean = sum(loads) / 24
    assert len(loads) == 24 and max(loads) <= mean + max(mean * 0.02, 33100)


def test_placement_of_documents_equals_the_heap(spark, sf_dir):
    """Each group where longest-processing-time scheduling by hand puts it: groups of one size may change places."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = {}
    for r in docs.collect():
        sizes[r["text"] or ""] = sizes.get(r["text"] or "", 0) + len((r["text"] or "").encode()) + 8
    loads = [0] * 24
    for n in sorted(sizes.values(), reverse=True):
        loads[loads.index(min(loads))] += n
    got = [r["b"] for r in sharding.shard_documents(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert sorted(got) == sorted(loads)


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 20):
        code = language.codewords(n)
        assert len({tuple(r) for r in code}) == n
        assert all(abs(c.sum()) < n for c in code.T.astype(int))


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    got = language.identify(docs, model, ["doc_id", "lang"]).where(language.held_out())
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n >= 0.98
    assert got.where("score < 0 or score > 1").count() == 0


def test_odd_texts_and_tables(spark):
    odd = spark.createDataFrame([(None, None, "en", 1.0), (1, "", None, 2.0), (2, "123 !?", "en", 0.0), (3, "x" * 300_000, "en", 0.0), (4, "the cat and the dog", "en", 0.0), (6, "le chat et la souris", "fr", 0.0)], "doc_id long, text string, lang string, score double")
    model = language.train(odd)
    got = {r["doc_id"]: r for r in language.identify(odd, model, ["doc_id"]).collect()}
    assert [got[k]["lang_pred"] for k in (None, 1, 2)] == ["und"] * 3 and got[2]["score"] == 0
    assert {r["doc_id"] for r in language.accepted(odd, model, 0.0).collect()} == {3, 4, 6}
    assert language.accepted(odd, model).columns == odd.columns
    none = language.train(odd.where("lang is null"))
    assert {r["lang_pred"] for r in language.identify(odd, none, ["doc_id"]).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0
    one = language.train(odd.where("lang = 'fr'"))
    assert one.languages in (["fr"], [])


def test_every_language_is_learnt(spark):
    """1,100 values of lang, one of which has most rows."""
    rows = [(5 * i + 1, f"w{i % 97} v{i % 89} " + "abcdefghij"[i % 10] * 5, f"l{i:04d}") for i in range(1100)] + [(5 * i + 2, f"the cat {i}", "l0000") for i in range(3000)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) >= 850 and {len(np.unique(c)) for c in model.code.T} == {2}
    held = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    assert set(model.languages) == held
