import re

import duckdb
import pytest

import corpus_pipeline
from pagetrace.llm import decontamination, language, queries


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What every stage got and gave."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        at = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(at)
        made = spark.read.parquet(at)
        out.append((name, docs, made))
        docs = made
    return out


def test_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "secret_scan", "packing"]


def test_all_but_the_last_return_documents(stages):
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_language_stage_rejects_what_it_cannot_tell(spark, stages):
    _, before, after = stages[0]
    model = language.train(before)
    want = {r["doc_id"] for r in language.identify(before, model, ["doc_id"]).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert {r["doc_id"] for r in after.collect()} == want and len(want) > 0.95 * before.count()


def test_dedup_stage_leaves_no_exact_copy_and_no_empty_group(stages):
    _, before, after = stages[1]
    words = lambda df: {tuple(re.findall(r"\w+", r["text"].lower())): r["doc_id"] for r in df.orderBy("doc_id", ascending=False).collect()}
    old, new = words(before), words(after)
    assert len(new) == after.count() and set(new) <= set(old)
    lone = {d for w, d in old.items()} & {r["doc_id"] for r in after.collect()}
    assert len(lone) == after.count()


def test_decontamination_stage(spark, sf_dir, stages):
    _, before, after = stages[2]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = {r["doc_id"] for r in decontamination.contaminations(before, bench).collect()}
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [norm(r["text"]) for r in bench.collect()]
    brute = {r["doc_id"] for r in before.collect() if any(f" {t} " in f" {norm(r['text'])} " for t in items)}
    kept = {r["doc_id"] for r in after.collect()}
    assert brute <= leaks and kept == {r["doc_id"] for r in before.collect()} - leaks


def test_secret_stage_keeps_documents_and_blots_out_secrets(stages):
    _, before, after = stages[3]
    old, new = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (before, after))
    assert old.keys() == new.keys()
    secret = re.compile(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}")
    assert not [d for d, t in new.items() if secret.search(t)]
    assert all(new[d] == t for d, t in old.items() if not secret.search(t) and not re.search(r"(?i)password|passwd|secret|token|api_?key|login|user|client|://", t))


def test_packing_stage_packs_all(stages):
    _, before, after = stages[4]
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in after.collect()}


def test_run_gives_the_same_rows(spark, sf_dir, stages):
    key = lambda df: sorted((r["doc_id"], r["doc_tokens"]) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages[-1][2])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert key(map(tuple, df.select(*columns).collect())) == key(want.select(*columns).fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
