import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagetrace.llm import mixture, token_store
from pagetrace.llm.common import new_dir
from pagetrace.llm.queries import vocabulary
from pagetrace.llm.wordbpe import WordEncoder

tokenizers = pytest.importorskip("tokenizers")
WHOLE = tokenizers.Tokenizer.from_file(vocabulary())
FAST = WordEncoder(vocabulary(), most=500)
ODD = [(None, None, None), (5, "x y", None), (5, "x y", None), (1, "", "a"), (2, "It's <|endoftext|> <|ENDOFTEXT|> 1,000. é É ﬁ", "a"), (3, "word " * 9000, "b"), (9, "Σας ΣΑΣ 😀😀 ok.", "c")] + [(20 + i, f"filler number {i} text", "hot") for i in range(300)]


def ids(text, end):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, end]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abE'.,<|> \n\tstré1- ́"), st.characters(exclude_categories=["Cs"]))), max_size=5))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_library(texts):
    got, at = FAST.encode(pa.array(texts, pa.string()))
    assert [got[i:j].tolist() for i, j in zip(at, at[1:])] == [ids(t, 0)[:-1] for t in texts]


def test_chunks_with_one_hash_keep_their_own_ids():
    word = "a"
    while len(word) < 1024:  # with its complement, it has one polynomial hash under every odd multiplier
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    got, at = WordEncoder(vocabulary()).encode(pa.array([word, other, f"{word} {other.upper()}, {word}"]))
    assert [got[i:j].tolist() for i, j in zip(at, at[1:])] == [ids(t, 0)[:-1] for t in (word, other, f"{word} {other.upper()}, {word}")]


def test_other_vocabularies_are_encoded_text_by_text():
    path = vocabulary().replace("word_bpe_49k", "byte_bpe_50k")
    other, whole = WordEncoder(path), tokenizers.Tokenizer.from_file(path)
    texts = ["Two  words,\n one\tTab", "", None, "é <|endoftext|> x"]
    got, at = other.encode(pa.array(texts))
    assert not other.by_chunk and [got[i:j].tolist() for i, j in zip(at, at[1:])] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").repartition(3)


def test_store_round_trip(spark, odd):
    path = new_dir(spark, "test-tokens")
    parts = token_store.write(odd, path, vocabulary())
    got = sorted(token_store.read(parts, path).collect(), key=lambda r: r["start"])
    want = sorted(((d is not None, d or 0, len(ids(t, 2)), crc(ids(t, 2))) for d, t, _ in ODD))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    found = token_store.lookup(parts, path, spark.createDataFrame([(2,), (77,), (None,), (-4,)], "doc_id long")).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {2: ids(ODD[4][1], 2), 77: ids("filler number 57 text", 2)}


def test_store_of_nothing(spark, odd):
    assert token_store.stored(odd.limit(0), spark, new_dir(spark, "test-none"), vocabulary()).count() == 0


def packed(docs, **options):
    """Pieces by sequence, in order; every sequence but the last is full."""
    window, got, by_seq = options.get("window", 2048), mixture.pack(docs, vocabulary(), **options).collect(), {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, rows in by_seq.items():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [0, *np.cumsum([r["length"] for r in rows])[:-1].tolist()]
        assert sum(r["length"] for r in rows) == window or s == max(by_seq)
    return [r for s in sorted(by_seq) for r in by_seq[s]]


def test_packing_loses_nothing(spark, odd):
    got = packed(odd, window=64)
    assert sum(r["length"] for r in got) == sum(len(ids(t, 1)) for _, t, _ in ODD)
    for d, t, _ in ODD:
        if d is None or d == 5:
            continue
        own = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"])
        x = ids(t, 1)
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
        assert sum(r["length"] for r in own) == len(x) == own[0]["doc_tokens"]
        assert all(crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in own)


def round_robin(queues, shares, window):
    """Deficit round-robin, round by round: (round, source, tokens of the queue served up to and with the packet)."""
    out, credit, served, turn = [], dict.fromkeys(queues, 0.0), dict.fromkeys(queues, 0), 0
    queues = {k: list(v) for k, v in queues.items()}
    while any(queues.values()):
        turn += 1
        for source in sorted(queues):
            credit[source] += shares[source] * window
            while queues[source] and queues[source][0] <= credit[source] + 1e-6:
                credit[source] -= queues[source][0]
                served[source] += queues[source].pop(0)
                out.append((turn, source, served[source]))
    return out


@pytest.mark.parametrize("targets", [None, {"b": 0.5, "c": 0.25, "a": 0.25}])
def test_packing_is_deficit_round_robin(spark, targets):
    draw = np.random.default_rng(4)
    rows = [(i, "w " * int(draw.integers(0, 200 if i % 9 else 900)), "aabbbc"[draw.integers(0, 6)]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    got = packed(df, window=128, targets=targets)
    queues = {}
    for _, t, s in rows:  # packets of a window at most, in the order of the rows
        n = len(t) // 2 + 1
        queues.setdefault(s, []).extend([128] * (n // 128) + [n % 128] * (n % 128 > 0))
    total = sum(map(sum, queues.values()))
    want = round_robin(queues, targets or {s: sum(q) / total for s, q in queues.items()}, 128)
    done, order = {}, []
    for r in got:
        done[r["source"]] = done.get(r["source"], 0) + r["length"]
        step = (r["round"], r["source"])
        order = order[:-1] + [(*step, done[r["source"]])] if order and order[-1][:2] == step else order + [(*step, done[r["source"]])]
    steps = {}
    for turn, s, n in want:
        steps[turn, s] = n
    assert order == [(*k, n) for k, n in steps.items()]
    whole = [r for r in got if r["doc_tokens"] <= 128]
    ends = {r["doc_id"]: 0 for r in whole}
    for r in whole:
        ends[r["doc_id"]] += 1
    assert max(ends.values()) <= 2 and sum(n == 2 for n in ends.values()) < total / 128 + 1  # cut only where a sequence ends


def test_windows_hold_the_targets(spark):
    draw, share = np.random.default_rng(6), {"a": 0.6, "b": 0.3, None: 0.1}
    rows = [(i, "w " * int(draw.integers(50, 400)), ["a", "b", None][i % 3]) for i in range(900)]
    got = packed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), window=1024, targets=share)
    seen = dict.fromkeys(share, 0)
    left = {s: sum(len(t) // 2 + 1 for _, t, x in rows if x == s) for s in share}
    for r in got:
        seen[r["source"]] += r["length"]
        left[r["source"]] -= r["length"]
        if all(left.values()):  # whatever the place in the stream, no source is off by more than a round and a packet
            assert all(abs(seen[s] - share[s] * sum(seen.values())) <= 2 * 1024 + 400 for s in share)


def test_packing_many_sources_and_a_long_document_of_a_rare_one(spark):
    rows = [(i, "w " * 40, f"s{i % 300}") for i in range(6000)] + [(10_000, "w " * 200_000, "rare"), (10_001, None, "none")]
    got = packed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    assert len(got) < 7000 and len({r["source"] for r in got}) == 302
    long = [r for r in got if r["doc_id"] == 10_000]
    assert sum(r["length"] for r in long) == 200_001 and len(long) <= 2 * 98 + 1
    # sources of equal size go side by side: no prefix of the stream has much more of one than of another
    seen = np.zeros(300)
    for r in got[: len(got) // 2]:
        if r["doc_id"] < 10_000:
            seen[int(r["source"][1:])] += r["length"]
    assert seen.max() - seen.min() <= 2 * 41


def test_targets_that_name_only_some(spark, odd):
    got = packed(odd, window=64, targets={"hot": 1.0})
    sources = [r["source"] for r in got]
    assert set(sources[: sources.index("a")] if "a" in sources else []) <= {"hot", None, "b", "c"} and sources[0] == "hot"
    assert max(i for i, s in enumerate(sources) if s == "hot") < min(i for i, s in enumerate(sources) if s != "hot")
    with pytest.raises(ValueError):
        mixture.pack(odd, vocabulary(), targets={"a": 0.7, "b": 0.4})


def test_packing_nothing(spark, odd):
    assert mixture.pack(odd.limit(0), vocabulary()).count() == 0
