import random

import pytest

from pagetrace.operators import snapshots

ROWS = "path string, text string"


def lines(*words):
    return "\n".join(words)


def changes(spark, before, after, least=0.5):
    got = snapshots.snapshot_changes(spark.createDataFrame(before, ROWS), spark.createDataFrame(after, ROWS), least)
    return {(r["path"], r["status"], r["previous_path"], None if r["similarity"] is None else round(r["similarity"], 4)) for r in got.collect()}


def test_kinds_of_changes(spark):
    page = lines(*(f"line {i}" for i in range(20)))
    before = [("same", "x"), ("edited", "x"), ("gone", "only here"), ("old/a.md", "whole\ncopy"), ("b.md", page), ("null", None), ("twice", "b"), ("twice", "a")]
    after = [("same", "x"), ("edited", "y"), ("new", "another"), ("new/a.md", "whole\ncopy"), ("c.md", page.replace("line 3\n", "changed line\n")), ("null", ""), ("twice", "a")]
    shared = sum(len(f"line {i}") + 1 for i in range(20) if i != 3)
    assert changes(spark, before, after) == {
        ("edited", "modified", None, None),
        ("gone", "removed", None, None),
        ("new", "added", None, None),
        ("new/a.md", "renamed", "old/a.md", 1.0),
        ("c.md", "renamed", "b.md", round(shared / (shared + len("changed line") + 1), 4)),
    }


def test_equal_contents_go_by_name_then_by_order(spark):
    before = [("x/one", "t"), ("x/two", "t"), ("x/three", "t")]
    after = [("y/two", "t"), ("y/aaa", "t"), ("y/bbb", "t"), ("y/ccc", "t")]
    assert changes(spark, before, after) == {("y/two", "renamed", "x/two", 1.0), ("y/aaa", "renamed", "x/one", 1.0), ("y/bbb", "renamed", "x/three", 1.0), ("y/ccc", "added", None, None)}


def test_the_most_similar_pair_comes_first(spark):
    a = [f"a{i}" for i in range(10)]
    before = [("p", lines(*a)), ("q", lines(*a[:9], "z"))]
    after = [("r", lines(*a[:9], "y")), ("s", lines(*a[:8], "z", "w"))]
    # q is a little more like r than like s, and than p is like r
    got = {(r[2], r[0]) for r in changes(spark, before, after)}
    assert got == {("p", "s"), ("q", "r")}


def greedy(before, after, least):
    def counted(t):
        out = {}
        for x in t.split("\n"):
            out[x] = out.get(x, 0) + 1
        return out

    size = lambda c: sum((len(x.encode()) + 1) * n for x, n in c.items())
    pairs = []
    for p, t in before.items():
        for q, u in after.items():
            a, b = counted(t), counted(u)
            s = sum((len(x.encode()) + 1) * min(n, b.get(x, 0)) for x, n in a.items()) / max(size(a), size(b))
            if s >= least:
                pairs.append((-s, p.split("/")[-1] != q.split("/")[-1], p, q))
    out, used = set(), set()
    for s, _, p, q in sorted(pairs):
        if ("o", p) not in used and ("n", q) not in used:
            used |= {("o", p), ("n", q)}
            out.add((q, "renamed", p, round(-s, 4)))
    return out


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_renames_equal_taking_the_best_pair_first(spark, least):
    rng = random.Random(7)
    common = ["", "}", "return"]  # lines that all files have
    before = {f"a/{i}": lines(*(rng.choice(common + [f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(4, 12)))) + f"\nb{i}" for i in range(40)}
    after = {f"b/{i}": lines(*(x for x in t.split("\n") if rng.random() > 0.2), f"n{i}") for i, t in enumerate(before.values())}
    got = {x for x in changes(spark, list(before.items()), list(after.items()), least) if x[1] == "renamed"}
    assert got == greedy(before, after, least) and len(got) > 5


PAIRS = "previous_path string, path string, similarity double"


def in_turn(pairs):
    """Pairs one after the other, the most similar first."""
    out, old, new = set(), set(), set()
    for s, _, o, n in sorted((-s, o.split("/")[-1] != n.split("/")[-1], o, n) for o, n, s in pairs):
        if o not in old and n not in new:
            old.add(o)
            new.add(n)
            out.add((o, n, -s))
    return out


def test_files_that_are_equally_similar_do_not_take_a_round_each(spark, monkeypatch):
    writes, kept = [], snapshots.kept
    monkeypatch.setattr(snapshots, "kept", lambda rows, tag="rows": (writes.append(tag), kept(rows, tag))[1])
    pairs = [(f"a/{i:02}", f"b/n{j:02}", 0.75) for i in range(12) for j in range(12)]
    got = snapshots.matched(spark.createDataFrame(pairs, PAIRS))
    assert {tuple(r) for r in got.collect()} == {(f"a/{i:02}", f"b/n{i:02}", 0.75) for i in range(12)}
    assert len(writes) < 20


@pytest.mark.parametrize("rounds, block", [(0, 30), (1, 200_000)])
def test_connected_pairs_are_taken_in_turn(spark, rounds, block):
    rng = random.Random(3)
    pairs = {(f"a/{rng.randint(0, 12)}", f"b/{rng.randint(0, 12)}"): rng.choice([0.5, 0.6, 1 / 3]) for _ in range(60)}
    pairs |= {(f"c/{i}", f"{d}/{i + j}"): 0.5 for i in range(12) for j, d in enumerate("de")}  # a chain
    pairs |= {(f"c/{i + 1}", f"d/{i}"): 0.5 for i in range(12)}
    rows = [(o, n, s) for (o, n), s in pairs.items()]
    got = snapshots.matched(spark.createDataFrame(rows, PAIRS), rounds, block)
    assert {tuple(r) for r in got.collect()} == in_turn(rows)


def test_less_similar_contents_of_files_with_a_better_one_are_not_compared(spark, monkeypatch):
    seen, matched = [], snapshots.matched
    monkeypatch.setattr(snapshots, "matched", lambda pairs: (seen.append(pairs.count()), matched(pairs))[1])
    shared = [f"shared line {i}" for i in range(6)]
    before = [(f"a/{i}", lines(*shared, *(f"own {i} {j}" for j in range(6)))) for i in range(12)]
    after = [(f"b/{i}", t + "\nx") for i, (_, t) in enumerate(before)]
    got = changes(spark, before, after)
    assert {(p, q) for q, _, p, _ in got} == {(f"a/{i}", f"b/{i}") for i in range(12)}
    assert sum(seen) == 12  # of 144 pairs that share half


def test_all_copies_of_similar_contents_find_a_partner(spark):
    page = [f"line {i}" for i in range(20)]
    near = lines(*page[:19], "other")
    before = [(f"a/{i}", lines(*page)) for i in "123"]
    # the best pair takes a/1, so the copies of the other content go with a/2 and a/3
    after = [("b/x", lines(*page) + "\nz"), ("b/y", near), ("c/3", near), ("c/z", near)]
    got = {(p, q) for q, status, p, _ in changes(spark, before, after) if status == "renamed"}
    assert got == {("a/1", "b/x"), ("a/2", "b/y"), ("a/3", "c/3")}
    assert got == {(p, q) for q, _, p, _ in greedy(dict(before), dict(after), 0.5)}


@pytest.mark.parametrize("seed", [1, 2])
def test_renames_of_copies_equal_taking_the_best_pair_first(spark, seed):
    rng = random.Random(seed)
    texts = [lines(*(f"w{rng.randint(0, 15)}" for _ in range(10)), f"t{i}") for i in range(6)]
    texts += [lines(*t.split("\n")[:-1], f"u{i}") for i, t in enumerate(texts)]
    # contents are on one side only, so that none is equal to another
    before = {f"{rng.choice('abc')}{i}/{rng.randint(0, 9)}": rng.choice(texts[:9]) for i in range(40)}
    after = {f"{rng.choice('xyz')}{i}/{rng.randint(0, 9)}": rng.choice(texts[3:]) + "\nv" * (i % 3) for i in range(40)}
    got = {x for x in changes(spark, list(before.items()), list(after.items())) if x[1] == "renamed"}
    assert got == greedy(before, after, 0.5) and len(got) > 20


@pytest.mark.parametrize("rounds, block", [(2, 200_000), (1, 40), (0, 5)])
def test_pairs_of_copies_are_taken_as_pairs_of_all_their_files(spark, rounds, block):
    rng = random.Random(rounds)

    def side(name):
        made = sorted({f"{name}{rng.randint(0, 40)}/{rng.randint(0, 5)}" for _ in range(40)})
        groups, i = {}, 0
        rng.shuffle(made)
        while i < len(made):
            n = rng.choice([1, 1, 2, 5])
            groups[min(made[i : i + n])] = made[i : i + n]
            i += n
        return groups

    old, new = side("a"), side("b")
    edges = [(o, n, rng.choice([0.5, 0.6, 1 / 3])) for o in old for n in new if rng.random() < 0.3]
    rows = [(o, n, s, None) for o, n, s in edges]
    rows += [(x, None, None, o) for o, files in old.items() if len(files) > 1 for x in files]
    rows += [(None, x, None, n) for n, files in new.items() if len(files) > 1 for x in files]
    got = snapshots.matched(spark.createDataFrame(rows, PAIRS + ", copy_of string"), rounds, block)
    assert {tuple(r) for r in got.collect()} == in_turn([(x, y, s) for o, n, s in edges for x in old[o] for y in new[n]])


def test_copies_are_not_made_into_pairs_of_each_with_each(spark, monkeypatch):
    seen, matched = [], snapshots.matched
    monkeypatch.setattr(snapshots, "matched", lambda pairs: (seen.append(pairs.count()), matched(pairs))[1])
    text = lines(*(f"line {i}" for i in range(30)))
    before = [(f"a/{i}", text) for i in range(100, 200)]
    after = [(f"b/{i}", f"{text}\n{i}") for i in range(100, 200)]
    assert {(p, q) for q, _, p, _ in changes(spark, before, after)} == {(f"a/{i}", f"b/{i}") for i in range(100, 200)}
    assert sum(seen) == 200  # each new content with the old one, and the old one's files


def test_empty_snapshots(spark):
    assert changes(spark, [], []) == set()
    assert changes(spark, [], [("a", "t")]) == {("a", "added", None, None)}
    assert changes(spark, [("a", "t")], []) == {("a", "removed", None, None)}
