"""Hard negatives by exact integer scores: residue products, then a selection in windows.

Components are integers.  A matrix of inner products is found modulo several
small primes: residues lie in [-p/2, p/2], and so many columns are multiplied at
once that every partial sum of a float32 product stays below 2^24, where float32
is exact.  Chinese remaindering puts the signed scores together.  How many primes
that takes follows from the longest vector (Cauchy and Schwarz).

Anchors and rows are dealt into blocks by hash, and each pair of blocks is a
group of its own: first the pairs of one label, for each anchor's best rows of
its label (the positives); then all pairs, for the best rows of other labels in
each positive's window of scores.  A group gives only its own best rows of an
anchor, and the best of those follow from a window that Spark limits before it
shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: The largest primes whose residues of 64 columns multiply exactly in float32.
PRIMES = (1021, 1019, 1013, 1009, 997, 991)
#: Scores are less than this, so that percentages of them fit 64 bits.
MOST = 1 << 56
#: Anchors whose scores with a block of rows are held at once.
TILE = 256


def _residues(x: np.ndarray, p: int) -> np.ndarray:
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def primes_for(bound: int) -> tuple[int, ...]:
    """The primes whose product tells all integers from -bound to bound apart."""
    product = 1
    for i, p in enumerate(PRIMES):
        product *= p
        if product > 2 * bound:
            return PRIMES[: i + 1]
    raise ValueError(f"scores of up to {bound} are out of range")


def scores(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """a @ b.T of integer matrices, exactly; no entry of it is larger than bound."""
    out, product = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes_for(bound):
        step = max(1, ((1 << 24) - 1) // (p // 2) ** 2)
        left, right = _residues(a, p), _residues(b, p)
        rest = np.zeros(out.shape, np.int64)
        for k in range(0, a.shape[1], step):
            rest += (left[:, k : k + step] @ right[:, k : k + step].T).astype(np.int64)
        # the digit of this prime, given those before
        out += product * ((rest - out) % p * pow(product, -1, p) % p)
        product *= p
    return np.where(out > product // 2, out - product, out)


def _first(i: np.ndarray, j: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` entries of each i with the largest scores, ties by smaller j; in that order."""
    order = np.lexsort((j, -score, i))
    i = i[order]
    return order[np.arange(len(i)) - np.searchsorted(i, i) < most]


def _integers(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    column = column.combine_chunks()
    return np.floor(scale * np.asarray(column.flatten(), np.float64)).astype(np.int64).reshape(len(column), -1)


def _ordered(group: pa.Table) -> pa.Table:
    return group.sort_by([("vec_id", "ascending")])  # nulls come last


def _met(anchors: DataFrame, rows: DataFrame, keys: list[str], block: int, pair: Callable, schema: str) -> DataFrame:
    """pair(anchors, rows) of each two blocks of anchors and rows that agree in keys."""

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    rows = rows.select(*(F.col(c).alias(c) for c in rows.columns))  # columns of its own, as anchors are rows too
    cut = stash(parts(rows, "_rows").join(parts(anchors, "_anchors"), keys))
    own = lambda n: F.pmod(F.xxhash64("_row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(cut, keys).withColumn("_a", own("_anchors")).withColumn("_b", every("_rows")).drop("_rows", "_anchors")
    right = rows.join(cut, keys).withColumn("_b", own("_rows")).withColumn("_a", every("_anchors")).drop("_rows", "_anchors")
    return left.groupBy(*keys, "_a", "_b").cogroup(right.groupBy(*keys, "_a", "_b")).applyInArrow(pair, schema)


def hard_negatives(embeddings: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, block: int = 8192) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components x count as floor(scale * x).  Of each row for which `anchor` holds,
    the positives are the first `positives` other rows of its label by falling
    score, ties by smaller vec_id; for each of them follow the first `negatives`
    rows of other labels whose score is `low` to `high` percent of the positive's,
    in the same order, by rank from 1.

    Rows with a null label or vector, or with null or non-finite components, take
    no part; vectors of different lengths don't meet.  Rows with one vec_id are
    different rows; a null vec_id comes after all others and is an anchor only if
    `anchor` holds for it.  An empty table, or one without anchors, gives no rows;
    neither does an anchor without positives.  Other columns are ignored.  Vectors
    so long that scores might reach 2^56 raise ValueError.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(finite & F.col("label").isNotNull(), F.lit(False))
    norm = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.pow(F.abs(v.cast("double")) * scale + 1, F.lit(2.0)))
    kept = embeddings.where(good).select("vec_id", "label", "embedding", F.coalesce(anchor, F.lit(False)).alias("_anchor"), F.size(x).alias("_size"), norm.alias("_norm"))
    rows = stash(kept.withColumn("_row", F.monotonically_increasing_id()))
    bound = rows.agg(F.max("_norm")).first()[0] or 1.0
    if bound >= MOST:
        raise ValueError("vectors are so long that their scores may not fit a long")
    bound = int(bound) + 1
    near_shape = pa.schema([(n, pa.int64()) for n in ("_row", "positive_id", "positive_score")])
    hard_shape = pa.schema([("_row", pa.int64()), ("_nth", pa.int32()), *((n, pa.int64()) for n in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"))])
    anchors, rows = rows.where("_anchor").select("_row", "vec_id", "label", "embedding", "_size"), rows.select("_row", "vec_id", "label", "embedding", "_size")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return near_shape.empty_table()
        right = _ordered(right)
        ids, own, other = right.column("vec_id"), left.column("_row").to_numpy(), right.column("_row").to_numpy()
        a, b, found = _integers(left.column("embedding"), scale), _integers(right.column("embedding"), scale), []
        for k in range(0, len(left), TILE):
            s = scores(a[k : k + TILE], b, bound)
            s[own[k : k + TILE, None] == other[None, :]] = -MOST
            least = np.partition(s, -positives, axis=1)[:, -positives] if s.shape[1] > positives else np.full(len(s), -MOST + 1)
            i, j = np.nonzero((s >= least[:, None]) & (s > -MOST))
            take = _first(i, j, s[i, j], positives)
            found.append((i[take] + k, j[take], s[i[take], j[take]]))
        i, j, s = (np.concatenate(c) for c in zip(*found))
        return pa.table({"_row": own[i], "positive_id": ids.take(pa.array(j)), "positive_score": s})

    near = _met(anchors, rows, ["_size", "label"], block, best, "_row long, positive_id long, positive_score long")
    order = lambda score, vec: (F.col(score).desc(), F.col(vec).asc_nulls_last())
    first = near.withColumn("_nth", F.row_number().over(Window.partitionBy("_row").orderBy(*order("positive_score", "positive_id")))).where(F.col("_nth") <= positives)
    wanted = first.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_nth", "positive_id", "positive_score"))).alias("_wanted"))  # `positives` each
    sought = stash(anchors.join(wanted, "_row"))

    def window(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return hard_shape.empty_table()
        right, lists = _ordered(right), left.column("_wanted").combine_chunks()
        many, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
        begin = np.cumsum(many) - many
        score = flat.field("positive_score").to_numpy()
        bottom, top = -((-low * score) // 100), high * score // 100
        codes = np.unique(np.r_[left.column("label").to_numpy(), right.column("label").to_numpy()], return_inverse=True)[1]
        mine, theirs = codes[: len(left)], codes[len(left) :]
        a, b, found = _integers(left.column("embedding"), scale), _integers(right.column("embedding"), scale), []
        for k in range(0, len(left), TILE):
            s, own = scores(a[k : k + TILE], b, bound), slice(begin[k], begin[k] + int(many[k : k + TILE].sum()))
            at = begin[k : k + TILE] - begin[k]
            least, most = np.minimum.reduceat(bottom[own], at), np.maximum.reduceat(top[own], at)
            i, j = np.nonzero((s >= least[:, None]) & (s <= most[:, None]) & (mine[k : k + TILE, None] != theirs[None, :]))
            met = s[i, j]
            for nth in range(int(many[k : k + TILE].max())):
                has = nth < many[k + i]
                p = begin[k + i[has]] + nth
                inside = np.flatnonzero(has)[(met[has] >= bottom[p]) & (met[has] <= top[p])]
                take = inside[_first(i[inside], j[inside], met[inside], negatives)]
                found.append((begin[k + i[take]] + nth, i[take] + k, j[take], met[take]))
        p, i, j, s = (np.concatenate(c) for c in zip(*found))
        pick, row = pa.array(p), pa.array(i)
        return pa.table(
            {"_row": left.column("_row").take(row), "_nth": flat.field("_nth").take(pick), "anchor_id": left.column("vec_id").take(row), "positive_id": flat.field("positive_id").take(pick), "negative_id": right.column("vec_id").take(pa.array(j)), "positive_score": flat.field("positive_score").take(pick), "negative_score": s}
        )

    hard = _met(sought, rows, ["_size"], block, window, "_row long, _nth int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    ranked = hard.withColumn("rank", F.row_number().over(Window.partitionBy("_row", "_nth").orderBy(*order("negative_score", "negative_id"))))
    return ranked.where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
