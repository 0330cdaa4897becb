"""Exact metric range join of embeddings: pivots, boundary replication, independent cells.

On the unit sphere a cosine of at least c is a distance of at most
r = sqrt(2 - 2c).  Vectors of a label go to the cell of their nearest pivot.  If
x (in cell i) and y (in cell j) are within r, the triangle inequality gives
d(x, p_j) <= d(x, p_i) + 2r, so x is replicated into every cell j < i for which
that holds, and a pair of vectors from two cells meets exactly once, in the
lower cell.  Cells join independently; within one, vectors are sorted by their
distance to the pivot and cut into blocks, and two blocks are compared only if
those distances come within r of each other (the triangle inequality again).

Where vectors fill the space so evenly that replication gains nothing (as random
directions in 64 dimensions do), fewer pivots are taken: that is decided by
measuring the replication of a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .components import components

#: Floating-point slack of the filters; the cosine itself decides.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distance(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def choose_pivots(sample: dict, counts: dict, radius: float, cell: int) -> dict:
    """label -> pivots: as many, up to one for each `cell` vectors, as make the least work on the sample.

    Work is the sum over cells of own * (own / 2 + replicas), both measured on the sample.
    """
    out = {}
    for label, x in sample.items():
        best, most = None, max(1, min(len(x) // 8, -(-counts[label] // cell), 256))
        k = 1
        while k <= most:
            pivots = x[np.linspace(0, len(x) - 1, k).astype(int)]
            d = _distance(x, pivots)
            own = d.argmin(1)
            near = (d <= d[np.arange(len(x)), own, None] + 2 * radius + SLACK) & (np.arange(k)[None, :] < own[:, None])
            size, replicas = np.bincount(own, minlength=k), near.sum(0)
            work = float((size * (size / 2 + replicas)).sum())
            if best is None or work < 0.8 * best[0]:
                best = (work, pivots)
            k *= 2
        out[label] = best[1]
    return out


def _tie(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a boolean matrix, the least row that it reaches through links."""
    rows, n = np.arange(near.shape[0]), near.shape[0]
    while True:
        columns = np.where(near, rows[:, None], n).min(0, initial=n)
        new = np.minimum(rows, np.where(near, columns[None, :], n).min(1, initial=n))
        if (new == rows).all():
            return rows, columns
        rows = new


def links(vectors: DataFrame, least_cosine: float = 0.98, cell: int = 4096, block: int = 1024, sample: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Of vectors (_row, label, embedding, copies), a label's all of one length: (_row, n) with how many others each vector links to, possibly in parts, and edges (a, b) that connect what is linked."""
    spark = vectors.sparkSession
    radius = float(np.sqrt(2 - 2 * least_cosine))
    total = vectors.count()
    some = vectors.select("label", "embedding", F.xxhash64("_row").alias("_h")).where(F.pmod("_h", F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, sample / max(1, total)))))
    got = some.orderBy("_h").limit(2 * sample).select("label", "embedding").toArrow().combine_chunks()
    taken: dict = {}
    if got.num_rows:
        names, column = np.array(got.column("label").to_pylist()), got.column("embedding").combine_chunks()
        taken = {k: unit(_matrix(column.take(pa.array(np.flatnonzero(names == k))))) for k in np.unique(names).tolist()}
    # of the labels in the sample, so at most as many rows as that
    counts = {r["label"]: r["count"] for r in vectors.where(F.col("label").isin(list(taken))).groupBy("label").count().collect()}
    pivots = choose_pivots(taken, counts, radius, cell)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.array(batch.column("label").to_pylist())
            row, at, home, ring = [], [], [], []
            for label in np.unique(names).tolist():
                own = np.flatnonzero(names == label)
                # a rare label that the sample missed is one cell
                d = _distance(unit(_matrix(batch.column("embedding").take(pa.array(own)))), pivots[label]) if label in pivots else np.zeros((len(own), 1))
                near = d.argmin(1)
                here = (np.arange(d.shape[1])[None, :] < near[:, None]) & (d <= d[np.arange(len(own)), near, None] + 2 * radius + SLACK)
                here[np.arange(len(own)), near] = True
                i, c = np.nonzero(here)
                row.append(own[i])
                at.append(c)
                home.append(near[i] == c)
                ring.append(d[i, c])
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").take(take), batch.column("copies").take(take), batch.column("label").take(take), batch.column("embedding").take(take), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(home)), pa.array(np.concatenate(ring))],
                ["_row", "copies", "label", "embedding", "cell", "home", "ring"],
            )

    kinds = dict(vectors.dtypes)
    member = stash(vectors.select("_row", "copies", "label", "embedding").mapInArrow(cells, f"_row long, copies long, label {kinds['label']}, embedding {kinds['embedding']}, cell int, home boolean, ring double"))
    # Blocks of a cell: by distance to the pivot, so that many pairs of blocks are too far apart.
    sizes = member.groupBy("label", "cell").agg(F.count("*").alias("size"))
    cut = sizes.select("label", "cell", F.ceil(F.col("size") / block).cast("int").alias("parts"))
    bounds = member.join(cut, ["label", "cell"]).groupBy("label", "cell", "parts").agg(F.percentile_approx("ring", F.expr("array(0.0625,0.125,0.1875,0.25,0.3125,0.375,0.4375,0.5,0.5625,0.625,0.6875,0.75,0.8125,0.875,0.9375)"), 1000).alias("q"))
    ranked = member.join(bounds, ["label", "cell"])
    # within an equal share of the distances, a hash deals out the rest
    share = F.aggregate("q", F.lit(0), lambda a, x: a + (F.col("ring") > x).cast("int"))
    fine = F.greatest(F.lit(1), F.ceil(F.col("parts") / 16)).cast("int")
    ranked = ranked.withColumn("block", F.when(F.col("parts") == 1, F.lit(0)).when(F.col("parts") < 16, F.floor(share * F.col("parts") / 16).cast("int")).otherwise(share * fine + F.pmod(F.xxhash64("_row"), fine).cast("int")))
    ranked = stash(ranked.select("_row", "copies", "label", "embedding", "cell", "home", "ring", "block"))
    span = ranked.groupBy("label", "cell", "block").agg(F.min("ring").alias("low"), F.max("ring").alias("high"), F.max("home").alias("any_home"))
    other = span.toDF("_label", "_cell", "with", "_low", "_high", "_any")
    close = f"block <= with and (any_home or _any) and _low - high <= {radius + SLACK} and low - _high <= {radius + SLACK}"
    pairs = stash(span.join(other, (F.col("label") == F.col("_label")) & (F.col("cell") == F.col("_cell"))).where(close).select("_label", "_cell", F.col("block").alias("first"), F.col("with").alias("second")))
    same = (F.col("label") == F.col("_label")) & (F.col("cell") == F.col("_cell"))
    columns = ["label", "cell", "first", "second", "side", "_row", "copies", "embedding", "home"]
    sent = ranked.join(pairs, same & (F.col("block") == F.col("first"))).withColumn("side", F.lit(0)).select(*columns)
    met = ranked.join(pairs.where("first <> second"), same & (F.col("block") == F.col("second"))).withColumn("side", F.lit(1)).select(*columns)

    def join(group: pa.Table) -> pa.Table:
        x, side = unit(_matrix(group.column("embedding").combine_chunks())), group.column("side").to_numpy()
        rows, home, copies = (group.column(c).to_numpy() for c in ("_row", "home", "copies"))
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if group.column("first")[0] != group.column("second")[0] else a
        near = x[a] @ x[b].T >= least_cosine
        near &= home[a, None] | home[None, b]  # replicas meet each other where one of them is at home
        near &= rows[a, None] != rows[None, b]
        left, right = _tie(near if b is not a else near | np.eye(len(a), dtype=bool))  # within one block a row is its own column
        out = [(rows[a], near @ copies[b], rows[a][left])]
        if b is not a:
            out.append((rows[b], copies[a] @ near, rows[a][np.minimum(right, len(a) - 1)] if len(a) else rows[b]))
        row, n, least = (np.concatenate(c) for c in zip(*out))
        return pa.table({"_row": row[n > 0], "n": n[n > 0].astype(np.int64), "least": least[n > 0]})

    found = stash(sent.unionByName(met).groupBy("label", "cell", "first", "second").applyInArrow(join, "_row long, n long, least long"))
    return found.select("_row", "n"), found.where("_row <> least").select(F.col("_row").alias("a"), F.col("least").alias("b"))


def near_vectors(embeddings: DataFrame, least_cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings.

    Rows compare within their label, and only with vectors of their length.  A
    null label or vector, a zero vector and one with null or non-finite components
    link with nothing and are components of their own.  Vectors equal bit for bit count as one while comparing and as many in the
    result.  Rows with a null vec_id take part and show null.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    good = F.coalesce(x.isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    rows = embeddings.select("vec_id", "label", "embedding", good.alias("good"))
    # a label's vectors of one length are a group
    group = F.concat_ws(":", F.size("embedding").cast("string"), F.col("label").cast("string"))
    rows = stash(rows.select("vec_id", group.alias("label"), "embedding", "good"))
    # One of equal vectors stands for all.
    stands = rows.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    stands = stash(stands.withColumn("_row", F.monotonically_increasing_id()))
    many, edges = links(stands, least_cosine)
    many = many.groupBy("_row").agg(F.sum("n").alias("n"))
    found = components(edges).select(F.col("node").alias("_row"), "component")
    told = stash(stands.join(many, "_row", "left").join(found, "_row", "left").select("label", "embedding", "least_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "_row").alias("component")))
    smallest = told.groupBy("component").agg(F.min("least_id").alias("component_id"))
    # written first, so that the copies of one common vector can be dealt to several tasks
    told = stash(told.join(smallest, "component").select("label", "embedding", "n_links", "component_id"))
    linked = rows.where("good").join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
