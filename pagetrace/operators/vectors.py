"""Sections of pages, their hashes, and cosine search over their vectors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrace.functions import text as T
from pagetrace.shared import kept

META = "kind STRING, model STRING, content_hash STRING, version STRING, rows BIGINT, checksum STRING, made BIGINT"


def sections(pages: DataFrame) -> DataFrame:
    """page_path, chunk_ord, chunk: a page's text cut before every line that begins with #.

    A line that begins the text needs no cut.  Chunks are trimmed; empty ones go.
    Each row is cut by itself, so no page's lines are gathered again.
    """
    cut = F.split(F.regexp_replace("text", r"(?m)^(\s*#)", "\u0001$1"), "\u0001")
    chunk = F.posexplode(F.filter(F.transform(cut, lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")), lambda x: x != ""))
    return pages.select("page_path", chunk.alias("chunk_ord", "chunk")).withColumn("chunk_ord", F.col("chunk_ord").cast("long"))


def content_hash(rows: DataFrame, key: str, model: str) -> DataFrame:
    """One hash for each key that changes with the model, any row (part, ord) or their order.

    Each row's SHA-256, of its ord and its part, is added up in four numbers of 60
    bits, so that no group is ever gathered: tasks add their own rows first.
    """
    row = F.sha2(F.concat(F.col("ord").cast("string"), F.lit(":"), F.sha2(F.coalesce("part", F.lit("")), 256)), 256)
    sums = [F.sum(F.conv(F.substring("_row", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return rows.select(key, row.alias("_row")).groupBy(key).agg(F.sha2(F.concat_ws(":", F.lit(model), F.count("*").cast("string"), *sums), 256).alias("content_hash"))


def stale(current: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys whose hash is not the stored one."""
    return current.join(stored.select(key, "content_hash"), [key, "content_hash"], "left_anti")


def top_k(vectors: DataFrame, query: list[float], k: int, floor: float) -> DataFrame:
    """The k vectors most like the query, of those with a cosine of at least the floor; ties by id."""
    q = F.array(*map(F.lit, query))
    scored = vectors.withColumn("score", T.cosine("embedding", q))
    return scored.where(F.col("score") >= floor).orderBy(F.desc("score"), "id").limit(k)


def best_chunk(scored: DataFrame) -> DataFrame:
    """page_path, score: the greatest score of a page's chunks."""
    return scored.groupBy("page_path").agg(F.max("score").alias("score"))


def normalised(vectors: DataFrame) -> DataFrame:
    """Embeddings of unit length (a zero vector stays)."""
    norm = F.greatest(T.l2_norm("embedding"), F.lit(1e-12))
    return vectors.withColumn("embedding", F.transform("embedding", lambda x: x / norm))


def index_size(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("page_path").alias("pages"))


def _checksum(vectors: DataFrame) -> tuple[int, str]:
    """How many rows there are, and a sum over them that changes with any; tasks add their own."""
    row = F.xxhash64(*sorted(vectors.columns)).cast("decimal(20,0)")
    n, total = vectors.agg(F.count("*"), F.sum(row)).first()
    return n, str(total)


def save_index(vectors: DataFrame, path: str, kind: str, model: str, content_hash: str) -> None:
    """Keep vectors (a key's columns, embedding) as Parquet with what they were made from.

    Vectors go to a new folder each time, and the description that names it comes
    last and whole: until then readers see the index that was there before.
    """
    spark, version = vectors.sparkSession, uuid.uuid4().hex
    vectors.write.parquet(f"{path}/vectors-{version}")
    rows, checksum = _checksum(spark.read.parquet(f"{path}/vectors-{version}"))
    told = spark.range(1).select(F.lit(kind).alias("kind"), F.lit(model).alias("model"), F.lit(content_hash).alias("content_hash"), F.lit(version).alias("version"), F.lit(rows).alias("rows"), F.lit(checksum).alias("checksum"), F.unix_micros(F.current_timestamp()).alias("made"))
    told.coalesce(1).write.mode("append").json(f"{path}/meta")


def load_index(spark: SparkSession, path: str, kind: str, model: str, content_hash: str) -> DataFrame | None:
    """The vectors of the index described last, or None if there is none, it is of another kind, model or content, or its rows aren't those that were saved or can't be read."""
    try:
        last = spark.read.schema(META).json(f"{path}/meta").where("version is not null").orderBy(F.desc("made"), "version").first()
        if last is None or (last["kind"], last["model"], last["content_hash"]) != (kind, model, content_hash):
            return None
        vectors = spark.read.parquet(f"{path}/vectors-{last['version']}")
        return vectors if _checksum(vectors) == (last["rows"], last["checksum"]) else None
    except (PySparkException, Py4JJavaError):
        return None


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)))


def in_cells(vectors: DataFrame, cells: int = 256) -> tuple[DataFrame, DataFrame]:
    """vectors (id, embedding) with the cell of their nearest pivot, and the cells (cell, pivot, radius: the largest angle to it).

    Pivots are at most `cells` of the vectors, taken by a hash of their ids, so
    the driver holds no more than those.  Vectors have one length; null, empty and
    non-finite ones are left out.
    """
    vectors = _usable(vectors)
    taken = vectors.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(cells).select("embedding").toArrow()
    pivots = _unit(taken.column("embedding")) if len(taken) else np.zeros((1, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _unit(batch.column("embedding")) @ pivots.T
                cell = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "embedding", "cell", "angle"])

    kinds = dict(vectors.dtypes)
    found = kept(vectors.select("id", "embedding").mapInArrow(assign, f"id {kinds['id']}, embedding {kinds['embedding']}, cell int, angle double"), "cells")
    radius = found.groupBy("cell").agg(F.max("angle").alias("radius"))
    held = vectors.sparkSession.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>")
    return found.drop("angle"), radius.join(F.broadcast(held), "cell").select("cell", "pivot", "radius")


def _best_in_blocks(vectors: DataFrame, asked: DataFrame, k: int, floor: float, block: int) -> DataFrame:
    """query_id, id, score: of each cell that a query (query_id, embedding, least, cell) asks, the k best ids, in parts.

    Cells are cut into blocks by hash, queries of a cell too, and each pair of them is a group.
    """

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    cut = kept(parts(vectors, "_vectors").join(parts(asked, "_queries"), "cell"), "blocks")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(cut, "cell").withColumn("_a", own("query_id", "_queries")).withColumn("_b", every("_vectors")).select("cell", "_a", "_b", "query_id", "embedding", "least")
    # one id may have many rows, which are dealt by what they hold
    right = vectors.join(cut, "cell").withColumn("_b", own("embedding", "_vectors")).withColumn("_a", every("_queries")).select("cell", "_a", "_b", "id", "embedding")
    shape = pa.schema([(n, t) for n, t in (("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()))])

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return shape.empty_table()
        rows, queries = rows.sort_by("id"), queries.combine_chunks()
        ids, first = np.unique(rows.column("id").to_numpy(), return_index=True)
        q, x, least, out = _unit(queries.column("embedding")), _unit(rows.column("embedding")), queries.column("least").to_numpy(), []
        for i in range(0, len(q), 256):
            score = np.maximum.reduceat(np.round(q[i : i + 256] @ x.T, 12), first, axis=1)  # an id's best row
            bar = np.maximum(least[i : i + 256], floor)
            if len(ids) > k:
                bar = np.maximum(bar, np.partition(score, -k, axis=1)[:, -k])
            a, b = np.nonzero(score >= bar[:, None])
            order = np.lexsort((b, -score[a, b], a))
            a, b = a[order], b[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < k
            a, b = a[keep], b[keep]
            out.append((a + i, b, score[a, b]))
        a, b, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"query_id": queries.column("query_id").take(pa.array(a)), "id": ids[b], "score": score}, schema=shape)

    return left.groupBy("cell", "_a", "_b").cogroup(right.groupBy("cell", "_a", "_b")).applyInArrow(best, "query_id long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    each = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k_each(vectors: DataFrame, cells: DataFrame, queries: DataFrame, k: int, floor: float, probes: int = 4, block: int = 8192) -> DataFrame:
    """query_id, id, score, rank: of every query (query_id, embedding) the k ids most like it with a cosine of at least the floor, exactly.

    vectors (id, embedding, cell) and cells are those of `in_cells`; an id may have
    several vectors, the best counts.  Ties go to the smaller id; ids are longs.
    A query first searches the `probes` cells that may hold the best, then all those
    that may still hold better ones than its k-th: no vector of a cell is nearer
    than the pivot's angle less the cell's radius.
    """
    told = cells.orderBy("cell").toArrow()  # as many as `in_cells` was asked for
    names, radius = told.column("cell").to_numpy(), told.column("radius").to_numpy()
    pivots = _unit(told.column("pivot")) if len(told) else np.zeros((0, 1))

    def chosen(first: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(names):
                    continue
                angle = np.arccos(np.clip(_unit(batch.column("embedding")) @ pivots.T, -1, 1)) - radius
                bound, least = np.cos(np.maximum(angle, 0)) + 1e-6, batch.column("least").to_numpy()
                nth = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
                i, j = np.nonzero((bound >= least[:, None]) & ((nth < probes) if first else (nth >= probes)))
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("query_id", "embedding", "least")), pa.array(names[j])], ["query_id", "embedding", "least", "cell"])

        return rows

    queries = kept(_usable(queries).select("query_id", "embedding", F.lit(float(floor)).alias("least")), "queries")
    shape = f"query_id long, embedding {dict(queries.dtypes)['embedding']}, least double, cell int"
    near = kept(_ranked(_best_in_blocks(vectors, kept(queries.mapInArrow(chosen(True), shape), "asked"), k, floor, block), k), "near")
    bar = near.where(F.col("rank") == k).select(F.col("query_id").alias("_query"), F.col("score").alias("_bar"))
    rest = queries.join(bar, F.col("query_id") == F.col("_query"), "left").select("query_id", "embedding", F.greatest("least", F.coalesce("_bar", "least")).alias("least"))
    more = _best_in_blocks(vectors, kept(rest.mapInArrow(chosen(False), shape), "asked"), k, floor, block)
    return _ranked(near.drop("rank").unionByName(more), k)
