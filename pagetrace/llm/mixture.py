"""Mixture-controlled packing: deficit round-robin over source queues.

Every source has a queue of its documents.  In each round a queue is credited
its quantum, its target share of one window, and serves its next document whole
as soon as its credit covers it; what is left over stays as the queue's deficit
for later rounds.  Documents of more than a window count as several packets of a
window, so no round is longer than the credits of its queues by more than a
packet each, and every window of the stream holds the target proportions to
within a packet of each source.

A packet that ends E tokens into its queue is served in the first round w with
w * quantum >= E.  With that closed form no round has to wait for the one
before: each partition tells its packets' rounds by itself, packets are sorted
by round, source and place, and the running sum of their sizes is their place in
the stream.  Sequences are the stream cut every `window` tokens: all are full but
the last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .common import in_batches, stash
from .wordbpe import encoding

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, round long"
#: The round of sources whose target is nothing: after all others.
LAST = 1 << 62


def encoded(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """doc_id, source, part, place, above, n_tokens, width, ids (little-endian, the end id last) of every row.

    above: tokens of the same source in earlier rows of the same input partition.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, tokens = TaskContext.get().partitionId(), 0, {}
        for batch, ids, at in encoding(vocabulary, batches):
            sizes = np.diff(at) + 1
            out = np.full(int(sizes.sum()), end, "<u2" if ids.max(initial=end) < 1 << 16 else "<u4")
            begin = np.cumsum(sizes) - sizes
            out[textscan.ragged(begin, sizes - 1)] = ids
            above = np.empty(len(sizes), np.int64)
            for i, (source, n) in enumerate(zip(batch.column("source").to_pylist(), sizes.tolist())):
                above[i] = tokens.get(source, 0)
                tokens[source] = above[i] + n
            n = batch.num_rows
            cuts = np.r_[begin, len(out)] * out.itemsize
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(np.full(n, part, np.int64)), pa.array(np.arange(done, done + n)), pa.array(above), pa.array(sizes), pa.array(np.full(n, out.itemsize, np.int32)), data.cast(pa.binary())],
                ["doc_id", "source", "part", "place", "above", "n_tokens", "width", "ids"],
            )
            done += n

    wanted = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return wanted.mapInArrow(rows, "doc_id long, source string, part long, place long, above long, n_tokens long, width int, ids binary")


def quanta(totals: DataFrame, targets: dict[str | None, float] | None, window: int) -> DataFrame:
    """source, quantum from source, total: tokens that a source is credited in each round.

    targets: share by source.  Sources that it doesn't name have what it leaves
    over in proportion to their tokens, nothing if it leaves nothing; without
    targets every source has its share of all tokens.
    """
    named = {k: float(v) for k, v in (targets or {}).items()}
    if any(v < 0 for v in named.values()) or sum(named.values()) > 1 + 1e-9:
        raise ValueError("targets are shares of at least 0 that add up to 1 at most")
    own = F.lit(None).cast("double")
    for source, share in named.items():
        own = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(share)).otherwise(own)
    shared = totals.withColumn("own", own)
    others = shared.where("own is null").agg(F.sum("total")).first()[0] or 0
    rest = max(0.0, 1.0 - sum(named.values()))
    rest = 0.0 if rest < 1e-9 else rest
    return shared.select("source", (F.coalesce("own", F.lit(rest) * F.col("total") / F.lit(float(max(1, others)))) * window).alias("quantum"))


def placed(packets: DataFrame) -> DataFrame:
    """Packets (round, source, behind, size, ...) with `stream`: the sizes of all before them by round, source, behind."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            ends = done + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), part, np.int64)), pa.array(ends - sizes)], [*batch.schema.names, "run", "within"])
            done = int(ends[-1]) if len(ends) else done

    shape = ", ".join(f"{n} {t}" for n, t in packets.dtypes)
    ordered = packets.repartitionByRange("round", "source", "behind").sortWithinPartitions("round", "source", "behind")
    # the runs are counted and read again: they must not be dealt out anew
    runs = stash(ordered.mapInArrow(rows, f"{shape}, run long, within long"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    base = runs.groupBy("run").agg(F.sum("size").alias("n")).select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return runs.join(F.broadcast(base), "run").withColumn("stream", F.col("base") + F.col("within")).drop("run", "within", "base")


def pack(docs: DataFrame, vocabulary: str, end: int = 1, window: int = 2048, targets: dict[str | None, float] | None = None) -> DataFrame:
    """One row for each piece of every document: PIECE.

    A null text counts as empty (its one id is the end id), a null source is a
    source of its own; repeated and null doc_ids are rows like any other.  An
    empty table gives no rows.  targets: see `quanta`; a source whose documents
    are all served drops out and the others go on in their proportions.
    """
    tokens = stash(encoded(docs, vocabulary, end))
    each = tokens.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    rates = quanta(each.groupBy("source").agg(F.sum("n").alias("total")), targets, window)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each input partition
    base = each.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    base = base.join(rates.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(F.col("source").alias("_source"), F.col("part").alias("_part"), "base", "quantum")
    narrow = tokens.select("part", "place", "source", "above", "n_tokens")
    queued = narrow.join(base, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    cut = queued.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(window).cast("long"))))
    size = F.least(F.lit(window).cast("long"), F.col("n_tokens") - F.col("start"))
    behind = F.col("base") + F.col("above") + F.col("start") + size
    packets = cut.select(
        F.when(F.col("quantum") > 0, F.ceil(behind / F.col("quantum"))).otherwise(F.lit(LAST)).cast("long").alias("round"), "source", behind.alias("behind"), size.alias("size"), "part", "place", "start"
    )
    # of a document at once: its packets are as many as it has windows
    spread = placed(packets).groupBy("part", "place").agg(F.sort_array(F.collect_list(F.struct("start", "size", "stream", "round"))).alias("packets"))

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.slices(batches, "ids"):
            many = batch.column("packets").value_lengths().to_numpy().astype(np.int64)
            flat = batch.column("packets").flatten()
            begin, size, place, turn = (flat.field(i).to_numpy() for i in range(4))
            row = np.repeat(np.arange(batch.num_rows), many)
            # at the ends of sequences
            parts = (place + size - 1) // window - place // window + 1
            own = np.repeat(np.arange(len(row)), parts)
            sequence = place[own] // window + textscan.ragged(np.zeros(len(own), np.int64)[: len(parts)], parts)
            a = np.maximum(place[own], sequence * window)
            length = np.minimum((place + size)[own], (sequence + 1) * window) - a
            start, row = begin[own] + a - place[own], row[own]
            texts = [np.frombuffer(x.as_buffer(), f"<u{w}").astype("<u4").data.cast("B") for x, w in zip(batch.column("ids"), batch.column("width").to_pylist())]
            crc = [zlib.crc32(texts[r][4 * i : 4 * (i + n)]) for r, i, n in zip(row.tolist(), start.tolist(), length.tolist())]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), batch.column("n_tokens").take(take), pa.array(sequence), pa.array(a - sequence * window), batch.column("source").take(take), pa.array(turn[own])],
                [f.split()[0] for f in PIECE.split(", ")],
            )

    whole = tokens.select("part", "place", "doc_id", "source", "n_tokens", "width", "ids").join(spread, ["part", "place"])
    return whole.select("doc_id", "source", "n_tokens", "width", "ids", "packets").mapInArrow(piece, PIECE)
