"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) are sorted by size and go, largest
first, to the least-loaded shard of a heap.  Groups of one size may change places,
so the driver only sees how many groups there are of each size and places runs of
equal groups; a group's rank among those of its size tells its shard.  Different
sizes add up, so n of them take n * n / 2 bytes: 100 TB have 14 million of them
at the very most, and documents far fewer.  The placement is that of the heap over
all groups, at every number of groups.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Rows of narrow columns that are broadcast at most; groups of 1/HOT of all rows are hot.
NARROW, HOT = 500_000, 4096


def _many(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n items of one size each shard takes, items going to the least-loaded shard (ties to the lower number).

    A shard of load l takes its items at loads l, l + size, l + 2 * size and so
    on; the n least of all those are taken.  Their bound is found by halving.
    """
    below = lambda t: [max(0, -(-(t - l) // size)) for l in loads]
    low, high = min(loads), max(loads) + size * n + 1
    while high - low > 1:
        middle = (low + high) // 2
        if sum(below(middle)) <= n:
            low = middle
        else:
            high = middle
    taken = below(low)
    left = n - sum(taken)
    for s, l in enumerate(loads):
        if left and l <= low and (low - l) % size == 0:
            taken[s], left = taken[s] + 1, left - 1
    return taken


def longest_first(runs: list[tuple[int, int]], shards: int) -> tuple[list[int], list[int], list[int]]:
    """Columns size, end, shard: of the groups of a size, those ranked below an end and not below the one before have its shard.

    runs are (size, how many groups have it), each size once; groups go by falling
    size to the least-loaded shard, ties to the lower number.
    """
    heap = [(0, s) for s in range(shards)]
    sizes, ends, places = [], [], []
    for size, n in sorted(runs, reverse=True):
        if n > shards:
            loads = [0] * shards
            for load, s in heap:
                loads[s] = load
            taken = _many(loads, size, n)
            heap = [(l + size * k, s) for s, (l, k) in enumerate(zip(loads, taken))]
            heapq.heapify(heap)
            told = [(s, k) for s, k in enumerate(taken) if k]
        else:
            told = []
            for _ in range(n):
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                told.append((s, 1))
        end = 0
        for s, k in told:
            end += k
            sizes.append(size)
            ends.append(end)
            places.append(s)
    return sizes, ends, places


def _placed(groups: DataFrame, shards: int) -> DataFrame:
    """_group, _rows, shard of groups (_group, _bytes, _rows, _at: the partition they lie in)."""
    spark = groups.sparkSession
    counts = stash(groups.groupBy("_bytes", "_at").count())
    runs = counts.groupBy("_bytes").agg(F.sum("count").alias("n")).toArrow()
    told = longest_first(list(zip(runs.column("_bytes").to_pylist(), runs.column("n").to_pylist())), shards)
    flat = pa.table([pa.array(told[0], pa.int64()), pa.array(told[1], pa.int64()), pa.array(told[2], pa.int32())], ["_bytes", "_end", "_shard"])
    ends = spark.createDataFrame(flat).groupBy("_bytes").agg(F.sort_array(F.collect_list(F.struct("_end", "_shard"))).alias("_ends"))  # at most `shards` of them
    # ranks go by partition first, so that no task sees all groups of a size
    before = Window.partitionBy("_bytes").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bytes", "_at", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")).join(ends, "_bytes")
    rank = F.col("_start") + F.row_number().over(Window.partitionBy("_bytes", "_at").orderBy("_group")) - 1
    return (
        groups.join(starts, ["_bytes", "_at"])
        .withColumn("_rank", rank)
        .select("_group", "_rows", F.element_at(F.filter("_ends", lambda e: e["_end"] > F.col("_rank")), 1)["_shard"].alias("shard"))
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    size is the text's UTF-8 bytes plus 8; a null text counts as empty, and
    both fall into one group.  Rows with equal texts share a shard, so a group
    larger than a fair share has a shard of its own and stays whole.  Repeated
    and null doc_ids are rows like any other.  An empty table gives no rows.
    Columns other than doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stash(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_group"),
            F.spark_partition_id().alias("_part"),
        )
    )
    groups = stash(rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")).withColumn("_at", F.spark_partition_id()))
    told = groups.agg(F.count("*").alias("groups"), F.sum("_rows").alias("rows")).first()
    own = stash(_placed(groups, shards))
    if told["groups"] <= NARROW:
        assigned = rows.join(F.broadcast(own.drop("_rows")), "_group")
    else:
        # at most HOT groups have 1/HOT of all rows; the rows of the others are moved to their group
        hot = F.broadcast(own.where(F.col("_rows") * HOT >= told["rows"]).drop("_rows"))
        assigned = rows.join(hot, "_group").unionByName(rows.join(hot, "_group", "left_anti").join(own.drop("_rows"), "_group"))
    # A slot is the rows of the shard in earlier input partitions plus the place in one's own:
    # no task sees more than the rows of one shard in one input partition.
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = assigned.groupBy("shard", "_part").count().select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "size", "text_crc32"))
    return assigned.join(starts, ["shard", "_part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_start") + place - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
