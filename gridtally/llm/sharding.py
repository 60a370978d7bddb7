"""Sharding by longest-processing-time scheduling: equal texts stay together, shards get near equal bytes.

Groups of equal texts are summed before the shuffle, so a group of any size is one row per task. The
largest group goes first, each to the least-loaded shard of a heap. Groups of one size are
interchangeable, so the heap deals sizes with their counts: the driver gets one row for each distinct
size of a group, however many groups there are, and sizes are whole numbers of bytes up to that of
the largest group. Groups of one size are then numbered, and their numbers tell their shards.

Defined results: a null text is empty; null doc_ids and repeated rows get slots like any other;
extra columns are ignored. The law is `bytes`, so grown_shard is null.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtally.llm.common import small, stored, text_of
from gridtally.llm.ranks import ranked


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """For each (size, count), largest size first: how many of these groups every shard gets.

    As if each group were taken from a sorted list and put on the least-loaded shard, the first of
    equals. Many groups of one size fill the shards up to a common level at once; the heap deals the rest.
    """
    loads = [0] * shards
    out = []
    for size, count in sorted(classes, reverse=True):
        got = [0] * shards
        if count > 4 * shards:
            low, high = min(loads), min(loads) + size * (count + 1)
            # The highest level below which the groups do not run out.
            while high - low > 1:
                level = (low + high) // 2
                low, high = (level, high) if sum(max(-(-(level - x) // size), 0) for x in loads) <= count else (low, level)
            got = [max(-(-(low - x) // size), 0) for x in loads]
        heap = [(x + size * n, k) for k, (x, n) in enumerate(zip(loads, got, strict=True))]
        heapq.heapify(heap)
        for _ in range(count - sum(got)):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            got[k] += 1
        loads = [x + size * n for x, n in zip(loads, got, strict=True)]
        out.append((size, got))
    return out


def _plan(groups: DataFrame, shards: int) -> DataFrame:
    """(size, ends): the numbers of a size's groups at which the next shard begins."""
    found = groups.groupBy("size").agg(F.count("*").alias("n")).toArrow()
    plan = schedule(zip(found["size"].to_pylist(), found["n"].to_pylist(), strict=True), shards)
    ends = [list(accumulate(got)) for _, got in plan]
    table = pa.table({"size": pa.array([s for s, _ in plan], pa.int64()), "ends": pa.array(ends, pa.list_(pa.int64()))})
    return groups.sparkSession.createDataFrame(table, "size long, ends array<long>")


def assigned(docs: DataFrame, shards: int = 8, hot_share: int = 10_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard), stored. hot_share: groups of more than 1 / hot_share of the rows are broadcast."""
    text = text_of()
    rows = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key")),
        "shard-rows",
    )
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n_rows")), "shard-groups")
    placed = ranked(groups, ["size"], ["key"], "shard-ranked").drop("n")
    shard = F.size(F.filter("ends", lambda end: end <= F.col("pos"))).alias("shard")
    found = stored(placed.join(small(_plan(groups, shards)), "size").select("key", "n_rows", shard), "shard-of-group")
    # Fewer than hot_share groups can have that many rows; the others are no hot keys of a join.
    hot = found.where(F.col("n_rows") * hot_share > rows.count())
    marked = rows.join(F.broadcast(hot.select("key", F.col("shard").alias("_hot"))), "key", "left")
    rest = marked.where("_hot IS NULL").join(found.select("key", "shard"), "key")
    columns = ["doc_id", "size", "text_crc32"]
    out = marked.where("_hot IS NOT NULL").select(*columns, F.col("_hot").alias("shard")).unionAll(rest.select(*columns, "shard"))
    return stored(out, "shard-places")


def sharded(docs: DataFrame, shards: int = 8, rows_per_part: int = 200_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): slots count from 0 in each shard.

    A shard is numbered in parts by hash, which start where the parts before them end.
    """
    places = assigned(docs, shards)
    parts = max(64, places.count() // (shards * rows_per_part))
    dealt = places.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(1)), F.lit(parts)).cast("int"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    offsets = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = dealt.withColumn("inside", inside).join(small(stored(offsets, "shard-parts")), ["shard", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
