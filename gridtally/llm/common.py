"""Helpers the operators share: stored tables, row positions, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.plans.ingest_job import scratch_folder


def new_uri(spark: SparkSession, name: str) -> str:
    """A fresh place in the folder that all executors share."""
    return f"{scratch_folder(spark)}/llm-{name}-{uuid.uuid4()}"


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Batches of at most `rows` rows go to Python meanwhile: texts of ten thousand rows are too much for a worker."""
    before = spark.conf.get(_BATCH_ROWS)
    if not 0 < int(before) <= rows:
        spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows as a Parquet table: a lost executor costs no more than the step that was running."""
    uri = new_uri(df.sparkSession, name)
    with short_batches(df.sparkSession):
        df.write.parquet(uri, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(names: list[str]) -> list[Column]:
    """Columns by their names, whatever signs these hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def plainly_named(df: DataFrame) -> DataFrame:
    """df with other names for columns whose names hold dots or back-ticks, which tasks in Python cannot be given."""
    return df.toDF(*(unused(df, f"column_{i}") if {".", "`"} & set(n) else n for i, n in enumerate(df.columns)))


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Edges of a node from which it counts as a hub.
HUB = 500


def _joined(rows: DataFrame, least: DataFrame, hubs: DataFrame) -> DataFrame:
    """rows (a, b) with `m`, the least of node a. Rows of hubs stay where they are, so no task gets all of one."""
    marked = rows.join(hubs.select("a", F.col("m").alias("_hub")), "a", "left")
    cold = marked.where("_hub IS NULL").join(least.where(F.col("n") <= HUB).select("a", "m"), "a").select("a", "b", "m")
    return marked.where("_hub IS NOT NULL").select("a", "b", F.col("_hub").alias("m")).unionAll(cold)


def smallest_reachable(edges: DataFrame, hub_rows: int = 100_000) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges no longer change, which takes about
    the square of the logarithm of the nodes at most. A node's least neighbour is a grouped minimum, so
    a node with very many edges is folded before the shuffle; those nodes' minima are then broadcast
    where they were counted to be few, so that the edges of a hub stay spread. The rows never exceed
    twice the edges. Each round is a stored table.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def starred(rows: DataFrame, least: DataFrame) -> DataFrame:
        least = stored(least, "least")
        hubs = least.where(F.col("n") > HUB)
        some = hubs.limit(hub_rows + 1).count()
        # Without hubs, or with too many to broadcast, the nodes meet their minima by key.
        return _joined(rows, least, F.broadcast(hubs)) if 0 < some <= hub_rows else rows.join(least.select("a", "m"), "a")

    table = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # Every larger neighbour of a node points at the smallest of its neighbourhood.
        near = both(table)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = starred(near.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every node's smaller neighbours point at the smallest of them.
        large = stored(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small_star = starred(large, least).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        table = stored(small_star.where("a <> b").distinct(), "edges")
        now = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = table.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return table.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A side for a join: broadcast when it was counted to have at most `rows` narrow rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words_in(column: Column) -> Column:
    """Number of words: runs of anything but the ASCII white space of the contracts."""
    return F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
