"""Mixing sources to target weights with hash-threshold histograms.

Every source gets a target from its weight. It is met with `base` copies of all its documents and
one more copy of those whose hash lies at or below a threshold. The threshold is found without
sorting: sizes are summed by source and hash bucket, the bucket in which the budget runs out is
found, and only the rows of that bucket are summed again by finer buckets. Thresholds are nested: a
smaller budget takes a subset of what a larger one takes. A source of any size arrives at a shuffle
as one row per task and bucket.

Defined results: a null text has size 0, a null source is a source (the last), a source without
words has target 0 and its documents are taken 0 times; rows that share doc_id and text are taken
alike; extra columns are carried by `mixed`. A budget that ends inside a document, all equal rows
of it together, is rounded to the nearer side. The number of sources is taken to fit one task (one row each); rows are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtally.llm.common import quoted, small, stored, text_of, unused, words_in

WEIGHTS = (5, 2, 1)
#: Bits of the hash, and of each refinement.
BITS, STEP = 60, 10


def hash_of() -> Column:
    """A hash of 60 bits from doc_id and text."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("#"), F.md5(text_of()))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, target) by weight; what a source cannot hold is shared again by weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*(F.lit(w) for w in weights))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = stored(sources.withColumn("weight", kinds[(F.row_number().over(order) - 1) % len(weights)]), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # One row of sums: what is left for the sources that are not full yet.
        over = F.col("source_size") * most < F.lit(level) * F.col("weight")
        row = table.agg(
            F.count(F.when(over, 1)).alias("full"),
            F.sum(F.when(over, F.col("source_size") * most).otherwise(0)).alias("held"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if row["full"] == full or not row["weight"]:
            break
        full, level = row["full"], (total * share - row["held"]) / row["weight"]
    even = F.lit(level) * F.col("weight")
    return table.select("source", "source_size", F.when(F.col("source_size") * most < even, (F.col("source_size") * most).cast("double")).otherwise(even).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame, most: int = 3) -> DataFrame:
    """goals with `base` and `threshold`: copies of every document, and the hash up to which one more."""
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    state = goals.withColumn("base", base)
    rest = F.when(F.col("base") >= most, F.lit(0.0)).otherwise(F.col("target") - F.col("base") * F.col("source_size"))
    # low: hashes below it are taken. rest: what is still to be taken from low on, within `bits`.
    state = stored(state.withColumns({"rest": rest, "low": F.lit(0).cast("long"), "done": F.col("source_size") == 0}), "thresholds")
    by_bucket = Window.partitionBy("source").orderBy("bucket")
    for bits in range(BITS - STEP, -1, -STEP):
        live = small(state.where("not done").select(F.col("source").alias("_s"), "low", "rest"))
        inside = F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", bits + STEP) == F.shiftright("low", bits + STEP))
        buckets = sizes.join(live, inside).groupBy("source", F.shiftright("hash", bits).alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("hash").alias("first"), F.max("hash").alias("last"), F.first("rest").alias("rest"))
        summed = buckets.withColumn("until", F.sum("size").over(by_bucket)).withColumn("before", F.col("until") - F.col("size"))
        # The bucket in which the budget runs out; the last one when it never does.
        edge = summed.groupBy("source").agg(
            F.min(F.when(F.col("until") > F.col("rest"), F.struct("bucket", "before", "size", "first", "last"))).alias("e"),
            F.max("last").alias("end"), F.first("rest").alias("rest"))
        single = F.col("e.first") == F.col("e.last")
        nearer = F.col("rest") - F.col("e.before") > F.col("e.size") / 2
        found = edge.select(
            F.col("source").alias("_s"),
            F.when(F.col("e").isNull(), F.col("end") + 1)
            .when(single, F.col("e.first") + nearer.cast("long"))
            .otherwise(F.shiftleft(F.col("e.bucket"), bits)).alias("_low"),
            (F.col("rest") - F.coalesce(F.col("e.before"), F.lit(0))).alias("_rest"),
            (F.col("e").isNull() | single).alias("_done"),
        )
        state = stored(
            state.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", "source_size", "target", "base",
                F.coalesce("_rest", "rest").alias("rest"), F.coalesce("_low", "low").alias("low"), F.coalesce("_done", "done").alias("done")),
            "thresholds")
        if state.where("not done").isEmpty():
            break
    return state.select("source", "source_size", "target", "base", (F.col("low") - 1).alias("threshold"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_in(text_of()).alias("size"), hash_of().alias("hash"))


def _planned(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    return stored(thresholds(sizes, targets(sizes, weights, share, most), most), "mixing")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    sizes = stored(_sized(docs), "sizes")
    plan = _planned(sizes, weights, share, most).withColumnRenamed("source", "_s")
    return sizes.join(small(plan), F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("base") + (F.col("hash") <= F.col("threshold")).cast("long"))).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """The documents the mix takes, each as often as it is taken."""
    sizes = stored(_sized(docs), "sizes")
    own, source, base, to, copy = (unused(docs, n) for n in ("mix_hash", "mix_source", "mix_base", "mix_to", "mix_copy"))
    plan = _planned(sizes, weights, share, most).select(F.col("source").alias(source), F.col("base").alias(base), F.col("threshold").alias(to))
    rows = docs.withColumn(own, hash_of()).join(small(plan), F.col("source").eqNullSafe(F.col(source)))
    times = F.col(base) + (F.col(own) <= F.col(to)).cast("long")
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*quoted(docs.columns))
