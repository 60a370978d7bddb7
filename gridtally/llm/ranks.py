"""Places of rows in an order, found without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridtally.llm.common import small, stored, unused


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "ranked") -> DataFrame:
    """df with `pos`, the place of each row in its group (from 0), and `n`, the rows of its group.

    Rows are dealt by ranges of the order, so a group with a third of all rows, or a third of all
    rows in one tie, spreads over many tasks. A row's place is its number within its range plus the
    counts of the ranges before; only one count per group and range is put in order. Groups and order
    columns sort ascending, nulls first; equal rows come in any order. The result is a stored table
    joined with those counts.
    """
    tie, at = unused(df, "tie"), unused(df, "at")
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order, tie)]
    salted = df.withColumn(tie, F.xxhash64(F.monotonically_increasing_id()))
    dealt = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    placed = stored(dealt.withColumn(at, F.monotonically_increasing_id()), name)
    part = F.shiftright(F.col(at), 33)
    counts = placed.groupBy(*group, part.alias("part")).agg(F.count("*").alias("rows"), F.min(at).alias("first"))
    # At most one row per range and group.
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(c).alias(f"of_{i}") for i, c in enumerate(group)], "part", "first",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy(*group)).alias("n"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{i}")) for i, c in enumerate(group)]
    found = placed.join(small(counts), [*same, part == F.col("part")])
    return found.select(*[c for c in placed.columns if c != at], (F.col(at) - F.col("first") + F.col("before")).alias("pos"), "n")
