"""Grouped totals, top-k and distributions.

All sums are partially aggregated before the shuffle, so one key holding a third of the rows
reaches its reducer as one row per map task. Sorting is applied to aggregates only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.functions.numbers import total
from gridtally.functions.quantiles import GROUP_LIMIT, group_percentiles
from gridtally.spec import ROW_ORDINAL, SOURCE_FILE, DatasetSpec


def total_by(df: DataFrame, keys: Sequence[str] | str, measure: str, scale: int | None = None) -> DataFrame:
    """Sum of a measure per key; rows with a null key are left out."""
    names = [keys] if isinstance(keys, str) else list(keys)
    for name in names:
        df = df.where(F.col(name).isNotNull())
    return df.groupBy(*names).agg(total(F.col(measure), scale).alias("total_value"))


def daily_total(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    day = spec.date.date
    return total_by(df, day, spec.measure, spec.measure_scale).orderBy(day)


def daily_total_by_entity(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Daily totals of every meter; filter first for a single one."""
    keys = [spec.entity, spec.date.date]
    return total_by(df, keys, spec.measure, spec.measure_scale)


def top_entities(df: DataFrame, spec: DatasetSpec, k: int = 10) -> DataFrame:
    """The k entities with the largest total; ties by key. Planned as a per-task top-k."""
    totals = total_by(df, spec.entity, spec.measure, spec.measure_scale)
    return totals.orderBy(F.desc("total_value"), F.asc(spec.entity)).limit(k)


def amount_by_source(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    totals = total_by(df, SOURCE_FILE, spec.measure, spec.measure_scale)
    return totals.orderBy(F.desc("total_value"), F.asc(SOURCE_FILE))


def hourly_profile(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Amount per hour of day, from full timestamps and bare times alike."""
    hour = spec.date.analysis_hour
    return total_by(df, hour, spec.measure, spec.measure_scale).orderBy(hour)


def category_breakdown(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Sum and number of non-null amounts per category, largest sum first."""
    category = spec.category
    if category is None:
        raise ValueError(f"{spec.name} has no category column")
    grouped = df.where(F.col(category).isNotNull()).groupBy(category)
    return grouped.agg(
        total(F.col(spec.measure), spec.measure_scale).alias("sum"), F.count(spec.measure).alias("count")
    ).orderBy(F.desc("sum"), F.asc(category))


def source_breakdown(df: DataFrame, spec: DatasetSpec, entity: str) -> DataFrame:
    """Amount per (entity, source file); filter first for a single entity."""
    totals = total_by(df, [entity, SOURCE_FILE], spec.measure, spec.measure_scale)
    return totals


def histogram(df: DataFrame, measure: str, bins: int = 40) -> DataFrame:
    """Equal-width histogram with empty bins kept: (bin, lower, upper, count).

    The bounds are one scalar subquery; the counting pass shuffles at most `bins` rows per task.
    Infinite values have no bin and are left out.
    """
    value = F.col(measure).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    rows = df.where(finite).select(value.alias("v"))
    ends = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("ends")).scalar()
    lo, hi = ends["lo"], ends["hi"]
    place = F.when(lo == hi, F.lit(1)).otherwise(F.least(F.width_bucket("v", lo, hi, F.lit(bins)), F.lit(bins)))
    counts = rows.select(place.cast("bigint").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    width = (hi - lo) / F.lit(bins)
    every = df.sparkSession.range(1, bins + 1, 1, 1).select(F.col("id").alias("bin"))
    return (
        every.join(counts, "bin", "left")
        .select(
            "bin",
            (lo + (F.col("bin") - 1) * width).alias("lower"),
            (lo + F.col("bin") * width).alias("upper"),
            F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
        )
        .orderBy("bin")
    )


def _fences(percentiles: Column, multiplier: float) -> dict[str, Column]:
    q1, median, q3 = percentiles[0], percentiles[1], percentiles[2]
    spread = F.lit(float(multiplier)) * (q3 - q1)
    return {"q1": q1, "median": median, "q3": q3, "lower_fence": q1 - spread, "upper_fence": q3 + spread}


# Largest side that is sent to every executor.
BROADCAST_BYTES = 8 << 20


def _key_bytes(df: DataFrame, key: str) -> int:
    """Size of one row of fences per distinct key."""
    keys = df.select(key).distinct()
    size = F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + F.lit(96))
    return keys.agg(F.coalesce(size, F.lit(0).cast("bigint"))).first()[0]


def _fenced(
    df: DataFrame, measure: str, group: str | None, multiplier: float, limit: int
) -> tuple[DataFrame, str]:
    """Rows of the measure with the quartiles and fences of their group attached."""
    key = group or "group"
    quartiles = group_percentiles(df, measure, (0.25, 0.5, 0.75), group, limit)
    fences = quartiles.select(key, *[c.alias(n) for n, c in _fences(F.col("percentiles"), multiplier).items()])
    rows = df.where(F.col(measure).isNotNull() & ~F.isnan(F.col(measure).cast("double")))
    if group is None:
        # One row of fences for the whole table: a scalar subquery, not a join.
        one = fences.select(F.struct("q1", "median", "q3", "lower_fence", "upper_fence").alias("f")).scalar()
        return rows.select(F.lit(None).cast("string").alias(key), F.col(measure).alias("v"), one.alias("f")), key
    left = rows.select(F.col(group).alias("_key"), F.col(measure).alias("v"))
    right = fences.select(F.col(key), F.struct("q1", "median", "q3", "lower_fence", "upper_fence").alias("f"))
    if _key_bytes(rows, group) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    joined = left.join(right, left["_key"].eqNullSafe(right[key]))
    return joined.select(key, "v", "f"), key


def box_stats(
    df: DataFrame, measure: str, group: str | None = None, multiplier: float = 1.5, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and outlier count, per group."""
    rows, key = _fenced(df, measure, group, multiplier, limit)
    inside = (F.col("v") >= F.col("f.lower_fence")) & (F.col("v") <= F.col("f.upper_fence"))
    stats = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("f.q1").alias("q1"),
        F.min("f.median").alias("median"),
        F.min("f.q3").alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("v"))).alias("upper_whisker"),
        F.count_if(~inside).alias("outlier_count"),
    )
    return stats if group else stats.drop(key)


def box_outliers(
    df: DataFrame, measure: str, group: str | None = None, multiplier: float = 1.5, limit: int = GROUP_LIMIT
) -> DataFrame:
    """The points drawn outside the whiskers."""
    rows, key = _fenced(df, measure, group, multiplier, limit)
    points = rows.where((F.col("v") < F.col("f.lower_fence")) | (F.col("v") > F.col("f.upper_fence")))
    return points.select(key, F.col("v").alias(measure)) if group else points.select(F.col("v").alias(measure))


def preview(df: DataFrame, n: int = 1000, order_by: Sequence[str] | None = None) -> DataFrame:
    """First n rows in file order, for a table view.

    The place of the n-th row is found on the order columns alone. It then bounds the scan of the
    whole rows: the bound on the first order column skips row groups, and few rows are sorted.
    """
    order = list(order_by) if order_by else [c for c in (SOURCE_FILE, ROW_ORDINAL) if c in df.columns]
    if not order:
        return df.limit(n)
    place = F.struct(*order)
    last = df.select(place.alias("place")).orderBy("place").limit(n).agg(F.max("place").alias("last")).scalar()
    first = F.col(order[0])
    near = (first.isNull() | (first <= last[order[0]])) & (place <= last)
    return df.where(near).orderBy(*order).limit(n)
