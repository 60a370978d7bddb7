"""One-row key figures.

Every distinct count is a scalar subquery over its own column. Spark would otherwise copy
each row once per distinct column (Expand) before the shuffle; a column-pruned scan per
distinct count moves only the distinct keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtally.functions.numbers import mean, percent, total
from gridtally.operators.transforms import union_by_name
from gridtally.spec import PARSED, SOURCE_FILE, DatasetSpec


def _null() -> Column:
    return F.lit(None)


def safe_total(df: DataFrame, column: str, scale: int | None = None) -> Column:
    return total(F.col(column), scale) if column in df.columns else F.lit(0.0)


def safe_mean(df: DataFrame, column: str, scale: int | None = None) -> Column:
    return mean(F.col(column), scale) if column in df.columns else F.lit(0.0)


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> Column:
    """Distinct non-null values as a scalar expression; exact unless asked otherwise."""
    if column not in df.columns:
        return F.lit(0).cast("bigint")
    if approximate:
        return df.select(column).agg(F.approx_count_distinct(column).alias("n")).scalar()
    # Distinct first, then count: Spark would merge several count-distinct subqueries into one
    # aggregate and expand its rows after all.
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    return values.agg(F.count(F.lit(1)).alias("n")).scalar()


def safe_aggregates(df: DataFrame, measure: str, key: str, scale: int | None = None) -> DataFrame:
    """Null-safe sum, mean and distinct count."""
    figures = df.agg(
        safe_total(df, measure, scale).alias("total_value"), safe_mean(df, measure, scale).alias("mean_value")
    )
    return figures.withColumn("distinct_keys", distinct_count(df, key))


def date_span(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns:
        return df.agg(_null().cast("timestamp_ntz").alias("min"), _null().cast("timestamp_ntz").alias("max"))
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def _span(df: DataFrame, column: str) -> list[Column]:
    if column not in df.columns:
        return [_null().cast("timestamp_ntz").alias("span_min"), _null().cast("timestamp_ntz").alias("span_max")]
    return [F.min(column).alias("span_min"), F.max(column).alias("span_max")]


def readings_kpis(df: DataFrame, spec: DatasetSpec, approximate: bool = False) -> DataFrame:
    """Rows, meters, totals, mean/min/max of the daily sums, time span: two-level aggregation.

    The first level groups by day (null days included), so the daily sums and the totals
    come from one pass and only one row per day is shuffled from each task.
    """
    day, scale = spec.date.date, spec.measure_scale
    first, second = spec.measure, spec.second_measure or spec.measure
    by_day = F.col(day) if day in df.columns else _null().cast("date")
    daily = df.groupBy(by_day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        safe_total(df, first, scale).alias("first_sum"),
        safe_total(df, second, scale).alias("second_sum"),
        *_span(df, spec.date.parsed),
    )
    dated = F.when(F.col("day").isNotNull(), F.col("first_sum"))
    figures = daily.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        total(F.col("first_sum"), scale).alias("total_kwh_consumption"),
        total(F.col("second_sum"), scale).alias("total_kvah_consumption"),
        mean(dated, scale).alias("average_daily_kwh"),
        F.coalesce(F.min(dated), F.lit(0.0)).alias("min_daily_kwh"),
        F.coalesce(F.max(dated), F.lit(0.0)).alias("max_daily_kwh"),
        F.min("span_min").alias("span_min"),
        F.max("span_max").alias("span_max"),
    )
    return figures.withColumn("unique_meters", distinct_count(df, spec.entity, approximate))


def payments_kpis(df: DataFrame, spec: DatasetSpec, approximate: bool = False) -> DataFrame:
    """Transactions, service points, meters, total, mean, span, rows with only a time of day."""
    flag = spec.date.is_time_only
    time_only = F.count_if(F.col(flag)) if flag in df.columns else F.lit(0).cast("bigint")
    figures = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.lit(1)).alias("transactions"),
        safe_total(df, spec.measure, spec.measure_scale).alias("total_transaction_amount"),
        safe_mean(df, spec.measure, spec.measure_scale).alias("average_transaction_amount"),
        time_only.alias("time_only_rows"),
        *_span(df, spec.date.parsed),
    )
    return figures.withColumns(
        {
            "unique_service_points": distinct_count(df, "servicepointno", approximate),
            "unique_meters": distinct_count(df, "meterno", approximate),
        }
    )


def dataset_kpis(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    return readings_kpis(df, spec) if spec.date.style == "full" else payments_kpis(df, spec)


def overview_kpis(datasets: list[tuple[DatasetSpec, DataFrame]], inventory: DataFrame) -> DataFrame:
    """File counts and every numeric key figure, long form: (dataset, metric, value)."""
    counts = [inventory.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("all").alias("dataset"), F.lit("files").alias("metric"), "value")]
    for spec, df in datasets:
        mine = inventory.where(F.col("dataset") == spec.name)
        counts.append(mine.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit(spec.name).alias("dataset"), F.lit("files").alias("metric"), "value"))
        figures = dataset_kpis(df, spec)
        names = [c for c in figures.columns if not c.startswith("span_")]
        wide = figures.select(*[F.col(c).cast("double").alias(c) for c in names])
        counts.append(wide.unpivot([], names, "metric", "value").select(F.lit(spec.name).alias("dataset"), "metric", "value"))
    return union_by_name(counts)


def coverage(datasets: list[tuple[DatasetSpec, DataFrame]], inventory: DataFrame) -> DataFrame:
    """Files, rows and date span of each dataset."""
    rows = []
    for spec, df in datasets:
        files = inventory.where(F.col("dataset") == spec.name).agg(F.count(F.lit(1)).alias("n")).scalar()
        figures = df.agg(F.count(F.lit(1)).alias("rows"), *_span(df, spec.date.parsed))
        text = F.concat_ws(" to ", F.to_date("span_min").cast("string"), F.to_date("span_max").cast("string"))
        rows.append(
            figures.select(
                F.lit(spec.display_name).alias("dataset"),
                files.alias("files"),
                "rows",
                F.when(F.col("span_min").isNull(), F.lit("Unavailable")).otherwise(text).alias("date_span"),
            )
        )
    return union_by_name(rows)


def parse_coverage(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Share of rows with a full timestamp in the current selection."""
    parsed = F.count_if(F.col(spec.date.status) == PARSED) if spec.date.status in df.columns else F.count(spec.date.parsed)
    figures = df.agg(parsed.alias("parsed_rows"), F.count(F.lit(1)).alias("total_rows"))
    return figures.withColumn("parse_coverage_pct", percent(F.col("parsed_rows"), F.col("total_rows")))


def entity_readings(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Rows, total and row-level extremes of each meter; filter first for a single one."""
    key = spec.entity
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        safe_total(df, spec.measure, spec.measure_scale).alias("total_value"),
        F.min(spec.measure).alias("min_value"),
        F.max(spec.measure).alias("max_value"),
    )


def entity_payments(df: DataFrame, spec: DatasetSpec, key: str) -> DataFrame:
    """Rows, total, mean and number of source files of each payer.

    Grouping by (key, file) first keeps the distinct count a plain count and lets the map
    side shrink a hot key before the shuffle.
    """
    scale = spec.measure_scale
    per_file = df.where(F.col(key).isNotNull()).groupBy(key, SOURCE_FILE).agg(
        F.count(F.lit(1)).alias("n"), total(F.col(spec.measure), scale).alias("amount"),
        F.count(spec.measure).alias("n_amount"),
    )
    return per_file.groupBy(key).agg(
        F.sum("n").alias("rows"),
        total(F.col("amount"), scale).alias("total_value"),
        # Null when no amount is present: a mean of nothing is not zero here.
        (total(F.col("amount"), scale) / F.nullif(F.sum("n_amount"), F.lit(0))).alias("mean_value"),
        F.count(SOURCE_FILE).alias("source_files"),
    )
