"""Data-quality checks.

Each check is an aggregate followed by an unfold of its single row, so that the counts of all
checks can be taken in one scan (see plans/quality_suite.py).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.functions.numbers import as_number, percent
from gridtally.functions.quantiles import GROUP_LIMIT, column_percentiles
from gridtally.operators.filters import LIST_LIMIT
from gridtally.operators.transforms import data_columns, union_by_name
from gridtally.spec import (
    FAILED,
    FAILED_OR_MISSING,
    MISSING,
    PARSED,
    ROW_ORDINAL,
    SOURCE_FILE,
    TIME_ONLY,
    UNKNOWN,
    DatasetSpec,
    Thresholds,
)

ROWS = "n_rows"


def _unfold(one_row: DataFrame, rows: list[Column], schema: str) -> DataFrame:
    """Several output rows from the single row of an aggregate."""
    if not rows:
        return one_row.sparkSession.createDataFrame([], schema)
    return one_row.select(F.inline(F.array(*rows)))


def _numbers(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    kinds = {f.name: f.dataType for f in df.schema}
    return {c: as_number(F.col(c), kinds[c]) for c in columns if c in kinds}


# --- missing values -----------------------------------------------------------------------


def missing_cells(df: DataFrame) -> list[Column]:
    return [F.count(c).alias(f"present__{c}") for c in data_columns(df)]


def missing_table(one_row: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = []
    for c in columns:
        missing = F.col(ROWS) - F.col(f"present__{c}")
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                missing.alias("missing_count"),
                F.bround(percent(missing, F.col(ROWS)), 2).alias("missing_pct"),
            )
        )
    table = _unfold(one_row.where(F.col(ROWS) > 0), rows, "column string, missing_count bigint, missing_pct double")
    return table.orderBy(F.desc("missing_count"), F.asc("column"))


def missing_summary(df: DataFrame) -> DataFrame:
    """Null count and share of each column, most first. Empty text is not null."""
    return missing_table(df.agg(F.count(F.lit(1)).alias(ROWS), *missing_cells(df)), data_columns(df))


# --- numeric flags ------------------------------------------------------------------------


def flag_cells(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    cells = []
    for c, value in _numbers(df, columns).items():
        cells += [
            F.count_if(value.isNull()).alias(f"null__{c}"),
            F.count_if(value < 0).alias(f"negative__{c}"),
            F.count_if(value == 0).alias(f"zero__{c}"),
        ]
    return cells


def flag_table(one_row: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"null__{c}").alias("null_count"),
            F.col(f"negative__{c}").alias("negative_count"),
            F.col(f"zero__{c}").alias("zero_count"),
        )
        for c in columns
    ]
    return _unfold(one_row, rows, "column string, null_count bigint, negative_count bigint, zero_count bigint")


def numeric_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null, negative and zero counts of the numeric columns that are present."""
    present = [c for c in columns if c in df.columns]
    return flag_table(df.agg(F.count(F.lit(1)).alias(ROWS), *flag_cells(df, present)), present)


# --- outliers -----------------------------------------------------------------------------

_OUTLIERS = (
    "column string, outlier_count bigint, lower_bound double, upper_bound double, iqr_multiplier double"
)


def iqr_outliers(
    df: DataFrame,
    columns: Sequence[str],
    multiplier: float = 1.5,
    limit: int = GROUP_LIMIT,
    approximate: bool = False,
) -> DataFrame:
    """Values strictly outside the IQR fences, per numeric column.

    The quartiles (one row per column) come to the driver and return as literals, so the counting
    scan is a plain aggregate. Fewer than four values give no fences.
    """
    present = [c for c in columns if c in df.columns]
    numbers = df.select(*[value.alias(c) for c, value in _numbers(df, present).items()]) if present else df
    if not present:
        return df.sparkSession.createDataFrame([], _OUTLIERS)
    quartiles = {
        r["column"]: r for r in column_percentiles(numbers, present, (0.25, 0.75), limit, approximate).collect()
    }
    cells, rows = [], []
    for c in present:
        found = quartiles.get(c)
        if found is None or found["n"] < 4:
            bounds = (None, None, None)
            cells.append(F.lit(0).cast("bigint").alias(f"outside__{c}"))
        else:
            q1, q3 = found["percentiles"]
            low, high = q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)
            bounds = (low, high, float(multiplier))
            cells.append(F.count_if((F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high))).alias(f"outside__{c}"))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"outside__{c}").alias("outlier_count"),
                *[
                    F.lit(b).cast("double").alias(n)
                    for n, b in zip(("lower_bound", "upper_bound", "iqr_multiplier"), bounds)
                ],
            )
        )
    return _unfold(numbers.agg(F.count(F.lit(1)).alias(ROWS), *cells), rows, _OUTLIERS)


# --- parse outcomes -----------------------------------------------------------------------


def parse_cells(df: DataFrame, spec: DatasetSpec) -> list[Column]:
    date = spec.date
    if date.style == "full":
        return [(F.count_if(F.col(date.success)) if date.success in df.columns else F.lit(0).cast("bigint")).alias("parsed_ok")]
    if date.status not in df.columns:
        return [F.lit(0).cast("bigint").alias(f"status__{s}") for s in (PARSED, TIME_ONLY, MISSING, FAILED, UNKNOWN)]
    status = F.coalesce(F.col(date.status), F.lit(UNKNOWN))
    return [F.count_if(status == s).alias(f"status__{s}") for s in (PARSED, TIME_ONLY, MISSING, FAILED, UNKNOWN)]


def parse_table(one_row: DataFrame, spec: DatasetSpec) -> DataFrame:
    schema = "status string, count bigint"
    if spec.date.style == "full":
        rows = [
            F.struct(F.lit(PARSED).alias("status"), F.col("parsed_ok").alias("count")),
            F.struct(F.lit(FAILED_OR_MISSING).alias("status"), (F.col(ROWS) - F.col("parsed_ok")).alias("count")),
        ]
        return _unfold(one_row, rows, schema)
    rows = [
        F.struct(F.lit(s).alias("status"), F.col(f"status__{s}").alias("count"))
        for s in (PARSED, TIME_ONLY, MISSING, FAILED, UNKNOWN)
    ]
    return _unfold(one_row, rows, schema).where(F.col("count") > 0).orderBy(F.desc("count"), F.asc("status"))


def parse_summary(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Rows per parse outcome: two-way for full dates, by status for classified ones."""
    return parse_table(df.agg(F.count(F.lit(1)).alias(ROWS), *parse_cells(df, spec)), spec)


# --- temporal sanity ----------------------------------------------------------------------


def temporal_cells(df: DataFrame, spec: DatasetSpec, as_of: dt.datetime, max_future_days: int) -> list[Column]:
    parsed = F.col(spec.date.parsed) if spec.date.parsed in df.columns else F.lit(None).cast("timestamp_ntz")
    cutoff = F.lit(as_of + dt.timedelta(days=max_future_days)).cast("timestamp_ntz")
    return [
        F.count(parsed).alias("parsed_rows"),
        F.count_if(parsed > cutoff).alias("future_row_count"),
        F.min(parsed).alias("oldest_date"),
        F.max(parsed).alias("latest_date"),
    ]


def temporal_table(one_row: DataFrame, spec: DatasetSpec, as_of: dt.datetime, stale_days: int) -> DataFrame:
    cutoff = F.lit(as_of - dt.timedelta(days=stale_days)).cast("timestamp_ntz")
    return one_row.select(
        F.lit(spec.date.parsed).alias("date_column"),
        "parsed_rows",
        F.col(ROWS).alias("total_rows"),
        F.bround(percent(F.col("parsed_rows"), F.col(ROWS)), 2).alias("parse_coverage_pct"),
        "future_row_count",
        "latest_date",
        "oldest_date",
        F.coalesce(F.col("latest_date") < cutoff, F.lit(False)).alias("is_stale"),
        F.lit(stale_days).cast("bigint").alias("stale_days"),
    )


def temporal_sanity(
    df: DataFrame, spec: DatasetSpec, as_of: dt.datetime, max_future_days: int = 0, stale_days: int = 90
) -> DataFrame:
    """Coverage, rows beyond the future window, oldest and latest time, staleness; one row."""
    cells = temporal_cells(df, spec, as_of, max_future_days)
    return temporal_table(df.agg(F.count(F.lit(1)).alias(ROWS), *cells), spec, as_of, stale_days)


# --- categories ---------------------------------------------------------------------------

_CATEGORIES = "column string, allowed_count bigint, invalid_count bigint, sample_invalid_values string"


def categorical_check(
    df: DataFrame,
    allow_lists: Mapping[str, Sequence[object]],
    order_by: Sequence[str] | None = None,
    samples: int = 5,
) -> DataFrame:
    """Values outside each allow-list: how many rows, and the first distinct ones in row order.

    Rows are grouped by value first, so a frequent bad value is one row per task in the shuffle.
    """
    order = list(order_by) if order_by else [c for c in (SOURCE_FILE, ROW_ORDINAL) if c in df.columns]
    tables = []
    for column, allowed in allow_lists.items():
        texts = sorted({str(value) for value in allowed or ()})
        if column in df.columns and texts:
            tables.append(_invalid_values(df, column, texts, order, samples))
    return union_by_name(tables) if tables else df.sparkSession.createDataFrame([], _CATEGORIES)


def _invalid_values(df: DataFrame, column: str, texts: list[str], order: list[str], samples: int) -> DataFrame:
    value = F.col(column).cast("string")
    rows = df.where(F.col(column).isNotNull()).select(
        value.alias("value"), (F.struct(*order) if order else F.lit(0)).alias("place")
    )
    if len(texts) <= LIST_LIMIT:
        bad = rows.where(~F.col("value").isin(*texts))
    else:
        # The list is a local relation of known size; Spark broadcasts it only if it fits.
        bad = rows.join(df.sparkSession.createDataFrame([(t,) for t in texts], "value string"), "value", "left_anti")
    values = bad.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    first = values.orderBy("place", "value").limit(samples)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda row: row["value"])
    sample = first.agg(F.array_join(ordered, " | ").alias("s")).scalar()
    return values.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("invalid_count")).select(
        F.lit(column).alias("column"),
        F.lit(len(texts)).cast("bigint").alias("allowed_count"),
        "invalid_count",
        sample.alias("sample_invalid_values"),
    )


# --- warnings -----------------------------------------------------------------------------


# The wording of all warnings below is fixed: readers and exports compare these texts.


def _number(count: Column) -> Column:
    return F.format_number(count, 0)


def status_warnings(spec: DatasetSpec, thresholds: Thresholds) -> list[Column]:
    """Warning texts from the row and status counts, in order; null where one does not apply."""
    texts = [F.lit(t) for t in spec.known_limitations]
    if spec.date.style == "full":
        return texts
    name, column = spec.name, spec.date.column
    time_only, missing, parsed = (F.col(f"status__{s}") for s in (TIME_ONLY, MISSING, PARSED))
    share = percent(parsed, F.col(ROWS))
    floor = float(thresholds.full_datetime_warning_pct)
    if spec.date_limitation:
        texts.append(F.lit(spec.date_limitation))
    low = F.concat(
        F.lit(f"{name.title()} full datetime coverage is "),
        F.format_number(share, 1),
        F.lit(f"% which is below the warning threshold of {floor:.1f}%. Date-based charts remain available with caution."),
    )
    time_text = F.lit(f" {name} records contain time-only {column} values and cannot support full date analysis.")
    return texts + [
        F.when(time_only > 0, F.concat(_number(time_only), time_text)),
        F.when(missing > 0, F.concat(_number(missing), F.lit(f" {name} records have missing {column} values."))),
        F.when((parsed == 0) & (F.col(ROWS) > 0), F.lit(f"No {name} rows currently contain a parsed full datetime.")),
        F.when((F.col(ROWS) > 0) & (share < floor), low),
    ]


def suite_warnings(thresholds: Thresholds) -> list[Column]:
    """Further texts of the whole suite, from the temporal and categorical checks."""
    future, days, invalid = F.col("future_row_count"), thresholds.max_future_days, F.col("invalid_total")
    future_text = F.lit(f" rows have parsed dates beyond the allowed future window ({days} days).")
    stale = F.lit(f"Latest parsed date appears stale based on a {thresholds.stale_days}-day threshold.")
    invalid_text = F.lit(" values outside configured allow-lists.")
    return [
        F.when(future > 0, F.concat(_number(future), future_text)),
        F.when(F.col("is_stale"), stale),
        F.when(invalid > 0, F.concat(F.lit("Categorical validation found "), _number(invalid), invalid_text)),
    ]


def warning_table(one_row: DataFrame, texts: list[Column]) -> DataFrame:
    """(position, warning) without repeats, in order."""
    if not texts:
        return one_row.sparkSession.createDataFrame([], "position bigint, warning string")
    kept = F.array_distinct(F.filter(F.array(*texts), lambda t: t.isNotNull()))
    table = one_row.select(F.posexplode(kept).alias("position", "warning"))
    return table.select(F.col("position").cast("bigint").alias("position"), "warning")


def quality_warnings(df: DataFrame, spec: DatasetSpec, thresholds: Thresholds | None = None) -> DataFrame:
    one_row = df.agg(F.count(F.lit(1)).alias(ROWS), *parse_cells(df, spec))
    return warning_table(one_row, status_warnings(spec, thresholds or spec.thresholds))


# --- schema -------------------------------------------------------------------------------


def validate_columns(columns: Sequence[str], required: Sequence[str]) -> dict[str, object]:
    missing = [c for c in required if c not in columns]
    return {
        "missing_columns": missing,
        "extra_columns": [c for c in columns if c not in required],
        "is_valid": not missing,
        "status": f"Missing required columns: {', '.join(missing)}" if missing else "All required columns present",
    }


_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("is_valid", T.BooleanType()),
        T.StructField("missing_columns", T.StringType()),
        T.StructField("extra_columns", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)


def schema_report(spark: SparkSession, columns: Sequence[str], spec: DatasetSpec) -> DataFrame:
    """Missing and extra columns of a table against its spec; one row."""
    found = validate_columns([c for c in columns if c != ROW_ORDINAL], spec.required_columns)
    row = (
        spec.name,
        found["is_valid"],
        ", ".join(found["missing_columns"]),
        ", ".join(found["extra_columns"]),
        found["status"],
    )
    return spark.createDataFrame([row], _SCHEMA)
