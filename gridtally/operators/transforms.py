"""Typed transforms of a raw, all-text table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.functions import dates, numbers, text
from gridtally.spec import ROW_ORDINAL, SOURCE_FILE, DatasetSpec, DatePolicy


def standardize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Snake-case column names and the mapping from old to new."""
    names = text.standard_names(df.columns)
    return df.toDF(*names), dict(zip(df.columns, names))


def trim_text(df: DataFrame) -> DataFrame:
    """Trim every text column; other columns are left alone."""
    cells = {f.name: text.strip(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns(cells) if cells else df


def coerce_numeric(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Turn the listed columns, where present, into doubles; bad values become null."""
    kinds = {f.name: f.dataType for f in df.schema}
    cells = {c: numbers.as_number(F.col(c), kinds[c]) for c in columns if c in kinds}
    return df.withColumns(cells) if cells else df


def _date_text(df: DataFrame, policy: DatePolicy) -> Column:
    return F.col(policy.column).cast("string") if policy.column in df.columns else F.lit(None).cast("string")


def _calendar(policy: DatePolicy) -> dict[str, Column]:
    day = F.col(policy.date)
    return {
        policy.month: dates.month_text(day),
        policy.week: F.weekofyear(day),
        policy.day_of_week: dates.day_name(day),
    }


def _file_signatures(df: DataFrame, policy: DatePolicy) -> DataFrame:
    """For every source file, the shape of its first date text (one row per file)."""
    value = _date_text(df, policy)
    wanted = ~dates.is_blank(value)
    if policy.style == "classified":
        wanted = wanted & ~dates.is_time_only(value)
    keyed = df.where(wanted)
    return keyed.groupBy(SOURCE_FILE).agg(
        F.min_by(dates.date_signature(value), F.col(ROW_ORDINAL)).alias("_file_signature"),
        # A first value of no known layout leaves every row of the file to be parsed freely.
        F.min_by(dates.parse_timestamp(value, policy).isNotNull(), F.col(ROW_ORDINAL)).alias("_file_known"),
    )


def parse_dates(df: DataFrame, policy: DatePolicy) -> DataFrame:
    """Add the parsed column. With per_file, a file keeps only the layout of its first value."""
    value = _date_text(df, policy)
    if not policy.per_file:
        return df.withColumn(policy.parsed, dates.parse_timestamp(value, policy))
    # One row per file: Spark sizes this side itself, no broadcast is forced.
    joined = df.join(_file_signatures(df, policy), SOURCE_FILE, "left")
    same = F.coalesce(~F.col("_file_known"), F.lit(False)) | (
        dates.date_signature(value) == F.col("_file_signature")
    )
    parsed = F.when(same, dates.parse_timestamp(value, policy))
    return joined.withColumn(policy.parsed, parsed).drop("_file_signature", "_file_known")


def enrich_full(df: DataFrame, policy: DatePolicy) -> DataFrame:
    """Raw text, parsed timestamp, success flag and calendar columns."""
    parsed = parse_dates(df.withColumn(policy.raw, _date_text(df, policy)), policy)
    parsed = parsed.withColumns(
        {policy.success: F.col(policy.parsed).isNotNull(), policy.date: F.to_date(policy.parsed)}
    )
    return parsed.withColumns(_calendar(policy))


def enrich_classified(df: DataFrame, policy: DatePolicy) -> DataFrame:
    """Four-way status, time-only columns, calendar columns and the analysis hour.

    Expects trimmed text. A date without a time counts as midnight, so hour 0 also holds
    date-only rows.
    """
    parsed = parse_dates(df.withColumn(policy.raw, _date_text(df, policy)), policy)
    value = F.col(policy.raw)
    time_only = dates.is_time_only(value)
    return (
        parsed.withColumns(
            {
                policy.status: dates.parse_status(value, F.col(policy.parsed)),
                policy.is_time_only: time_only,
                policy.time_only_text: F.when(time_only, value),
                policy.time_hour: dates.time_only_hour(value),
                policy.date: F.to_date(policy.parsed),
                policy.hour: F.hour(policy.parsed),
            }
        )
        .withColumns(_calendar(policy))
        .withColumn(policy.analysis_hour, F.coalesce(policy.hour, policy.time_hour))
    )


def transform(df: DataFrame, spec: DatasetSpec, source_file: str | None = None) -> DataFrame:
    """Raw text table to typed table: trim, coerce, derive dates; extra columns are kept."""
    typed = coerce_numeric(trim_text(df), spec.numeric_columns)
    if source_file is not None or SOURCE_FILE not in df.columns:
        typed = typed.withColumn(SOURCE_FILE, F.lit(source_file))
    enrich = enrich_full if spec.date.style == "full" else enrich_classified
    return _ordered(enrich(typed, spec.date), spec)


def _ordered(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Input columns first, then the source file, the derived columns and the row ordinal."""
    derived = [name for name, _ in spec.date.derived_fields()]
    last = [SOURCE_FILE, *derived, ROW_ORDINAL]
    head = [c for c in df.columns if c not in last]
    return df.select(*head, *[c for c in last if c in df.columns])


def data_columns(df: DataFrame) -> list[str]:
    """Columns that count as data: everything but the row ordinal."""
    return [c for c in df.columns if c != ROW_ORDINAL]


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """One table from frames with different columns; absent cells are null."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)
