"""Optional, ANDed predicates. Predicates compare typed columns, so they reach the Parquet scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.spec import PARSED, SOURCE_FILE, DatasetSpec

# Above this many values a list filter becomes a semi-join against a local table.
LIST_LIMIT = 2000


@dataclass(frozen=True)
class ReadingFilter:
    parsed_only: bool = False
    date_range: tuple[dt.date, dt.date] | None = None
    entities: Sequence[str] = ()
    measure_range: tuple[float, float] | None = None


@dataclass(frozen=True)
class PaymentFilter:
    statuses: Sequence[str] = ()
    full_datetime_only: bool = False
    meterno: Sequence[str] = ()
    servicepointno: Sequence[str] = ()
    categorycode: Sequence[str] = ()
    source_file: Sequence[str] = ()
    measure_range: tuple[float, float] | None = None
    date_range: tuple[dt.date, dt.date] | None = None
    hours: Sequence[int] = ()


def _typed(values: Iterable[object], kind: T.DataType) -> list[object]:
    """Values of the column's own type; a text that is no such value can match nothing."""
    wanted: set[object] = set()
    for value in values:
        if isinstance(kind, T.IntegralType):
            try:
                number = int(str(value))
            except ValueError:
                continue
            if str(number) == str(value):
                wanted.add(number)
        else:
            wanted.add(str(value))
    return sorted(wanted)  # type: ignore[type-var]


def member(df: DataFrame, column: str, values: Iterable[object]) -> DataFrame:
    """Rows whose column, as text, is one of the values. Null never matches."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegralType):
        kind = T.StringType()
    wanted = _typed(values, kind)
    probe = F.col(column)
    if isinstance(kind, T.StringType) and not isinstance(df.schema[column].dataType, T.StringType):
        probe = probe.cast("string")
    if len(wanted) <= LIST_LIMIT:
        return df.where(probe.isin(*wanted)) if wanted else df.where(F.lit(False))
    # A local relation carries its exact size, so Spark broadcasts it only when it fits.
    keys = df.sparkSession.createDataFrame([(v,) for v in wanted], T.StructType([T.StructField("_key", kind)]))
    return df.join(keys, probe == keys["_key"], "left_semi")


def _inside(column: str, bounds: tuple[object, object]) -> Column:
    return F.col(column).between(F.lit(bounds[0]), F.lit(bounds[1]))


def _dates_inside(df: DataFrame, spec: DatasetSpec, bounds: tuple[dt.date, dt.date]) -> list[Column]:
    """Date range, and the month range it implies: that one prunes a table partitioned by month."""
    date = spec.date
    found = [_inside(date.date, bounds)] if date.date in df.columns else []
    if found and date.month in df.columns:
        found.append(_inside(date.month, (f"{bounds[0]:%Y-%m}", f"{bounds[1]:%Y-%m}")))
    return found


def _where(df: DataFrame, predicates: list[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, predicates)) if predicates else df


def filter_readings(df: DataFrame, spec: DatasetSpec, wanted: ReadingFilter) -> DataFrame:
    predicates: list[Column] = []
    if wanted.parsed_only and spec.date.success in df.columns:
        predicates.append(F.col(spec.date.success))
    if wanted.date_range:
        predicates += _dates_inside(df, spec, wanted.date_range)
    if wanted.measure_range and spec.measure in df.columns:
        predicates.append(_inside(spec.measure, wanted.measure_range))
    kept = _where(df, predicates)
    if wanted.entities and spec.entity in df.columns:
        kept = member(kept, spec.entity, wanted.entities)
    return kept


def filter_payments(df: DataFrame, spec: DatasetSpec, wanted: PaymentFilter) -> DataFrame:
    date = spec.date
    predicates: list[Column] = []
    if wanted.full_datetime_only and date.status in df.columns:
        predicates.append(F.col(date.status) == PARSED)
    if wanted.measure_range and spec.measure in df.columns:
        predicates.append(_inside(spec.measure, wanted.measure_range))
    if wanted.date_range:
        predicates += _dates_inside(df, spec, wanted.date_range)
    kept = _where(df, predicates)
    lists = {
        date.status: wanted.statuses,
        "meterno": wanted.meterno,
        "servicepointno": wanted.servicepointno,
        "categorycode": wanted.categorycode,
        SOURCE_FILE: wanted.source_file,
        date.analysis_hour: wanted.hours,
    }
    for column, values in lists.items():
        if values and column in kept.columns:
            kept = member(kept, column, values)
    return kept


def drill_down(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows of one meter, service point or other entity."""
    return member(df, column, [value])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values of a column, as text: the choices of a list filter."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    return values.select(F.col(column).cast("string").alias("value")).orderBy("value")


def value_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value of each column: the ends of a range filter."""
    cells = []
    for column in columns:
        cells += [F.min(column).alias(f"{column}_min"), F.max(column).alias(f"{column}_max")]
    return df.agg(*cells)


def failed_files(inventory: DataFrame) -> DataFrame:
    return inventory.where(F.col("read_status") != "ok")


# Columns of the per-file diagnostics, in order.
FILE_DIAGNOSTICS = (
    "dataset",
    "file_name",
    "rows_read",
    "column_count",
    "schema_valid",
    "missing_required_columns",
    "read_status",
    "parse_warning_count",
    "file_size_mb",
    "duplicate_policy_mode",
)


def file_diagnostics(inventory: DataFrame, dataset: str | None = None) -> DataFrame:
    rows = inventory if dataset is None else inventory.where(F.col("dataset") == dataset)
    return rows.select(*[c for c in FILE_DIAGNOSTICS if c in inventory.columns])
