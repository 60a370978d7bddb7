"""All quality checks of one dataset, sharing scans where they can."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Collection
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.functions.quantiles import GROUP_LIMIT
from gridtally.operators import quality as q
from gridtally.operators.dedupe import duplicate_groups, duplicates_by_date, duplicates_by_source, extra_copies
from gridtally.operators.filters import file_diagnostics
from gridtally.operators.profile import column_profile
from gridtally.operators.transforms import data_columns, union_by_name
from gridtally.plans.ingest_job import INVENTORY
from gridtally.spec import PARSED, DatasetSpec


CHECKS = (
    "schema_report",
    "missing_summary",
    "parse_summary",
    "numeric_flags",
    "outlier_summary",
    "temporal_summary",
    "duplicates_by_source",
    "duplicates_by_date",
    "duplicate_rows",
    "categorical_summary",
    "column_profile",
    "warnings",
    "file_diagnostics",
)
# Checks with numbers, and the column that names their rows.
NUMERIC_CHECKS = {
    "missing_summary": "column",
    "parse_summary": "status",
    "numeric_flags": "column",
    "outlier_summary": "column",
    "temporal_summary": "date_column",
    "duplicates_by_source": "label",
    "duplicates_by_date": "label",
    "duplicate_rows": "dataset",
    "categorical_summary": "column",
}
SNAPSHOT_CHECKS = ("schema_report", "parse_summary", "duplicate_rows")


@dataclass
class QualityReport:
    """One table per check."""

    spec: DatasetSpec
    checks: dict[str, DataFrame]

    def __getitem__(self, check: str) -> DataFrame:
        return self.checks[check]


def run_checks(
    df: DataFrame,
    spec: DatasetSpec,
    as_of: dt.datetime,
    inventory: DataFrame | None = None,
    order_by: list[str] | None = None,
    approximate: bool = False,
    exact_limit: int = GROUP_LIMIT,
    only: Collection[str] = CHECKS,
) -> QualityReport:
    """Run the suite, or some of its checks. `df` should be a stored table: checks that shuffle
    scan it again, pruned to their columns.

    Missing values, numeric flags, parse outcomes, temporal sanity and the counts behind the
    warnings are one aggregate. Its single row comes to the driver and the small tables are
    unfolded from it. Duplicate counts and diagnostics share one table of duplicate groups.
    """
    builders = _builders(df, spec, as_of, inventory, order_by, approximate, exact_limit)
    checks = {name: builders[name]() for name in CHECKS if name in only and name in builders}
    named = {n: t.select(F.lit(spec.name).alias("dataset"), *t.drop("dataset").columns) for n, t in checks.items()}
    return QualityReport(spec, named)


def _builders(
    df: DataFrame,
    spec: DatasetSpec,
    as_of: dt.datetime,
    inventory: DataFrame | None,
    order_by: list[str] | None,
    approximate: bool,
    exact_limit: int,
) -> dict[str, Callable[[], DataFrame]]:
    """One function per check; shared inputs are made once, when first wanted."""
    spark, limits = df.sparkSession, spec.thresholds
    numeric = [c for c in spec.numeric_columns if c in df.columns]

    @cache
    def one_row() -> DataFrame:
        shared = df.agg(
            F.count(F.lit(1)).alias(q.ROWS),
            *q.missing_cells(df),
            *q.flag_cells(df, numeric),
            *q.parse_cells(df, spec),
            *q.temporal_cells(df, spec, as_of, limits.max_future_days),
        )
        return spark.createDataFrame(shared.collect(), shared.schema)

    @cache
    def groups() -> DataFrame:
        return duplicate_groups(df, spec.dedup_exclude)

    @cache
    def categories() -> DataFrame:
        return q.categorical_check(df, spec.allow_lists, order_by)

    def warnings() -> DataFrame:
        invalid = categories().agg(F.coalesce(F.sum("invalid_count"), F.lit(0).cast("bigint")).alias("n")).scalar()
        stale = F.col("latest_date") < F.lit(as_of - dt.timedelta(days=limits.stale_days)).cast("timestamp_ntz")
        counted = one_row().withColumns({"invalid_total": invalid, "is_stale": F.coalesce(stale, F.lit(False))})
        return q.warning_table(counted, [*q.status_warnings(spec, limits), *q.suite_warnings(limits)])

    builders: dict[str, Callable[[], DataFrame]] = {
        "schema_report": lambda: q.schema_report(spark, df.columns, spec),
        "missing_summary": lambda: q.missing_table(one_row(), data_columns(df)),
        "parse_summary": lambda: q.parse_table(one_row(), spec),
        "numeric_flags": lambda: q.flag_table(one_row(), numeric),
        "outlier_summary": lambda: q.iqr_outliers(df, numeric, limits.outlier_iqr_multiplier, exact_limit, approximate),
        "temporal_summary": lambda: q.temporal_table(one_row(), spec, as_of, limits.stale_days),
        "duplicates_by_source": lambda: duplicates_by_source(groups()),
        "duplicates_by_date": lambda: duplicates_by_date(groups(), spec),
        "duplicate_rows": lambda: extra_copies(groups()),
        "categorical_summary": categories,
        "column_profile": lambda: column_profile(df, order_by=order_by, approximate=approximate),
        "warnings": warnings,
    }
    if inventory is not None:
        builders["file_diagnostics"] = lambda: file_diagnostics(inventory, spec.name)
    return builders


def check_schemas(spark: SparkSession, spec: DatasetSpec) -> dict[str, T.StructType]:
    """Schema of each check's table, for reading written reports; from an empty table of the dataset."""
    empty = spark.createDataFrame([], spec.struct_type())
    inventory = spark.createDataFrame([], INVENTORY)
    report = run_checks(empty, spec, dt.datetime(2000, 1, 1), inventory)
    return {name: table.schema for name, table in report.checks.items()}


def snapshot(reports: list[QualityReport]) -> DataFrame:
    """Duplicates, parse warnings and missing columns of each dataset; one row each."""
    rows = []
    for report in reports:
        parse = report["parse_summary"].where(F.col("status") != PARSED)
        warnings = parse.agg(F.coalesce(F.sum("count"), F.lit(0).cast("bigint")).alias("n")).scalar()
        missing = report["schema_report"].select("missing_columns").scalar()
        valid = report["schema_report"].select("is_valid").scalar()
        rows.append(
            report["duplicate_rows"].select(
                "dataset",
                valid.alias("schema_valid"),
                F.when(missing == "", F.lit("None")).otherwise(missing).alias("missing_columns"),
                "duplicate_rows",
                warnings.alias("parse_warning_count"),
            )
        )
    return union_by_name(rows)


def suite_rows(report: QualityReport) -> DataFrame:
    """The numeric results of a report in long form: (dataset, check, item, metric, value)."""
    parts = []
    for check, item in NUMERIC_CHECKS.items():
        if check not in report.checks:
            continue
        table = report[check]
        numbers = [f.name for f in table.schema if f.dataType.simpleString() in ("bigint", "double")]
        wide = table.select("dataset", F.col(item).cast("string").alias("item"), *[F.col(c).cast("double").alias(c) for c in numbers])
        long = wide.unpivot(["dataset", "item"], numbers, "metric", "value")
        parts.append(long.select("dataset", F.lit(check).alias("check"), "item", "metric", "value"))
    return union_by_name(parts)
