"""End to end: ingest every dataset, persist it, run its quality suite."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.operators.kpis import coverage, overview_kpis
from gridtally.operators.transforms import union_by_name
from gridtally.plans.ingest_job import Ingested, ingest_and_persist, inventory_of, message, messages_of, side_by_side
from gridtally.plans.quality_suite import QualityReport, run_checks
from gridtally.sinks.files import write_report
from gridtally.spec import DatasetSpec


@dataclass
class Bundle:
    """Tables of one run: stored datasets, file inventory, messages and quality reports."""

    ingested: dict[str, Ingested]
    inventory: DataFrame
    messages: DataFrame
    quality: dict[str, QualityReport]

    def datasets(self) -> list[tuple[DatasetSpec, DataFrame]]:
        return [(i.spec, i.table) for i in self.ingested.values()]

    def overview(self) -> DataFrame:
        return overview_kpis(self.datasets(), self.inventory)

    def coverage(self) -> DataFrame:
        return coverage(self.datasets(), self.inventory)


def run_pipeline(
    spark: SparkSession, specs: Sequence[DatasetSpec], raw_uri: str, out_uri: str, as_of: dt.datetime
) -> Bundle:
    """Ingest and persist, then check each stored table. `as_of` is the time taken as now.

    Datasets are worked on side by side. One whose ingest or checks break off has a message that says
    so, and no quality report if its checks did; the others are whole.
    """
    ingested = ingest_and_persist(spark, specs, raw_uri, out_uri)
    inventory = inventory_of(spark, ingested)

    def checks(done: Ingested) -> Callable[[], QualityReport]:
        return lambda: run_checks(done.table, done.spec, as_of, inventory)

    found = side_by_side(spark, {name: checks(i) for name, i in ingested.items()})
    quality = {name: report for name, report in found.items() if not isinstance(report, Exception)}
    for name, error in found.items():
        if isinstance(error, Exception):
            text = str(error).strip().split("\n", 1)[0] or type(error).__name__
            ingested[name].messages.append(message(name, f"Failed to check {name}: {text}"))
    return Bundle(ingested, inventory, messages_of(spark, ingested), quality)


def summary(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """One row per dataset: rows, files by state, duplicate rows, parse warnings, quality warnings, errors."""
    parts = []
    for name, done in bundle.ingested.items():
        files = bundle.inventory.where(F.col("dataset") == name)
        report = bundle.quality.get(name)
        none = F.lit(None).cast("bigint")
        parts.append(files.agg(
            F.count(F.lit(1)).alias("files"), F.count_if(F.col("read_status") != "ok").alias("failed_files"),
            F.count_if(~F.col("schema_valid") & (F.col("read_status") == "ok")).alias("files_missing_columns"),
            F.coalesce(F.sum("rows_read"), F.lit(0)).alias("rows_read"), F.coalesce(F.sum("parse_warning_count"), F.lit(0)).alias("parse_warnings"),
        ).select(
            F.lit(name).alias("dataset"), F.lit(done.ok).alias("ok"), "files", "failed_files", "files_missing_columns", "rows_read", "parse_warnings",
            done.table.agg(F.count(F.lit(1)).alias("n")).scalar().alias("rows"),
            (none if report is None else report["duplicate_rows"].agg(F.max("duplicate_rows").alias("n")).scalar()).alias("duplicate_rows"),
            (none if report is None else report["warnings"].agg(F.count(F.lit(1)).alias("n")).scalar()).alias("warnings"),
            F.lit(sum(m[1] == "error" for m in done.messages)).cast("bigint").alias("errors"),
        ))
    return union_by_name(parts)


def export_quality(spark: SparkSession, bundle: Bundle, uri: str, generated_at: dt.datetime) -> str:
    """Versioned JSON export of all quality tables; returns the path."""
    tables = {name: report.checks for name, report in bundle.quality.items()}
    return write_report(spark, tables, uri, generated_at.isoformat())
