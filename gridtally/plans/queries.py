"""Registered queries: every operator bound to the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.functions import numbers, text
from gridtally.operators import dedupe, filters, kpis, profile, quality, rollups, transforms
from gridtally.plans.extracts import CELLS, EXTRACT, extract_folder, write_extract
from gridtally.plans.file_queries import FILE_QUERIES
from gridtally.plans.ingest_job import inventory_of, persist_dataset
from gridtally.plans.quality_suite import CHECKS, NUMERIC_CHECKS, SNAPSHOT_CHECKS, run_checks, snapshot, suite_rows
from gridtally.plans.tables import (
    PAYMENTS,
    READINGS,
    load,
    payments,
    raw_payments,
    raw_readings,
    readings,
    repeated_payments,
    stored,
    typed_payments,
)
from gridtally.sources.discovery import discover
from gridtally.streaming.incremental import ingest_new_files, read_table

Query = Callable[[SparkSession, str], DataFrame]

# "Now" for the temporal checks, fixed so that results are reproducible.
ORDERS_AS_OF = dt.datetime(2001, 1, 1)
EVENTS_AS_OF = dt.datetime(2024, 1, 20, 12)
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
ALLOWED_TYPES = ("click", "view")


# --- transforms ---------------------------------------------------------------------------


def trim_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_payments(spark, sf).select("event_id", "meterno", "issuedate")
    return transforms.trim_text(rows)


def null_tokens(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.when(F.col("event_id") % 4 == 0, "NA").when(F.col("event_id") % 4 == 1, " NA").otherwise(F.col("event_type"))
    rows = load(spark, sf, "events").select("event_id", cell.alias("cell"))
    return rows.select("event_id", text.strip(text.null_tokens(F.col("cell"))).alias("cell"))


def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_payments(spark, sf).select("event_id", "transactionamount")
    return transforms.coerce_numeric(transforms.trim_text(rows), ["transactionamount"])


def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_readings(spark, sf).select("l_orderkey", "l_linenumber", "midnightdate")
    parsed = transforms.parse_dates(rows, READINGS.date)
    return parsed.select("l_orderkey", "l_linenumber", F.col("midnightdate_parsed").cast("string").alias("parsed"))


def parse_dates_per_file(spark: SparkSession, sf: str) -> DataFrame:
    """Each file keeps the layout of its first date text."""
    policy = replace(READINGS.date, per_file=True)
    place = F.struct(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("seq"))
    rows = raw_readings(spark, sf).withColumn("row_ordinal", place)
    parsed = transforms.parse_dates(rows, policy)
    return parsed.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.count("midnightdate_parsed").alias("parsed")
    )


def enrich_readings(spark: SparkSession, sf: str) -> DataFrame:
    typed = transforms.transform(raw_readings(spark, sf), READINGS)
    return typed.select(
        "l_orderkey",
        "l_linenumber",
        "mtrid",
        "kwh_consumption",
        "midnightdate_raw",
        "midnightdate_parse_success",
        "date",
        "month",
        F.col("week").cast("bigint").alias("week"),
        "day_of_week",
    )


def classify_payment_dates(spark: SparkSession, sf: str) -> DataFrame:
    return typed_payments(spark, sf).select(
        "event_id", "issuedate_parse_status", "issuedate_is_time_only", "issuedate_time_only_text"
    )


def payment_hours(spark: SparkSession, sf: str) -> DataFrame:
    whole = {c: F.col(c).cast("bigint") for c in ("issuedate_time_hour", "vend_week", "vend_hour", "analysis_hour")}
    return typed_payments(spark, sf).select(
        "event_id", "vend_date", "vend_month", "vend_day_of_week", *[c.alias(n) for n, c in whole.items()]
    )


# --- duplicates ---------------------------------------------------------------------------


def dup_policy_drop(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedupe.apply_duplicate_policy(repeated_payments(spark, sf), "drop_first").df
    return kept.select("payment_id", "meterno", "transactionamount", "vend_date", "source_file")


def dup_policy_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = repeated_payments(spark, sf)
    dropped = dedupe.apply_duplicate_policy(rows, "drop_last")
    kept = dedupe.apply_duplicate_policy(rows, "keep_all")
    return transforms.union_by_name(
        [r.counts.select(F.lit(r.mode).alias("mode"), "before", "after") for r in (dropped, kept)]
    )


def dup_keep_last_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Newest payment of each meter: a duplicate policy on a key subset."""
    kept = dedupe.keep_one(payments(spark, sf), ["meterno"], "last", ["issuedate_parsed", "payment_id"])
    return kept.select("meterno", "payment_id", "transactionamount", "source_file")


def dup_row_count(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.duplicate_row_count(repeated_payments(spark, sf))


def dup_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.duplicates_by_source(dedupe.duplicate_groups(repeated_payments(spark, sf)))


def dup_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.duplicates_by_date(dedupe.duplicate_groups(repeated_payments(spark, sf)), PAYMENTS)


def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return filters.distinct_values(typed_payments(spark, sf), "meterno")


def value_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return filters.value_bounds(payments(spark, sf), ["transactionamount", "vend_date"])


# --- filters ------------------------------------------------------------------------------


def filter_readings(spark: SparkSession, sf: str) -> DataFrame:
    wanted = filters.ReadingFilter(
        parsed_only=True,
        date_range=(dt.date(1996, 1, 1), dt.date(2000, 6, 30)),
        entities=[str(n) for n in range(1, 60, 2)],
        measure_range=(5.0, 40.0),
    )
    typed = readings(spark, sf).withColumn("midnightdate_parse_success", F.col("midnightdate_parsed").isNotNull())
    kept = filters.filter_readings(typed, READINGS, wanted)
    return kept.select("mtrid", "kwh_consumption", "kvah_consumption", "date", "source_file")


def filter_payments(spark: SparkSession, sf: str) -> DataFrame:
    wanted = filters.PaymentFilter(
        statuses=["parsed_datetime", "time_only"],
        categorycode=["click", "view", "purchase"],
        source_file=["file_0", "file_2"],
        measure_range=(0.0, 1000.0),
        hours=list(range(6, 19)),
    )
    kept = filters.filter_payments(typed_payments(spark, sf), PAYMENTS, wanted)
    return kept.select(
        "event_id", "categorycode", "transactionamount", F.col("analysis_hour").cast("bigint").alias("analysis_hour")
    )


def filter_full_datetime(spark: SparkSession, sf: str) -> DataFrame:
    wanted = filters.PaymentFilter(
        full_datetime_only=True, date_range=(dt.date(2024, 1, 3), dt.date(2024, 1, 12)), servicepointno=["1", "2", "3"]
    )
    kept = filters.filter_payments(typed_payments(spark, sf), PAYMENTS, wanted)
    return kept.select("event_id", "servicepointno", "meterno", "vend_date")


def drilldown_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.drill_down(readings(spark, sf), "mtrid", "7")
    return kept.select("mtrid", "kwh_consumption", "date")


# --- key figures --------------------------------------------------------------------------


def safe_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return kpis.safe_aggregates(typed_payments(spark, sf), "transactionamount", "meterno", 2)


def date_span(spark: SparkSession, sf: str) -> DataFrame:
    span = kpis.date_span(payments(spark, sf), "issuedate_parsed")
    return span.select(F.to_date("min").alias("min"), F.to_date("max").alias("max"))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.to_date(c) for c in ("span_min", "span_max")})


def readings_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(kpis.readings_kpis(readings(spark, sf), READINGS))


def payments_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(kpis.payments_kpis(typed_payments(spark, sf), PAYMENTS))


def _file_table(df: DataFrame, dataset: str) -> DataFrame:
    """A listing with one row per source file, in the place of an inventory."""
    return df.select("source_file").distinct().select(F.lit(dataset).alias("dataset"), F.col("source_file").alias("file_name"))


def _overview_inputs(spark: SparkSession, sf: str):
    r, p = readings(spark, sf), payments(spark, sf)
    files = _file_table(r, READINGS.name).unionByName(_file_table(p, PAYMENTS.name))
    return [(READINGS, r), (PAYMENTS, p)], files


def overview_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return kpis.overview_kpis(*_overview_inputs(spark, sf))


def coverage_table(spark: SparkSession, sf: str) -> DataFrame:
    return kpis.coverage(*_overview_inputs(spark, sf))


def parse_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return kpis.parse_coverage(typed_payments(spark, sf), PAYMENTS)


def meter_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return kpis.entity_readings(readings(spark, sf), READINGS)


def payer_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return kpis.entity_payments(typed_payments(spark, sf), PAYMENTS, "servicepointno")


# --- rollups ------------------------------------------------------------------------------


def daily_total(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.daily_total(readings(spark, sf), READINGS)


def daily_total_by_meter(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.daily_total_by_entity(readings(spark, sf), READINGS)


def top10_meters(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.top_entities(readings(spark, sf), READINGS)


def amount_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.amount_by_source(payments(spark, sf), PAYMENTS)


def daily_amount(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.daily_total(typed_payments(spark, sf), PAYMENTS)


def hourly_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile_rows = rollups.hourly_profile(typed_payments(spark, sf), PAYMENTS)
    return profile_rows.select(F.col("analysis_hour").cast("bigint").alias("analysis_hour"), "total_value")


def category_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.category_breakdown(typed_payments(spark, sf), PAYMENTS)


def drilldown_sources(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.source_breakdown(payments(spark, sf), PAYMENTS, "meterno")


def histogram40(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.histogram(payments(spark, sf), "transactionamount", 40)


def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.box_stats(typed_payments(spark, sf), "transactionamount")


def box_stats_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.box_stats(payments(spark, sf), "transactionamount", "categorycode")


def box_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.box_outliers(typed_payments(spark, sf), "transactionamount")


def preview(spark: SparkSession, sf: str) -> DataFrame:
    rows = rollups.preview(payments(spark, sf), 1000, ["payment_id"])
    return rows.select("payment_id", "meterno", "categorycode", "transactionamount")


# --- quality ------------------------------------------------------------------------------

_PAYMENT_COLUMNS = ("event_id", "meterno", "categorycode", "transactionamount", "issuedate_parse_status", "vend_date")


def numeric_flags(spark: SparkSession, sf: str) -> DataFrame:
    return quality.numeric_flags(typed_payments(spark, sf), ["transactionamount", "event_id"])


def iqr_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return quality.iqr_outliers(typed_payments(spark, sf), ["transactionamount", "event_id"])


def missing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.missing_summary(typed_payments(spark, sf).select(*_PAYMENT_COLUMNS))


def table_overview(spark: SparkSession, sf: str) -> DataFrame:
    return profile.table_overview(payments(spark, sf)).select("rows", "columns")


def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["servicepointno", "meterno", "categorycode", "transactionamount", "vend_date", "source_file"]
    return profile.column_profile(payments(spark, sf), columns, ["payment_id"])


def parse_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.parse_summary(typed_payments(spark, sf), PAYMENTS)


def parse_summary_readings(spark: SparkSession, sf: str) -> DataFrame:
    return quality.parse_summary(transforms.transform(raw_readings(spark, sf), READINGS), READINGS)


def temporal_sanity(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.temporal_sanity(payments(spark, sf), PAYMENTS, ORDERS_AS_OF, 30, 90)
    return found.withColumns({c: F.to_date(c) for c in ("latest_date", "oldest_date")})


def categorical_check(spark: SparkSession, sf: str) -> DataFrame:
    lists = {"categorycode": PRIORITIES, "source_file": ("F",), "meterno": ()}
    return quality.categorical_check(payments(spark, sf), lists, ["payment_id"])


def quality_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_warnings(typed_payments(spark, sf), PAYMENTS)


def _report(spark: SparkSession, sf: str, only=CHECKS):
    """Checks of the stored payments, in which every tenth row occurs twice."""
    spec = replace(PAYMENTS, allow_lists={"categorycode": ALLOWED_TYPES})
    table = typed_payments(spark, sf)
    repeated = stored(table.unionByName(table.where(F.col("event_id") % 10 == 0)))
    return run_checks(repeated, spec, EVENTS_AS_OF, order_by=["event_id"], only=only)


def quality_suite(spark: SparkSession, sf: str) -> DataFrame:
    return suite_rows(_report(spark, sf, NUMERIC_CHECKS))


def quality_suite_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf, ["warnings"])["warnings"].drop("dataset")


def quality_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    table = transforms.transform(raw_readings(spark, sf), READINGS)
    repeated = stored(table.unionByName(table.where(F.col("l_orderkey") % 10 == 0)))
    order = ["l_orderkey", "l_linenumber"]
    reports = [
        run_checks(repeated, READINGS, ORDERS_AS_OF, order_by=order, only=SNAPSHOT_CHECKS),
        _report(spark, sf, SNAPSHOT_CHECKS),
    ]
    return snapshot(reports)


# --- files --------------------------------------------------------------------------------

def csv_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Text extract written, discovered, read by its headers, typed, stored; then status and hour totals."""
    folder = extract_folder(spark)
    headers = {"servicepointno": "Service-Point No", "meterno": "Meter.No", "transactionamount": "TransactionAmount"}
    spec = replace(
        EXTRACT,
        required_columns=("service_point_no", "meter_no", "categorycode", "transaction_amount", "issuedate"),
        numeric_columns=("transaction_amount",),
        measure="transaction_amount",
    )
    write_extract(raw_payments(spark, sf).select(*CELLS), f"{folder}/raw", headers)
    files = discover(spark, f"{folder}/raw", [spec])[spec.name]
    table = persist_dataset(spark, spec, files, f"{folder}/table").table
    return table.groupBy("issuedate_parse_status", F.col("analysis_hour").cast("bigint").alias("analysis_hour")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("meter_no").alias("meters"),
        numbers.total(F.col("transaction_amount"), 2).alias("total_value"),
    )


def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Inventory of two header layouts in one folder, summed over files."""
    folder = extract_folder(spark)
    rows = raw_payments(spark, sf)
    spec = replace(EXTRACT, required_columns=(*EXTRACT.required_columns[:4], "issuedate"))
    write_extract(rows.where(F.col("event_id") % 2 == 0).select(*CELLS), f"{folder}/raw")
    write_extract(rows.where(F.col("event_id") % 2 == 1).select("issuedate", "meterno", "event_id"), f"{folder}/raw", mode="append")
    files = discover(spark, f"{folder}/raw", [spec])[spec.name]
    done = persist_dataset(spark, spec, files, f"{folder}/table")
    inventory = inventory_of(spark, {spec.name: done})
    return inventory.groupBy("dataset", "read_status", "schema_valid", "column_count", "standardized_columns").agg(
        F.sum("rows_read").alias("rows_read"), F.sum("parse_warning_count").alias("parse_warning_count")
    )


def incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Files that arrive in two waves, taken by two runs of the incremental job."""
    folder = extract_folder(spark)
    rows = raw_payments(spark, sf)
    for rest, mode in ((0, "overwrite"), (1, "append")):
        write_extract(rows.where(F.col("event_id") % 2 == rest).select(*CELLS), f"{folder}/raw", mode=mode)
        ingest_new_files(spark, EXTRACT, f"{folder}/raw", f"{folder}/out", f"{folder}/checkpoint")
    table = read_table(spark, f"{folder}/out")
    return table.groupBy("issuedate_parse_status").agg(
        F.count(F.lit(1)).alias("rows"), numbers.total(F.col("transactionamount"), 2).alias("total_value")
    )


_OWN: dict[str, Query] = {
    query.__name__: query
    for query in (
        trim_text,
        null_tokens,
        coerce_numeric,
        parse_dates,
        parse_dates_per_file,
        enrich_readings,
        classify_payment_dates,
        payment_hours,
        dup_policy_drop,
        dup_policy_counts,
        dup_keep_last_by_key,
        dup_row_count,
        dup_by_source,
        dup_by_date,
        distinct_values,
        value_bounds,
        filter_readings,
        filter_payments,
        filter_full_datetime,
        drilldown_filter,
        safe_aggregates,
        date_span,
        readings_kpis,
        payments_kpis,
        overview_kpis,
        coverage_table,
        quality_snapshot,
        parse_coverage,
        meter_kpis,
        payer_kpis,
        daily_total,
        daily_total_by_meter,
        top10_meters,
        amount_by_source,
        daily_amount,
        hourly_profile,
        category_breakdown,
        drilldown_sources,
        histogram40,
        box_stats,
        box_stats_by_category,
        box_outliers,
        preview,
        numeric_flags,
        iqr_outliers,
        missing_summary,
        table_overview,
        column_profile,
        parse_summary,
        parse_summary_readings,
        temporal_sanity,
        categorical_check,
        quality_warnings,
        quality_suite,
        quality_suite_warnings,
        csv_ingest,
        file_inventory,
        incremental_ingest,
    )
}

QUERIES: dict[str, Query] = {**_OWN, **FILE_QUERIES}
