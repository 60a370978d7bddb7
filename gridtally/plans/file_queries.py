"""Registered queries about files, stored state and exports."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.functions import numbers
from gridtally.operators import profile, sketches, transforms
from gridtally.plans.extracts import CELLS, EXTRACT, deliver, extract_folder, withdraw, write_extract, write_lines
from gridtally.plans.ingest_job import inventory_of, messages_of, persist_dataset
from gridtally.plans.pipeline import run_pipeline, summary
from gridtally.plans.quality_suite import CHECKS, QualityReport, check_schemas, run_checks, suite_rows
from gridtally.plans.tables import PAYMENTS, READINGS, payments, raw_payments, raw_readings, readings, stored, typed_payments
from gridtally.sinks import versioned
from gridtally.sinks.files import read_csv, read_report, report_tables, write_csv, write_report
from gridtally.sources.discovery import discover
from gridtally.spec import CONSUMPTION, DatasetSpec
from gridtally.streaming import rollup_state as state
from gridtally.streaming.incremental import ingest_new_files, read_table
from gridtally.streaming.refresh import read_current, refresh

EVENTS_AS_OF = dt.datetime(2024, 1, 20, 12)
ALLOWED_TYPES = ("click", "view")
REWRITTEN_MONTH = "1996-03"


def _totals(table: DataFrame) -> DataFrame:
    return table.groupBy("issuedate_parse_status").agg(
        F.count(F.lit(1)).alias("rows"), F.count("meterno").alias("meters"), numbers.total(F.col("transactionamount"), 2).alias("total_value"))


def _dedup_waves(spark: SparkSession, sf: str, policy: str) -> DataFrame:
    """Three waves of files; later waves bring copies of earlier rows. Copies count across files."""
    folder = extract_folder(spark)
    spec = replace(EXTRACT, duplicate_policy=policy, dedup_exclude=("source_file",))
    rows, wave = raw_payments(spark, sf), F.col("event_id") % 3
    for turn in range(3):
        again = rows.where((wave < turn) & (F.col("event_id") % 10 == 0))
        write_extract(rows.where(wave == turn).unionByName(again).select(*CELLS), f"{folder}/raw", mode="append")
        ingest_new_files(spark, spec, f"{folder}/raw", f"{folder}/out", f"{folder}/checkpoint")
    return read_table(spark, f"{folder}/out")


def incremental_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(_dedup_waves(spark, sf, "drop_first"))


def incremental_dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(_dedup_waves(spark, sf, "drop_last"))


def incremental_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Three refreshes: files arrive, one delivery is corrected and another added, one is withdrawn."""
    folder = extract_folder(spark)
    raw, spec = f"{folder}/raw", replace(EXTRACT, file_patterns=("vend-*.csv",))
    rows, wave = raw_payments(spark, sf), F.col("event_id") % 3

    def part(turn: int) -> DataFrame:
        return rows.where(wave == turn)

    deliver(part(0).select(*CELLS).repartition(4), raw, "vend-a")
    deliver(part(1).select(*CELLS).repartition(4), raw, "vend-b")
    refresh(spark, spec, raw, f"{folder}/out")
    deliver(part(1).where(F.col("event_id") % 2 == 0).select(*CELLS).repartition(4), raw, "vend-b")
    deliver(part(2).select(*CELLS).repartition(4), raw, "vend-c")
    refresh(spark, spec, raw, f"{folder}/out")
    withdraw(spark, raw, "vend-a", 4)
    refresh(spark, spec, raw, f"{folder}/out")
    return _totals(read_current(spark, spec, f"{folder}/out"))


def _figures(kpis: DataFrame) -> DataFrame:
    names = [c for c in kpis.columns if not c.startswith("span_")]
    wide = kpis.select(*[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot([], names, "key", "value").select(F.lit("kpi").alias("rollup"), "key", "value")


def rollup_state(spark: SparkSession, sf: str) -> DataFrame:
    """Rollups and key figures of both datasets after three batches, the last of them run twice."""
    folder, parts = extract_folder(spark), []
    for spec, table, number in ((PAYMENTS, typed_payments(spark, sf), "event_id"), (READINGS, readings_numbered(spark, sf), "line")):
        uri = f"{folder}/{spec.name}"
        for batch in (0, 1, 2, 2):
            state.update(spark, spec, uri, batch, table.where(F.pmod(F.col(number), F.lit(3)) == batch))
        found = state.State(spark, spec, uri)
        keyed = [("day", found.daily_total()), ("entity", found.totals(f"by_{spec.entity}")), ("source", found.amount_by_source())]
        if spec is PAYMENTS:
            keyed.append(("hour", found.hourly_profile()))
            keyed.append(("category", found.category_breakdown().select(spec.category, F.col("sum").alias("total_value"))))
        tables = [t.select(F.lit(n).alias("rollup"), F.col(t.columns[0]).cast("string").alias("key"), F.col("total_value").alias("value")) for n, t in keyed]
        parts += [t.select(F.lit(spec.name).alias("dataset"), "*") for t in (*tables, _figures(found.kpis()))]
    return transforms.union_by_name(parts)


def readings_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with a number to deal them into batches by."""
    rows = readings(spark, sf)
    return rows.withColumn("line", F.xxhash64("mtrid", "midnightdate_parsed", "kvah_consumption"))


def stored_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches stored per file and month in two batches, merged when read and held against exact figures."""
    columns = ["servicepointno", "meterno", "categorycode", "transactionamount", "issuedate_raw"]
    uri, table = extract_folder(spark), typed_payments(spark, sf)
    version = versioned.current(spark, uri)
    parts = []
    for batch in range(2):
        made = sketches.build(table.where(F.col("event_id") % 2 == batch), PAYMENTS, columns)
        parts.append(versioned.add_part(made, uri, batch))
    version = versioned.publish(spark, uri, version, parts, made.schema)
    found = sketches.estimates(sketches.merged(versioned.read(spark, version)))
    return sketches.checked(table, found, columns)


def malformed_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Good files, files with long records, files with an open quote and an empty one, under both policies.

    Files of a kind are summed up; paths, sizes, names and the numbers in messages are left out.
    """
    raw, rows = f"{extract_folder(spark)}/raw", raw_payments(spark, sf)
    kind = F.col("event_id") % 4
    write_extract(rows.where(kind < 2).select(*CELLS).repartition(2), raw)
    bad = F.col("event_id") % 8 < 4
    plain = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in CELLS])
    write_lines(rows.where(kind == 2), ",".join(CELLS), F.when(bad, F.concat(plain, F.lit(",surplus"))).otherwise(plain), raw)
    write_lines(rows.where(kind == 3), ",".join(CELLS), F.when(bad, F.concat(F.lit('"open '), plain)).otherwise(plain), raw)
    spark.createDataFrame([], "value string").coalesce(1).write.mode("append").text(raw)
    parts = []
    for policy in ("fail_file", "quarantine"):
        spec = replace(EXTRACT, file_patterns=("part-*",), malformed_policy=policy)
        done = persist_dataset(spark, spec, discover(spark, raw, [spec])[spec.name], f"{extract_folder(spark)}/table")
        told = ("read_status", "column_count", "raw_columns", "standardized_columns", "schema_valid", "missing_required_columns",
                "schema_status", "column_mapping", "duplicate_policy_mode")
        files = inventory_of(spark, {"vend": done}).groupBy(F.concat_ws(" | ", *[F.col(c).cast("string") for c in told]).alias("text")).agg(
            F.count(F.lit(1)).alias("files"), F.sum("rows_read").alias("rows_read"), F.sum("parse_warning_count").alias("parse_warnings"))
        notes = messages_of(spark, {"vend": done}).groupBy(F.regexp_replace(F.regexp_replace("message", r"part-\S+:", "*:"), r"\d[\d,]*", "N").alias("text"), "severity").agg(F.count(F.lit(1)).alias("files"))
        none = F.lit(None).cast("bigint")
        parts.append(files.select(F.lit(policy).alias("policy"), F.lit("file").alias("kind"), "text", "files", "rows_read", "parse_warnings"))
        parts.append(notes.select(F.lit(policy).alias("policy"), F.col("severity").alias("kind"), "text", "files", none.alias("rows_read"), none.alias("parse_warnings")))
    return transforms.union_by_name(parts)


def partition_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """A table of months in which one month is written again; all others stay the files they were."""
    uri = extract_folder(spark)
    rows = payments(spark, sf).withColumn("vend_month", F.date_format("vend_date", "yyyy-MM"))
    first = versioned.overwrite_partitions(rows, uri, "vend_month")
    corrected = rows.where(F.col("vend_month") == REWRITTEN_MONTH).withColumn("transactionamount", F.col("transactionamount") + 1)
    second = versioned.overwrite_partitions(corrected, uri, "vend_month")
    same = {(p.key, p.path) for p in first.parts}
    moved = spark.createDataFrame([(p.key[1:], (p.key, p.path) not in same) for p in second.parts], "vend_month string, rewritten boolean")
    months = versioned.read_table(spark, uri).groupBy("vend_month").agg(
        F.count(F.lit(1)).alias("rows"), numbers.total(F.col("transactionamount"), 2).alias("total_value"))
    return months.join(F.broadcast(moved), "vend_month")


def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Quality reports of both datasets written as JSON, read back with their types, in long form."""
    paid = replace(PAYMENTS, allow_lists={"categorycode": ALLOWED_TYPES})
    table = typed_payments(spark, sf)
    reports = {
        "vend": run_checks(stored(table.unionByName(table.where(F.col("event_id") % 10 == 0))), paid, EVENTS_AS_OF, order_by=["event_id"], only=CHECKS),
        "consumption": run_checks(stored(transforms.transform(raw_readings(spark, sf), READINGS)), READINGS, EVENTS_AS_OF,
                                  order_by=["l_orderkey", "l_linenumber"], only=("parse_summary", "duplicate_rows")),
    }
    path = write_report(spark, {n: r.checks for n, r in reports.items()}, extract_folder(spark), "2024-01-20T12:00:00Z")
    known, _ = read_report(spark, path)
    parts = []
    for name, report in reports.items():
        tables = report_tables(known.where(F.col("dataset") == name), {c: t.schema for c, t in report.checks.items()})
        parts.append(suite_rows(QualityReport(report.spec, {c: t.drop("generated_at_utc") for c, t in tables.items()})))
    return transforms.union_by_name(parts)


def candidate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """How well the declared keys and pairs of them tell rows apart, in both datasets."""
    return transforms.union_by_name([profile.key_check(typed_payments(spark, sf), PAYMENTS), profile.key_check(readings(spark, sf), READINGS)])


def field_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return profile.field_snapshot(spark, [(PAYMENTS, payments(spark, sf)), (READINGS, readings(spark, sf))])


def _bundle_inputs(spark: SparkSession, sf: str, raw: str) -> list[DatasetSpec]:
    """Files of both datasets in one folder: the payments with copies, and files of theirs with long records."""
    vend = replace(PAYMENTS, file_patterns=("vend-*.csv",))
    read = replace(READINGS, file_patterns=CONSUMPTION.file_patterns)
    paid = raw_payments(spark, sf)
    # Rows that are equal once typed go to one file, where they are copies.
    alike = ["servicepointno", "meterno", "categorycode", "issuedate"]
    deliver(paid.unionByName(paid.where(F.col("event_id") % 10 == 0)).select(*CELLS).repartition(3, *alike), raw, "vend-good")
    # Line breaks in a cell, which this dataset does not allow.
    deliver(paid.select(F.concat_ws("\n", *CELLS).alias("one cell"), "event_id").repartition(2), raw, "vend-bad")
    measures = {c: F.col("kwh_consumption") for c in ("kwh_abs", "kvah_abs", "kvah_consumption")}
    # The measures are one cell until the rows are dealt: a file is written by one task, which reads a third of all rows.
    dealt = raw_readings(spark, sf).select("mtrid", "midnightdate", "kwh_consumption").repartition(3, "mtrid", "midnightdate", "kwh_consumption")
    deliver(dealt.withColumns(measures).select(*CONSUMPTION.required_columns), raw, "daily_consumption")
    return [read, vend]


def bundle_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Both datasets ingested from files side by side, checked, and summed up."""
    folder = extract_folder(spark)
    specs = _bundle_inputs(spark, sf, f"{folder}/raw")
    return summary(spark, run_pipeline(spark, specs, f"{folder}/raw", f"{folder}/out", EVENTS_AS_OF)).drop("warnings")


def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """A table exported as CSV and read back: quotes, line breaks, empty cells and leading zeros survive."""
    turn = F.col("event_id") % 7
    note = (F.when(turn == 0, F.lit(None)).when(turn == 1, "").when(turn == 2, 'say "hi", twice').when(turn == 3, "line one\nline two")
            .when(turn == 4, "  007 ").when(turn == 5, "NA").otherwise(F.lpad(F.col("user_id").cast("string"), 8, "0")))
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", note.alias("note"), F.col("value").alias("amount"), F.to_date("ts").alias("day"))
    uri = f"{extract_folder(spark)}/csv-{uuid.uuid4()}"
    write_csv(rows, uri)
    return read_csv(spark, uri, rows.schema)


def stored_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Values and stored bytes of every column of a written table, from its footers."""
    uri = f"{extract_folder(spark)}/table"
    payments(spark, sf).write.parquet(uri)
    return profile.column_bytes(spark, uri).select("column", "values", (F.col("stored_bytes") > 0).alias("has_bytes"))


FILE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        incremental_dedup, incremental_dedup_last, incremental_replace, rollup_state, stored_sketches, malformed_ingest, partition_rewrite,
        report_round_trip, candidate_keys, field_snapshot, bundle_summary, csv_export, stored_columns,
    )
}
