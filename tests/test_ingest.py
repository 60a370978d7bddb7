from __future__ import annotations

import datetime as dt
import json
import subprocess
import sys
import uuid
from collections import Counter
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gridtally.operators.filters import PaymentFilter, failed_files, file_diagnostics, filter_payments
from gridtally.plans import ingest_job
from gridtally.plans.ingest_job import (
    _without_files, ingest_and_persist, inventory_of, messages_of, persist_dataset, quarantined_rows, read_dataset,
)
from gridtally.plans.pipeline import export_quality, run_pipeline, summary
from gridtally.plans.quality_suite import check_schemas
from gridtally.sinks.files import (
    REPORT_SCHEMA, read_csv, read_report, report_tables, stamped_name, unread_checks, write_csv, write_parquet, write_report,
)
from gridtally.sources import csv_source
from gridtally.sources.csv_source import _header_reader, read_group, read_headers
from gridtally.sources.discovery import discover, list_files
from gridtally.spec import CONSUMPTION, VEND
from gridtally.streaming.incremental import ingest_new_files, read_inventory, read_table

VEND_HEADER = "ServicePointNo,Meter No,categorycode,transactionAmount,issuedate\n"
SPEC = replace(VEND, required_columns=("service_point_no", "meter_no", "categorycode", "transaction_amount", "issuedate"),
               numeric_columns=("transaction_amount",), candidate_keys=("service_point_no", "meter_no"), measure="transaction_amount")


def put(folder: str, name: str, text: str | bytes) -> None:
    path = Path(folder) / "raw" / name
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def files_of(spark, folder, spec=SPEC):
    return discover(spark, f"{folder}/raw", [spec])[spec.name]


def ingest(spark, folder, spec=SPEC):
    return persist_dataset(spark, spec, files_of(spark, folder, spec), f"{folder}/out/{spec.name}.parquet")


def inventory(done):
    return {r.file_name: r for r in done.inventory.collect()}


def test_discovery_is_flat_sorted_and_keeps_empty_files(spark, folder):
    put(folder, "vend-b.csv", VEND_HEADER)
    put(folder, "vend-a 1+2%.csv", VEND_HEADER)
    put(folder, "vend-empty.csv", "")
    put(folder, "Jan_consumption.csv", "mtrid\n")
    put(folder, "vend-consumption.csv", "mtrid\n")
    (Path(folder) / "raw" / "k=1").mkdir()
    put(folder, "k=1/vend-deep.csv", VEND_HEADER)
    found = discover(spark, f"{folder}/raw", [CONSUMPTION, VEND])
    assert [f.name for f in found["vend"]] == ["vend-a 1+2%.csv", "vend-b.csv", "vend-consumption.csv", "vend-empty.csv"]
    assert [f.name for f in found["consumption"]] == ["Jan_consumption.csv", "vend-consumption.csv"]
    assert {f.name: f.size for f in found["vend"]}["vend-empty.csv"] == 0
    assert discover(spark, f"{folder}/raw/../raw/./", [VEND])["vend"] == found["vend"]
    assert list_files(spark, f"{folder}/nowhere", "*.csv") == []


def test_headers_bom_quotes_and_blank_lines(spark, folder):
    put(folder, "vend-1.csv", b"\xef\xbb\xbf\n" + b'"Meter, No",b\n1,2\n')
    put(folder, "vend-2.csv", '"two\nlines",b\n1,2\n')
    put(folder, "vend-3.csv", "")
    put(folder, "vend-4.csv", '"never closed ' + "x\n" * 200_000)
    headers, empty = read_headers(spark, files_of(spark, folder))
    assert [h.raw for h in headers] == [("Meter, No", "b"), ("two\nlines", "b")]
    assert [h.standard for h in headers] == [("meter_no", "b"), ("two_lines", "b")]
    assert [f.name for f in empty] == ["vend-3.csv", "vend-4.csv"]


def test_headers_of_large_files_come_from_their_first_lines(spark, folder, monkeypatch):
    """Every case of a header, and how many lines of a file reach the task that looks for it."""
    monkeypatch.setattr(csv_source, "_SMALL_FILE", 1_000, raising=False)
    put(folder, "vend-1.csv", b"\xef\xbb\xbf\n" + b'"Meter, No",b\n' + b"1,2\n" * 2_000)
    put(folder, "vend-2.csv", '"' + "two\nlines" * 50 + '",b\n' + "1,2\n" * 2_000)
    put(folder, "vend-3.csv", "\n" * 2_000)
    put(folder, "vend-4.csv", '"never closed ' + "x\n" * 200_000)
    put(folder, "vend-5.csv", "small,file\n" + "1,2\n" * 30)
    make = csv_source._header_reader

    def counting(*most):
        task, told = make(*most), f"{folder}/fed-"

        def run(batches):
            all_of = list(batches)
            for path, n in Counter(Path(p).name for b in all_of for p in b["path"]).items():
                Path(f"{told}{path}-{uuid.uuid4()}").write_text(str(n))
            yield from task(iter(all_of))

        return run

    monkeypatch.setattr(csv_source, "_header_reader", counting)
    headers, empty = read_headers(spark, files_of(spark, folder))
    assert [h.raw for h in headers] == [("Meter, No", "b"), ("two\nlines" * 50, "b"), ("small", "file")]
    assert [f.name for f in empty] == ["vend-3.csv", "vend-4.csv"]
    fed = {n: max(int(p.read_text()) for p in Path(folder).glob(f"fed-vend-{n}.csv-*")) for n in (1, 2, 5)}
    assert fed == {1: 16, 2: 1024, 5: 31}


def test_files_with_different_headers_are_merged_by_name(spark, folder):
    put(folder, "vend-1.csv", VEND_HEADER + "S1,007,A,10.5,2026-01-10 08:30\nS2,008,NA,x,09:45\n")
    put(folder, "vend-2.csv", "issuedate,extra,Meter No\n,e,009\n")
    done = ingest(spark, folder)
    rows = {r.meter_no: r for r in done.table.collect()}
    assert set(rows) == {"007", "008", "009"}
    assert (rows["007"].transaction_amount, rows["007"].source_file, rows["007"].analysis_hour) == (10.5, "vend-1.csv", 8)
    assert (rows["008"].categorycode, rows["008"].transaction_amount, rows["008"].issuedate_parse_status) == (None, None, "time_only")
    assert (rows["009"].extra, rows["009"].service_point_no, rows["009"].issuedate_parse_status) == ("e", None, "missing")
    files = inventory(done)
    one, two = files["vend-1.csv"], files["vend-2.csv"]
    assert (one.read_status, one.rows_read, one.column_count, one.schema_valid, one.parse_warning_count) == ("ok", 2, 5, True, 1)
    assert one.schema_status == "All required columns present"
    assert one.raw_columns == "ServicePointNo, Meter No, categorycode, transactionAmount, issuedate"
    assert one.column_mapping.startswith("ServicePointNo->service_point_no, Meter No->meter_no")
    assert (two.schema_valid, two.missing_required_columns) == (False, "service_point_no, categorycode, transaction_amount")
    assert two.schema_status == "Missing required columns: service_point_no, categorycode, transaction_amount"
    assert two.duplicate_policy_mode == "keep_all"
    diagnostics = file_diagnostics(done.inventory, "vend")
    assert diagnostics.columns[:3] == ["dataset", "file_name", "rows_read"] and diagnostics.count() == 2


def test_a_long_row_fails_its_file_and_no_other(spark, folder):
    put(folder, "vend-good.csv", VEND_HEADER + 'S1,1,"a, b",1,2026-01-10\nS2,2\n')
    put(folder, "vend-long.csv", VEND_HEADER + "S3,3,A,1,2026-01-10\nS4,4,A,1,2026-01-10,surplus\n")
    put(folder, "vend-empty.csv", "")
    done = ingest(spark, folder)
    assert sorted(r.service_point_no for r in done.table.collect()) == ["S1", "S2"]
    short = done.table.where("service_point_no = 'S2'").first()
    assert (short.categorycode, short.issuedate_parse_status) == (None, "missing")
    files = inventory(done)
    assert {n: (r.read_status, r.rows_read) for n, r in files.items()} == {
        "vend-good.csv": ("ok", 2), "vend-long.csv": ("error", 0), "vend-empty.csv": ("error", 0),
    }
    assert files["vend-long.csv"].schema_status.startswith("Failed to read file: ")
    assert {r.file_name for r in failed_files(done.inventory).collect()} == {"vend-long.csv", "vend-empty.csv"}
    texts = messages_of(spark, {"vend": done}).collect()
    assert [t.severity for t in texts] == ["error", "error", "success", "success"]
    assert texts[2].message == "Vend duplicate policy 'keep_all': 0 duplicate rows before policy, 0 after policy."
    assert texts[3].message == "Wrote vend.parquet with 2 rows."
    assert read_dataset(spark, SPEC, files_of(spark, folder)).count() == 2


def test_a_long_first_row_is_malformed_too(spark, folder):
    put(folder, "vend-1.csv", "a,b\n1,2,3\n")
    assert inventory(ingest(spark, folder))["vend-1.csv"].read_status == "error"


def test_quarantine_keeps_the_good_rows(spark, folder):
    put(folder, "vend-1.csv", VEND_HEADER + "S3,3,A,1,2026-01-10\nS4,4,A,1,2026-01-10,surplus\n")
    spec = replace(SPEC, malformed_policy="quarantine")
    done = ingest(spark, folder, spec)
    assert [r.service_point_no for r in done.table.collect()] == ["S3"]
    assert [r.service_point_no for r in quarantined_rows(spark, spec, files_of(spark, folder)).collect()] == ["S4"]


def test_line_breaks_in_cells_need_multi_line(spark, folder):
    put(folder, "vend-1.csv", VEND_HEADER + 'S1,1,"two\nlines",1,2026-01-10\n')
    assert inventory(ingest(spark, folder))["vend-1.csv"].read_status == "error"
    done = ingest(spark, folder, replace(SPEC, multi_line=True))
    assert done.table.first().categorycode == "two\nlines"
    put(folder, "vend-2.csv", VEND_HEADER + 'S1,1,"two\nlines, here",1,2026-01-10\nS2,2,A,1,2026-01-10,surplus\n')
    files = inventory(ingest(spark, folder, replace(SPEC, multi_line=True)))
    assert {n: r.read_status for n, r in files.items()} == {"vend-1.csv": "ok", "vend-2.csv": "error"}


def test_names_that_differ_in_case_and_reserved_names(spark, folder):
    put(folder, "vend-1.csv", "A,a,source_file,issuedate\n1,2,mine,2026-01-10\n")
    row = ingest(spark, folder).table.first()
    assert (row.a, row.a_2, row.source_file) == ("1", "2", "vend-1.csv")


def test_no_files_give_an_empty_typed_table(spark, folder):
    put(folder, "other.csv", "a\n")
    done = ingest(spark, folder)
    assert done.table.count() == 0 and "issuedate_parse_status" in done.table.columns
    assert [m[1:] for m in done.messages] == [("warning", "No valid vend files were ingested."), ("success", "Wrote vend.parquet with 0 rows.")]


@pytest.mark.parametrize("mode, rows, counts", [("keep_all", 5, "2 duplicate rows before policy, 2 after"), ("drop_first", 3, "2 duplicate rows before policy, 0 after"),
                                                ("drop_last", 3, "2 duplicate rows before policy, 0 after"), ("error", 5, "2 duplicate rows before policy, 2 after")])
def test_duplicate_policies(spark, folder, mode, rows, counts):
    line = "S1,1,A,1,2026-01-10\n"
    put(folder, "vend-1.csv", VEND_HEADER + line * 3 + "S2,2,A,1,2026-01-10\n")
    put(folder, "vend-2.csv", VEND_HEADER + line)  # the same row of another file is no duplicate
    done = ingest(spark, folder, replace(SPEC, duplicate_policy=mode))
    assert done.table.count() == rows
    texts = [m[2] for m in done.messages]
    assert any(counts in t for t in texts)
    assert any("set to error" in t for t in texts) == (mode == "error")
    assert texts[-1] == f"Wrote vend.parquet with {rows} rows."
    assert inventory(done)["vend-1.csv"].rows_read == 4
    if mode.startswith("drop"):
        kept = done.table.where("service_point_no = 'S1' and source_file = 'vend-1.csv'").first()
        assert kept.row_ordinal.seq % (1 << 33) == {"drop_first": 0, "drop_last": 2}[mode]


def test_duplicates_across_files_on_request(spark, folder):
    for name in ("vend-1.csv", "vend-2.csv"):
        put(folder, name, VEND_HEADER + "S1,1,A,1,2026-01-10\n")
    done = ingest(spark, folder, replace(SPEC, duplicate_policy="drop_first", dedup_exclude=("source_file",)))
    assert [r.source_file for r in done.table.collect()] == ["vend-1.csv"]


def test_partitioned_table_and_overwrite(spark, folder, plan_of):
    put(folder, "vend-1.csv", VEND_HEADER + "S1,1,A,1,2026-01-10\nS2,2,A,1,2026-02-10\nS3,3,A,1,\n")
    for _ in range(2):
        done = persist_dataset(spark, SPEC, files_of(spark, folder), f"{folder}/out/p", partition_by="vend_month")
    assert done.table.count() == 3
    assert sorted(str(r.vend_month) for r in done.table.collect()) == ["2026-01", "2026-02", "None"]
    wanted = PaymentFilter(date_range=(dt.date(2026, 2, 1), dt.date(2026, 2, 28)))
    kept = filter_payments(done.table, SPEC, wanted)
    assert [r.service_point_no for r in kept.collect()] == ["S2"]
    assert "PartitionFilters: [isnotnull(vend_month" in plan_of(kept)
    assert sorted(p.name for p in Path(f"{folder}/out/p").glob("vend_month=*")) == [
        "vend_month=2026-01", "vend_month=2026-02", "vend_month=__HIVE_DEFAULT_PARTITION__",
    ]


def test_write_failure_is_a_message(spark, folder):
    Path(folder, "blocked").write_text("a file")
    ok, text = write_parquet(spark.range(1), f"{folder}/blocked/table.parquet")
    assert not ok and text.startswith("Failed to write table.parquet: ")


def test_csv_export_has_every_row(spark, folder):
    df = spark.range(2500).select("id", F.struct("id").alias("row_ordinal"), F.lit('say "hi"').alias("t"))
    write_csv(df, f"{folder}/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/csv")
    assert back.columns == ["id", "t"] and back.count() == 2500 and back.first().t == 'say "hi"'


def test_stamped_names():
    for stamp in ("2026-03-23T15:34:12.123456+00:00", "2026-03-23T15:34:12Z", "2026-03-23T17:34:12+02:00", "2026-03-23T15:34:12"):
        assert stamped_name("quality_diagnostics", stamp) == "quality_diagnostics_20260323T153412Z.json"


def test_pipeline_end_to_end(spark, folder):
    put(folder, "Jan_consumption.csv", "mtrid,midnightdate,kwh_abs,kvah_abs,kwh_consumption,kvah_consumption\n"
        "M1,2026-01-30,1,1,5,6\nM1,2026-01-31,1,1,7,8\nM2,2026-01-31,1,1,1.5,2\nM2,oops,1,1,1,1\n")
    put(folder, "vend-1.csv", ",".join(VEND.required_columns) + "\nS1,1,A,10,2026-01-10 08:30\nS1,1,A,10,09:15\nS1,1,A,10,09:15\n")
    bundle = run_pipeline(spark, [CONSUMPTION, VEND], f"{folder}/raw", f"{folder}/out", dt.datetime(2026, 2, 1))
    overview = {(r.dataset, r.metric): r.value for r in bundle.overview().collect()}
    assert overview[("all", "files")] == 2 and overview[("consumption", "unique_meters")] == 2
    assert overview[("consumption", "average_daily_kwh")] == (5 + 8.5) / 2
    assert overview[("vend", "time_only_rows")] == 2
    coverage = {r.dataset: (r.files, r.rows, r.date_span) for r in bundle.coverage().collect()}
    assert coverage == {"Consumption": (1, 4, "2026-01-30 to 2026-01-31"), "Vend / Recharge": (1, 3, "2026-01-10 to 2026-01-10")}
    vend = bundle.quality["vend"]
    assert vend["duplicate_rows"].first().duplicate_rows == 1
    assert [r.file_name for r in vend["file_diagnostics"].collect()] == ["vend-1.csv"]
    assert any("2 vend records contain time-only" in r.warning for r in vend["warnings"].collect())
    path = export_quality(spark, bundle, f"{folder}/export", dt.datetime(2026, 2, 1, 12, tzinfo=dt.UTC))
    assert path.endswith("quality_diagnostics_20260201T120000Z.json")
    lines = [json.loads(line) for p in Path(path).glob("part-*") for line in p.read_text().splitlines()]
    found = {(x["dataset"], x["check"]): json.loads(x["payload"]) for x in lines}
    assert {x["schema_version"] for x in lines} == {"1.0.0"}
    assert found[("vend", "duplicate_rows")]["duplicate_rows"] == 1
    assert found[("consumption", "outlier_summary")]["outlier_count"] == 0
    assert "lower_bound" in found[("vend", "outlier_summary")] and found[("vend", "outlier_summary")]["lower_bound"] is None
    assert inventory_of(spark, bundle.ingested).count() == 2
    again = ingest_and_persist(spark, [CONSUMPTION, VEND], f"{folder}/raw", f"{folder}/out")
    assert again["vend"].table.count() == 3


def test_incremental_takes_each_file_once(spark, folder):
    raw, out, checkpoint = f"{folder}/raw", f"{folder}/out", f"{folder}/checkpoint"
    put(folder, "vend-1.csv", VEND_HEADER + "S1,1,A,10,2026-01-10 08:30\n")
    ingest_new_files(spark, SPEC, raw, out, checkpoint)
    assert read_table(spark, out).count() == 1
    put(folder, "vend-2 b.csv", "issuedate,Meter No,extra\n09:30,2,x\n")
    put(folder, "vend-3.csv", VEND_HEADER + "S4,4,A,1,2026-01-10,surplus\n")
    ingest_new_files(spark, SPEC, raw, out, checkpoint)
    ingest_new_files(spark, SPEC, raw, out, checkpoint)
    rows = {r.source_file: r for r in read_table(spark, out).collect()}
    assert set(rows) == {"vend-1.csv", "vend-2 b.csv"} and rows["vend-2 b.csv"].extra == "x"
    status = {r.file_name: r.read_status for r in read_inventory(spark, out).collect()}
    assert status == {"vend-1.csv": "ok", "vend-2 b.csv": "ok", "vend-3.csv": "error"}


@pytest.fixture
def text_rows(spark, monkeypatch):
    """Counts the records that scans of CSV text give, over all scans."""
    seen = spark.sparkContext.accumulator(0)

    def counted(*args):
        rows = read_group(*args)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(count, rows.schema)

    monkeypatch.setattr(ingest_job, "read_group", counted)
    return seen


@pytest.mark.parametrize("policy, mode", [("fail_file", "keep_all"), ("fail_file", "drop_first"), ("quarantine", "keep_all")])
def test_text_is_scanned_once_with_and_without_bad_files(spark, folder, text_rows, policy, mode):
    spec = replace(SPEC, malformed_policy=policy, duplicate_policy=mode)
    put(folder, "vend-good.csv", VEND_HEADER + "S1,1,A,1,2026-01-10\n" * 2)
    ingest(spark, folder, spec)
    assert text_rows.value == 2
    put(folder, "vend-long.csv", VEND_HEADER + "S3,3,A,1,2026-01-10\nS4,4,A,1,2026-01-10,surplus\n")
    put(folder, "vend-quote.csv", VEND_HEADER + 'S5,5,A,1,2026-01-10\n"S6,6,A,1,2026-01-10\n')
    put(folder, "vend-empty.csv", "")
    done = ingest(spark, folder, spec)
    assert text_rows.value == 2 + 6
    kept = {"fail_file": {"S1"}, "quarantine": {"S1", "S3", "S5"}}[policy]
    # The written table itself holds no row of a failed file.
    for table in (done.table, spark.read.parquet(done.uri)):
        assert {r.service_point_no for r in table.collect()} == kept
        assert table.where("service_point_no = 'S1'").count() == (1 if mode == "drop_first" else 2)
    status = {n: (r.read_status, r.rows_read) for n, r in inventory(done).items()}
    lost = ("error", 0) if policy == "fail_file" else ("ok", 1)
    assert status == {"vend-good.csv": ("ok", 2), "vend-long.csv": lost, "vend-quote.csv": lost, "vend-empty.csv": ("error", 0)}


def test_many_failed_files_are_left_out_by_a_join(spark, folder):
    table = spark.createDataFrame([(i, f"f{i}") for i in range(300)], "v int, source_file string")
    assert {r.v for r in _without_files(table, [f"f{i}" for i in range(250)]).collect()} == set(range(250, 300))


def test_a_dataset_that_breaks_off_leaves_the_others_whole(spark, folder):
    put(folder, "Jan_consumption.csv", "mtrid,midnightdate\nM1,2026-01-30\n")
    put(folder, "vend-1.csv", ",".join(VEND.required_columns) + "\nS1,1,A,10,2026-01-10 08:30\n")
    Path(folder, "out").mkdir()
    broken = replace(CONSUMPTION, date=replace(CONSUMPTION.date, extra_formats=("not a format {",)))
    bundle = run_pipeline(spark, [broken, VEND], f"{folder}/raw", f"{folder}/out", dt.datetime(2026, 2, 1))
    rows = {r.dataset: r for r in summary(spark, bundle).collect()}
    assert (rows["vend"].ok, rows["vend"].rows, rows["vend"].errors) == (True, 1, 0)
    assert (rows["consumption"].ok, rows["consumption"].rows) == (False, 0) and rows["consumption"].errors >= 1


def test_csv_export_is_read_back_as_it_was(spark, folder):
    schema = "id string, note string, amount double, day date, at timestamp_ntz, flag boolean"
    moment = dt.datetime(2026, 1, 2, 3, 4, 5, 678901)
    rows = [("007", "", 1.5, dt.date(2026, 1, 2), moment, True), ("", None, None, None, None, None), ('a"b', 'say "hi", twice', -0.1, None, None, False),
            (" pad ", "line one\nline two\r\nthree", 1e300, None, None, None), ("NA", "\\", 0.0, None, None, None), (None, "é,漢", None, None, None, None)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    write_csv(df, f"{folder}/csv")
    assert sorted(map(repr, read_csv(spark, f"{folder}/csv", df.schema).collect())) == sorted(map(repr, df.collect()))
    wrong = spark.createDataFrame([], "id int, note string, amount double, day date, at timestamp_ntz, flag boolean").schema
    with pytest.raises(Exception):
        read_csv(spark, f"{folder}/csv", wrong).collect()


def test_reports_are_read_back_with_their_types(spark, folder):
    nan, moment = float("nan"), dt.datetime(2026, 1, 2, 3, 4, 5, 678901)
    table = spark.createDataFrame([("vend", "a", 0.0, 0, moment), ("vend", "b", nan, None, None), ("vend", None, None, 7, None)], "dataset string, item string, x double, n long, at timestamp_ntz")
    path = write_report(spark, {"vend": {"made_up": table}}, f"{folder}/reports", "2026-02-01T12:00:00Z")
    other = spark.createDataFrame([("2.0.0", "2026-03-01T00:00:00Z", "vend", "made_up", '{"x": "all different"}'), (None, None, None, "made_up", "{}")], REPORT_SCHEMA)
    other.write.mode("append").json(path)
    known, unknown = read_report(spark, f"{folder}/reports/*")
    assert known.count() == 3 and unknown.count() == 2
    back = {r["item"]: r for r in report_tables(known, {"made_up": table.schema})["made_up"].collect()}
    assert (back["a"].x, back["a"].n, back["a"]["at"]) == (0.0, 0, moment)
    assert (back["b"].x, back["b"].n, back[None].x, back[None].n) == (None, None, None, 7)
    assert unread_checks(known, {"other": table.schema}).collect() == [("vend", "made_up", 3)]
    with pytest.raises(Exception):
        report_tables(unknown.where("schema_version = '2.0.0'"), {"made_up": table.schema})["made_up"].collect()


def test_check_schemas_fit_written_reports(spark, folder):
    put(folder, "vend-1.csv", ",".join(VEND.required_columns) + "\nS1,1,A,10,2026-01-10 08:30\nS1,1,A,10,09:15\n")
    bundle = run_pipeline(spark, [VEND], f"{folder}/raw", f"{folder}/out", dt.datetime(2026, 2, 1))
    path = export_quality(spark, bundle, f"{folder}/export", dt.datetime(2026, 2, 1, tzinfo=dt.UTC))
    known, unknown = read_report(spark, path)
    schemas = check_schemas(spark, VEND)
    assert unknown.count() == 0 and unread_checks(known, schemas).count() == 0
    tables = report_tables(known, schemas)
    for check, table in bundle.quality["vend"].checks.items():
        assert sorted(map(repr, tables[check].select(*table.columns).collect())) == sorted(map(repr, table.collect())), check


def test_header_task_runs_where_the_package_is_not_installed(folder):
    Path(folder, "task.bin").write_bytes(cloudpickle.dumps(_header_reader()))
    code = (
        "import pickle, pandas as pd\n"
        f"task = pickle.load(open({folder + '/task.bin'!r}, 'rb'))\n"
        "print(next(task(iter([pd.DataFrame({'path': ['p'], 'value': ['a,b']})])))['cells'][0])"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env={"PATH": ""})
    assert done.stdout.strip() == "['a', 'b']", done.stderr


def test_a_dropping_ingest_does_not_search_copies_twice(spark, folder, monkeypatch):
    put(folder, "vend-1.csv", VEND_HEADER + "S1,1,A,1,2026-01-10\n" * 3 + "S2,2,A,1,2026-01-10\n")
    monkeypatch.setattr(ingest_job, "duplicate_row_count", None)
    spec = replace(VEND, duplicate_policy="drop_first", required_columns=SPEC.required_columns)
    done = ingest_job.persist_dataset(spark, spec, files_of(spark, folder, spec), f"{folder}/table")
    assert done.table.count() == 2
    assert any("2 duplicate rows before policy, 0 after" in m[2] for m in done.messages)
    assert any("with 2 rows" in m[2] for m in done.messages)
