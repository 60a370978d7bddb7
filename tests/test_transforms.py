from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gridtally.functions import dates, numbers, text
from gridtally.operators import transforms
from gridtally.spec import CONSUMPTION, VEND, DatePolicy, resolve_duplicate_policy


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "name, want",
    [
        ("\tFeeder No. ", "feeder_no"),
        ("tariffBandOld", "tariff_band_old"),
        ("CT/PT--ratio (%)", "ct_pt_ratio"),
        ("kWh2Used", "k_wh2_used"),
        ("__x__", "x"),
        ("ABC", "abc"),
    ],
)
def test_snake_case(name, want):
    assert text.snake_case(name) == want


def test_header_names_repeat_and_blank():
    raw = text.header_names(["a", "a", "", "A"])
    assert raw == ["a", "a.1", "Unnamed: 2", "A"]
    assert text.standard_names(raw) == ["a", "a_1", "unnamed_2", "a_2"]


def test_standardize_columns_returns_mapping(spark):
    # Names that come to the same, and one without a letter, stay apart and in their places.
    raw = ["Feeder No.", "feederNo", "%", "feeder_no_2"]
    df, mapping = transforms.standardize_columns(spark.createDataFrame([tuple("abcd")], ", ".join(f"`{n}` string" for n in raw)))
    assert df.columns == ["feeder_no", "feeder_no_2", "column_2", "feeder_no_2_2"]
    assert mapping == dict(zip(raw, df.columns)) and tuple(df.first()) == tuple("abcd")


def test_null_tokens_apply_before_trimming(spark):
    values = ["", "NA", "null", "None", "nan", "#N/A", " NA", "  ", "x", None, "na"]
    got = column(spark, values, lambda c: text.strip(text.null_tokens(c)))
    assert got == [None] * 6 + ["NA", "", "x", None, "na"]


def test_strip_removes_unicode_space_only_at_the_ends(spark):
    values = ["  a b\t", " x　", "\x1cy\x1f", "z"]
    assert column(spark, values, text.strip) == ["a b", "x", "y", "z"]


def test_trim_leaves_other_types(spark):
    day = dt.date(2024, 2, 29)
    df = transforms.trim_text(spark.createDataFrame([("\tfeeder 7 ", None, 0.5, day, [" x "])], "`a.b` string, note string, load double, day date, tags array<string>"))
    assert tuple(df.first()) == ("feeder 7", None, 0.5, day, [" x "])


def test_to_number(spark):
    values = ["1e3", "+3", ".5", "5.", "-2.25", "inf", "-Infinity", "1,000", "0x1A", "0x1p3", "1.5d", "1.5f", "nan", "", None, "abc", "1_0"]
    inf = float("inf")
    want = [1000.0, 3.0, 0.5, 5.0, -2.25, inf, -inf] + [None] * 10
    assert column(spark, values, numbers.to_number) == want


def test_numeric_coercion_skips_absent_columns(spark):
    df = transforms.coerce_numeric(spark.createDataFrame([("1.5", "x")], "a string, b string"), ["a", "zz"])
    assert df.collect()[0].asDict() == {"a": 1.5, "b": "x"}


def test_parse_layouts_month_first(spark):
    cases = {
        "2026-01-31": dt.datetime(2026, 1, 31),
        "2026-1-3 8:05": dt.datetime(2026, 1, 3, 8, 5),
        "2026-01-31T08:05:01.5": dt.datetime(2026, 1, 31, 8, 5, 1, 500000),
        "01/31/2026": dt.datetime(2026, 1, 31),
        "1-31-2026 23:59:59": dt.datetime(2026, 1, 31, 23, 59, 59),
        "2026/01/31 07:00": dt.datetime(2026, 1, 31, 7),
        "1/31/26": dt.datetime(2026, 1, 31),
        "1/31/70": dt.datetime(1970, 1, 31),
        "1/31/2026 2:30 PM": dt.datetime(2026, 1, 31, 14, 30),
        "31-Jan-2026": dt.datetime(2026, 1, 31),
        "31 January 2026 06:15": dt.datetime(2026, 1, 31, 6, 15),
        "25/04/2026": None,
        "2026-02-30": None,
        "2026-01-31 25:00": None,
        "2026-01-31 08:00+02:00": None,
        "2026-01": None,
        "9999-12-31": None,
        "1500-01-01": None,
        "09:45": None,
        "bad": None,
        "": None,
    }
    got = column(spark, list(cases), lambda c: dates.parse_timestamp(c, DatePolicy("d")))
    assert dict(zip(cases, got)) == cases


def test_parse_day_first_and_extra_formats(spark):
    policy = DatePolicy("d", day_first=True, extra_formats=("yyyyMMdd",))
    got = column(spark, ["25/04/2026", "04/25/2026", "20260425"], lambda c: dates.parse_timestamp(c, policy))
    assert got == [dt.datetime(2026, 4, 25), None, dt.datetime(2026, 4, 25)]


def test_time_only_hour(spark):
    values = ["9:45", "09:45:30.5", "23:59", "25:00", "12:75", "1:2", None]
    assert column(spark, values, dates.time_only_hour) == [9, 9, 23, None, None, None, None]


def test_consumption_columns(spark):
    raw = spark.createDataFrame([(" M1", "2026-01-31", "10.5"), ("M2", "not-a-date", "x")], "mtrid string, midnightdate string, kwh_abs string")
    first, second = transforms.transform(raw, CONSUMPTION, "Jan.csv").orderBy("mtrid").collect()
    assert (first.mtrid, first.kwh_abs, first.source_file) == ("M1", 10.5, "Jan.csv")
    assert (first.midnightdate_raw, first.midnightdate_parsed) == ("2026-01-31", dt.datetime(2026, 1, 31))
    assert (first.midnightdate_parse_success, first.date) == (True, dt.date(2026, 1, 31))
    assert (first.month, first.week, first.day_of_week) == ("2026-01", 5, "Saturday")
    assert (second.kwh_abs, second.midnightdate_parse_success, second.midnightdate_parsed) == (None, False, None)
    assert (second.date, second.month, second.week, second.day_of_week) == (None, None, None, None)


def test_iso_week_without_its_year(spark):
    raw = spark.createDataFrame([("2021-01-01",)], "midnightdate string")
    assert transforms.transform(raw, CONSUMPTION, "f").first().week == 53


def test_vend_statuses_and_hours(spark):
    texts = ["2026-01-10 08:30", "", "09:45", "bad-date", None, "   ", "25:00", "2026-01-10"]
    rows = [(str(i), t) for i, t in enumerate(texts)]
    typed = transforms.transform(spark.createDataFrame(rows, "meterno string, issuedate string"), VEND, "v.csv")
    got = typed.orderBy("meterno").collect()
    assert [r.issuedate_parse_status for r in got] == [
        "parsed_datetime", "missing", "time_only", "failed", "missing", "missing", "time_only", "parsed_datetime",
    ]
    assert [r.analysis_hour for r in got] == [8, None, 9, None, None, None, None, 0]
    assert [r.issuedate_is_time_only for r in got] == [False, False, True, False, False, False, True, False]
    assert [r.issuedate_time_only_text for r in got] == [None, None, "09:45", None, None, None, "25:00", None]
    assert [r.vend_hour for r in got] == [8, None, None, None, None, None, None, 0]
    assert (got[0].vend_date, got[0].vend_month, got[0].vend_week) == (dt.date(2026, 1, 10), "2026-01", 2)
    assert got[0].vend_day_of_week == "Saturday"
    # An empty text stays empty, a null stays null.
    assert (got[1].issuedate_raw, got[4].issuedate_raw) == ("", None)


def test_missing_date_column_gives_null_columns(spark):
    typed = transforms.transform(spark.createDataFrame([("M",)], "meterno string"), VEND, "v.csv").first()
    assert (typed.issuedate_parse_status, typed.issuedate_raw, typed.vend_date) == ("missing", None, None)


@pytest.mark.parametrize("spec", [CONSUMPTION, VEND])
def test_empty_table_matches_the_typed_schema(spark, spec):
    raw = spark.createDataFrame([("x",) * len(spec.required_columns)], ", ".join(f"{c} string" for c in spec.required_columns))
    typed = transforms.transform(raw, spec, "f")
    empty = spark.createDataFrame([], spec.struct_type())
    assert [(f.name, f.dataType) for f in typed.schema] == [(f.name, f.dataType) for f in empty.schema]


def test_per_file_layout(spark):
    rows = [
        ("a", 0, "2026-01-01"), ("a", 1, "01/02/2026"), ("a", 2, "2026-01-03"),
        ("b", 0, None), ("b", 1, "01/02/2026"), ("b", 2, "2026-01-03"),
        ("c", 0, "mystery"), ("c", 1, "2026-01-03"), ("c", 2, "01/02/2026"),
    ]
    df = spark.createDataFrame(rows, "source_file string, n long, midnightdate string").withColumn(
        "row_ordinal", F.struct(F.lit(0).alias("block"), F.col("n").alias("seq"))
    )
    policy = replace(CONSUMPTION.date, per_file=True)
    got = transforms.parse_dates(df, policy).orderBy("source_file", "n").collect()
    assert [r.midnightdate_parsed is not None for r in got] == [True, False, True, False, True, False, False, True, True]


def test_ansi_mode_never_raises(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    raw = spark.createDataFrame([("x", "y", "z")], "transactionamount string, issuedate string, meterno string")
    assert transforms.transform(raw, VEND, "f").first().transactionamount is None


@pytest.mark.parametrize("mode, want", [(" DROP_First ", "drop_first"), ("other", "keep_all"), (None, "keep_all"), ("error", "error")])
def test_policy_names(mode, want):
    assert resolve_duplicate_policy(mode) == want


def test_union_by_name_fills_absent_columns(spark):
    a = spark.createDataFrame([("1", "2")], "x string, y string")
    b = spark.createDataFrame([("3", "4")], "z string, x string")
    assert sorted(map(str, transforms.union_by_name([a, b]).select("x", "y", "z").collect())) == sorted(
        ["Row(x='1', y='2', z=None)", "Row(x='4', y=None, z='3')"]
    )
