"""Filters, key figures, rollups, duplicates, quality and profile against plain-Python formulas."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import Counter, defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gridtally.operators import dedupe, filters, kpis, profile, quality, rollups
from gridtally.plans.quality_suite import run_checks
from gridtally.spec import CONSUMPTION, VEND, VEND_DATE_LIMITATION, Thresholds

NOW = dt.datetime(2026, 3, 1)
DAY = dt.timedelta(days=1)


def vend_rows(n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        status = rng.choice(["parsed_datetime", "parsed_datetime", "time_only", "missing", "failed"])
        when = dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 60)) if status == "parsed_datetime" else None
        hour = when.hour if when else (rng.randrange(24) if status == "time_only" else None)
        rows.append((
            f"S{rng.randrange(9)}", None if rng.random() < 0.1 else f"M{rng.randrange(20)}",
            None if rng.random() < 0.1 else rng.choice("ABC"), None if rng.random() < 0.1 else round(rng.uniform(-5, 90), 2),
            f"f{0 if rng.random() < 0.4 else rng.randrange(1, 5)}.csv", status, status == "time_only", when,
            when.date() if when else None, hour, i,
        ))
    return rows


VEND_COLUMNS = (
    "servicepointno string, meterno string, categorycode string, transactionamount double, source_file string, "
    "issuedate_parse_status string, issuedate_is_time_only boolean, issuedate_parsed timestamp_ntz, vend_date date, "
    "analysis_hour int, n int"
)


@pytest.fixture(scope="module")
def rows():
    return vend_rows()


@pytest.fixture(scope="module")
def vend(spark, rows):
    return spark.createDataFrame(rows, VEND_COLUMNS).repartition(4).cache()


@pytest.fixture(scope="module")
def readings(spark):
    data = [
        ("M1", True, dt.date(2026, 1, 1), 2.0, 3.0), ("M1", True, dt.date(2026, 1, 2), 4.0, 5.0), ("M2", True, dt.date(2026, 1, 2), 1.0, 1.0),
        ("M2", False, None, 10.0, 1.0), ("M3", True, dt.date(2026, 1, 3), None, None), (None, False, None, 7.0, None),
    ]
    df = spark.createDataFrame(data, "mtrid string, midnightdate_parse_success boolean, date date, kwh_consumption double, kvah_consumption double")
    return df.withColumn("midnightdate_parsed", F.col("date").cast("timestamp_ntz"))


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- filters ------------------------------------------------------------------------------


def test_reading_filter_is_opt_in(readings):
    assert filters.filter_readings(readings, CONSUMPTION, filters.ReadingFilter()).count() == 6
    kept = filters.filter_readings(readings, CONSUMPTION, filters.ReadingFilter(parsed_only=True))
    assert kept.count() == 4


def test_ranges_are_inclusive_and_drop_nulls(readings):
    wanted = filters.ReadingFilter(measure_range=(1.0, 4.0))
    assert filters.filter_readings(readings, CONSUMPTION, wanted).count() == 3
    wanted = filters.ReadingFilter(date_range=(dt.date(2026, 1, 2), dt.date(2026, 1, 3)), entities=["M1", "M3"])
    assert filters.filter_readings(readings, CONSUMPTION, wanted).count() == 2


def test_payment_filter_matches_python(vend, rows):
    wanted = filters.PaymentFilter(
        statuses=["parsed_datetime", "time_only"], categorycode=["A", "B"], source_file=["f0.csv", "f1.csv"],
        measure_range=(0.0, 50.0), hours=[0, 5, 9, 13, 20], meterno=[f"M{i}" for i in range(0, 20, 2)], servicepointno=["S1", "S2", "S3", "S4"],
    )
    want = [r[10] for r in rows if r[5] in ("parsed_datetime", "time_only") and r[2] in ("A", "B") and r[4] in ("f0.csv", "f1.csv")
            and r[3] is not None and 0 <= r[3] <= 50 and r[9] in (0, 5, 9, 13, 20) and r[1] in {f"M{i}" for i in range(0, 20, 2)} and r[0] in ("S1", "S2", "S3", "S4")]
    got = filters.filter_payments(vend, VEND, wanted).select("n")
    assert result(got) == sorted(((n,) for n in want), key=repr)
    assert filters.filter_payments(vend, VEND, filters.PaymentFilter(full_datetime_only=True)).count() == sum(r[5] == "parsed_datetime" for r in rows)


def test_long_lists_use_a_semi_join(spark, vend, rows, monkeypatch):
    monkeypatch.setattr(filters, "LIST_LIMIT", 2)
    got = filters.member(vend, "meterno", ["M1", "M2", "M3", "other"]).count()
    assert got == sum(r[1] in ("M1", "M2", "M3") for r in rows)


def test_integer_keys_compare_as_text(spark):
    df = spark.range(20)
    assert result(filters.member(df, "id", ["7", "07", "x", 8])) == [(7,), (8,)]
    assert filters.drill_down(df, "id", "nope").count() == 0


def test_choices_and_bounds(vend, rows):
    assert [r[0] for r in filters.distinct_values(vend, "meterno").collect()] == sorted({r[1] for r in rows if r[1]})
    amounts = [r[3] for r in rows if r[3] is not None]
    assert tuple(filters.value_bounds(vend, ["transactionamount"]).first()) == (min(amounts), max(amounts))


# --- key figures --------------------------------------------------------------------------


def test_readings_kpis(readings):
    got = kpis.readings_kpis(readings, CONSUMPTION).first().asDict()
    assert got == {
        "rows": 6, "unique_meters": 3, "total_kwh_consumption": 24.0, "total_kvah_consumption": 10.0,
        "average_daily_kwh": (2 + 5 + 0) / 3, "min_daily_kwh": 0.0, "max_daily_kwh": 5.0,
        "span_min": dt.datetime(2026, 1, 1), "span_max": dt.datetime(2026, 1, 3),
    }


@pytest.mark.parametrize("approximate", [False, True])
def test_payments_kpis(vend, rows, approximate):
    got = kpis.payments_kpis(vend, replace(VEND, measure_scale=2), approximate).first()
    amounts = [r[3] for r in rows if r[3] is not None]
    assert (got.rows, got.transactions, got.unique_service_points, got.unique_meters) == (600, 600, 9, 20)
    assert got.total_transaction_amount == round(sum(amounts), 2)
    assert got.average_transaction_amount == pytest.approx(sum(amounts) / len(amounts))
    assert got.time_only_rows == sum(r[6] for r in rows)


def test_kpis_of_empty_and_missing_columns(spark, vend, readings):
    empty = kpis.payments_kpis(vend.limit(0), VEND).first()
    assert (empty.rows, empty.total_transaction_amount, empty.average_transaction_amount, empty.span_min) == (0, 0.0, 0.0, None)
    bare = spark.createDataFrame([("x",)], "other string")
    got = kpis.payments_kpis(bare, VEND).first()
    assert (got.rows, got.unique_meters, got.total_transaction_amount, got.time_only_rows) == (1, 0, 0.0, 0)
    got = kpis.readings_kpis(bare, CONSUMPTION).first()
    assert (got.rows, got.unique_meters, got.average_daily_kwh, got.max_daily_kwh) == (1, 0, 0.0, 0.0)
    assert kpis.readings_kpis(readings.limit(0), CONSUMPTION).first().rows == 0


def test_parse_coverage_of_nothing_is_zero(vend):
    assert kpis.parse_coverage(vend.limit(0), VEND).first().parse_coverage_pct == 0.0


def test_drill_downs(vend, rows, readings):
    meters = {r.mtrid: tuple(r)[1:] for r in kpis.entity_readings(readings, CONSUMPTION).collect()}
    assert meters == {"M1": (2, 6.0, 2.0, 4.0), "M2": (2, 11.0, 1.0, 10.0), "M3": (1, 0.0, None, None)}
    by_point = defaultdict(list)
    for r in rows:
        by_point[r[0]].append(r)
    for got in kpis.entity_payments(vend, VEND, "servicepointno").collect():
        mine = by_point[got.servicepointno]
        amounts = [r[3] for r in mine if r[3] is not None]
        assert (got.rows, got.source_files) == (len(mine), len({r[4] for r in mine}))
        assert got.total_value == pytest.approx(sum(amounts)) and got.mean_value == pytest.approx(sum(amounts) / len(amounts))


# --- rollups ------------------------------------------------------------------------------


def sums(rows, *keys):
    found = defaultdict(float)
    for r in rows:
        if all(r[k] is not None for k in keys):
            found[tuple(r[k] for k in keys)] += r[3] or 0.0
    return found


@pytest.mark.parametrize("make, keys", [
    (rollups.daily_total, (8,)), (rollups.amount_by_source, (4,)), (rollups.hourly_profile, (9,)),
    (lambda df, spec: rollups.source_breakdown(df, spec, "meterno"), (1, 4)), (rollups.daily_total_by_entity, (0, 8)),
])
def test_rollups(vend, rows, make, keys):
    got = {tuple(r)[:-1]: r.total_value for r in make(vend, VEND).collect()}
    assert got == pytest.approx(sums(rows, *keys))


def test_rollup_order(vend):
    days = [r.vend_date for r in rollups.daily_total(vend, VEND).collect()]
    amounts = [r.total_value for r in rollups.amount_by_source(vend, VEND).collect()]
    assert days == sorted(days) and amounts == sorted(amounts, reverse=True)


def test_null_measures_sum_to_zero(readings):
    assert {r.mtrid: r.total_value for r in rollups.top_entities(readings, CONSUMPTION).collect()}["M3"] == 0.0


def test_top_entities_break_ties_by_key(spark):
    df = spark.createDataFrame([(f"M{i:02}", 1.0) for i in range(15)] + [("M14", 5.0)], "mtrid string, kwh_consumption double")
    got = [r.mtrid for r in rollups.top_entities(df, CONSUMPTION, 4).collect()]
    assert got == ["M14", "M00", "M01", "M02"]


def test_category_breakdown(vend, rows):
    got = {r.categorycode: (r["sum"], r["count"]) for r in rollups.category_breakdown(vend, VEND).collect()}
    for category in "ABC":
        amounts = [r[3] for r in rows if r[2] == category and r[3] is not None]
        assert got[category] == (pytest.approx(sum(amounts)), len(amounts))
    assert len(got) == 3


def test_histogram_keeps_empty_bins_and_the_top_edge(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 9.99, 10.0, None, float("nan"), float("inf"))], "v double")
    got = [(r.bin, r.lower, r.upper, r["count"]) for r in rollups.histogram(df, "v", 5).collect()]
    assert got == [(1, 0.0, 2.0, 2), (2, 2.0, 4.0, 0), (3, 4.0, 6.0, 0), (4, 6.0, 8.0, 0), (5, 8.0, 10.0, 2)]


def test_histogram_of_one_value(spark):
    got = rollups.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 4).collect()
    assert [r["count"] for r in got] == [2, 0, 0, 0]


def test_box_stats_and_points(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 1000, 4, 5)], "v double")
    got = rollups.box_stats(df, "v").first().asDict()
    assert got == {"n": 6, "q1": 2.25, "median": 3.5, "q3": 4.75, "lower_whisker": 1.0, "upper_whisker": 5.0, "outlier_count": 1}
    assert result(rollups.box_outliers(df, "v")) == [(1000.0,)]


@pytest.mark.parametrize("broadcast_bytes", [0, 8 << 20])
def test_box_stats_with_a_hot_group(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(rollups, "BROADCAST_BYTES", broadcast_bytes)
    rows = [("hot", float(i % 97)) for i in range(900)] + [("small", float(i)) for i in range(9)] + [("small", 500.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    narrowed = {r.g: tuple(r)[1:] for r in rollups.box_stats(df, "v", "g", limit=50).collect()}
    builtin = {r.g: tuple(r)[1:] for r in rollups.box_stats(df, "v", "g").collect()}
    assert narrowed == builtin and set(narrowed) == {"hot", "small", None}
    assert sorted(r.g for r in rollups.box_outliers(df, "v", "g", limit=50).collect()) == ["small"]


def test_preview_follows_row_order(spark):
    df = spark.range(0, 100, 1, 8).select(F.lit("f").alias("source_file"), F.struct(F.lit(0).alias("block"), (99 - F.col("id")).alias("seq")).alias("row_ordinal"), "id")
    assert [r.id for r in rollups.preview(df, 3).collect()] == [99, 98, 97]
    assert rollups.preview(df, 1000).count() == 100 and rollups.preview(df.limit(0), 5).count() == 0
    nulls = spark.createDataFrame([(2, "a"), (None, "b"), (1, "c"), (None, "d")], "k int, v string")
    assert [r.k for r in rollups.preview(nulls, 3, ["k", "v"]).collect()] == [None, None, 1]


# --- duplicates ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def copies(spark):
    """A third of all rows are copies of one row; nulls take part in equality."""
    data = [("hot", None, dt.date(2026, 1, 1), "f1")] * 400
    data += [(f"k{i}", float(i), dt.date(2026, 1, 2) if i % 2 else None, f"f{i % 3}") for i in range(700)]
    data += [(f"k{i}", float(i), dt.date(2026, 1, 2) if i % 2 else None, f"f{i % 3}") for i in range(0, 100, 5)]
    df = spark.createDataFrame(data, "k string, v double, date date, source_file string").repartition(4)
    return data, df.withColumn("row_ordinal", F.struct(F.lit(0).alias("block"), F.monotonically_increasing_id().alias("seq"))).cache()


@pytest.mark.parametrize("limit", [0, 5, 500_000])
def test_duplicate_counts(copies, limit):
    data, df = copies
    found = Counter(data)
    assert dedupe.duplicate_row_count(df, limit=limit).first()[0] == sum(n - 1 for n in found.values())
    groups = dedupe.duplicate_groups(df, limit=limit)
    sources, days = Counter(), Counter()
    for row, n in found.items():
        if n > 1:
            sources[row[3]] += n
            days[str(row[2]) if row[2] else "unknown"] += n
    assert {r.label: r.duplicate_rows for r in dedupe.duplicates_by_source(groups).collect()} == sources
    assert [(r.label, r.duplicate_rows) for r in dedupe.duplicates_by_date(groups, CONSUMPTION).collect()] == sorted(days.items())


@pytest.mark.parametrize("limit", [0, 500_000])
@pytest.mark.parametrize("mode", ["drop_first", "drop_last"])
def test_dropping_copies(copies, limit, mode):
    data, df = copies
    kept = dedupe.apply_duplicate_policy(df, mode, limit=limit)
    assert Counter(tuple(r) for r in kept.df.select("k", "v", "date", "source_file").collect()) == Counter(set(data))
    assert tuple(kept.counts.first()) == (len(data) - len(set(data)), 0)
    seq = df.where("k = 'hot'").agg(F.min("row_ordinal.seq"), F.max("row_ordinal.seq")).first()
    assert kept.df.where("k = 'hot'").first().row_ordinal.seq == seq[0 if mode == "drop_first" else 1]


@pytest.mark.parametrize("mode, after, messages", [("keep_all", 1, 0), ("drop_first", 0, 0), ("drop_last", 0, 0), ("error", 1, 1), ("??", 1, 0)])
def test_policy_counts(spark, mode, after, messages):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    kept = dedupe.apply_duplicate_policy(df, mode)
    assert tuple(kept.counts.first()) == (1, after)
    assert kept.df.count() == (2 if mode.startswith("drop") else 3)
    assert len(kept.messages(1)) == messages


def test_no_duplicates(spark):
    df = spark.range(50).withColumn("source_file", F.lit("f"))
    groups = dedupe.duplicate_groups(df)
    assert dedupe.extra_copies(groups).first()[0] == 0
    assert dedupe.duplicates_by_source(groups).count() == 0
    assert dedupe.duplicates_by_date(groups, VEND).columns == ["label", "duplicate_rows"]


def test_rows_that_differ_only_in_where_a_null_stands(spark):
    df = spark.createDataFrame([(None, "1"), ("1", None), (None, "1")], "a string, b string")
    assert dedupe.duplicate_row_count(df).first()[0] == 1


def test_keep_one_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), (None, 2, "z"), (None, 5, "w")], "k string, t int, v string")
    assert result(dedupe.keep_one(df, ["k"], "first", ["t"])) == [("a", 1, "x"), (None, 2, "z")]
    assert result(dedupe.keep_one(df, ["k"], "last", ["t"])) == [("a", 3, "y"), (None, 5, "w")]


# --- quality ------------------------------------------------------------------------------


def test_missing_summary_order_and_rounding(spark):
    df = spark.createDataFrame([(None, "", None), ("1", None, None), ("2", "x", None)], "b string, a string, c string")
    got = [tuple(r) for r in quality.missing_summary(df).collect()]
    assert got == [("c", 3, 100.0), ("a", 1, 33.33), ("b", 1, 33.33)]
    assert quality.missing_summary(df.limit(0)).count() == 0


def test_numeric_flags_coerce_text(spark):
    df = spark.createDataFrame([("1", 0), ("-2", -1), ("x", 0), (None, 3)], "t string, i int")
    got = [tuple(r) for r in quality.numeric_flags(df, ["t", "i", "absent"]).collect()]
    assert got == [("t", 2, 1, 0), ("i", 0, 1, 2)]
    assert quality.numeric_flags(df, ["absent"]).count() == 0


def test_outliers(spark):
    df = spark.createDataFrame([(float(v), 1.0 if v < 4 else None, 5.0, str(v)) for v in (1, 2, 3, 1000, 4, 5)], "a double, few double, same double, t string")
    got = {r.column: tuple(r)[1:] for r in quality.iqr_outliers(df, ["a", "few", "same", "t", "absent"]).collect()}
    assert got["a"] == (1, -1.5, 8.5, 1.5) and got["t"] == got["a"]
    assert got["few"] == (0, None, None, None)
    assert got["same"] == (0, 5.0, 5.0, 1.5)
    assert quality.iqr_outliers(df, ["absent"]).count() == 0


def test_parse_summaries(vend, rows, readings):
    assert {r.status: r["count"] for r in quality.parse_summary(vend, VEND).collect()} == Counter(r[5] for r in rows)
    assert [tuple(r) for r in quality.parse_summary(readings, CONSUMPTION).collect()] == [("parsed_datetime", 4), ("failed_or_missing", 2)]


def test_unknown_status(spark):
    df = spark.createDataFrame([(None,), ("missing",), (None,)], "issuedate_parse_status string")
    assert [tuple(r) for r in quality.parse_summary(df, VEND).collect()] == [("unknown", 2), ("missing", 1)]


def test_temporal_cutoffs_are_strict(spark):
    def check(days, **options):
        df = spark.createDataFrame([(d,) for d in days], "issuedate_parsed timestamp_ntz")
        return quality.temporal_sanity(df, VEND, NOW, **options).first()

    got = check([NOW, NOW + DAY, NOW - 5 * DAY, None])
    assert (got.parsed_rows, got.total_rows, got.parse_coverage_pct, got.future_row_count) == (3, 4, 75.0, 1)
    assert (got.latest_date, got.oldest_date, got.is_stale, got.stale_days) == (NOW + DAY, NOW - 5 * DAY, False, 90)
    assert check([NOW + DAY], max_future_days=1).future_row_count == 0
    assert not check([NOW - 90 * DAY]).is_stale
    assert check([NOW - 90 * DAY - dt.timedelta(seconds=1)]).is_stale
    empty = check([None])
    assert (empty.is_stale, empty.latest_date, empty.parse_coverage_pct) == (False, None, 0.0)


def test_temporal_without_the_column(spark):
    got = quality.temporal_sanity(spark.range(3), VEND, NOW).first()
    assert (got.parsed_rows, got.total_rows, got.latest_date, got.is_stale) == (0, 3, None, False)


@pytest.mark.parametrize("list_limit", [0, 2000])
def test_allow_lists(spark, monkeypatch, list_limit):
    monkeypatch.setattr(quality, "LIST_LIMIT", list_limit)
    values = ["A", "z9", "z1", None, "z9", "z5", "z4", "z3", "z2", "A"]
    df = spark.createDataFrame(list(enumerate(values)), "n int, c string").repartition(3)
    got = [tuple(r) for r in quality.categorical_check(df, {"c": ["A", "A"], "absent": ["x"], "n": []}, ["n"]).collect()]
    assert got == [("c", 1, 7, "z9 | z1 | z5 | z4 | z3")]
    assert quality.categorical_check(df, {}, ["n"]).columns == ["column", "allowed_count", "invalid_count", "sample_invalid_values"]
    assert [tuple(r) for r in quality.categorical_check(df, {"c": sorted({v for v in values if v})}, ["n"]).collect()] == [("c", 7, 0, "")]


def test_warnings(spark):
    def texts(statuses, spec=VEND):
        df = spark.createDataFrame([(s,) for s in statuses], "issuedate_parse_status string")
        return [r.warning for r in quality.quality_warnings(df, spec).orderBy("position").collect()]

    fixed = [*VEND.known_limitations, VEND_DATE_LIMITATION]
    assert texts(["parsed_datetime"] * 8 + ["missing"] * 2)[4:] == ["2 vend records have missing issuedate values."]
    got = texts(["time_only"] * 1234)
    assert got[:4] == fixed
    assert got[4] == "1,234 vend records contain time-only issuedate values and cannot support full date analysis."
    assert got[5] == "No vend rows currently contain a parsed full datetime."
    assert got[6].startswith("Vend full datetime coverage is 0.0% which is below the warning threshold of 70.0%.")
    assert texts([]) == fixed
    twice = replace(VEND, known_limitations=("same", "same"))
    assert texts([], twice)[0:2] == ["same", VEND_DATE_LIMITATION]
    df = spark.createDataFrame([(True,)], "midnightdate_parse_success boolean")
    assert [r.warning for r in quality.quality_warnings(df, CONSUMPTION).collect()] == list(CONSUMPTION.known_limitations)


def test_schema_report(spark):
    got = quality.schema_report(spark, ["a", "b", "row_ordinal"], replace(VEND, required_columns=("a", "c"))).first()
    assert (got.is_valid, got.missing_columns, got.extra_columns, got.status) == (False, "c", "b", "Missing required columns: c")


def test_suite_warnings_and_tables(vend, rows):
    spec = replace(VEND, allow_lists={"categorycode": ("A",)}, thresholds=Thresholds(outlier_iqr_multiplier=2.0, stale_days=1))
    report = run_checks(vend, spec, dt.datetime(2026, 2, 1), order_by=["n"])
    texts = [r.warning for r in report["warnings"].orderBy("position").collect()]
    future = sum(r[7] is not None and r[7] > dt.datetime(2026, 2, 1) for r in rows)
    invalid = sum(r[2] not in (None, "A") for r in rows)
    assert f"{future:,} rows have parsed dates beyond the allowed future window (0 days)." in texts
    assert f"Categorical validation found {invalid:,} values outside configured allow-lists." in texts
    assert not any("stale" in t for t in texts)
    later = run_checks(vend, spec, dt.datetime(2027, 1, 1), order_by=["n"], only=["warnings"])
    assert "Latest parsed date appears stale based on a 1-day threshold." in [r.warning for r in later["warnings"].collect()]
    assert list(later.checks) == ["warnings"]
    assert report["outlier_summary"].first().iqr_multiplier == 2.0
    assert all(t.columns[0] == "dataset" for t in report.checks.values())


# --- profile ------------------------------------------------------------------------------


@pytest.mark.parametrize("approximate", [False, True])
def test_column_profile(spark, approximate):
    data = [(i, None if i % 4 == 0 else f"v{i % 3}", float(-i), i % 2 == 0) for i in range(8)]
    df = spark.createDataFrame(data, "n int, s string, d double, b boolean").repartition(3)
    got = {r.column: r for r in profile.column_profile(df, order_by=["n"], approximate=approximate).collect()}
    s = got["s"]
    assert (s.dtype, s.non_null_count, s.null_count, s.missing_pct, s.unique_count) == ("string", 6, 2, 25.0, 3)
    assert (s.sample_values, s.min_value, s.max_value) == ("v1 | v2 | v0", None, None)
    assert (got["d"].min_value, got["d"].max_value, got["d"].sample_values) == ("-7.0", "0.0", "0.0 | -1.0 | -2.0")
    assert (got["b"].unique_count, got["b"].min_value, got["b"].max_value) == (2, "false", "true")


def test_overview_and_metadata(spark, folder):
    df = spark.range(1000).withColumn("t", F.lit("x"))
    df.write.parquet(f"{folder}/t")
    got = profile.table_overview(df, f"{folder}/t").first()
    assert (got.rows, got.columns) == (1000, 2) and got.stored_mb >= 0.0
    assert tuple(profile.table_overview(df.limit(0)).first()) == (0, 0, 0.0)
    assert profile.stored_bytes(spark, f"{folder}/t") > 0
    assert [tuple(r) for r in profile.candidate_keys(spark, [CONSUMPTION, VEND]).collect()] == [
        ("mtrid", "consumption"), ("servicepointno", "vend"), ("meterno", "vend"),
    ]
    assert tuple(profile.field_snapshot(spark, [(VEND, df)], 1).first()) == ("vend", "id")


def test_key_check_counts_nulls_and_copies(spark):
    df = spark.createDataFrame([("S1", "M1"), ("S1", "M2"), ("S2", None), (None, "M3"), ("S3", "M4"), ("S3", "M4")], "servicepointno string, meterno string")
    got = {r.field: r for r in profile.key_check(df, VEND).collect()}
    one, both = got["servicepointno"], got["servicepointno + meterno"]
    assert (one.rows, one.null_rows, one.distinct_keys, one.most_rows, one.unique) == (6, 1, 3, 2, False)
    assert (both.null_rows, both.distinct_keys, both.most_rows, both.distinct_pct) == (2, 3, 2, 75.0)
    unique = profile.key_check(df.limit(0).unionByName(spark.createDataFrame([("S1", "M1"), ("S2", "M1")], df.schema)), VEND, pairs=False)
    assert {r.field: r.unique for r in unique.collect()} == {"servicepointno": True, "meterno": False}
    assert all(not r.unique and r.rows == 0 for r in profile.key_check(df.limit(0), VEND).collect())


def test_column_bytes_come_from_footers(spark, folder):
    df = spark.range(0, 5000, 1, 3).selectExpr("id", "'same' as label", "if(id % 2 = 0, null, uuid()) as noise", "named_struct('a', id) as s")
    df.write.parquet(f"{folder}/t")
    got = {r.column: r for r in profile.column_bytes(spark, f"{folder}/t").collect()}
    assert set(got) == {"id", "label", "noise", "s.a"}
    assert all(r["values"] == 5000 and r.files == 3 and r.stored_bytes > 0 for r in got.values())
    assert got["noise"].stored_bytes > got["label"].stored_bytes
    assert sum(r.stored_bytes for r in got.values()) < profile.stored_bytes(spark, f"{folder}/t")


def test_many_copies_are_told_apart_without_grouping_whole_rows(spark, plan_of):
    nan = float("nan")
    values = [("a", None, 1.0), (None, "a", 1.0), ("a", None, 1.0), ("a", "b", 0.0), ("a", "b", -0.0), ("a", "b", nan), ("a", "b", nan), (None, None, None), (None, None, None), ("ab", "", 1.0), ("a", "b", 1.0)]
    rows = [(*v, "f" if i % 2 else "g", i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "x string, y string, z double, source_file string, row_ordinal int")
    for limit in (0, 100):
        groups = dedupe.duplicate_groups(df, ["source_file"], limit)
        assert sorted(r.copies for r in groups.collect()) == [2, 2, 2, 2]
        assert dedupe.duplicate_row_count(df, ["source_file"], limit).first()[0] == 4
        for keep, gone in (("first", {2, 4, 6, 8}), ("last", {0, 3, 5, 7})):
            kept = dedupe.drop_copies(df.withColumn("source_file", F.lit("f")), keep, ["source_file"], limit)
            assert {r.row_ordinal for r in kept.collect()} == set(range(11)) - gone
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan_of(dedupe.extra_copies(dedupe.duplicate_groups(df, (), 0))))
    assert any("_key1" in k for k in keys) and not any(re.search(r"\b[xyz]#", k) for k in keys)
