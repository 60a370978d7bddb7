"""Incremental jobs: copies across batches, replaced files, kept-up figures, sketches, versions."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridtally.operators import kpis, rollups, sketches
from gridtally.plans.ingest_job import persist_dataset
from gridtally.plans.tables import PAYMENTS, READINGS
from gridtally.sinks import versioned
from gridtally.sources.discovery import discover
from gridtally.spec import VEND
from gridtally.streaming import ledger, rollup_state
from gridtally.streaming.incremental import ingest_batch, ingest_new_files, read_table
from gridtally.streaming.refresh import live_files, read_current, read_inventory, refresh

HEADER = ",".join(VEND.required_columns) + "\n"
ACROSS = replace(VEND, duplicate_policy="drop_first", dedup_exclude=("source_file",))


def put(folder: str, name: str, text: str) -> None:
    path = Path(folder) / "raw" / name
    path.parent.mkdir(exist_ok=True)
    path.write_text(text)


def line(k: int) -> str:
    return f"S{k},{k},A,{k}.5,2026-01-{1 + k % 28:02d}\n"


def files(spark, folder, *names):
    return [f for f in discover(spark, f"{folder}/raw", [VEND])["vend"] if f.name in names]


def ids(df) -> list[str]:
    return sorted(r.servicepointno for r in df.collect())


# --- copies across batches ---


def waves(folder):
    """Three waves with copies inside a file, across files of a wave, and across waves."""
    return [
        [("vend-1.csv", HEADER + line(1) * 2 + line(2)), ("vend-2.csv", HEADER + line(2) + line(3) + "S9,,,,\n")],
        [("vend-3.csv", HEADER + line(3) + line(4) + line(1)), ("vend-4.csv", "issuedate,servicepointno,extra\n,S9,\n,S9,x\n")],
        [("vend-5.csv", HEADER + line(4) + line(5) * 3 + "S9,,,,\n")],
    ]


@pytest.mark.parametrize("policy", ["drop_first", "drop_last"])
def test_copies_across_batches_equal_the_batch_job(spark, folder, policy):
    spec = replace(ACROSS, duplicate_policy=policy)
    for wave in waves(folder):
        for name, text in wave:
            put(folder, name, text)
        ingest_new_files(spark, spec, f"{folder}/raw", f"{folder}/out", f"{folder}/checkpoint")
    got = read_table(spark, f"{folder}/out")
    whole = persist_dataset(spark, spec, discover(spark, f"{folder}/raw", [spec])["vend"], f"{folder}/whole").table
    columns = [c for c in whole.columns if c not in ("row_ordinal",)]
    assert Counter(got.select(*columns).collect()) == Counter(whole.select(*columns).collect())
    assert ids(got) == ["S1", "S2", "S3", "S4", "S5", "S9", "S9"]


@pytest.mark.parametrize("policy", ["drop_first", "drop_last"])
def test_a_replayed_batch_changes_nothing(spark, folder, policy):
    spec = replace(ACROSS, duplicate_policy=policy)
    for wave in waves(folder):
        for name, text in wave:
            put(folder, name, text)
    batches = [files(spark, folder, *[n for n, _ in wave]) for wave in waves(folder)]
    out = f"{folder}/out"
    for k, batch in enumerate(batches):
        ingest_batch(spark, spec, batch, out, k)
        before = Counter(read_table(spark, out).drop("row_ordinal").collect())
        ingest_batch(spark, spec, batch, out, k)
        assert Counter(read_table(spark, out).drop("row_ordinal").collect()) == before
    # A batch that died after its rows were written, before the ledger was.
    version = versioned.current(spark, f"{out}/ledger")
    versioned.publish(spark, f"{out}/ledger", version, [p for p in version.parts if p.high < 2])
    ingest_batch(spark, spec, batches[2], out, 2)
    assert Counter(read_table(spark, out).drop("row_ordinal").collect()) == before


def test_ledger_tells_rows_apart(spark, folder):
    rows = [(None, "1", 0.0), ("1", None, 0.0), ("1", "1", -0.0), ("1", "1", 0.0), (None, None, None)]
    keyed = ledger.with_keys(spark.createDataFrame(rows, "a string, b string, c double"), ())
    assert keyed.select(*ledger.KEYS).distinct().count() == 4
    # The order of columns and a missing column of nulls make no difference.
    turned = ledger.with_keys(spark.createDataFrame([(0.0, "1")], "c double, a string"), ())
    assert turned.select(*ledger.KEYS).first() == keyed.where("a = '1' and b is null").select(*ledger.KEYS).first()


def test_ledger_against_a_set(spark, folder):
    """Random batches, with merging of folders and both kinds of join, against plain Python."""
    rng, seen, uri = random.Random(4), {}, f"{folder}/ledger"
    for batch in range(7):
        values = [rng.randrange(60) for _ in range(25)]
        keyed = ledger.with_keys(spark.createDataFrame([(v,) for v in values], "v int"), ())
        for limit in (0, 1000):
            known = ledger.seen_before(spark, uri, keyed, batch, limit)
            got = {r.v: r.owner for r in keyed.select("v", *ledger.KEYS).distinct().join(known, ledger.KEYS).collect()}
            assert got == {v: seen[v] for v in values if v in seen}
        ledger.enter(spark, uri, keyed, batch, most_parts=2)
        assert len(versioned.current(spark, uri).parts) <= 4
        seen.update({v: batch for v in values})


# --- replaced files ---


def test_refresh_follows_the_folder(spark, folder):
    raw, out = f"{folder}/raw", f"{folder}/out"
    put(folder, "vend-1.csv", HEADER + line(1) + line(2))
    put(folder, "vend-2.csv", HEADER + line(3))
    put(folder, "vend-empty.csv", "")
    done = refresh(spark, VEND, raw, out)
    assert (done.added, done.replaced, done.removed) == (("vend-1.csv", "vend-2.csv", "vend-empty.csv"), (), ())
    assert refresh(spark, VEND, raw, out).batch is None
    assert ids(read_current(spark, VEND, out)) == ["S1", "S2", "S3"]
    put(folder, "vend-1.csv", HEADER + line(1) + line(7) + line(8))
    put(folder, "vend-3.csv", HEADER + line(4) + "S5,5,A,1,2026-01-10,surplus\n")
    done = refresh(spark, VEND, raw, out)
    assert (done.added, done.replaced) == (("vend-3.csv",), ("vend-1.csv",))
    assert ids(read_current(spark, VEND, out)) == ["S1", "S3", "S7", "S8"]
    status = {r.file_name: (r.read_status, r.rows_read) for r in read_inventory(spark, out).collect()}
    assert status == {"vend-1.csv": ("ok", 3), "vend-2.csv": ("ok", 1), "vend-3.csv": ("error", 0), "vend-empty.csv": ("error", 0)}
    # A failed file that is mended, and one that is gone.
    put(folder, "vend-3.csv", HEADER + line(4) + line(5))
    (Path(raw) / "vend-2.csv").unlink()
    done = refresh(spark, VEND, raw, out)
    assert (done.replaced, done.removed) == (("vend-3.csv",), ("vend-2.csv",))
    assert ids(read_current(spark, VEND, out)) == ["S1", "S4", "S5", "S7", "S8"]


def test_refresh_that_died_is_run_again(spark, folder, monkeypatch):
    raw, out = f"{folder}/raw", f"{folder}/out"
    put(folder, "vend-1.csv", HEADER + line(1))
    refresh(spark, VEND, raw, out)
    put(folder, "vend-1.csv", HEADER + line(2) + line(3))
    real = versioned.publish

    def killed(*args, **kwargs):
        raise RuntimeError("killed")

    monkeypatch.setattr(versioned, "publish", killed)
    with pytest.raises(RuntimeError):
        refresh(spark, VEND, raw, out)
    assert ids(read_current(spark, VEND, out)) == ["S1"]
    monkeypatch.setattr(versioned, "publish", real)
    refresh(spark, VEND, raw, out)
    assert ids(read_current(spark, VEND, out)) == ["S2", "S3"]


def test_copies_across_files_follow_replaced_files(spark, folder):
    raw, out = f"{folder}/raw", f"{folder}/out"
    put(folder, "vend-1.csv", HEADER + line(1) + line(2))
    put(folder, "vend-2.csv", HEADER + line(2) * 2 + line(3))
    refresh(spark, ACROSS, raw, out)
    rows = {r.servicepointno: r.source_file for r in read_current(spark, ACROSS, out).collect()}
    assert rows == {"S1": "vend-1.csv", "S2": "vend-1.csv", "S3": "vend-2.csv"}
    put(folder, "vend-1.csv", HEADER + line(1))
    refresh(spark, ACROSS, raw, out)
    rows = [(r.servicepointno, r.source_file) for r in read_current(spark, ACROSS, out).collect()]
    assert sorted(rows) == [("S1", "vend-1.csv"), ("S2", "vend-2.csv"), ("S3", "vend-2.csv")]


# --- kept-up figures ---


def typed(spark, n=300):
    rng = random.Random(9)
    rows = [(rng.choice(["S1", "S2", "S3", None]), rng.choice(["M1", "M2", None]), rng.choice(["A", "B", None]), rng.choice([None, 1.25, -2.5, 7.0]),
             rng.choice([None, "2026-01-03 08:15:00", "2026-02-01 23:00:00"]), rng.choice([True, False]), f"f{i % 4}", i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "servicepointno string, meterno string, categorycode string, transactionamount double, at string, issuedate_is_time_only boolean, source_file string, wave int")
    at = F.col("at").cast("timestamp_ntz")
    return df.withColumns({"issuedate_parsed": at, "vend_date": at.cast("date"), "analysis_hour": F.hour(at)}).drop("at")


@pytest.mark.parametrize("spec", [PAYMENTS, replace(PAYMENTS, measure_scale=None)])
def test_state_equals_the_recomputation(spark, folder, spec, plan_of):
    df, uri = typed(spark), f"{folder}/state"
    for wave in (0, 1, 2, 2):
        rollup_state.update(spark, spec, uri, wave, df.where(F.col("wave") == wave).drop("wave"), most_parts=1)
    state, df = rollup_state.State(spark, spec, uri), df.drop("wave")
    assert len(versioned.current(spark, uri).parts) <= 3

    def same(a, b):
        assert Counter(tuple(r) for r in a.collect()) == Counter(tuple(r) for r in b.select(*a.columns).collect())

    same(rollups.daily_total(df, spec), state.daily_total())
    same(rollups.daily_total_by_entity(df, spec), state.daily_total_by_entity())
    same(rollups.top_entities(df, spec, 2), state.top_entities(2))
    same(rollups.amount_by_source(df, spec), state.amount_by_source())
    same(rollups.hourly_profile(df, spec), state.hourly_profile())
    same(rollups.category_breakdown(df, spec), state.category_breakdown())
    same(rollups.source_breakdown(df, spec, "meterno"), state.source_breakdown("meterno"))
    same(kpis.payments_kpis(df, spec), state.kpis())
    # Figures are read from the state alone.
    for figures in (state.kpis(), state.daily_total()):
        assert all("/state/parts/" in f for f in figures.inputFiles())
        assert "PushedFilters: [IsNotNull(rollup), EqualTo(rollup" in plan_of(state.rollup("day"))


def test_state_of_readings_equals_the_recomputation(spark, folder):
    rows = [(f"M{i % 3}" if i % 7 else None, float(i % 5), float(i % 4), f"2026-01-{1 + i % 9:02d} 06:00:00" if i % 6 else None, f"f{i % 2}") for i in range(120)]
    df = spark.createDataFrame(rows, "mtrid string, kwh_consumption double, kvah_consumption double, at string, source_file string")
    at = F.col("at").cast("timestamp_ntz")
    df = df.withColumns({"midnightdate_parsed": at, "date": at.cast("date")}).drop("at")
    for wave, some in enumerate((df.where("source_file = 'f0'"), df.where("source_file = 'f1'"), df.limit(0))):
        rollup_state.update(spark, READINGS, f"{folder}/state", wave, some)
    found = kpis.readings_kpis(df, READINGS)
    assert rollup_state.State(spark, READINGS, f"{folder}/state").kpis().select(*found.columns).collect() == found.collect()


def test_state_leaves_out_replaced_files(spark, folder):
    raw, out, uri = f"{folder}/raw", f"{folder}/out", f"{folder}/state"

    def turn():
        done = refresh(spark, VEND, raw, out)
        rows = read_current(spark, VEND, out, with_batch=True).where(F.col("batch_id") == done.batch).drop("batch_id")
        rollup_state.update(spark, VEND, uri, done.batch, rows, live_files(spark, out), most_parts=1)

    for texts in ({"vend-1.csv": line(1) + line(2), "vend-2.csv": line(3)}, {"vend-1.csv": line(1)}, {"vend-3.csv": line(5), "vend-2.csv": line(3) + line(6)}):
        for name, text in texts.items():
            put(folder, name, HEADER + text)
        turn()
    state, table = rollup_state.State(spark, VEND, uri, live_files(spark, out)), read_current(spark, VEND, out)
    assert state.amount_by_source().collect() == rollups.amount_by_source(table, VEND).collect()
    assert state.kpis().first().rows == 4 and ids(table) == ["S1", "S3", "S5", "S6"]


# --- stored sketches ---


def test_sketches_merge_over_files_and_months(spark, folder):
    rows = [(f"f{i % 5}", f"2026-0{1 + i % 3}", f"k{i % 1200}" if i % 10 else None, float((i * 7919) % 6000) if i % 11 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "source_file string, vend_month string, meterno string, transactionamount double")
    made = sketches.build(df, VEND, ["meterno", "transactionamount"])
    made.write.parquet(f"{folder}/sketches")
    stored = spark.read.parquet(f"{folder}/sketches")
    assert stored.count() == 15 * 2
    for r in sketches.checked(df, sketches.estimates(sketches.merged(stored)), ["meterno", "transactionamount"]).collect():
        assert r.distinct_within and r.quartiles_within in (True, None) and r.rows == 6000
    by_month = {(r.month, r.column): r for r in sketches.estimates(sketches.merged(stored, ["month"])).collect()}
    for month in ("2026-01", "2026-02", "2026-03"):
        values = sorted(v for _, m, _, v in rows if m == month and v is not None)
        r = by_month[month, "transactionamount"]
        assert (r.low, r.high) == (values[0], values[-1])
        assert abs(values.index(r.median) / len(values) - 0.5) < 0.01 and r.upper_bound == r.q3 + 1.5 * (r.q3 - r.q1)


def test_sketches_of_empty_columns(spark):
    df = spark.createDataFrame([("f", None, None)], "source_file string, meterno string, transactionamount double")
    for r in sketches.estimates(sketches.merged(sketches.build(df, VEND, ["meterno", "transactionamount"]))).collect():
        assert (r.rows, r.nulls, r.distinct_estimate, r.median) == (1, 1, 0, None)


# --- versions ---


def test_partitions_are_rewritten_alone(spark, folder):
    uri = f"{folder}/t"
    df = spark.createDataFrame([(1, "2026-01"), (2, "2026-02"), (3, None), (4, "a/b=c %")], "v int, m string")
    first = versioned.overwrite_partitions(df, uri, "m")
    versioned.overwrite_partitions(spark.createDataFrame([(5, None, "x")], "v int, m string, extra string"), uri, "m")
    rows = {(r.v, r.m, r.extra) for r in versioned.read_table(spark, uri).collect()}
    assert rows == {(1, "2026-01", None), (2, "2026-02", None), (5, None, "x"), (4, "a/b=c %", None)}
    now = versioned.current(spark, uri)
    assert {p.path for p in first.parts if p.key != "0"} < {p.path for p in now.parts}
    some = versioned.read_table(spark, uri, ["2026-02", None])
    assert {r.v for r in some.collect()} == {2, 5} and len(some.inputFiles()) == 2
    with pytest.raises(ValueError):
        versioned.overwrite_partitions(spark.createDataFrame([("1", "2026-01")], "v string, m string"), uri, "m")


def test_a_killed_write_leaves_the_old_table(spark, folder, monkeypatch):
    uri = f"{folder}/t"
    versioned.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, m string"), uri, "m")
    dying = spark.createDataFrame([(3, "a"), (4, "b")], "v int, m string").withColumn("v", F.when(F.col("v") == 4, F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        versioned.overwrite_partitions(dying, uri, "m")
    assert {r.v for r in versioned.read_table(spark, uri).collect()} == {1, 2}
    # Killed after the rows were written, and while the list was.
    (Path(uri) / "versions" / "version=2" / "_temporary").mkdir(parents=True)
    assert versioned.current(spark, uri).number == 1
    versioned.overwrite_partitions(spark.createDataFrame([(3, "a")], "v int, m string"), uri, "m")
    assert {r.v for r in versioned.read_table(spark, uri).collect()} == {2, 3}


def test_a_batch_is_made_once_for_all_its_rollups(spark, folder):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def meter(number):
        made.add(1)
        return f"M{number % 3}"

    rows = spark.range(90).select(
        meter(F.col("id")).alias("mtrid"), F.col("id").cast("double").alias("kwh_consumption"), F.lit("a.csv").alias("source_file"), F.lit(dt.date(2026, 1, 1)).alias("date"))
    rollup_state.update(spark, READINGS, f"{folder}/state", 0, rows)
    assert made.value == 90
    state = rollup_state.State(spark, READINGS, f"{folder}/state")
    expected = {f"M{k}": float(sum(range(k, 90, 3))) for k in range(3)}
    assert {r.mtrid: r.total_value for r in state.totals("by_mtrid").collect()} == expected
    assert {(r.mtrid, r.source_file): r.total_value for r in state.source_breakdown("mtrid").collect()} == {(m, "a.csv"): v for m, v in expected.items()}


def test_a_large_batch_is_not_shuffled_to_be_counted(spark, folder):
    rows = ledger.with_keys(spark.range(50).selectExpr("id % 10 as a"), ())
    ledger.enter(spark, f"{folder}/book", rows.where("a < 4"), 0)
    for limit in (5, 100):
        assert ledger.seen_before(spark, f"{folder}/book", rows, 1, limit).count() == 4
    assert ledger.seen_before(spark, f"{folder}/other", rows, 0).count() == 0
