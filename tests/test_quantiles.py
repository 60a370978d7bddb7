from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridtally.functions.quantiles import column_percentiles, group_percentiles

SHARES = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)


def linear(values: list[float], share: float) -> float:
    values = sorted(values)
    place = share * (len(values) - 1)
    low, high = int(place // 1), int(-(-place // 1))
    return values[low] if low == high else (high - place) * values[low] + (place - low) * values[high]


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, v double").repartition(4)


def samples(kind: str, n: int = 3000) -> list[float]:
    rng = random.Random(7)
    if kind == "uniform":
        return [round(rng.uniform(-100, 100), 2) for _ in range(n)]
    if kind == "heavy_tail":
        return [10 ** rng.uniform(-12, 12) for _ in range(n)]
    if kind == "one_value_holds_a_third":
        return [5.0 if rng.random() < 0.34 else round(rng.uniform(0, 10), 1) for _ in range(n)]
    return [3.0] * n


@pytest.mark.parametrize("kind", ["uniform", "heavy_tail", "one_value_holds_a_third", "constant"])
def test_narrowing_equals_sorting(spark, kind):
    values = samples(kind)
    df = table(spark, [("a", v) for v in values] + [("a", None), ("a", float("nan"))])
    row = group_percentiles(df, "v", SHARES, limit=40).first()
    assert row.n == len(values)
    assert row.percentiles == pytest.approx([linear(values, s) for s in SHARES], rel=1e-12)


def test_narrowed_and_builtin_agree_bit_for_bit(spark):
    df = table(spark, [("a", v) for v in samples("uniform", 1001)])
    narrowed = group_percentiles(df, "v", SHARES, limit=10).first().percentiles
    builtin = group_percentiles(df, "v", SHARES).first().percentiles
    assert narrowed == builtin


def test_hot_group_beside_small_ones(spark):
    rng = random.Random(1)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(2000)]
    rows += [(f"g{i % 50}", float(i)) for i in range(1000)] + [(None, float(i)) for i in range(300)]
    got = {r.g: r.percentiles for r in group_percentiles(table(spark, rows), "v", (0.25, 0.75), "g", limit=100).collect()}
    for group in {g for g, _ in rows}:
        values = [v for g, v in rows if g == group]
        assert got[group] == pytest.approx([linear(values, 0.25), linear(values, 0.75)], rel=1e-12)


def test_columns_within_and_above_the_limit(spark):
    df = spark.range(0, 500, 1, 4).select(
        F.col("id").cast("double").alias("big"), F.when(F.col("id") < 20, F.col("id")).cast("double").alias("small"),
        F.lit(None).cast("double").alias("none"),
    )
    got = {r.column: (r.n, r.percentiles) for r in column_percentiles(df, ["big", "small", "none"], (0.25, 0.75), limit=100).collect()}
    assert got["big"] == (500, [124.75, 374.25])
    assert got["small"] == (20, [4.75, 14.25])
    assert got["none"] == (0, None)


def test_approximate_mode(spark):
    df = spark.range(0, 1000, 1, 4).select(F.col("id").cast("double").alias("v"))
    assert column_percentiles(df, ["v"], (0.5,), approximate=True).first().percentiles == pytest.approx([499.5], abs=2)
