"""Sketches of columns that are stored once per file and month and merged when they are read.

Distinct values are kept in HyperLogLog sketches, the distribution of numbers in KLL sketches. Sketches
of parts merge into the sketch of the whole, so an approximate profile of any choice of files and
months reads a few kilobytes per part and no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.functions.numbers import as_number
from gridtally.spec import SOURCE_FILE, DatasetSpec

#: log2 of the registers of a HyperLogLog sketch, and the size of a KLL sketch.
DISTINCT_SIZE = 12
VALUES_SIZE = 800
#: Relative error of the distinct count, three standard errors; error of a quantile's rank, at 99 percent.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (DISTINCT_SIZE / 2)
RANK_ERROR = 2.446 / VALUES_SIZE**0.9433
_HASHED = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)

SCHEMA = "source_file string, month string, column string, rows bigint, nulls bigint, low double, high double, distinct_values binary, spread binary"


def build(df: DataFrame, spec: DatasetSpec, columns: Sequence[str]) -> DataFrame:
    """One row of sketches per source file, month and column. All columns share one scan."""
    kinds = {f.name: f.dataType for f in df.schema}
    month = spec.date.month
    keys = [(F.col(c) if c in kinds else F.lit(None)).cast("string").alias(n) for c, n in ((SOURCE_FILE, "source_file"), (month, "month"))]
    cells, rows = [F.count(F.lit(1)).alias("n")], []
    for i, name in enumerate(columns):
        value = F.col(f"`{name}`")
        hashed = value if isinstance(kinds[name], _HASHED) else value.cast("string")
        numeric = isinstance(kinds[name], T.NumericType)
        cells += [F.count(value).alias(f"count{i}"), F.hll_sketch_agg(hashed, DISTINCT_SIZE).alias(f"hll{i}")]
        if numeric:
            number = as_number(value, kinds[name])
            cells += [F.kll_sketch_agg_double(number, VALUES_SIZE).alias(f"kll{i}"), F.min(number).alias(f"low{i}"), F.max(number).alias(f"high{i}")]
        rows.append(F.struct(
            F.lit(name).alias("column"), F.col("n").alias("rows"), (F.col("n") - F.col(f"count{i}")).alias("nulls"),
            (F.col(f"low{i}") if numeric else F.lit(None).cast("double")).alias("low"),
            (F.col(f"high{i}") if numeric else F.lit(None).cast("double")).alias("high"),
            F.col(f"hll{i}").alias("distinct_values"), (F.col(f"kll{i}") if numeric else F.lit(None).cast("binary")).alias("spread")))
    return df.groupBy(*keys).agg(*cells).select("source_file", "month", F.inline(F.array(*rows)))


def merged(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of each column (and of each value of `by`), from those of its parts."""
    return stored.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct_values").alias("distinct_values"), F.kll_merge_agg_double("spread", VALUES_SIZE).alias("spread"))


def _quantile(rank: float) -> Column:
    held = F.col("low").isNotNull()
    return F.when(held, F.kll_sketch_get_quantile_double(F.when(held, F.col("spread")), F.lit(rank)))


def estimates(sketches: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Distinct count, quartiles and outlier bounds of merged sketches."""
    rest = [c for c in sketches.columns if c not in ("distinct_values", "spread")]
    found = sketches.select(
        *rest, F.hll_sketch_estimate("distinct_values").alias("distinct_estimate"),
        *[_quantile(q).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    spread = F.lit(float(multiplier)) * (F.col("q3") - F.col("q1"))
    return found.withColumns({"lower_bound": F.col("q1") - spread, "upper_bound": F.col("q3") + spread})


def checked(df: DataFrame, found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Estimates beside exact figures, and whether each lies within its stated error.

    A quantile is judged by its rank: the share of values at or below it, and the share below it, must
    enclose the wanted rank up to the error.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    parts = []
    for name in columns:
        mine = found.where(F.col("column") == name)
        exact = df.where(F.col(f"`{name}`").isNotNull()).select(F.col(f"`{name}`").alias("v"))
        figures = exact.distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
        right: Column = F.lit(None).cast("boolean")
        if isinstance(kinds[name], T.NumericType):
            right = F.lit(True)
            for rank, column in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
                q = mine.select(column).scalar()
                v, n = F.col("v").cast("double"), F.count(F.lit(1))
                ranks = exact.agg((F.count_if(v < q) / n).alias("a"), (F.count_if(v <= q) / n).alias("b"))
                right = right & ranks.select((F.col("a") <= rank + RANK_ERROR) & (F.col("b") >= rank - RANK_ERROR)).scalar()
        parts.append(mine.select(
            "column", "rows", "nulls", figures.alias("distinct_exact"),
            (F.abs(F.col("distinct_estimate") - figures) <= F.greatest(figures * DISTINCT_ERROR, F.lit(1.0))).alias("distinct_within"),
            right.alias("quartiles_within")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
