"""Exact linear percentiles at any size, without holding a group in one task.

Spark's own percentile keeps one counter per distinct value of a group in memory. It is used
here only for groups whose row count was checked against `limit`. For a larger group the wanted
order statistics are found by narrowing an open interval (lo, hi) around each of them:

1. percentile_approx (a small mergeable sketch) over the rows inside the interval proposes two
   data values close to the wanted rank;
2. one aggregate counts the rows below, at and between the two values, exactly;
3. the interval shrinks to the piece that holds the rank, about 1/200 of its rows.

The proposal may be off; the counts decide, so the result does not depend on the sketch. Only
counts return to the driver, one small row per wanted rank. Each pass is a map-side aggregate over
one pruned column, and the interval reaches the scan as a literal predicate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of one group that a single task may hold (eight megabytes of doubles).
GROUP_LIMIT = 1 << 20
_GRID = 1000
_MARGIN = 2
_ACCURACY = 10_000


@dataclass(frozen=True)
class _Rank:
    """A wanted order statistic (counted from 0) of one group and the open interval it lies in."""

    group: object
    rank: int
    below: int
    inside: int
    lo: float | None = None
    hi: float | None = None
    value: float | None = None


def _within(rank: _Rank, value: Column) -> Column:
    bounds = F.lit(True)
    if rank.lo is not None:
        bounds = bounds & (value > F.lit(rank.lo))
    if rank.hi is not None:
        bounds = bounds & (value < F.lit(rank.hi))
    return bounds


def _of(rank: _Rank, group: Column, value: Column) -> Column:
    return group.eqNullSafe(F.lit(rank.group)) & _within(rank, value)


def _any(predicates: list[Column]) -> Column:
    result = predicates[0]
    for predicate in predicates[1:]:
        result = result | predicate
    return result


def _propose(rows: DataFrame, ranks: list[_Rank]) -> list[tuple[float, float]]:
    """Two values around each rank, read from a sketch of the rows in its interval."""
    group, value = F.col("_group"), F.col("_value")
    intervals = list(dict.fromkeys((r.group, r.lo, r.hi) for r in ranks))
    sample = {(r.group, r.lo, r.hi): r for r in ranks}
    grid = F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)])
    cells = [
        F.percentile_approx(F.when(_of(sample[key], group, value), value), grid, _ACCURACY).alias(f"g{i}")
        for i, key in enumerate(intervals)
    ]
    grids = rows.where(_any([_of(r, group, value) for r in sample.values()])).agg(*cells).first()
    proposals = []
    for r in ranks:
        points = grids[intervals.index((r.group, r.lo, r.hi))]
        place = int((r.rank - r.below) / r.inside * _GRID)
        proposals.append((points[max(0, place - _MARGIN)], points[min(_GRID, place + 1 + _MARGIN)]))
    return proposals


def _narrow(rows: DataFrame, ranks: list[_Rank]) -> list[_Rank]:
    group, value = F.col("_group"), F.col("_value")
    proposals = _propose(rows, ranks)
    cells = []
    for i, (r, (lo, hi)) in enumerate(zip(ranks, proposals)):
        mine = _of(r, group, value)
        cells += [
            F.count_if(mine & (value < F.lit(lo))).alias(f"under{i}"),
            F.count_if(mine & (value == F.lit(lo))).alias(f"low{i}"),
            F.count_if(mine & (value > F.lit(lo)) & (value < F.lit(hi))).alias(f"between{i}"),
            F.count_if(mine & (value == F.lit(hi))).alias(f"high{i}"),
        ]
    counts = rows.where(_any([_of(r, group, value) for r in ranks])).agg(*cells).first()
    return [_cut(r, lo, hi, counts, i) for i, (r, (lo, hi)) in enumerate(zip(ranks, proposals))]


def _cut(r: _Rank, lo: float, hi: float, counts: Row, i: int) -> _Rank:
    """The piece of the interval that holds the rank, or the value itself if it is an end."""
    place = r.rank - r.below
    under, low = counts[f"under{i}"], counts[f"low{i}"]
    if place < under:
        return replace(r, hi=lo, inside=under)
    if place < under + low:
        return replace(r, value=lo)
    if lo == hi:
        return replace(r, lo=lo, below=r.below + under + low, inside=r.inside - under - low)
    between, high = counts[f"between{i}"], counts[f"high{i}"]
    if place < under + low + between:
        return replace(r, lo=lo, hi=hi, below=r.below + under + low, inside=between)
    if place < under + low + between + high:
        return replace(r, value=hi)
    taken = under + low + between + high
    return replace(r, lo=hi, below=r.below + taken, inside=r.inside - taken)


def _finish(rows: DataFrame, ranks: list[_Rank]) -> list[_Rank]:
    """Read the ranks whose interval now holds at most `limit` rows."""
    group, value = F.col("_group"), F.col("_value")
    cells = [
        F.get(F.sort_array(F.collect_list(F.when(_of(r, group, value), value))), F.lit(r.rank - r.below)).alias(f"v{i}")
        for i, r in enumerate(ranks)
    ]
    found = rows.where(_any([_of(r, group, value) for r in ranks])).agg(*cells).first()
    return [replace(r, value=found[i]) for i, r in enumerate(ranks)]


def _resolve(rows: DataFrame, ranks: list[_Rank], limit: int) -> dict[tuple[object, int], float]:
    done: dict[tuple[object, int], float] = {}
    # A few ranks per job keep the generated expressions small however many groups are hot.
    for start in range(0, len(ranks), 8):
        open_ranks = ranks[start : start + 8]
        while open_ranks:
            small = [r for r in open_ranks if r.inside <= limit]
            large = [r for r in open_ranks if r.inside > limit]
            solved = (_finish(rows, small) if small else []) + (_narrow(rows, large) if large else [])
            done.update({(r.group, r.rank): r.value for r in solved if r.value is not None})
            open_ranks = [r for r in solved if r.value is None]
    return done


def _interpolate(count: int, share: float, found: dict[tuple[object, int], float], group: object) -> float:
    """Same formula, in the same order, as Spark's percentile."""
    place = (count - 1) * share
    low, high = _floor(place), _ceil(place)
    below, above = found[(group, low)], found[(group, high)]
    return below if below == above else (high - place) * below + (place - low) * above


def group_percentiles(
    df: DataFrame, value: str, shares: Sequence[float], group: str | None = None, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Exact linear percentiles of each group: (group, n, percentiles array). Nulls are skipped.

    Without a group column there is one row whose group is null.
    """
    spark = df.sparkSession
    key = F.col(group) if group else F.lit(None).cast("string")
    rows = df.select(key.alias("_group"), F.col(value).cast("double").alias("_value")).where(
        F.col("_value").isNotNull() & ~F.isnan("_value")
    )
    kind = rows.schema["_group"].dataType
    counts = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("n"))
    # At most (rows / limit) groups can be above the limit, so this list stays short.
    hot = [(r["_group"], r["n"]) for r in counts.where(F.col("n") > limit).collect()]
    named = "group" if group is None else group
    if not hot:
        return _small_groups(rows, shares, named)
    ranks = []
    for name, n in hot:
        wanted = {f((n - 1) * share) for share in shares for f in (_floor, _ceil)}
        ranks += [_Rank(name, rank, 0, n) for rank in sorted(wanted)]
    found = _resolve(rows, ranks, limit)
    schema = T.StructType(
        [
            T.StructField(named, kind),
            T.StructField("n", T.LongType()),
            T.StructField("percentiles", T.ArrayType(T.DoubleType())),
        ]
    )
    solved = spark.createDataFrame(
        [(name, n, [_interpolate(n, s, found, name) for s in shares]) for name, n in hot], schema
    )
    if group is None:
        return solved
    cold = rows.where(~_any([F.col("_group").eqNullSafe(F.lit(name)) for name, _ in hot]))
    return _small_groups(cold, shares, named).unionByName(solved)


def _floor(place: float) -> int:
    return int(place // 1)


def _ceil(place: float) -> int:
    return int(-(-place // 1))


def _small_groups(rows: DataFrame, shares: Sequence[float], named: str) -> DataFrame:
    array = F.array(*[F.lit(float(s)) for s in shares])
    return rows.groupBy(F.col("_group").alias(named)).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("_value", array).alias("percentiles")
    )


def column_percentiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float], limit: int = GROUP_LIMIT, approximate: bool = False
) -> DataFrame:
    """Percentiles of several columns: (column, n, percentiles), one row per column.

    Columns are checked in one aggregate. Those within the limit share one exact aggregate;
    the others are narrowed one column at a time, each over its own pruned scan.
    """
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    array = F.array(*[F.lit(float(s)) for s in shares])
    if approximate:
        cells = {c: F.percentile_approx(v, array, _ACCURACY) for c, v in values.items()}
        return _by_column(df, {c: F.struct(F.count(values[c]).alias("n"), cell.alias("percentiles")) for c, cell in cells.items()})
    counts = df.agg(*[F.count(v).alias(c) for c, v in values.items()]).first()
    small = [c for c in columns if counts[c] <= limit]
    parts = []
    if small:
        parts.append(
            _by_column(
                df,
                {
                    c: F.struct(F.count(values[c]).alias("n"), F.percentile(values[c], array).alias("percentiles"))
                    for c in small
                },
            )
        )
    for c in columns:
        if c not in small:
            solved = group_percentiles(df, c, shares, limit=limit)
            parts.append(solved.select(F.lit(c).alias("column"), "n", "percentiles"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _by_column(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    one_row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), cell.alias("stats")) for c, cell in cells.items()]).alias("rows"))
    return one_row.select(F.inline("rows")).select("column", "stats.n", "stats.percentiles")
