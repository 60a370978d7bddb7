"""Whole-row duplicates: counting, diagnosing and dropping.

Grouping on every column would shuffle the whole table. Instead an eight-byte hash of each row is
counted first; only rows whose hash occurs more than once can be copies. When those hashes are few
(the count is checked) the suspects are picked by a broadcast semi-join, so the table itself is
never shuffled, and the suspects alone are grouped on the full row, which settles hash collisions.
When they are many, all rows are grouped by 128 bits of hash (see `with_keys`) instead of their own
columns: a task's table of groups has two numbers a row, however wide the rows are, and the sorting
aggregate of a drop compares two numbers. Copies of a hot row fold before the shuffle either way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.operators.transforms import data_columns
from gridtally.spec import ROW_ORDINAL, SOURCE_FILE, UNKNOWN, DatasetSpec, resolve_duplicate_policy

# Most hashes that are sent to every executor: four megabytes.
SUSPECT_LIMIT = 500_000
COPIES = "copies"
_HASH = "_row_hash"


def _keys(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [c for c in data_columns(df) if c not in exclude]


def _row_hash(keys: Sequence[str]) -> Column:
    # Rows that differ only in where a null stands share a hash; the full-row grouping parts them.
    return F.xxhash64(*[F.col(k) for k in keys])


#: The two hashes that tell rows apart.
KEYS = ["_key1", "_key2"]


def with_keys(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """df with the two hashes of each row. Cells are hashed with their column's name and combined in any
    order, so neither the order of columns nor columns full of nulls matter. At 10**12 rows the odds of one
    mistake are about 10**-15."""

    def cell(name: str, kind: T.DataType, seed: int) -> Column:
        value = F.col(f"`{name}`")
        # Both zeros are one value.
        value = value + F.lit(0.0) if isinstance(kind, (T.DoubleType, T.FloatType)) else value
        return F.when(value.isNotNull(), F.xxhash64(F.lit(seed), F.lit(name), value)).otherwise(F.lit(0).cast("bigint"))

    names = _keys(df, exclude)
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({
        key: reduce(lambda a, b: a.bitwiseXOR(b), [cell(c, kinds[c], seed) for c in names]) for seed, key in enumerate(KEYS)})


def _suspects(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Hashes that occur more than once as a local table, or None when there are too many."""
    repeated = df.select(_row_hash(keys).alias(_HASH)).groupBy(_HASH).agg(F.count(F.lit(1)).alias("n"))
    hashes = repeated.where(F.col("n") > 1).select(_HASH).limit(limit + 1).toArrow()
    if hashes.num_rows > limit:
        return None
    schema = T.StructType([T.StructField(_HASH, T.LongType())])
    return df.sparkSession.createDataFrame(hashes, schema)


def _split(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows that may have copies, rows that surely have none or None when not separated)."""
    suspects = _suspects(df, keys, limit)
    if suspects is None:
        return df, None
    hashed = df.withColumn(_HASH, _row_hash(keys))
    small = F.broadcast(suspects)
    return (
        hashed.join(small, _HASH, "left_semi").drop(_HASH),
        hashed.join(small, _HASH, "left_anti").drop(_HASH),
    )


def duplicate_groups(df: DataFrame, exclude: Sequence[str] = (), limit: int = SUSPECT_LIMIT) -> DataFrame:
    """One row per repeated row value, with its number of copies. Nulls compare equal."""
    keys = _keys(df, exclude)
    maybe, unique = _split(df, keys, limit)
    if unique is not None:
        return maybe.groupBy(*keys).agg(F.count(F.lit(1)).alias(COPIES)).where(F.col(COPIES) > 1)
    # Readers that use only some columns, or only the counts, have the others left out of the aggregate.
    groups = with_keys(df, exclude).groupBy(*KEYS).agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in keys], F.count(F.lit(1)).alias(COPIES))
    return groups.where(F.col(COPIES) > 1).drop(*KEYS)


def extra_copies(groups: DataFrame) -> DataFrame:
    """Number of rows beyond the first of each group."""
    return groups.agg(F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0).cast("bigint")).alias("duplicate_rows"))


def duplicate_row_count(df: DataFrame, exclude: Sequence[str] = (), limit: int = SUSPECT_LIMIT) -> DataFrame:
    return extra_copies(duplicate_groups(df, exclude, limit))


def duplicates_by_source(groups: DataFrame) -> DataFrame:
    """Members of duplicate groups per source file, most first."""
    if SOURCE_FILE not in groups.columns:
        return _no_labels(groups)
    counts = groups.groupBy(F.col(SOURCE_FILE).alias("label")).agg(F.sum(COPIES).alias("duplicate_rows"))
    return counts.orderBy(F.desc("duplicate_rows"), F.asc_nulls_last("label"))


def duplicates_by_date(groups: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Members of duplicate groups per date, rows without a date under 'unknown'."""
    if spec.date.date not in groups.columns:
        return _no_labels(groups)
    label = F.coalesce(F.col(spec.date.date).cast("string"), F.lit(UNKNOWN))
    return groups.groupBy(label.alias("label")).agg(F.sum(COPIES).alias("duplicate_rows")).orderBy("label")


def _no_labels(groups: DataFrame) -> DataFrame:
    return groups.sparkSession.createDataFrame([], "label string, duplicate_rows bigint")


def keep_one(df: DataFrame, keys: Sequence[str], keep: str = "first", order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the first or last in row order.

    Written as an aggregate, not a window: copies fold on the map side, so a key that holds a
    third of all rows never meets in one task. A null key is a key like any other.
    """
    order = list(order_by) if order_by else [c for c in (SOURCE_FILE, ROW_ORDINAL) if c in df.columns]
    rest = [c for c in df.columns if c not in keys]
    if not rest or not order:
        return df.dropDuplicates(list(keys))
    pick = F.min_by if keep == "first" else F.max_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    kept = df.groupBy(*keys).agg(row)
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def drop_copies(
    df: DataFrame, keep: str = "first", exclude: Sequence[str] = (), limit: int = SUSPECT_LIMIT
) -> DataFrame:
    """The table without extra copies; rows that have none are passed through unshuffled."""
    keys = _keys(df, exclude)
    maybe, unique = _split(df, keys, limit)
    if unique is None:
        return keep_one(with_keys(df, exclude), KEYS, keep).drop(*KEYS)
    return keep_one(maybe, keys, keep).unionByName(unique)


# Fixed value: text shown when the error policy meets duplicates.
ERROR_POLICY_TEXT = (
    "Duplicate policy is set to error and duplicates were detected. "
    "Rows were preserved; review Data Quality diagnostics."
)


@dataclass(frozen=True)
class Deduplicated:
    """Result of a duplicate policy: the rows, a one-row table of counts, and warnings."""

    df: DataFrame
    counts: DataFrame
    mode: str

    def messages(self, before: int) -> list[str]:
        if self.mode != "error" or before == 0:
            return []
        return [ERROR_POLICY_TEXT]


def apply_duplicate_policy(
    df: DataFrame, mode: object, exclude: Sequence[str] = (), limit: int = SUSPECT_LIMIT
) -> Deduplicated:
    """keep_all, drop_first, drop_last or error. Error keeps the rows and raises a message."""
    policy = resolve_duplicate_policy(mode)
    before = duplicate_row_count(df, exclude, limit).withColumnRenamed("duplicate_rows", "before")
    if policy in ("drop_first", "drop_last"):
        kept = drop_copies(df, policy.removeprefix("drop_"), exclude, limit)
        # One copy of each row is left by construction.
        return Deduplicated(kept, before.withColumn("after", F.lit(0).cast("bigint")), policy)
    return Deduplicated(df, before.withColumn("after", F.col("before")), policy)
