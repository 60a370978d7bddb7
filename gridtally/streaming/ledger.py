"""A ledger of the rows a stream has taken, so that copies are found across batches without reading old rows.

Sixteen bytes are kept for every distinct row, with the batch that brought it, in folders by the first
bits of the hash. A batch is compared with what batches of smaller numbers left and nothing else, so a
batch that is replayed after a failure finds what it found the first time. The list of the ledger's
folders is published as a version after the batch's rows are written (see `sinks.versioned`); many
small folders are merged into one as they add up.

Two rows are copies if all compared columns are equal, nulls included; a column that a batch lacks
counts as null. Rows are told apart by 128 bits of hash: at 10**12 rows the odds of one mistake are
about 10**-15.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.operators.dedupe import KEYS, with_keys  # noqa: F401  (with_keys: what the ledger's callers hash rows by)
from gridtally.sinks import versioned
from gridtally.sinks.versioned import Part, Version

SCHEMA = T.StructType([*[T.StructField(c, T.LongType()) for c in (*KEYS, "batch")], T.StructField("bucket", T.IntegerType())])
BUCKET_BITS = 6
#: Keys of a batch that are sent to every executor: eight megabytes.
BROADCAST_KEYS = 500_000
#: Folders beyond which the ledger is merged into one.
MOST_PARTS = 16


def _bucketed(keys: DataFrame) -> DataFrame:
    return keys.withColumn("bucket", F.shiftrightunsigned(KEYS[0], 64 - BUCKET_BITS).cast("int"))


def _older(version: Version, batch: int) -> list[Part]:
    return [p for p in version.parts if p.high < batch]


def _read(spark: SparkSession, parts: Sequence[Part], batch: int) -> DataFrame:
    rows = versioned.read(spark, Version(0, tuple(parts)), SCHEMA)
    return rows.where(F.col("batch") < batch)


def _write(keys: DataFrame, uri: str, low: int, high: int) -> Part:
    folder = versioned.new_folder(uri)
    # Sorted, so that a reader skips the row groups of other hashes.
    _bucketed(keys).hint("rebalance", "bucket").sortWithinPartitions("bucket", KEYS[0]).write.parquet(folder)
    return Part(folder, None, low, high)


def seen_before(spark: SparkSession, uri: str, keyed: DataFrame, batch: int, limit: int = BROADCAST_KEYS) -> DataFrame:
    """(_key1, _key2, owner) of the batch's rows that earlier batches had; owner is the last of these batches.

    A batch of few rows is sent to the ledger, which then is not shuffled; a large one meets it by key.
    Its rows are counted, not its distinct keys, which would have to be shuffled for it.
    """
    older = _older(versioned.current(spark, uri), batch)
    ledger = _read(spark, older, batch)
    mine = _bucketed(keyed.select(*KEYS).distinct())
    mine = F.broadcast(mine) if older and keyed.limit(limit + 1).count() <= limit else mine
    return ledger.join(mine, [*KEYS, "bucket"], "left_semi").groupBy(*KEYS).agg(F.max("batch").alias("owner"))


def enter(spark: SparkSession, uri: str, keyed: DataFrame, batch: int, most_parts: int = MOST_PARTS) -> None:
    """Publish the batch's keys. What this batch left at an earlier attempt is replaced."""
    before = versioned.current(spark, uri)
    older = _older(before, batch)
    if len(older) > most_parts:
        # Earlier batches are committed: only now may their folders be merged. The last owner of a key stays.
        merged = _read(spark, older, batch).groupBy(*KEYS).agg(F.max("batch").alias("batch"))
        older = [_write(merged, uri, min(p.low for p in older), max(p.high for p in older))]
    mine = _write(keyed.select(*KEYS).distinct().withColumn("batch", F.lit(batch).cast("bigint")), uri, batch, batch)
    versioned.publish(spark, uri, before, [*older, mine])
