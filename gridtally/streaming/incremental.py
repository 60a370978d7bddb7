"""Ingest of files as they arrive.

The stream carries file names, not rows: its checkpoint remembers which files were taken. Each
micro-batch ingests its files like the batch job (own headers, malformed files set aside) and
overwrites the folder of its batch number, so a batch that is replayed after a failure leaves
the same rows once.

Copies within a file are dropped inside its batch. Where the policy ignores the source file, copies
across batches are found through a ledger of row hashes (see `ledger`): drop_first leaves out rows that
an earlier batch brought, drop_last names the earlier row in a list that readers leave out.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridtally.plans.ingest_job import persist_dataset
from gridtally.sources.discovery import RawFile, spelled_path
from gridtally.spec import SOURCE_FILE, DatasetSpec, resolve_duplicate_policy
from gridtally.streaming import ledger

BATCH = "batch_id"
#: Superseded rows that are sent to every reader task.
BROADCAST_ROWS = 500_000


def ingest_batch(spark: SparkSession, spec: DatasetSpec, files: list[RawFile], out_uri: str, batch_id: int) -> None:
    """Ingest the files of one batch. Running it again leaves the same rows."""
    mode = resolve_duplicate_policy(spec.duplicate_policy)
    across = mode in ("drop_first", "drop_last") and SOURCE_FILE in spec.dedup_exclude
    table = f"{out_uri}/table/{BATCH}={batch_id}"
    done = persist_dataset(spark, spec, files, f"{out_uri}/arrived/{BATCH}={batch_id}" if across else table)
    if not done.ok:
        raise RuntimeError(done.messages[-1][2])
    if across:
        book = f"{out_uri}/ledger"
        rows = ledger.with_keys(done.table, spec.dedup_exclude)
        known = ledger.seen_before(spark, book, rows, batch_id)
        if mode == "drop_first":
            rows = rows.join(known, ledger.KEYS, "left_anti")
        else:
            known.write.mode("overwrite").parquet(f"{out_uri}/superseded/{BATCH}={batch_id}")
        rows.write.mode("overwrite").parquet(table)
        ledger.enter(spark, book, spark.read.schema(rows.schema).parquet(table), batch_id)
    done.inventory.write.mode("overwrite").parquet(f"{out_uri}/inventory/{BATCH}={batch_id}")


def start_incremental(
    spark: SparkSession,
    spec: DatasetSpec,
    raw_uri: str,
    out_uri: str,
    checkpoint_uri: str,
    files_per_batch: int = 1000,
    pattern: str | None = None,
) -> StreamingQuery:
    """Take all files that are new since the last run, then stop (trigger availableNow)."""

    def ingest(batch: DataFrame, batch_id: int) -> None:
        found = batch.select("path", "length").collect()
        files = sorted(RawFile(spelled_path(r["path"]), r["length"]) for r in found)
        ingest_batch(batch.sparkSession, spec, files, out_uri, batch_id)

    glob = pattern or spec.file_patterns[0]
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    names = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(raw_uri)
        # Only names and sizes are used, so file contents are never loaded.
        .select("path", "length")
    )
    return (
        names.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint_uri)
        .trigger(availableNow=True)
        .start()
    )


def ingest_new_files(spark: SparkSession, spec: DatasetSpec, raw_uri: str, out_uri: str, checkpoint_uri: str, **options: object) -> None:
    """Run the incremental ingest to its end; failures are raised."""
    start_incremental(spark, spec, raw_uri, out_uri, checkpoint_uri, **options).awaitTermination()


def read_table(spark: SparkSession, out_uri: str) -> DataFrame:
    """All rows ingested so far; batches with different columns are merged by name."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{out_uri}/table")
    if ledger.KEYS[0] not in rows.columns:
        return rows.drop(BATCH)
    try:
        gone = spark.read.schema(f"_key1 bigint, _key2 bigint, owner bigint, {BATCH} bigint").parquet(f"{out_uri}/superseded").drop(BATCH)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows.drop(BATCH, *ledger.KEYS)
    gone = F.broadcast(gone) if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else gone
    return rows.withColumn("owner", F.col(BATCH).cast("bigint")).join(gone, [*ledger.KEYS, "owner"], "left_anti").drop(BATCH, "owner", *ledger.KEYS)


def read_inventory(spark: SparkSession, out_uri: str) -> DataFrame:
    return spark.read.parquet(f"{out_uri}/inventory").drop(BATCH)
