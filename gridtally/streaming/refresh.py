"""Refresh of a table from a folder whose files may be added, delivered again with new content, or removed.

A list of file versions (path, length, modification time) is kept with the batch that ingested each.
A refresh compares it with the folder's listing and ingests only files that are new or changed, into a
folder of its own; then the new list is published (see `sinks.versioned`). Readers take the rows whose
file and batch are on the list, so rows of superseded and removed versions are gone the moment the
list appears, and old rows are neither read nor rewritten. A refresh that dies is simply run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.operators.dedupe import drop_copies
from gridtally.plans.ingest_job import INVENTORY, persist_dataset
from gridtally.sinks import versioned
from gridtally.sinks.versioned import Part, Version
from gridtally.sources.discovery import RawFile, discover, spelled_path
from gridtally.spec import SOURCE_FILE, DatasetSpec, resolve_duplicate_policy

BATCH = "batch_id"
#: Files whose names are sent to every task of a reader; beyond that rows and names meet by key.
BROADCAST_FILES = 200_000


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: names of the files, and the number of its batch (None where nothing changed)."""

    batch: int | None
    added: tuple[str, ...]
    replaced: tuple[str, ...]
    removed: tuple[str, ...]


def file_versions(spark: SparkSession, spec: DatasetSpec, raw_uri: str) -> dict[RawFile, str]:
    """Every file of the dataset with its version, from the listing alone."""
    files = discover(spark, raw_uri, [spec])[spec.name]
    found = {}
    for pattern in spec.file_patterns if files else ():
        try:
            listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(raw_uri)
            rows = listed.select("path", "length", F.unix_micros("modificationTime").alias("at")).collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        found.update({spelled_path(r["path"]): f"{r['length']}:{r['at']}" for r in rows})
    # Spark leaves empty files out of a scan.
    return {f: found.get(f.path, "0:") for f in files}


def _books(out_uri: str) -> str:
    return f"{out_uri}/files"


def refresh(spark: SparkSession, spec: DatasetSpec, raw_uri: str, out_uri: str, drop_missing: bool = True) -> Refreshed:
    """Bring the table up to date with the folder. drop_missing: rows of files that are gone go too."""
    before = versioned.current(spark, _books(out_uri))
    known = {p.path: p for p in before.parts}
    now = file_versions(spark, spec, raw_uri)
    changed = sorted(f for f, v in now.items() if f.path not in known or known[f.path].key != v)
    gone = sorted(set(known) - {f.path for f in now}) if drop_missing else []
    if not changed and not gone:
        return Refreshed(None, (), (), ())
    batch = before.number + 1
    if changed:
        # Copies across files are settled by readers: the file that holds the first of them may change.
        inner = replace(spec, dedup_exclude=tuple(c for c in spec.dedup_exclude if c != SOURCE_FILE))
        done = persist_dataset(spark, inner, changed, f"{out_uri}/table/{BATCH}={batch}")
        if not done.ok:
            raise RuntimeError(done.messages[-1][2])
        done.inventory.write.mode("overwrite").parquet(f"{out_uri}/inventory/{BATCH}={batch}")
    stay = [p for p in before.parts if p.path not in gone and p.path not in {f.path for f in changed}]
    versioned.publish(spark, _books(out_uri), before, [*stay, *(Part(f.path, now[f], batch, batch) for f in changed)])
    added, replaced = ([f.name for f in changed if (f.path in known) == old] for old in (False, True))
    return Refreshed(batch, tuple(added), tuple(replaced), tuple(p.rsplit("/", 1)[-1] for p in gone))


def live_files(spark: SparkSession, out_uri: str) -> DataFrame:
    """(file, batch_id) of the file versions that count."""
    return _live(spark, versioned.current(spark, _books(out_uri)))


def _live(spark: SparkSession, version: Version) -> DataFrame:
    rows = [(p.path.rsplit("/", 1)[-1], p.low) for p in version.parts]
    live = spark.createDataFrame(rows, f"file string, {BATCH} bigint")
    return F.broadcast(live) if len(rows) <= BROADCAST_FILES else live


def _of_live(rows: DataFrame, spark: SparkSession, version: Version, name: str) -> DataFrame:
    """Rows of the versions that count; folders of batches without one are not read."""
    batches: Sequence[int] = sorted({p.low for p in version.parts})
    live = _live(spark, version).withColumnRenamed("file", name)
    return rows.where(F.col(BATCH).isin(*batches)).withColumn(BATCH, F.col(BATCH).cast("bigint")).join(live, [name, BATCH], "left_semi")


def read_current(spark: SparkSession, spec: DatasetSpec, out_uri: str, with_batch: bool = False) -> DataFrame:
    """All rows of the current file versions, without copies where the policy says so."""
    version = versioned.current(spark, _books(out_uri))
    if not version.parts:
        empty = spark.createDataFrame([], spec.struct_type())
        return empty.withColumn(BATCH, F.lit(0).cast("bigint")) if with_batch else empty
    rows = _of_live(spark.read.option("mergeSchema", True).parquet(f"{out_uri}/table"), spark, version, SOURCE_FILE)
    mode = resolve_duplicate_policy(spec.duplicate_policy)
    if mode.startswith("drop_") and SOURCE_FILE in spec.dedup_exclude:
        rows = drop_copies(rows, mode.removeprefix("drop_"), (*spec.dedup_exclude, BATCH))
    return rows if with_batch else rows.drop(BATCH)


def read_inventory(spark: SparkSession, out_uri: str) -> DataFrame:
    """The inventory of the current file versions, failed files included."""
    version = versioned.current(spark, _books(out_uri))
    if not version.parts:
        return spark.createDataFrame([], INVENTORY)
    return _of_live(spark.read.parquet(f"{out_uri}/inventory"), spark, version, "file_name").drop(BATCH)
