"""Raw CSV files to a typed Parquet table, with a file inventory and messages.

The CSV text is read once. The write of the typed table also gathers the names of the files with
malformed records (an observed metric of that write, a list of files and never of rows). Where such
files fail, readers of the written table leave them out by name; the text is not read again. Row counts
and parse warnings per file come from the written Parquet table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.operators.dedupe import Deduplicated, drop_copies, duplicate_row_count
from gridtally.operators.quality import validate_columns
from gridtally.operators.transforms import transform, union_by_name
from gridtally.sinks.files import write_parquet
from gridtally.sources.csv_source import MALFORMED, FileHeader, header_groups, read_group, read_headers
from gridtally.sources.discovery import RawFile, discover
from gridtally.spec import PARSED, SOURCE_FILE, DatasetSpec, resolve_duplicate_policy

# Columns of the file inventory, in order.
INVENTORY = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_size_mb", T.DoubleType()),
        T.StructField("read_status", T.StringType()),
        T.StructField("rows_read", T.LongType()),
        T.StructField("column_count", T.LongType()),
        T.StructField("raw_columns", T.StringType()),
        T.StructField("standardized_columns", T.StringType()),
        T.StructField("schema_valid", T.BooleanType()),
        T.StructField("missing_required_columns", T.StringType()),
        T.StructField("schema_status", T.StringType()),
        T.StructField("column_mapping", T.StringType()),
        T.StructField("parse_warning_count", T.LongType()),
        T.StructField("duplicate_policy_mode", T.StringType()),
    ]
)
Result = TypeVar("Result")
MESSAGES = "dataset string, severity string, message string"


def shared_folder(spark: SparkSession, fallback: str) -> str:
    """Folder that every executor reaches: the cluster's checkpoint folder, else the fallback."""
    return spark.conf.get("spark.checkpoint.dir", None) or fallback


def scratch_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set a local session takes a folder of this machine; a cluster has none."""
    if spark.sparkContext.master.split("[")[0] == "local":
        return shared_folder(spark, "/tmp/gridtally").rstrip("/")
    if not spark.conf.get("spark.checkpoint.dir", None):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return shared_folder(spark, "").rstrip("/")


def message(dataset: str, text: str) -> tuple[str, str, str]:
    """A message with its severity, which follows from how the text starts."""
    if text.startswith("Failed"):
        return dataset, "error", text
    return dataset, "warning" if text.startswith("No valid") else "success", text


@dataclass
class RawTable:
    """Readable files of one dataset and why the others are not readable."""

    spec: DatasetSpec
    headers: list[FileHeader]
    failures: dict[RawFile, str] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame | None:
        """Typed rows of all readable files, with the malformed flag; None without any file."""
        tables = []
        for columns, group in header_groups(self.headers).items():
            rows = read_group(spark, columns, [h.file.path for h in group], self.spec.multi_line)
            tables.append(_typed(rows, self.spec))
        return union_by_name(tables) if tables else None

    def without(self, names: Iterable[str], reason: str) -> RawTable:
        bad = set(names)
        failures = dict(self.failures)
        failures.update({h.file: reason for h in self.headers if h.file.name in bad})
        return RawTable(self.spec, [h for h in self.headers if h.file.name not in bad], failures)


def _typed(rows: DataFrame, spec: DatasetSpec) -> DataFrame:
    typed = transform(rows, spec)
    return typed.select(*[c for c in typed.columns if c != MALFORMED], MALFORMED)


def open_files(spark: SparkSession, spec: DatasetSpec, files: Sequence[RawFile]) -> RawTable:
    headers, empty = read_headers(spark, list(files))
    return RawTable(spec, headers, {f: "No columns to parse from file" for f in empty})


def malformed_files(frame: DataFrame) -> list[str]:
    """Names of the files with malformed records (a list of files, never rows)."""
    return [r[0] for r in frame.where(F.col(MALFORMED)).select(SOURCE_FILE).distinct().collect()]


# Messages of the ingest, here and below.
_MALFORMED_REASON = "Error tokenizing data: a record has more fields than the header"


def read_dataset(spark: SparkSession, spec: DatasetSpec, files: Sequence[RawFile]) -> DataFrame:
    """Typed rows of all good files as a lazy table, before any duplicate policy.

    With fail_file the text is scanned once to find bad files; prefer `persist_dataset`, which
    finds them while writing.
    """
    raw = open_files(spark, spec, files)
    frame = raw.frame(spark)
    if frame is not None and spec.malformed_policy == "fail_file":
        bad = malformed_files(frame)
        if bad:
            frame = raw.without(bad, _MALFORMED_REASON).frame(spark)
    if frame is None:
        return spark.createDataFrame([], spec.struct_type())
    return frame.where(~F.col(MALFORMED)).drop(MALFORMED)


def quarantined_rows(spark: SparkSession, spec: DatasetSpec, files: Sequence[RawFile]) -> DataFrame | None:
    """The malformed records, typed as far as they go; for the quarantine policy."""
    frame = open_files(spark, spec, files).frame(spark)
    return None if frame is None else frame.where(F.col(MALFORMED)).drop(MALFORMED)


def _without_files(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of all other files. The names are a local list: a small one is a literal filter, a larger one a join."""
    if not names:
        return table
    if len(names) <= 100:
        return table.where(~F.col(SOURCE_FILE).isin(*names))
    listed = table.sparkSession.createDataFrame([(n,) for n in names], f"{SOURCE_FILE} string")
    return table.join(F.broadcast(listed) if len(names) <= 200_000 else listed, SOURCE_FILE, "left_anti").select(*table.columns)


def _write(
    raw: RawTable, spark: SparkSession, uri: str, partition_by: str | None = None
) -> tuple[RawTable, T.StructType, bool, str, list[str]]:
    """Write the good records of all files in one pass over their text.

    Returns the files that did not fail, and the names of those that did: records of theirs that
    are good by themselves were written too, so whoever reads the table leaves these files out.
    """
    frame = raw.frame(spark)
    if frame is None:
        empty = spark.createDataFrame([], raw.spec.struct_type())
        return raw, empty.schema, *write_parquet(empty, uri, partition_by), []
    seen = Observation(f"malformed-{uuid.uuid4()}")
    watched = frame.observe(seen, F.collect_set(F.when(F.col(MALFORMED), F.col(SOURCE_FILE))).alias("files"))
    good = watched.where(~F.col(MALFORMED)).drop(MALFORMED)
    ok, text = write_parquet(good, uri, partition_by)
    if not ok or raw.spec.malformed_policy != "fail_file":
        return raw, good.schema, ok, text, []
    bad = sorted(seen.get["files"])
    return raw.without(bad, _MALFORMED_REASON), good.schema, ok, text, bad


def _per_file(table: DataFrame, spec: DatasetSpec) -> DataFrame:
    date = spec.date
    unparsed = ~F.col(date.success) if date.style == "full" else F.col(date.status) != PARSED
    return table.groupBy(F.col(SOURCE_FILE).alias("file_name")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(unparsed).alias("warnings")
    )


def file_inventory(spark: SparkSession, raw: RawTable, table: DataFrame | None) -> DataFrame:
    """One row per input file. `table` holds the typed rows before duplicates were dropped."""
    spec = raw.spec
    mode = resolve_duplicate_policy(spec.duplicate_policy) if raw.headers else None
    rows = []
    for h in raw.headers:
        found = validate_columns(h.standard, spec.required_columns)
        rows.append(
            (spec.name, h.file.name, h.file.path, round(h.file.size / (1024 * 1024), 2), "ok", 0, len(h.raw),
             ", ".join(h.raw), ", ".join(h.standard), found["is_valid"], ", ".join(found["missing_columns"]),
             found["status"], h.mapping, 0, mode)
        )
    for file, reason in raw.failures.items():
        rows.append(
            (spec.name, file.name, file.path, round(file.size / (1024 * 1024), 2), "error", 0, 0,
             "", "", False, "", f"Failed to read file: {reason}", "", 0, mode)
        )
    files = spark.createDataFrame(rows, INVENTORY)
    if table is None or not raw.headers:
        return files
    counted = files.join(_per_file(table, spec), "file_name", "left")
    cells = {f.name: F.col(f.name) for f in INVENTORY}
    cells["rows_read"] = F.coalesce("rows", F.lit(0).cast("bigint"))
    cells["parse_warning_count"] = F.coalesce("warnings", F.lit(0).cast("bigint"))
    return counted.select(*[c.alias(n) for n, c in cells.items()])


@dataclass
class Ingested:
    """A persisted dataset: its table (read back from Parquet), inventory and messages."""

    spec: DatasetSpec
    table: DataFrame
    uri: str
    inventory: DataFrame
    messages: list[tuple[str, str, str]]
    ok: bool = True


def persist_dataset(
    spark: SparkSession,
    spec: DatasetSpec,
    files: Sequence[RawFile],
    uri: str,
    partition_by: str | None = None,
) -> Ingested:
    """Ingest files, apply the duplicate policy and overwrite the Parquet table at `uri`.

    Policies that keep all rows write the table once. Dropping policies write a stage in the
    shared folder first: the inventory counts rows before the drop, and the drop reads typed
    columns instead of parsing text again.
    """
    mode = resolve_duplicate_policy(spec.duplicate_policy)
    dropping = mode in ("drop_first", "drop_last")
    raw = open_files(spark, spec, files)
    place = f"{shared_folder(spark, uri.rstrip('/') + '_stage')}/stage-{spec.name}"
    stage = f"{place}-{uuid.uuid4()}" if dropping else uri
    raw, schema, ok, text, bad = _write(raw, spark, stage, None if dropping else partition_by)
    notes = [message(spec.name, f"Failed to read {f.name}: {why}") for f, why in sorted(raw.failures.items())]
    if not ok:
        return Ingested(spec, spark.createDataFrame([], spec.struct_type()), uri,
                        file_inventory(spark, raw, None), [*notes, message(spec.name, text)], False)
    # The schema is given: a month such as 2026-01 as partition value would be read as a date.
    staged = _without_files(spark.read.schema(schema).parquet(stage), bad)
    if bad and not dropping:
        # The table holds records of failed files: the others move aside as Parquet and back again.
        aside = f"{place}-{uuid.uuid4()}"
        ok, text = write_parquet(staged, aside)
        staged = spark.read.schema(schema).parquet(aside)
        if ok:
            ok, text = write_parquet(staged, uri, partition_by)
    inventory = file_inventory(spark, raw, staged)
    rows = staged.count()
    dropped = None
    if dropping:
        # What the drop left out are the duplicates: they are not searched for a second time.
        ok, text = write_parquet(drop_copies(staged, mode.removeprefix("drop_"), spec.dedup_exclude), uri, partition_by)
        dropped = rows - spark.read.schema(schema).parquet(uri).count() if ok else None
    if not raw.headers:
        notes.append(message(spec.name, f"No valid {spec.name} files were ingested."))
        before = after = 0
    else:
        before = duplicate_row_count(staged, spec.dedup_exclude).first()[0] if dropped is None else dropped
        after = 0 if dropping else before
        notes += [message(spec.name, t) for t in Deduplicated(staged, staged, mode).messages(before)]
        notes.append(
            message(
                spec.name,
                f"{spec.name.title()} duplicate policy '{mode}': "
                f"{before:,} duplicate rows before policy, {after:,} after policy.",
            )
        )
    if ok:
        name = uri.rstrip("/").rsplit("/", 1)[-1]
        text = f"Wrote {name} with {rows - (before - after):,} rows."
    notes.append(message(spec.name, text))
    return Ingested(spec, spark.read.schema(schema).parquet(uri) if ok else staged, uri, inventory, notes, ok)


def side_by_side(spark: SparkSession, jobs: dict[str, Callable[[], Result]], most: int = 8) -> dict[str, Result | Exception]:
    """Results of independent jobs that run at the same time, each in a scheduler pool of its own.

    A job that fails gives its exception as its result; the others go on.
    """

    def run(name: str) -> Result | Exception:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return jobs[name]()
        except Exception as error:  # the caller sees which job failed and why
            return error
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=min(most, max(len(jobs), 1))) as pool:
        # Each thread inherits the local properties of the caller, as its jobs would without threads.
        running = {name: pool.submit(inheritable_thread_target(spark)(run), name) for name in jobs}
        return {name: future.result() for name, future in running.items()}


def failed_dataset(spark: SparkSession, spec: DatasetSpec, uri: str, error: Exception) -> Ingested:
    """What is left of a dataset whose ingest broke off: no rows, and a message that says why."""
    text = str(error).strip().split("\n", 1)[0] or type(error).__name__
    empty = spark.createDataFrame([], spec.struct_type())
    return Ingested(spec, empty, uri, spark.createDataFrame([], INVENTORY), [message(spec.name, f"Failed to ingest {spec.name}: {text}")], False)


def ingest_and_persist(
    spark: SparkSession, specs: Sequence[DatasetSpec], raw_uri: str, out_uri: str
) -> dict[str, Ingested]:
    """Discover, ingest and persist every dataset: `<out_uri>/<dataset>.parquet`.

    Datasets are ingested side by side; one that breaks off leaves the others whole.
    """
    def place(spec: DatasetSpec) -> str:
        return f"{out_uri.rstrip('/')}/{spec.name}.parquet"

    def job(spec: DatasetSpec) -> Callable[[], Ingested]:
        return lambda: persist_dataset(spark, spec, discover(spark, raw_uri, [spec])[spec.name], place(spec))

    done = side_by_side(spark, {s.name: job(s) for s in specs})
    return {s.name: failed_dataset(spark, s, place(s), r) if isinstance(r := done[s.name], Exception) else r for s in specs}


def inventory_of(spark: SparkSession, ingested: dict[str, Ingested]) -> DataFrame:
    frames = [i.inventory for i in ingested.values()]
    return union_by_name(frames) if frames else spark.createDataFrame([], INVENTORY)


def messages_of(spark: SparkSession, ingested: dict[str, Ingested]) -> DataFrame:
    return spark.createDataFrame([m for i in ingested.values() for m in i.messages], MESSAGES)
