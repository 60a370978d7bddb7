"""Tables whose readers see one whole version or the next, never a half-written one.

A version is a short list of the folders that make up the table. Data goes into new folders first; the
list is published last, as one small file under a new version number, which appears at once. A job that
dies before that leaves the old version untouched, and folders that no version names are not read.
One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIST = "path string, key string, low bigint, high bigint, version bigint"
_FOLDER = "_folder"


@dataclass(frozen=True)
class Part:
    """A folder of the table: the partition it holds, or the batches it comes from."""

    path: str
    key: str | None = None
    low: int = 0
    high: int = 0


@dataclass(frozen=True)
class Version:
    number: int = 0
    parts: tuple[Part, ...] = ()
    schema: T.StructType | None = None


def current(spark: SparkSession, uri: str) -> Version:
    """The newest published version; version 0 without parts where there is none."""
    try:
        lists = spark.read.schema(_LIST).parquet(f"{uri}/versions")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return Version()
        raise
    newest = lists.agg(F.max("version")).first()[0]
    if newest is None:
        return Version()
    rows = lists.where(F.col("version") == newest).collect()
    # The row without a path carries the schema.
    schema = next((T.StructType.fromJson(json.loads(r["key"])) for r in rows if not r["path"] and r["key"]), None)
    return Version(newest, tuple(Part(r["path"], r["key"], r["low"], r["high"]) for r in rows if r["path"]), schema)


def publish(spark: SparkSession, uri: str, after: Version, parts: Sequence[Part], schema: T.StructType | None = None) -> Version:
    """Make the parts the next version. Whatever an unfinished attempt left under its number is overwritten."""
    schema = schema or after.schema
    number = after.number + 1
    rows = [("", None if schema is None else schema.json(), 0, 0), *((p.path, p.key, p.low, p.high) for p in parts)]
    table = spark.createDataFrame(rows, _LIST.rsplit(", ", 1)[0])
    table.coalesce(1).write.mode("overwrite").parquet(f"{uri}/versions/version={number}")
    return Version(number, tuple(parts), schema)


def new_folder(uri: str) -> str:
    return f"{uri.rstrip('/')}/parts/{uuid.uuid4()}"


def add_part(df: DataFrame, uri: str, batch: int) -> Part:
    """Write rows as a new folder that no version names yet."""
    folder = new_folder(uri)
    df.write.parquet(folder)
    return Part(folder, None, batch, batch)


def read(spark: SparkSession, version: Version, schema: T.StructType | None = None, keep: Callable[[Part], bool] | None = None) -> DataFrame:
    """Rows of the version's parts; parts that `keep` rejects are not even listed."""
    schema = schema or version.schema
    paths = [p.path for p in version.parts if keep is None or keep(p)]
    if schema is None:
        raise ValueError("the table has no version yet: its schema must be given")
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, uri: str, partitions: Sequence[str | None] | None = None) -> DataFrame:
    """The current version of a partitioned table, or the given partitions of it."""
    wanted = None if partitions is None else {_key(p) for p in partitions}
    return read(spark, current(spark, uri), keep=None if wanted is None else lambda p: p.key in wanted)


def _key(value: str | None) -> str:
    return "0" if value is None else f"1{value}"


def overwrite_partitions(df: DataFrame, uri: str, by: str) -> Version:
    """Replace the partitions that df has rows of; all others stay the very files they are.

    Partitions are the values of column `by`, null included. Each lies in a folder of its own, so a
    later run replaces it by naming another folder. Columns that df has anew are added to the schema;
    a column of another type than before is refused, since the partitions that stay could not be read.
    """
    spark = df.sparkSession
    before = current(spark, uri)
    schema = _grown(before.schema, df.schema)
    root = new_folder(uri)
    key = F.coalesce(F.concat(F.lit("1"), F.col(by).cast("string")), F.lit("0"))
    # Values may hold signs that a path cannot, so folders carry their digest.
    keyed = df.withColumn(_FOLDER, F.sha2(key, 256))
    keyed.hint("rebalance", _FOLDER).write.partitionBy(_FOLDER).parquet(root)
    # One row per partition, from one column.
    found = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(_FOLDER, T.StringType())])).parquet(root)
    new = {r["key"]: Part(f"{root}/{_FOLDER}={r[_FOLDER]}", r["key"]) for r in found.select(key.alias("key"), _FOLDER).distinct().collect()}
    stay = [p for p in before.parts if p.key not in new]
    return publish(spark, uri, before, [*stay, *new.values()], schema)


def _grown(before: T.StructType | None, now: T.StructType) -> T.StructType:
    if before is None:
        return now
    kinds = {f.name: f.dataType for f in now}
    for field in before:
        if kinds.get(field.name, field.dataType) != field.dataType:
            raise ValueError(f"column {field.name} was {field.dataType.simpleString()}, not {kinds[field.name].simpleString()}")
    return T.StructType([*before.fields, *(f for f in now if f.name not in before.names)])
