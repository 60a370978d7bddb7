"""Writers of typed tables, filtered tables and quality reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.operators.transforms import union_by_name
from gridtally.spec import ROW_ORDINAL

REPORT_VERSION = "1.0.0"
_MOMENT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_JSON = {"timestampNTZFormat": _MOMENT, "timestampFormat": _MOMENT + "XXX"}
#: Columns of the long form of a report.
REPORT_SCHEMA = "schema_version string, generated_at_utc string, dataset string, check string, payload string"


def write_parquet(df: DataFrame, uri: str, partition_by: str | None = None) -> tuple[bool, str]:
    """Overwrite a Parquet table; (ok, message) instead of an exception, as callers list messages.

    With a partition column the rows are rebalanced on it: adaptive execution splits a large
    month over several tasks and joins small ones, so there is neither a hot writer nor a
    file per task and month.
    """
    name = uri.rstrip("/").rsplit("/", 1)[-1]
    try:
        if partition_by is None:
            df.write.mode("overwrite").parquet(uri)
        else:
            df.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(uri)
    except Exception as error:  # the message is the result
        return False, f"Failed to write {name}: {error}"
    return True, f"Wrote {name}."


#: What the reader turns a quoted empty cell into, to tell it from a missing one. No cell holds it.
_EMPTY_CELL = "\x00empty\x00"


def write_csv(df: DataFrame, uri: str) -> None:
    """A filtered table as CSV files with headers: no row limit, no sort, one file per task.

    A null is an empty cell, an empty text a quoted one. Quotes in a cell are doubled; white space at
    its ends and line breaks in it are kept.
    """
    writer = df.drop(ROW_ORDINAL).write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("timestampNTZFormat", _MOMENT).csv(uri)


def read_csv(spark: SparkSession, uri: str, schema: T.StructType) -> DataFrame:
    """An exported table with the types it had: identifiers keep leading zeros, empty texts stay apart from nulls.

    Cells are read as text and cast, so a cell that does not fit its type fails the read instead of
    becoming null. Cells may hold line breaks, so a file is read by one task; an export has many files.
    """
    fields = [f for f in schema if f.name != ROW_ORDINAL]
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    reader = spark.read.schema(texts).option("header", True).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST")
    reader = reader.option("emptyValue", _EMPTY_CELL).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    rows = reader.option("maxCharsPerColumn", -1).option("enforceSchema", False).csv(uri)
    cells = []
    for f in fields:
        cell = F.col(f"`{f.name}`")
        text = F.when(cell == _EMPTY_CELL, F.lit("")).otherwise(cell)
        cells.append((text if isinstance(f.dataType, T.StringType) else cell.cast(f.dataType)).alias(f.name))
    return rows.select(*cells)


def stamped_name(prefix: str, generated_at: str, suffix: str = "json") -> str:
    """<prefix>_YYYYMMDDTHHMMSSZ.<suffix>, from an ISO time of any offset (none means UTC)."""
    moment = dt.datetime.fromisoformat(str(generated_at).strip().replace("Z", "+00:00"))
    moment = moment.replace(tzinfo=dt.UTC) if moment.tzinfo is None else moment.astimezone(dt.UTC)
    return f"{prefix}_{moment:%Y%m%dT%H%M%SZ}.{suffix}"


def _json_safe(df: DataFrame) -> DataFrame:
    """NaN has no JSON form; it becomes null."""
    cells = {f.name: F.nanvl(F.col(f.name), F.lit(None).cast("double"))
             for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(cells) if cells else df


def report_rows(tables: dict[str, dict[str, DataFrame]], generated_at: str) -> DataFrame:
    """Long form of a quality report: one JSON payload per row of every check of every dataset."""
    parts = []
    for dataset, checks in tables.items():
        for check, table in checks.items():
            safe = _json_safe(table)
            payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in safe.columns]), {"ignoreNullFields": "false", **_JSON})
            parts.append(
                safe.select(
                    F.lit(REPORT_VERSION).alias("schema_version"),
                    F.lit(generated_at).alias("generated_at_utc"),
                    F.lit(dataset).alias("dataset"),
                    F.lit(check).alias("check"),
                    payload.alias("payload"),
                )
            )
    return union_by_name(parts)


def write_report(
    spark: SparkSession, tables: dict[str, dict[str, DataFrame]], uri: str, generated_at: str
) -> str:
    """Write the report as JSON lines under a UTC-stamped name; returns the path."""
    path = f"{uri.rstrip('/')}/{stamped_name('quality_diagnostics', generated_at)}"
    # The report has a few rows per column of a dataset: one file.
    report_rows(tables, generated_at).coalesce(1).write.mode("overwrite").json(path)
    return path


def read_report(spark: SparkSession, uri: str) -> tuple[DataFrame, DataFrame]:
    """The long form of written reports: rows of the version this package writes, and rows of all others.

    `uri` may be one report or a folder pattern of many.
    """
    rows = spark.read.schema(REPORT_SCHEMA).json(uri)
    known = F.col("schema_version").eqNullSafe(REPORT_VERSION)
    return rows.where(known), rows.where(~known)


def report_tables(rows: DataFrame, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """One typed table per check, with the dataset and the report's time; from rows of a known version.

    A payload that does not fit its check's schema fails the read. A number that was null or NaN is
    null again, never zero.
    """
    tables = {}
    for check, schema in schemas.items():
        fields = T.StructType([f for f in schema if f.name != "dataset"])
        payload = F.from_json("payload", fields, {"mode": "FAILFAST", **_JSON})
        mine = rows.where(F.col("check") == check).select("dataset", "generated_at_utc", payload.alias("_payload"))
        tables[check] = mine.select("dataset", "generated_at_utc", *[F.col("_payload").getField(f.name).alias(f.name) for f in fields])
    return tables


def unread_checks(rows: DataFrame, schemas: dict[str, T.StructType]) -> DataFrame:
    """Checks of a report that no schema is known for, with their rows: (dataset, check, rows)."""
    return rows.where(~F.col("check").isin(*schemas)).groupBy("dataset", "check").agg(F.count(F.lit(1)).alias("rows"))
