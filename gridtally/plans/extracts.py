"""Raw CSV extracts of the given tables, for the registered queries about files."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.plans.ingest_job import scratch_folder
from gridtally.plans.tables import PAYMENTS

CELLS = ("servicepointno", "meterno", "categorycode", "transactionamount", "issuedate")
EXTRACT = replace(PAYMENTS, file_patterns=("part-*.csv",))


def extract_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/extract-{uuid.uuid4()}"


def write_extract(rows: DataFrame, uri: str, headers: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    """Raw rows as CSV files, with other header names where given."""
    names = headers or {}
    cells = rows.select(*[F.col(c).alias(names.get(c, c)) for c in rows.columns])
    writer = cells.write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(uri)


def _store(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def deliver(rows: DataFrame, raw_uri: str, name: str) -> None:
    """Raw rows as files `<name>-<k>.csv`, one per partition; files of these names are replaced."""
    spark = rows.sparkSession
    staged = f"{raw_uri}-staged-{uuid.uuid4()}"
    write_extract(rows, staged)
    folder, store = _store(spark, staged)
    store.mkdirs(_store(spark, raw_uri)[0])
    written = sorted(s.getPath().toString() for s in store.listStatus(folder) if s.getPath().getName().startswith("part-"))
    for k, path in enumerate(written):
        target = _store(spark, f"{raw_uri}/{name}-{k}.csv")[0]
        store.delete(target, False)
        store.rename(_store(spark, path)[0], target)


def withdraw(spark: SparkSession, raw_uri: str, name: str, files: int) -> None:
    """Remove delivered files."""
    for k in range(files):
        path, store = _store(spark, f"{raw_uri}/{name}-{k}.csv")
        store.delete(path, False)


def write_lines(rows: DataFrame, header: str, line: Column, uri: str, files: int = 2) -> None:
    """Lines of text as they are, each file with its header first: for records no CSV writer would write."""
    spark = rows.sparkSession
    lines = rows.select(F.pmod(F.xxhash64(line), F.lit(files)).cast("int").alias("k"), F.lit(1).alias("place"), line.alias("value"))
    heads = spark.range(files).select(F.col("id").cast("int").alias("k"), F.lit(0).alias("place"), F.lit(header).alias("value"))
    dealt = lines.unionByName(heads).repartitionById(files, "k").sortWithinPartitions("k", "place")
    dealt.select("value").write.mode("append").text(uri)
