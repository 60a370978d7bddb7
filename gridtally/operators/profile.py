"""Column profiles and table metadata."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.functions.numbers import percent
from gridtally.operators.kpis import distinct_count
from gridtally.operators.transforms import data_columns, union_by_name
from gridtally.spec import ROW_ORDINAL, SOURCE_FILE, DatasetSpec

_ORDERED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _samples(df: DataFrame, column: str, order: Sequence[str], n: int) -> Column:
    """The first n non-null values in row order, joined by ' | '. Each task keeps n rows only."""
    place = F.struct(*order) if order else F.lit(0)
    first = df.where(F.col(column).isNotNull()).select(place.alias("place"), F.col(column).cast("string").alias("value"))
    first = first.orderBy("place").limit(n) if order else first.limit(n)
    values = F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda row: row["value"])
    return first.agg(F.array_join(values, " | ").alias("s")).scalar()


def column_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
    samples: int = 3,
    approximate: bool = False,
) -> DataFrame:
    """Type, null counts, distinct count, first sample values and extremes of every column.

    Counts and extremes of all columns share one scan. Distinct counts and samples are scalar
    subqueries, each over its own pruned column, so no row is copied per column.
    """
    names = list(columns) if columns else data_columns(df)
    order = list(order_by) if order_by else [c for c in (SOURCE_FILE, ROW_ORDINAL) if c in df.columns]
    kinds = {f.name: f.dataType for f in df.schema}
    cells = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(names):
        cells.append(F.count(name).alias(f"count{i}"))
        if approximate:
            cells.append(F.approx_count_distinct(name).alias(f"distinct{i}"))
        if isinstance(kinds[name], _ORDERED):
            cells += [F.min(name).cast("string").alias(f"min{i}"), F.max(name).cast("string").alias(f"max{i}")]
    wide = df.agg(*cells)
    rows = []
    for i, name in enumerate(names):
        nulls = F.col("n") - F.col(f"count{i}")
        ranged = isinstance(kinds[name], _ORDERED)
        rows.append(
            F.struct(
                F.lit(i).cast("bigint").alias("position"),
                F.lit(name).alias("column"),
                F.lit(kinds[name].simpleString()).alias("dtype"),
                F.col(f"count{i}").alias("non_null_count"),
                nulls.alias("null_count"),
                F.bround(percent(nulls, F.col("n")), 2).alias("missing_pct"),
                (F.col(f"distinct{i}") if approximate else distinct_count(df, name)).alias("unique_count"),
                _samples(df, name, order, samples).alias("sample_values"),
                (F.col(f"min{i}") if ranged else F.lit(None).cast("string")).alias("min_value"),
                (F.col(f"max{i}") if ranged else F.lit(None).cast("string")).alias("max_value"),
            )
        )
    return wide.select(F.inline(F.array(*rows)))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files under a path, from the listing alone (no content is read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def table_overview(df: DataFrame, path: str | None = None) -> DataFrame:
    """Rows, columns and stored size in MB (null when the table has no path)."""
    size = None if path is None else round(stored_bytes(df.sparkSession, path) / (1024 * 1024), 2)
    names = data_columns(df)
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    empty = F.col("rows") == 0
    return rows.select(
        "rows",
        F.when(empty, F.lit(0)).otherwise(F.lit(len(names))).cast("bigint").alias("columns"),
        F.when(empty, F.lit(0.0)).otherwise(F.lit(size).cast("double")).alias("stored_mb"),
    )


def column_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(column, files, values, stored_bytes, raw_bytes) of a Parquet table, from the files' footers.

    Footers are read in tasks, a few files each; no column data is read. Nested columns are named by
    their path. The store must be one that Arrow's file systems reach.
    """

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for uri in batch["path"]:
                # Local files are listed as file:/, which Arrow spells file:///.
                store, inner = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
                with store.open_input_file(inner) as file:
                    found = pq.ParquetFile(file).metadata
                    cells: dict[str, list[int]] = {}
                    for g in range(found.num_row_groups):
                        for c in range(found.num_columns):
                            one = found.row_group(g).column(c)
                            cell = cells.setdefault(one.path_in_schema, [0, 0, 0])
                            for i, n in enumerate((one.num_values, one.total_compressed_size, one.total_uncompressed_size)):
                                cell[i] += n
                yield pd.DataFrame([(name, *cell) for name, cell in cells.items()], columns=["column", "n", "stored", "raw"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    # Only names are used. A file is one row, and its footer little work: about a hundred of them to a task.
    names = files.select("path")
    tasks = max(1, min(names.count() // 100, 10_000))
    found = names.repartition(tasks).mapInPandas(footers, "column string, n bigint, stored bigint, raw bigint")
    return found.groupBy("column").agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("values"), F.sum("stored").alias("stored_bytes"), F.sum("raw").alias("raw_bytes"))


def field_snapshot(spark: SparkSession, datasets: Sequence[tuple[DatasetSpec, DataFrame]], first: int = 20) -> DataFrame:
    """The first columns of each dataset, as text."""
    rows = [(spec.name, ", ".join(data_columns(df)[:first])) for spec, df in datasets]
    return spark.createDataFrame(rows, "dataset string, available_columns string")


def candidate_keys(spark: SparkSession, specs: Sequence[DatasetSpec]) -> DataFrame:
    """Declared keys of each dataset. No key is shared: datasets are never joined."""
    return spark.createDataFrame([(key, s.name) for s in specs for key in s.candidate_keys], "field string, dataset string")


def key_check(df: DataFrame, spec: DatasetSpec, pairs: bool = True) -> DataFrame:
    """How well the declared keys, and pairs of them, tell rows apart.

    (field, rows, null_rows, distinct_keys, distinct_pct, null_pct, most_rows, unique): a row with a null
    in any field of the key has no key; most_rows is the largest number of rows that share one. Each key
    is a count per value of its own columns, folded before the shuffle; no row is copied per key.
    """
    names = [k for k in spec.candidate_keys if k in df.columns]
    keys = [(n,) for n in names] + ([*combinations(names, 2)] if pairs else [])
    parts = []
    for key in keys:
        counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
        mine = F.when(whole, F.col("n"))
        figures = counts.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(~whole, F.col("n"))), F.lit(0)).alias("null_rows"),
            F.count(mine).alias("distinct_keys"), F.coalesce(F.max(mine), F.lit(0)).alias("most_rows"))
        parts.append(figures.select(
            F.lit(spec.name).alias("dataset"), F.lit(" + ".join(key)).alias("field"), "rows", "null_rows", "distinct_keys",
            percent(F.col("distinct_keys"), F.col("rows") - F.col("null_rows")).alias("distinct_pct"), percent(F.col("null_rows"), F.col("rows")).alias("null_pct"),
            "most_rows", ((F.col("most_rows") == 1) & (F.col("null_rows") == 0)).alias("unique")))
    return union_by_name(parts)
