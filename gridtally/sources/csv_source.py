"""CSV files read as text cells, whatever their headers.

Headers are read first, from the first lines of each file (small files are read whole). Files whose
standardised columns agree are then read together with an explicit all-text schema, so nothing
is inferred and identifiers keep their leading zeros.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.functions import text
from gridtally.sources.discovery import RawFile, decoded_name, literal_path, plain_path
from gridtally.spec import ROW_ORDINAL, SOURCE_FILE

CORRUPT = "_corrupt"
MALFORMED = "_malformed"
# Larger than any file: keeps every file in one task of the header job.
_WHOLE_FILE = str(1 << 42)
# Files up to this size are read whole for their header, one task each.
_SMALL_FILE = 16 << 20
# Lines of a larger file that are looked at first; where its first record is longer, this many times as many.
_FIRST_LINES, _MORE = 16, 64
# Larger files in one header job.
_FILES_PER_JOB = 50


@dataclass(frozen=True)
class FileHeader:
    file: RawFile
    raw: tuple[str, ...]
    standard: tuple[str, ...]

    @property
    def mapping(self) -> str:
        return ", ".join(f"{a}->{b}" for a, b in zip(self.raw, self.standard))


def _header_reader(most: int | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The task function of the header job. Defined inside so that it travels by value: workers
    need not have this package installed.

    most: the task gets the first lines of one or more files, so many of each at most, and not the whole
    of one file. A first record that goes on beyond them gives its path without cells.
    """

    class Unended(Exception):
        pass

    def record(lines: Iterator[tuple[str, str]]) -> list[str] | None:
        """First CSV record of one file. One that cannot be read (a quote that never closes) is none."""

        def cleaned() -> Iterator[str]:
            seen = 0
            for seen, (_, line) in enumerate(lines, 1):
                yield line.lstrip("\ufeff") + "\n"
            if seen == most:
                raise Unended

        try:
            return next((cells for cells in csv.reader(cleaned()) if cells), None)
        except csv.Error:
            return None

    def first_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in zip(batch["path"], batch["value"]))
        for path, lines in groupby(rows, key=itemgetter(0)):
            try:
                header = record(lines)
            except Unended:
                yield pd.DataFrame({"path": [path], "cells": [None]})
            else:
                if header is not None:
                    yield pd.DataFrame({"path": [path], "cells": [header]})
            if most is None:
                return

    return first_records


def _whole_headers(job: SparkSession, files: list[RawFile]) -> dict[str, list[str]]:
    """Header cells by path; every file is read whole by one task."""
    text_rows = job.read.text([literal_path(f.path) for f in files]).where("_metadata.file_block_start = 0")
    lines = text_rows.select(F.col("_metadata.file_path").alias("path"), "value")
    found = lines.mapInPandas(_header_reader(), "path string, cells array<string>").collect()
    return {plain_path(r["path"]): r["cells"] for r in found}


def _first_headers(job: SparkSession, files: list[RawFile]) -> dict[str, list[str]]:
    """Header cells by path, from the first lines of every file.

    A task in Python is fed its whole input even if it stops at the first row, so the limit comes before
    it. Files whose first record goes on beyond the limit are looked at again with more lines.
    """
    cells: dict[str, list[str]] = {}
    most, left = _FIRST_LINES, files
    while left:
        longer = []
        job.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(most, 1024)))
        for i in range(0, len(left), _FILES_PER_JOB):
            some = left[i : i + _FILES_PER_JOB]
            heads = [job.read.text(literal_path(f.path)).select(F.col("_metadata.file_path").alias("path"), "value").limit(most) for f in some]
            rows = reduce(DataFrame.unionAll, heads).mapInPandas(_header_reader(most), "path string, cells array<string>").collect()
            found = {plain_path(r["path"]): r["cells"] for r in rows}
            cells.update({p: c for p, c in found.items() if c is not None})
            longer += [f for f in some if f.path in found and found[f.path] is None]
        most, left = most * _MORE, longer
    return cells


def read_headers(spark: SparkSession, files: list[RawFile]) -> tuple[list[FileHeader], list[RawFile]]:
    """Header of every file, and the files that have none.

    The header jobs run in their own session: their settings (one file per task, small batches) must
    not touch the caller's. Of a large file only the first lines are read, so no task reads more than
    a small file.
    """
    if not files:
        return [], []
    job = spark.newSession()
    job.conf.set("spark.sql.files.maxPartitionBytes", _WHOLE_FILE)
    job.conf.set("spark.sql.files.openCostInBytes", _WHOLE_FILE)
    job.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    small = [f for f in files if f.size <= _SMALL_FILE]
    cells = _whole_headers(job, small) if small else {}
    cells.update(_first_headers(job, [f for f in files if f.size > _SMALL_FILE]))
    headers, empty = [], []
    for file in files:
        if file.path in cells:
            raw = text.header_names(cells[file.path])
            headers.append(FileHeader(file, tuple(raw), tuple(text.standard_names(raw))))
        else:
            empty.append(file)
    return headers, empty


def header_groups(headers: list[FileHeader]) -> dict[tuple[str, ...], list[FileHeader]]:
    """Files that can share one read: same standardised columns in the same order."""
    groups: dict[tuple[str, ...], list[FileHeader]] = {}
    for header in headers:
        groups.setdefault(header.standard, []).append(header)
    return groups


def _malformed(record: Column, width: int) -> Column:
    """Whether a record has too many fields, or a quote that never closes.

    Spark marks short records too; those are fine, their missing cells are null. An open quote
    means a line break inside a cell, which needs the multi_line option of the dataset.
    """
    commas = F.regexp_count(F.regexp_replace(record, '"([^"]|"")*"', ""), F.lit(","))
    quotes = F.length(record) - F.length(F.replace(record, F.lit('"'), F.lit("")))
    return F.coalesce((commas + 1 > width) | (quotes % 2 == 1), F.lit(False))


def read_group(
    spark: SparkSession, columns: tuple[str, ...], paths: list[str], multi_line: bool = False
) -> DataFrame:
    """Rows of files with the same columns: text cells, source file, row ordinal, malformed flag.

    The row ordinal (start of the block, running number) restores file order within a source file.
    """
    fields = [T.StructField(c, T.StringType()) for c in (*columns, CORRUPT)]
    rows = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        # A pruned reader would not see surplus fields.
        .option("columnPruning", False)
        .csv([literal_path(p) for p in paths])
    )
    ordinal = F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")
    )
    # Spark refuses queries that use nothing but the raw record, such as a count of the good rows;
    # the empty prefix of a cell makes the flag use one data column too.
    record = F.concat(F.col(CORRUPT), F.left(F.coalesce(F.col(f"`{columns[0]}`"), F.lit("")), F.lit(0)))
    return rows.select(
        *[text.null_tokens(F.col(f"`{c}`")).alias(c) for c in columns if c not in (SOURCE_FILE, ROW_ORDINAL)],
        decoded_name().alias(SOURCE_FILE),
        ordinal.alias(ROW_ORDINAL),
        _malformed(record, len(columns)).alias(MALFORMED),
    )
