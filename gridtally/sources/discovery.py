"""Listing of raw files by name pattern."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridtally.spec import DatasetSpec


@dataclass(frozen=True, order=True)
class RawFile:
    path: str
    size: int

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]


def spelled_path(path: str) -> str:
    """Path with one spelling of the local scheme."""
    return "file:/" + path[len("file:///") :] if path.startswith("file:///") else path


def literal_path(path: str) -> str:
    """Path as a reader argument: glob characters in a file name stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def plain_path(uri: str) -> str:
    """Decoded path of a URI."""
    return spelled_path(unquote(uri))


def list_files(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> list[RawFile]:
    """Files of a directory (or explicit paths), with sizes. Names only; no content is read.

    Spark leaves empty files out of a scan, so the names come from the file index and the sizes
    from the scan; a file without a size is empty.
    """
    reader = spark.read.format("binaryFile")
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    try:
        listing = reader.load(paths)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    # The scan reports decoded paths, the index encoded ones.
    sizes = {spelled_path(r["path"]): r["length"] for r in listing.select("path", "length").collect()}
    return sorted(RawFile(p, sizes.get(p, 0)) for p in {plain_path(u) for u in listing.inputFiles()})


def discover(spark: SparkSession, raw_uri: str, specs: Iterable[DatasetSpec]) -> dict[str, list[RawFile]]:
    """Files of each dataset: not recursive, without repeats, sorted. A file may serve two datasets."""
    found: dict[str, list[RawFile]] = {}
    for spec in specs:
        files = {f for pattern in spec.file_patterns for f in list_files(spark, raw_uri, pattern)}
        found[spec.name] = sorted(f for f in files if _in_directory(f.path, raw_uri))
    return found


def _in_directory(path: str, directory: str) -> bool:
    """Whether a file lies directly in the directory (partition folders are not searched)."""
    parent = path.rsplit("/", 1)[0].split(":", 1)[-1]
    wanted = posixpath.normpath(directory.split(":", 1)[-1])
    while wanted.startswith("../"):
        wanted = wanted[3:]
    return wanted == "." or parent.strip("/").endswith(wanted.strip("/"))


def decoded_name() -> Column:
    """Name of the file a row was read from. File metadata is URI-encoded ('a%20b.csv')."""
    name = F.col("_metadata.file_name")
    plus_kept = F.replace(name, F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(name, F.lit("%")), F.url_decode(plus_kept)).otherwise(name)
