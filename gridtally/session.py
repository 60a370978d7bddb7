"""Session settings the jobs are written for. Any session works; these are the sensible ones."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Texts are rendered in UTC; the typed timestamps themselves have no zone.
    "spark.sql.session.timeZone": "UTC",
    # Many small shuffle partitions at first; adaptive execution merges them to about 128 MB and
    # splits the skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # Few, larger input splits keep the number of output files of a CSV ingest down.
    "spark.sql.files.maxPartitionBytes": "512m",
    # A batch job may be large; do not let the driver's result limit grow with it.
    "spark.driver.maxResultSize": "2g",
    "spark.sql.parquet.filterPushdown": "true",
}


def cluster_session(app: str, shuffle_partitions: int) -> SparkSession:
    """Session for a cluster job. A good start for the partitions is two to three per core."""
    builder = SparkSession.builder.appName(app).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
