"""The given tables seen as metered readings and payments, for the registered queries."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.operators.transforms import transform
from gridtally.plans.ingest_job import scratch_folder
from gridtally.spec import CONSUMPTION, VEND

# Measures of the given tables have two decimals.
READINGS = replace(CONSUMPTION, measure_scale=2)
PAYMENTS = replace(VEND, measure_scale=2)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as typed readings: supplier as meter, quantity and price as the two measures."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("mtrid"),
        F.col("l_quantity").alias("kwh_consumption"),
        F.col("l_extendedprice").alias("kvah_consumption"),
        F.col("l_shipdate").alias("midnightdate_parsed"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_linestatus").alias("source_file"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as typed payments: customer as meter, priority as category, status as file."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("payment_id"),
        (F.col("o_custkey") % 40).alias("servicepointno"),
        F.col("o_custkey").alias("meterno"),
        F.col("o_orderpriority").alias("categorycode"),
        F.col("o_totalprice").alias("transactionamount"),
        F.col("o_orderdate").alias("issuedate_parsed"),
        F.to_date("o_orderdate").alias("vend_date"),
        F.col("o_orderstatus").alias("source_file"),
    )


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: what the pipeline checks and queries."""
    uri = f"{scratch_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(uri)
    return df.sparkSession.read.parquet(uri)


def _every(divisor: int, rest: int = 0) -> Column:
    return F.col("event_id") % divisor == rest


def raw_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an untyped extract: padded cells, bad numbers, five kinds of date text."""
    day = F.to_date("ts").cast("string")
    clock = F.date_format("ts", "HH:mm")
    padded = F.concat(F.lit("  "), F.col("value").cast("string"), F.lit(" \t"))
    return load(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 40).cast("string").alias("servicepointno"),
        F.when(~_every(19), F.concat(F.lit("  "), F.col("user_id").cast("string"))).alias("meterno"),
        F.when(~_every(17), F.col("event_type")).alias("categorycode"),
        F.when(_every(13), "abc")
        .when(_every(13, 1), "1.5d")
        .when(_every(13, 2), padded)
        .when(_every(13, 3), "-3.25")
        .when(_every(13, 4), "0")
        .when(_every(13, 5), "+2e1")
        .otherwise(F.col("value").cast("string"))
        .alias("transactionamount"),
        F.when(_every(5), "")
        .when(_every(5, 1), clock)
        .when(_every(5, 2), "bad-date")
        .otherwise(F.concat(day, F.lit(" "), clock))
        .alias("issuedate"),
        F.concat(F.lit("file_"), (F.col("event_id") % 3).cast("string")).alias("source_file"),
    )


def typed_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(raw_payments(spark, sf_dir), PAYMENTS)


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as an untyped extract with three date layouts and unreadable dates."""
    key = F.col("l_orderkey")
    iso = F.to_date("l_shipdate").cast("string")
    month, day, year = (F.split_part(iso, F.lit("-"), F.lit(i)) for i in (2, 3, 1))
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_suppkey").cast("string").alias("mtrid"),
        F.when(key % 11 == 0, "not-a-date")
        .when(key % 11 == 1, F.concat_ws("/", month, day, year))
        .when(key % 11 == 2, F.concat(iso, F.lit(" 06:30:00")))
        .when(key % 11 != 3, iso)
        .alias("midnightdate"),
        F.col("l_quantity").cast("string").alias("kwh_consumption"),
        F.col("l_linestatus").alias("source_file"),
    )


def repeated_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payments in which every tenth row occurs twice and some of these three times; some lack a date."""
    rows = payments(spark, sf_dir).withColumns(
        {
            "issuedate_parsed": F.when(F.col("payment_id") % 30 != 0, F.col("issuedate_parsed")),
            "vend_date": F.when(F.col("payment_id") % 30 != 0, F.col("vend_date")),
        }
    )
    again = rows.where(F.col("payment_id") % 10 == 0)
    return rows.unionByName(again).unionByName(rows.where(F.col("payment_id") % 50 == 0))
