"""Rollups and key figures kept up batch by batch, without reading old rows.

Every batch adds partial aggregates: for each rollup, source file and key the number of rows, the
number and sums of the measures, and the ends of the time span. They merge by adding and comparing, so
a figure over all batches is an aggregate of these rows alone. Small folders are merged as they add up.
A batch that is replayed replaces what it added before. A list of live files leaves out what came from
file versions that have been replaced since (see `refresh`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.functions.numbers import mean, total
from gridtally.plans.ingest_job import shared_folder
from gridtally.sinks import versioned
from gridtally.sinks.versioned import Part
from gridtally.spec import SOURCE_FILE, DatasetSpec

MOST_PARTS = 16
_KEYS = ["rollup", "key1", "key2", "source", "batch"]


def rollups_of(spec: DatasetSpec) -> dict[str, tuple[str, ...]]:
    """Names of the dataset's rollups, and the columns each is grouped by."""
    found = {"day": (spec.date.date,), "source": (SOURCE_FILE,)}
    found.update({f"by_{key}": (key,) for key in spec.candidate_keys})
    found["entity_day"] = (spec.entity, spec.date.date)
    found.update({f"{key}_source": (key, SOURCE_FILE) for key in spec.candidate_keys})
    if spec.date.style == "classified":
        found["hour"] = (spec.date.analysis_hour,)
    if spec.category:
        found["category"] = (spec.category,)
    return found


def _sum_type(spec: DatasetSpec) -> T.DataType:
    return T.DoubleType() if spec.measure_scale is None else T.DecimalType(38, spec.measure_scale)


def state_schema(spec: DatasetSpec) -> T.StructType:
    kind = _sum_type(spec).simpleString()
    return T.StructType.fromDDL(
        "rollup string, key1 string, key2 string, source string, batch bigint, rows bigint, counted bigint, "
        f"total {kind}, second_total {kind}, low timestamp_ntz, high timestamp_ntz, flagged bigint")


def _sum(column: Column, spec: DatasetSpec) -> Column:
    value = column if spec.measure_scale is None else column.cast(T.DecimalType(18, spec.measure_scale))
    return F.coalesce(F.sum(value), F.lit(0)).cast(_sum_type(spec))


def _needed(table: DataFrame, spec: DatasetSpec) -> list[str]:
    """The columns that rollups read."""
    names = {SOURCE_FILE, spec.measure, spec.second_measure, spec.date.parsed, spec.date.is_time_only, *(k for keys in rollups_of(spec).values() for k in keys)}
    return [c for c in table.columns if c in names]


def partials(table: DataFrame, spec: DatasetSpec, batch: int) -> DataFrame:
    """The partial aggregates of a batch. Each rollup reads its own few columns of the table.

    Rollups that come to the same groups, as the source file is always one of their keys, are one aggregate.
    """

    def of(name: str) -> Column:
        return F.col(name) if name in table.columns else F.lit(None)

    flag = spec.date.is_time_only
    groups: dict[frozenset[str], list[tuple[str, tuple[str, ...]]]] = {}
    for rollup, keys in rollups_of(spec).items():
        groups.setdefault(frozenset((*keys, SOURCE_FILE)), []).append((rollup, keys))
    parts = []
    for alike in groups.values():
        names = list(dict.fromkeys(k for _, keys in alike for k in (*keys, SOURCE_FILE)))
        cells = {k: f"group{i}" for i, k in enumerate(names)}
        kinds = [F.struct(F.lit(rollup).alias("rollup"), *[(F.col(cells[keys[i]]) if i < len(keys) else F.lit(None).cast("string")).alias(f"key{i + 1}") for i in range(2)])
                 for rollup, keys in alike]
        parts.append(table.groupBy(*[of(k).cast("string").alias(c) for k, c in cells.items()]).agg(
            F.count(F.lit(1)).alias("rows"), F.count(of(spec.measure)).alias("counted"),
            _sum(of(spec.measure), spec).alias("total"), _sum(of(spec.second_measure or spec.measure), spec).alias("second_total"),
            F.min(of(spec.date.parsed).cast("timestamp_ntz")).alias("low"), F.max(of(spec.date.parsed).cast("timestamp_ntz")).alias("high"),
            (F.count_if(F.col(flag)) if flag in table.columns else F.lit(0).cast("bigint")).alias("flagged"),
        ).select(F.explode(F.array(*kinds)).alias("kind"), "*").select("kind.*", F.col(cells[SOURCE_FILE]).alias("source"), F.lit(batch).cast("bigint").alias("batch"),
                 "rows", "counted", "total", "second_total", "low", "high", "flagged"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select(*state_schema(spec).names)


def _merged(rows: DataFrame, keys: list[str], spec: DatasetSpec) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("counted").alias("counted"),
        *[F.sum(c).cast(_sum_type(spec)).alias(c) for c in ("total", "second_total")],
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("flagged").alias("flagged"))


def update(spark: SparkSession, spec: DatasetSpec, uri: str, batch: int, table: DataFrame, live: DataFrame | None = None, most_parts: int = MOST_PARTS) -> None:
    """Add the partial aggregates of a batch; `table` holds the rows of this batch only.

    live: (file, batch_id) as in `refresh.live_files`; merging then drops what no longer counts.
    """
    before = versioned.current(spark, uri)
    older = [p for p in before.parts if p.high < batch]
    schema = state_schema(spec)
    if len(older) > most_parts:
        rows = _counting(versioned.read(spark, versioned.Version(0, tuple(older)), schema), live)
        folder = versioned.new_folder(uri)
        _merged(rows, _KEYS, spec).select(*schema.names).sort(*_KEYS).write.parquet(folder)
        older = [Part(folder, None, min(p.low for p in older), max(p.high for p in older))]
    # The rollups read the batch's rows once each; what made the rows is run once.
    staged = f"{shared_folder(spark, uri.rstrip('/') + '_stage')}/rollup-{uuid.uuid4()}"
    narrow = table.select(*_needed(table, spec))
    narrow.write.parquet(staged)
    table = spark.read.schema(narrow.schema).parquet(staged)
    folder = versioned.new_folder(uri)
    # In the order of the keys, so that a reader of one rollup skips the others' row groups.
    partials(table, spec, batch).sortWithinPartitions(*_KEYS).write.parquet(folder)
    versioned.publish(spark, uri, before, [*older, Part(folder, None, batch, batch)], schema)


def _counting(rows: DataFrame, live: DataFrame | None) -> DataFrame:
    if live is None:
        return rows
    names = live.select(F.col("file").alias("source"), F.col("batch_id").cast("bigint").alias("batch"))
    return rows.join(names, ["source", "batch"], "left_semi").select(*rows.columns)


class State:
    """Figures read from the state of a dataset. `live` as in `update`."""

    def __init__(self, spark: SparkSession, spec: DatasetSpec, uri: str, live: DataFrame | None = None) -> None:
        self.spec = spec
        self.rows = _counting(versioned.read(spark, versioned.current(spark, uri), state_schema(spec)), live)

    def rollup(self, name: str, sources: bool = False) -> DataFrame:
        """One row per key of a rollup, null keys included, with the columns' own names."""
        keys = rollups_of(self.spec)[name]
        columns = [f"key{i}" for i in range(1, len(keys) + 1)]
        found = _merged(self.rows.where(F.col("rollup") == name), columns, self.spec)
        kinds = {f.name: f.dataType for f in self.spec.struct_type()}
        kinds[SOURCE_FILE] = T.StringType()
        typed = [F.col(c).cast(kinds.get(k, T.StringType())).alias(k) for c, k in zip(columns, keys, strict=True)]
        return found.select(*typed, *[c for c in found.columns if c not in columns])

    def totals(self, name: str) -> DataFrame:
        """Sum of the measure per key, rows with a null key left out."""
        keys = rollups_of(self.spec)[name]
        found = self.rollup(name)
        for key in keys:
            found = found.where(F.col(key).isNotNull())
        return found.select(*keys, F.col("total").cast("double").alias("total_value"))

    def daily_total(self) -> DataFrame:
        return self.totals("day").orderBy(self.spec.date.date)

    def daily_total_by_entity(self) -> DataFrame:
        return self.totals("entity_day")

    def top_entities(self, k: int = 10) -> DataFrame:
        return self.totals(f"by_{self.spec.entity}").orderBy(F.desc("total_value"), F.asc(self.spec.entity)).limit(k)

    def amount_by_source(self) -> DataFrame:
        return self.totals("source").orderBy(F.desc("total_value"), F.asc(SOURCE_FILE))

    def source_breakdown(self, entity: str) -> DataFrame:
        return self.totals(f"{entity}_source")

    def hourly_profile(self) -> DataFrame:
        return self.totals("hour").orderBy(self.spec.date.analysis_hour)

    def category_breakdown(self) -> DataFrame:
        category = self.spec.category
        found = self.rollup("category").where(F.col(category).isNotNull())
        return found.select(category, F.col("total").cast("double").alias("sum"), F.col("counted").alias("count")).orderBy(F.desc("sum"), F.asc(category))

    def _distinct(self, key: str) -> Column:
        # The key's rows are folded first; there is one per source file and key.
        keys = self.rows.where((F.col("rollup") == f"by_{key}") & F.col("key1").isNotNull()).select("key1").distinct()
        return keys.agg(F.count(F.lit(1)).alias("n")).scalar()

    def kpis(self) -> DataFrame:
        """The one-row key figures of the dataset, as `operators.kpis` computes them from all rows."""
        days, spec = self.rollup("day"), self.spec
        if spec.date.style == "full":
            scale = spec.measure_scale
            dated = F.when(F.col(spec.date.date).isNotNull(), F.col("total").cast("double"))
            return days.agg(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                total(F.col("total").cast("double"), scale).alias("total_kwh_consumption"),
                total(F.col("second_total").cast("double"), scale).alias("total_kvah_consumption"),
                mean(dated, scale).alias("average_daily_kwh"),
                F.coalesce(F.min(dated), F.lit(0.0)).alias("min_daily_kwh"), F.coalesce(F.max(dated), F.lit(0.0)).alias("max_daily_kwh"),
                F.min("low").alias("span_min"), F.max("high").alias("span_max"),
            ).withColumn("unique_meters", self._distinct(spec.entity))
        amount = F.coalesce(F.sum("total").cast("double"), F.lit(0.0))
        return days.agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("rows"), F.lit(0)).alias("transactions"),
            amount.alias("total_transaction_amount"),
            F.coalesce(amount / F.nullif(F.sum("counted"), F.lit(0)), F.lit(0.0)).alias("average_transaction_amount"),
            F.coalesce(F.sum("flagged"), F.lit(0)).alias("time_only_rows"), F.min("low").alias("span_min"), F.max("high").alias("span_max"),
        ).withColumns({"unique_service_points": self._distinct("servicepointno"), "unique_meters": self._distinct("meterno")})
