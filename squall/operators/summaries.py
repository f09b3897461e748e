"""Run-length summaries of message streams, and volume timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIAL = "RDADigitalRadarDataGenericFormat"
#: Types whose messages always stand alone.
SINGLE = ("RDAStatusData", "RDAVolumeCoveragePattern")


def message_runs(messages: DataFrame, order: str = "ordinal", partition: list[str] | None = None) -> DataFrame:
    """messages(volume_id, ordinal, message_type, elevation_number) with run: consecutive messages of one type
    (and, for radials, of one elevation); status and pattern messages never merge."""
    along = Window.partitionBy(*(partition or ["volume_id"])).orderBy(order)
    kind, elevation = F.col("message_type"), F.when(F.col("message_type") == RADIAL, F.col("elevation_number"))
    same = (F.lag(kind).over(along) == kind) & F.lag(elevation).over(along).eqNullSafe(elevation) & ~kind.isin(*SINGLE)
    return messages.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(along)).drop("_new")


def message_groups(messages: DataFrame, partition: list[str] | None = None, counts: tuple[str, ...] = ()) -> DataFrame:
    """One row per run: type, elevation, messages, first and last ordinal and time, is_continued, and how many messages have each of counts."""
    keys = partition or ["volume_id"]
    runs = message_runs(messages, partition=keys)
    elevation = F.when(F.col("message_type") == RADIAL, F.col("elevation_number"))
    groups = runs.groupBy(*keys, "run").agg(
        F.first("message_type").alias("message_type"), F.first(elevation).alias("elevation_number"), F.count(F.lit(1)).alias("message_count"),
        F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"),
        F.min_by("time_ms", "ordinal").alias("start_ms"), F.max_by("time_ms", "ordinal").alias("end_ms"), *[F.count(c).alias(f"n_{c}") for c in counts],
    )
    earlier = Window.partitionBy(*keys, "message_type", "elevation_number").orderBy("run")
    return groups.withColumn("is_continued", (F.col("message_type") == RADIAL) & (F.row_number().over(earlier) > 1))


def collection_times(messages: DataFrame) -> dict[str, Column]:
    """Aggregates: earliest (positive only) and latest time of radial and status messages."""
    timed = F.when(F.col("message_type").isin(RADIAL, "RDAStatusData"), F.col("time_ms"))
    return {"earliest_ms": F.min(F.when(timed > 0, timed)), "latest_ms": F.max(timed)}


def set_flags(**flags: Column) -> Column:
    """Names of the flags that are set, in the order given."""
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]))


def sweep_gaps(sweeps: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Adds gap_ms: from a sweep's last radial to the next one's first."""
    along = Window.partitionBy(*(partition or ["volume_id"])).orderBy("sweep_idx")
    return sweeps.withColumn("gap_ms", F.lead("first_ms").over(along) - F.col("last_ms"))


def timing_by_pattern(sweeps: DataFrame) -> DataFrame:
    """sweeps(volume_id, pattern, sweep_idx, first_ms, last_ms): durations and gaps per coverage pattern."""
    gaps = sweep_gaps(sweeps).withColumn("sweep_ms", F.col("last_ms") - F.col("first_ms"))
    volumes = gaps.groupBy("volume_id", "pattern").agg(
        (F.max("last_ms") - F.min("first_ms")).alias("volume_ms"), F.count(F.lit(1)).alias("n_sweeps"), F.sum("sweep_ms").alias("s"), F.min("sweep_ms").alias("s0"), F.max("sweep_ms").alias("s1"),
        F.sum("gap_ms").alias("g"), F.count("gap_ms").alias("n_gaps"), F.min("gap_ms").alias("g0"), F.max("gap_ms").alias("g1"),
    )
    return volumes.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n_volumes"), F.min("volume_ms").alias("min_volume_ms"), F.avg("volume_ms").alias("mean_volume_ms"), F.max("volume_ms").alias("max_volume_ms"),
        F.min("s0").alias("min_sweep_ms"), (F.sum("s") / F.sum("n_sweeps")).alias("mean_sweep_ms"), F.max("s1").alias("max_sweep_ms"),
        F.min("g0").alias("min_gap_ms"), (F.sum("g") / F.sum("n_gaps")).alias("mean_gap_ms"), F.max("g1").alias("max_gap_ms"),
    )
