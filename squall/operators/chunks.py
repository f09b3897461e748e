"""Real-time chunks: maps from patterns to chunks, timing history and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squall.functions import names, timing


def chunk_map(cuts: DataFrame) -> DataFrame:
    """cuts(volume_id, cut_no from 1, half_degree, rate, elevation_deg): one row per chunk, the metadata chunk (sequence 1) included."""
    along = Window.partitionBy("volume_id").orderBy("cut_no")
    n = F.when(F.col("half_degree"), timing.CHUNKS_HALF_DEGREE).otherwise(timing.CHUNKS_WHOLE_DEGREE)
    cuts = cuts.withColumn("chunks_in_sweep", n).withColumn("start_seq", F.coalesce(F.sum("chunks_in_sweep").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 2)
    cuts = cuts.withColumn("end_seq", F.col("start_seq") + F.col("chunks_in_sweep") - 1)
    radial = cuts.select(
        "volume_id", F.explode(F.sequence(F.col("start_seq").cast("int"), F.col("end_seq").cast("int"))).alias("sequence"), F.col("cut_no").cast("int").alias("elevation_number"), "chunks_in_sweep",
        "start_seq", "end_seq", "rate", "elevation_deg",
    )
    radial = radial.select(
        "volume_id", "sequence", "elevation_number", (F.col("sequence") - F.col("start_seq")).cast("int").alias("chunk_index"), F.col("chunks_in_sweep").cast("int").alias("chunks_in_sweep"),
        (F.col("sequence") == F.col("start_seq")).alias("is_first"), (F.col("sequence") == F.col("end_seq")).alias("is_last"), "rate", "elevation_deg", F.lit(False).alias("is_start"),
    )
    start = cuts.groupBy("volume_id").agg(F.lit(1).alias("sequence")).select(
        "volume_id", "sequence", F.lit(None).cast("int").alias("elevation_number"), F.lit(0).alias("chunk_index"), F.lit(1).alias("chunks_in_sweep"), F.lit(False).alias("is_first"),
        F.lit(False).alias("is_last"), F.lit(0.0).alias("rate"), F.lit(0.0).alias("elevation_deg"), F.lit(True).alias("is_start"),
    )
    return start.unionByName(radial)


def cut_of_chunk(chunks: DataFrame, cuts: DataFrame) -> DataFrame:
    """chunks(volume_id, sequence) with the cut whose range of sequences holds it."""
    ranges = cuts.select(F.col("volume_id").alias("_v"), "elevation_number", "start_seq", "end_seq")
    return chunks.join(ranges, (F.col("volume_id") == F.col("_v")) & F.col("sequence").between(F.col("start_seq"), F.col("end_seq")), "left").drop("_v")


def timing_history(samples: DataFrame, order: str = "ts") -> DataFrame:
    """samples(chunk_type, waveform, phase, ts, ms, attempts) with the mean over the last ten of the same kind: whole milliseconds, attempts."""
    last = Window.partitionBy("chunk_type", "waveform", "phase").orderBy(order).rowsBetween(-(timing.WINDOW - 1), 0)
    return samples.withColumns(
        {"average_ms": F.floor(F.sum("ms").over(last) / F.count("ms").over(last)).cast("long"), "average_attempts": F.avg("attempts").over(last), "n_samples": F.count(F.lit(1)).over(last)}
    )


def timing_statistics(samples: DataFrame, order: str = "ts", parts: int = 64) -> DataFrame:
    """Per kind, what the last ten samples give.

    There are few kinds, so each kind's newest are found in parts first: no task sees more than a part of a kind, or ten a part.
    """
    kind = ["chunk_type", "waveform", "phase"]

    def newest(df: DataFrame, *by: str) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(*kind, *by).orderBy(F.desc(order)))
        return df.withColumn("_n", number).where(F.col("_n") <= timing.WINDOW).drop("_n")

    kept = newest(newest(samples.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(parts))), "_part"))
    return kept.groupBy(*kind).agg(
        F.floor(F.sum("ms") / F.count(F.lit(1))).cast("long").alias("average_ms"), F.avg("attempts").alias("average_attempts"), F.count(F.lit(1)).alias("n_samples")
    )


def project(chunks: DataFrame, anchor_sequence: int = 1, history_ms: str | None = None) -> DataFrame:
    """chunk_map rows after the anchor with interval_ms and offset_ms from it (truncated per chunk, then summed).

    Volumes whose anchor is their last chunk have nothing to project.
    """
    along = Window.partitionBy("volume_id").orderBy("sequence")
    physics = timing.chunk_interval(F.col("is_start"), F.col("is_first"), F.col("rate"), F.col("chunks_in_sweep"), F.lag("elevation_deg").over(along), F.col("elevation_deg"))
    seconds = timing.blended(physics, F.col(history_ms)) if history_ms else physics
    out = chunks.withColumn("interval_ms", timing.whole_millis(seconds)).where(F.col("sequence") > anchor_sequence)
    return out.withColumn("offset_ms", F.sum("interval_ms").over(along.rowsBetween(Window.unboundedPreceding, 0)))


def volume_end(projected: DataFrame) -> DataFrame:
    return projected.groupBy("volume_id").agg(F.max("offset_ms").alias("remaining_ms"), F.max("sequence").alias("final_sequence"))


def newest_at_most(slots: DataFrame, target=None) -> DataFrame:
    """slots(site, idx, value): per site the index of the greatest value, at most the target where one is given; holes (null) are passed over.
    Equal values: the greatest index."""
    have = slots.where(F.col("value").isNotNull())
    if target is not None:
        have = have.where(F.col("value") <= target)
    return have.groupBy("site").agg(F.max(F.struct("value", "idx")).alias("top")).select("site", F.col("top.idx").alias("idx"), F.col("top.value").alias("value"))


def stream_start(chunks: DataFrame) -> DataFrame:
    """chunks(site, volume, sequence, chunk_type, time_ms): where to join each site's feed.

    (site, volume, sequence, chunk_type, time_ms) of the newest chunk of the newest volume, and whether the volume is joined
    in its midst, so that its start chunk (sequence 1) has to be fetched too.
    """
    newest = F.max(F.struct("time_ms", "volume", "sequence", "chunk_type")).alias("top")
    out = chunks.groupBy("site").agg(newest).select("site", "top.volume", "top.sequence", "top.chunk_type", "top.time_ms")
    return out.withColumn("joined_midway", F.col("chunk_type") != "Start")


def next_chunks(current: DataFrame, chunk_map_: DataFrame, history_ms: str | None = None) -> DataFrame:
    """current(site, volume, volume_id, sequence, chunk_type, time_ms) with what follows: next_volume, next_sequence, next_type and expected_ms.

    chunk_map_ has the chunks of each volume_id's pattern.  The wait is the gap between volumes behind a start chunk, else the
    history where there is one, else the timing model.
    """
    along = Window.partitionBy("volume_id").orderBy("sequence")
    physics = timing.chunk_interval(F.lit(False), F.col("is_first"), F.col("rate"), F.col("chunks_in_sweep"), F.lag("elevation_deg").over(along), F.col("elevation_deg"))
    waits = chunk_map_.select(F.col("volume_id").alias("_v"), F.col("sequence").alias("_s"), timing.whole_millis(physics).alias("_ms"), F.max("sequence").over(Window.partitionBy("volume_id")).alias("_final"))
    finals = waits.groupBy("_v").agg(F.first("_final").alias("final_sequence")).withColumnRenamed("_v", "_f")
    out = current.join(finals, F.col("volume_id") == F.col("_f"), "left").drop("_f")
    out = out.join(waits.drop("_final"), (F.col("volume_id") == F.col("_v")) & (F.col("sequence") + 1 == F.col("_s")), "left")
    after = names.next_chunk(F.col("sequence"), F.col("final_sequence"))
    wait = F.coalesce(F.col(history_ms), F.col("_ms")) if history_ms else F.col("_ms")
    wait = F.when(F.col("chunk_type") == "Start", F.lit(int(timing.VOLUME_GAP_S * 1000)).cast("long")).otherwise(wait)
    return out.select(
        *current.columns, F.when(after["next_volume"], names.next_volume(F.col("volume"))).otherwise(F.col("volume")).alias("next_volume"), after["next_sequence"].alias("next_sequence"),
        F.when(after["next_volume"], "S").otherwise(after["next_type"]).alias("next_type"), (F.col("time_ms") + wait).alias("expected_ms"),
    )
