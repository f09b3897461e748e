"""Radar relations over the general test tables, in Spark and in DuckDB's SQL.

embeddings become sweeps (a label is a tilt, a vector a radial, an element a
gate), events real-time chunks and messages, parts coverage patterns, orders
status words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squall.functions import wire
from squall.operators import fields as FL
from squall.shipping import ship

FIRST_KM, STEP_KM = 2.0, 0.25


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys over all cores: a file of one row group is one task's, however much is made of each row."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def radials(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label")
    e = read(spark, d, "embeddings").withColumns({"az_idx": (F.row_number().over(w.orderBy("vec_id")) - 1).cast("int"), "n_az": F.count(F.lit(1)).over(w)})
    return e.select(
        F.lit("emb").alias("volume_id"), F.col("label").alias("sweep_idx"), (F.col("label") + 1).alias("elevation_number"), (F.lit(0.5) + F.col("label") * 0.5).alias("elevation_deg"),
        "az_idx", "n_az", (F.col("az_idx") * 360.0 / F.col("n_az")).alias("azimuth_deg"), (F.lit(360.0) / F.col("n_az")).alias("az_spacing_deg"), "vec_id", "embedding",
    )


R = """(select 'emb' volume_id, label sweep_idx, label + 1 elevation_number, 0.5e0 + label * 0.5e0 elevation_deg, az_idx, n_az, az_idx * 360e0 / n_az azimuth_deg,
 360e0 / n_az az_spacing_deg, vec_id, embedding from (select *, (row_number() over (partition by label order by vec_id) - 1)::int az_idx, count(*) over (partition by label) n_az from embeddings))"""


def raw_gates(spark: SparkSession, d: str) -> DataFrame:
    r = radials(spark, d).select("volume_id", "sweep_idx", "elevation_deg", "az_idx", "azimuth_deg", "az_spacing_deg", F.posexplode("embedding").alias("gate_idx", "x"))
    x = F.abs(F.col("x").cast("double"))
    return r.select(
        "volume_id", "sweep_idx", "elevation_deg", "az_idx", "azimuth_deg", "az_spacing_deg", "gate_idx", F.lit(FIRST_KM).alias("first_gate_km"), F.lit(STEP_KM).alias("gate_interval_km"),
        F.floor(x * 400.0).cast("int").alias("raw"), (F.floor(x * 1000.0) % 256).cast("int").alias("raw2"),
    )


RAW = f"""(select volume_id, sweep_idx, elevation_deg, az_idx, azimuth_deg, az_spacing_deg, (g - 1)::int gate_idx, 2e0 first_gate_km, 0.25e0 gate_interval_km,
 floor(abs(embedding[g]::double) * 400e0)::int raw, (floor(abs(embedding[g]::double) * 1000e0) % 256)::int raw2 from {R}, range(1, 65) t(g))"""


def gates(spark: SparkSession, d: str) -> DataFrame:
    """Reflectivity: scale 2, offset 66."""
    g = raw_gates(spark, d)
    return g.withColumns({"value": FL.moment_value(F.col("raw"), 2.0, 66.0), "status": FL.moment_status(F.col("raw"), 2.0)}).drop("raw", "raw2")


GATES = f"""(select * exclude (raw, raw2), case when raw >= 2 then (raw - 66e0) / 2e0 end as value,
 case raw when 0 then 'BelowThreshold' when 1 then 'RangeFolded' else 'Valid' end status from {RAW})"""


def correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation: raw2 / 255, every seventh gate without data."""
    g = raw_gates(spark, d)
    none = F.col("gate_idx") % 7 == 6
    return g.withColumns({"value": F.when(~none, F.col("raw2") / 255.0), "status": F.when(none, FL.NO_DATA).otherwise(FL.VALID)}).drop("raw", "raw2")


CORRELATION = f"""(select * exclude (raw, raw2), case when gate_idx % 7 <> 6 then raw2 / 255e0 end as value, case when gate_idx % 7 = 6 then 'NoData' else 'Valid' end status from {RAW})"""


def cuts(spark: SparkSession, d: str) -> DataFrame:
    """Coverage patterns of twenty cuts from parts."""
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        F.floor(k / 20).alias("volume_id"), (k % 20 + 1).alias("cut_no"), (k * 37 % 65536).alias("angle_raw"), (k * 8191 % 65536).alias("rate_raw"), (k * 2654435 % 65536).alias("flags_raw"),
        (k * 40503 % 65536).alias("sequencing_raw"), (k % 7).alias("waveform_raw"), (k % 4).alias("channel_raw"), (F.col("p_size") % 2 == 1).alias("half_degree"),
    ).withColumns({"elevation_deg": wire.decode_angle(F.col("angle_raw")), "rate": F.abs(wire.decode_angular_velocity(F.col("rate_raw")))})


CUTS = """(select *, (angle_raw & 65528) * 180e0 / 32768e0 elevation_deg, (rate_raw & 32760) * 22.5e0 / 16384e0 rate from (select p_partkey // 20 volume_id, p_partkey % 20 + 1 cut_no,
 p_partkey * 37 % 65536 angle_raw, p_partkey * 8191 % 65536 rate_raw, p_partkey * 2654435 % 65536 flags_raw, p_partkey * 40503 % 65536 sequencing_raw, p_partkey % 7 waveform_raw,
 p_partkey % 4 channel_raw, p_size % 2 = 1 half_degree from part))"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Real-time chunks of each user, in order of time."""
    e = read(spark, d, "events")
    letter = F.when(F.col("event_type") == "signup", "S").when(F.col("event_type") == "error", "E").otherwise("I")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        "event_id", F.col("user_id").alias("site"), "ts", "event_type", "value", letter.alias("letter"), F.row_number().over(w).alias("sequence"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"),
    )


CHUNKS = """(select event_id, user_id site, ts, event_type, value, case event_type when 'signup' then 'S' when 'error' then 'E' else 'I' end letter,
 row_number() over (partition by user_id order by ts, event_id) as sequence, epoch_us(ts) // 1000 time_ms from events)"""

_KINDS = {"click": "RDADigitalRadarDataGenericFormat", "view": "RDADigitalRadarDataGenericFormat", "purchase": "RDAStatusData", "signup": "RDAVolumeCoveragePattern"}


def messages(spark: SparkSession, d: str) -> DataFrame:
    """A message stream per user: clicks and views are radials, purchases status, signups patterns, errors log data."""
    e = chunks(spark, d)
    return e.select(
        F.col("site").alias("volume_id"), F.col("event_id").alias("ordinal"), wire.label(F.col("event_type"), _KINDS, "RDALogData").alias("message_type"),
        F.floor(F.col("event_id") / 4 % 2).cast("int").alias("elevation_number"), "time_ms", F.when(F.col("event_type") == "click", F.col("value")).alias("reflectivity"),
    )


MESSAGES = f"""(select site volume_id, event_id ordinal, case when event_type in ('click', 'view') then 'RDADigitalRadarDataGenericFormat' when event_type = 'purchase' then 'RDAStatusData'
 when event_type = 'signup' then 'RDAVolumeCoveragePattern' else 'RDALogData' end message_type, (event_id // 4 % 2)::int elevation_number, time_ms,
 case when event_type = 'click' then value end reflectivity from {CHUNKS})"""


def words(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen-bit words from order keys."""
    o = read(spark, d, "orders")
    return o.select("o_orderkey", (F.col("o_orderkey") % 65536).cast("int").alias("w"), (F.col("o_orderkey") * 7919 % 65536).cast("int").alias("v"), (F.col("o_orderkey") % 66).cast("int").alias("c"))


WORDS = "(select o_orderkey, (o_orderkey % 65536)::int w, (o_orderkey * 7919 % 65536)::int v, (o_orderkey % 66)::int c from orders)"


def archives(spark: SparkSession, d: str) -> DataFrame:
    """Archive names from event times: one site per user of ten."""
    e = read(spark, d, "events").withColumn("site", F.concat(F.lit("K"), F.lpad((F.col("user_id") % 10).cast("string"), 3, "A")))
    ending = F.when(F.col("event_id") % 11 == 0, "_V06_MDM").otherwise("_V06")
    return e.select("event_id", "site", "ts", F.concat("site", F.date_format("ts", "yyyyMMdd_HHmmss"), ending).alias("name"))


ARCHIVES = """(select event_id, site, ts, site || strftime(ts, '%Y%m%d_%H%M%S') || case when event_id % 11 = 0 then '_V06_MDM' else '_V06' end as name
 from (select *, 'K' || lpad((user_id % 10)::varchar, 3, 'A') site from events))"""
