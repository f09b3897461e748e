"""The engine's front door: open volumes, list and choose them, take fields out, find sites, follow a feed.

Roots are folders of any store that Spark reads, with volumes under
yyyy/mm/dd/SITE/name, as the public archive has them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.functions import names
from squall.functions.geo import RadarSite
from squall.functions.timing import DOWNLOAD_RETRY
from squall.operators import fields
from squall.operators.fields import MissingData
from squall.shipping import ship
from squall.sources import archive, listing, objects, stations
from squall.streaming import chunk_stream, feed, site_state

# ---- volumes ----


def load(spark: SparkSession, data: bytes, volume_id: str = "volume", mode: str = "FAILFAST") -> DataFrame:
    """Radials, with sweep_idx, of one volume's bytes."""
    return archive.scan(ship(spark).createDataFrame([(volume_id, bytearray(data))], "volume_id string, content binary"), mode)


def load_file(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Radials of a volume file, or of all under a folder or pattern."""
    return archive.load(spark, path, mode)


def list_scans(spark: SparkSession, root: str, site: str, day: str) -> DataFrame:
    """(name, path, size, modified, time) of a site's volumes on a day (yyyy-mm-dd), in order."""
    found = listing.list_folder(spark, f"{root}/{day.replace('-', '/')}/{site}")
    return found.withColumn("time", names.archive_time(F.col("name"))).orderBy("name")


def download(spark: SparkSession, root: str, name: str | DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Radials of the volume of that name, or of all that a table's column name has: executors fetch them, and one that isn't there is an error."""
    if isinstance(name, str):
        return load_file(spark, f"{root}/{name[4:8]}/{name[8:10]}/{name[10:12]}/{name[:4]}/{name}", mode)
    n = F.col("name")
    where = F.concat_ws("/", F.lit(root), F.substring(n, 5, 4), F.substring(n, 9, 2), F.substring(n, 11, 2), F.substring(n, 1, 4), n)
    return archive.scan(_fetched(name.select(n.alias("volume_id"), where.alias("path"))), mode)


def download_latest(spark: SparkSession, root: str, site: str, day: str) -> DataFrame:
    """Radials of the last volume of the day."""
    row = listing.volumes_only(list_scans(spark, root, site, day)).agg(F.max_by("path", "name").alias("path")).first()
    if row["path"] is None:
        raise MissingData(f"no volume of {site} on {day}")
    return load_file(spark, row["path"])


def download_at(spark: SparkSession, root: str, site: str, at: datetime) -> DataFrame:
    """Radials of the last volume of the same day at or before that time (UTC)."""
    found = listing.volumes_only(list_scans(spark, root, site, at.strftime("%Y-%m-%d"))).where(F.col("time") <= F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"))
    row = found.agg(F.max_by("path", F.struct("time", "name")).alias("path")).first()
    if row["path"] is None:
        raise MissingData(f"no volume of {site} at {at}")
    return load_file(spark, row["path"])


def download_object(spark: SparkSession, path: str) -> tuple[bytes, int]:
    """An object's bytes and when it was last modified; listing.ObjectNotFound without it."""
    return listing.read_object(spark, path)


def download_chunk(spark: SparkSession, root: str, chunk: feed.ChunkName) -> feed.Downloaded:
    """A real-time chunk, with the time of its upload; listing.ObjectNotFound while it isn't there."""
    data, modified = listing.read_object(spark, f"{root.rstrip('/')}/{chunk.site}/{chunk.volume}/{chunk.name}")
    archive.chunk_kind(data)  # an error for anything else
    return feed.Downloaded(feed.ChunkName(chunk.site, chunk.volume, chunk.prefix, chunk.sequence, chunk.letter, modified), data)


def cache_files(paths: DataFrame, folder: str) -> int:
    """Read-through copies in a cache folder of the files that a table's column path names, made by the executors; returns how many were made: those that are there stay."""
    spark = paths.sparkSession
    wanted = paths.select(F.regexp_extract("path", "([^/]+)$", 1).alias("volume_id"), "path").distinct()
    if listing.object_names(spark, folder):
        wanted = wanted.join(listing.list_folder(spark, folder).select(F.col("name").alias("volume_id")), "volume_id", "left_anti")
    return save_bytes(_fetched(wanted), "volume_id", "content", folder)


def _fetched(files: DataFrame) -> DataFrame:
    """files(volume_id, path) with their content; an error for one that isn't there."""
    got = objects.fetch(files)
    missing = F.raise_error(F.concat_ws(": ", "path", "error")).cast("binary")
    return got.select("volume_id", F.when(F.col("error").isNull(), F.col("data")).otherwise(missing).alias("content"))


# ---- fields ----


def extract_field(radials: DataFrame, product: str, sweep: int) -> DataFrame:
    """Gates of a product of one sweep of each volume; MissingData if no radial has it."""
    one = radials.where(F.col("sweep_idx") == sweep)
    if one.where(F.col(product).isNotNull()).isEmpty():
        raise MissingData(f"no {product} in sweep {sweep}")
    return fields.extract_field(one, product)


def extract_fields(radials: DataFrame, product: str) -> DataFrame:
    """Gates of a product of all sweeps that have it."""
    return fields.extract_field(radials, product)


def extract_first_field(radials: DataFrame, product: str) -> DataFrame:
    """Gates of a product of each volume's first sweep that has it."""
    return fields.first_field(fields.extract_field(radials, product))


def coordinate_system(radials: DataFrame) -> RadarSite | None:
    """Where the radar stands, from the first radial that tells."""
    told = radials.where(F.col("latitude").isNotNull()).orderBy("volume_id", "ordinal").select("latitude", "longitude", "site_height_m", "tower_height_m").first()
    return RadarSite(told[0], told[1], told[2] or 0.0, told[3] or 0.0) if told else None


def coordinate_system_required(radials: DataFrame) -> RadarSite:
    found = coordinate_system(radials)
    if found is None:
        raise MissingData("no radial tells where the radar stands")
    return found


# ---- sites ----


def sites(spark: SparkSession) -> DataFrame:
    return stations.sites(spark)


def site(identifier: str) -> dict | None:
    """A registry entry by its identifier, whatever the case."""
    keys = ("id", "city", "state", "latitude", "longitude", "elevation_m")
    return next((dict(zip(keys, x, strict=True)) for x in stations.SITES if x[0] == identifier.upper()), None)


# ---- feed ----


def stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of real-time chunks under a folder, with each site's timing state."""
    chunks = chunk_stream.read_chunks(spark, path, max_files)
    return site_state.track(chunks.select("site", "volume", "sequence", "chunk_type", F.unix_millis("upload_time").alias("time_ms")))


def follow(spark: SparkSession, root: str, site: str, **policies) -> tuple[feed.ChunkFeed, feed.Downloaded, feed.Downloaded | None]:
    """One site's feed from its newest volume on: (feed, newest chunk, start chunk where that is another one)."""
    return feed.ChunkFeed.start(ship(spark), root, site, **policies)


def with_retries(work: Callable, policy: dict = DOWNLOAD_RETRY, sleep: Callable[[float], None] = time.sleep):
    """work(), again after each failure until the policy's attempts are used up; the last failure is raised."""
    for attempt in range(policy["max_attempts"] + 1):
        try:
            return work()
        except Exception:
            if attempt == policy["max_attempts"]:
                raise
            grown = int(policy["initial_ms"] * policy["multiplier"] ** max(attempt - 1, 0))
            sleep((policy["initial_ms"] if attempt == 0 else min(grown, policy["max_ms"])) / 1000.0)


# ---- files ----


def save_bytes(df: DataFrame, name: str, data: str, folder: str) -> int:
    """Each row's bytes as a file of its own in a folder of any store that executors reach; returns how many.  All appear together, or none."""
    from pyspark.sql import Observation

    seen = Observation()
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(data).alias("data")).observe(seen, F.count(F.lit(1)).alias("n"))
    objects.save(rows, folder)
    return seen.get.get("n", 0)


def save_records(volumes: DataFrame, folder: str, opened: bool = True) -> int:
    """Every record of volumes as a file volume-number, decompressed unless told otherwise; returns how many."""
    records = archive.split_volumes(volumes)
    records = archive.open_records(records) if opened else records
    return save_bytes(records.withColumn("_name", F.format_string("%s-%04d", "volume_id", "record_idx")), "_name", "data", folder)


def save_messages(messages: DataFrame, folder: str) -> int:
    """Every message's payload as a file volume-record-number-type; returns how many."""
    joined = archive.whole_payload(F.col("payloads"))
    named = messages.withColumn("_name", F.format_string("%s-%04d-%06d-%d", "volume_id", "record_idx", "message_idx", "message_type")).withColumn("_data", joined)
    return save_bytes(named, "_name", "_data", folder)
