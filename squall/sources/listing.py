"""Listings of archive and real-time objects, and choices among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squall.functions import names
from squall.operators.fields import MissingData

#: Metadata files that stand beside volumes.
METADATA_ENDING = "_MDM"
#: Slots that a search for the newest volume looks at (the last slot is never looked at).
SEARCHED_VOLUMES = 998


def list_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, path, size, modified) of files under a path, contents unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def volumes_only(listing: DataFrame) -> DataFrame:
    return listing.where(~F.col("name").endswith(METADATA_ENDING))


def with_prefix(listing: DataFrame, site: str, day: str, max_keys: int | None = None) -> DataFrame:
    """Objects of a site and a day (yyyy-mm-dd) by key, in order; more than max_keys raise, as listings are not paged."""
    prefix = f"{day.replace('-', '/')}/{site}"
    found = listing.withColumn("key", names.archive_key(F.col("name"))).where(F.col("key").startswith(prefix)).orderBy("key")
    if max_keys is not None and found.limit(max_keys + 1).count() > max_keys:
        raise MissingData("listing is truncated")
    return found


def latest(listing: DataFrame, by: list[str]) -> DataFrame:
    """The last name in order per group."""
    return listing.groupBy(*by).agg(F.max("name").alias("name"))


def as_of(requests: DataFrame, listing: DataFrame, parts: int = 8) -> DataFrame:
    """requests(request, site, at) with the last volume of the same site and day at or before that time; null without any.

    A merge: both in order of time per site and day, and each request takes the last name before it (of equal times the
    greatest).  Requests of one site and day are dealt over so many parts, with the few volumes of the day in each.
    """
    have = listing.where(F.col("site").isNotNull() & F.col("time").isNotNull()).select(F.col("site").alias("_site"), F.col("time").alias("_time"), "name")
    have = have.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_row", F.lit(None).cast(requests.schema))
    whole = F.struct(*[F.col(c) for c in requests.columns])
    asked = requests.select(F.col("site").alias("_site"), F.col("at").cast("timestamp").alias("_time"), F.lit(None).cast("string").alias("name"), F.pmod(F.xxhash64(whole), F.lit(parts)).cast("int").alias("_part"), whole.alias("_row"))
    both = asked.unionByName(have.withColumn("_time", F.col("_time").cast("timestamp")))
    along = Window.partitionBy("_site", F.to_date("_time"), "_part").orderBy("_time", F.col("_row").isNotNull(), "name").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("name", F.last("name", ignorenulls=True).over(along)).where(F.col("_row").isNotNull()).select("_row.*", "name")


def parse_object_list(xml: DataFrame) -> DataFrame:
    """xml(request, body): bucket listings in XML as (request, key, modified, size, truncated), one row per object."""
    item = "Contents array<struct<Key:string,LastModified:string,Size:bigint>>, IsTruncated boolean"
    parsed = xml.select("request", F.from_xml("body", item).alias("x"))
    one = parsed.select("request", F.col("x.IsTruncated").alias("truncated"), F.explode("x.Contents").alias("o"))
    return one.select("request", F.col("o.Key").alias("key"), F.to_timestamp("o.LastModified").alias("modified"), F.col("o.Size").alias("size"), "truncated")


def require_site(present: Column, value: Column) -> Column:
    """value, or an error where the site is missing."""
    return F.when(present, value).otherwise(F.raise_error(F.lit("missing site")).cast("string"))


class ObjectNotFound(MissingData):
    """There is no object of that name."""


def read_object(spark: SparkSession, path: str) -> tuple[bytes, int]:
    """An object's bytes and its last modification (milliseconds since 1970), from any store that Spark reads; ObjectNotFound without it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        raise ObjectNotFound(path)
    stream = files.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)), files.getFileStatus(where).getModificationTime()
    finally:
        stream.close()


def fetch_chunks(chunks: DataFrame, root: str) -> DataFrame:
    """chunks(site, volume, prefix, sequence, letter) with what their objects hold: data, modified_ms, error (not found while one isn't there), and kind, which is an error for other content."""
    from squall.sources import objects

    number = F.lpad(F.col("sequence").cast("string"), 3, "0")
    name = F.concat_ws("-", "prefix", number, "letter")
    got = objects.fetch(chunks.withColumn("path", F.concat_ws("/", F.lit(root.rstrip("/")), "site", F.col("volume").cast("string"), name)))
    return got.withColumn("kind", chunk_kind(F.col("data")))


def chunk_kind(data: Column) -> Column:
    """Start (a volume's head) or a record; anything else is an error."""
    other = F.raise_error(F.lit("unrecognised chunk format")).cast("string")
    return F.when(data.isNull(), F.lit(None)).when(F.substring(data, 1, 3) == F.lit(b"AR2"), "Start").when(F.substring(data, 5, 2) == F.lit(b"BZ"), "IntermediateOrEnd").otherwise(other)


def object_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in one folder, in order; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []


def cached(spark: SparkSession, source: str, cache: str) -> str:
    """A read-through copy of a volume file: copied into the cache folder unless it is there; returns its path."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(cache, source.rsplit("/", 1)[-1])
    files = dst.getFileSystem(conf)
    if not files.exists(dst):
        jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, files, dst, False, conf)
    return dst.toString()
