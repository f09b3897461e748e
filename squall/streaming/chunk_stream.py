"""Real-time chunks as a stream: a plain file source, sessions, and volumes put together from a table.

Chunk files are named SITE/volume/yyyymmdd-hhmmss-nnn-T.  ``sources.chunk_source`` follows the
slots of sites; ``site_state`` and ``assembly`` keep state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.functions import names
from squall.shipping import ship

def read_chunks(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of chunk files: site, volume, name, data, upload time."""
    reader = ship(spark).readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_chunks(reader.load(path))


def parse_chunks(files: DataFrame) -> DataFrame:
    """Chunk files, streamed or not, with what their paths tell."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    out = files.select(F.element_at(parts, -3).alias("site"), F.element_at(parts, -2).cast("int").alias("volume"), name.alias("name"), F.col("modificationTime").alias("upload_time"), F.col("content").alias("data"))
    return out.withColumns(names.parse_chunk_name(F.col("name"))).where("is_valid").drop("is_valid")


def session_windows(chunks: DataFrame, delay: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """Chunks per site in sessions of activity; late ones count within the delay."""
    marked = chunks.withWatermark("upload_time", delay)
    return marked.groupBy(F.session_window("upload_time", gap), "site").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("sequence").alias("last_sequence"))


def assemble(chunks: DataFrame) -> DataFrame:
    """chunks(site, volume, sequence, data and, where there is one, chunk_type): volumes put together from what has arrived, in sequence.

    (volume_id, content) for the archive reader, with n_chunks, the missing sequences up to the
    last one, and complete: nothing is missing and the last one is an End.  Only the start chunk is
    required; of a chunk that came twice, late or not, the least bytes count.
    """
    kind = F.col("chunk_type") if "chunk_type" in chunks.columns else F.lit(None).cast("string")
    once = chunks.groupBy("site", "volume", "sequence").agg(F.min("data").alias("data"), F.max(kind).alias("kind"))
    whole = once.groupBy("site", "volume").agg(
        F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count(F.lit(1)).alias("n_chunks"), F.max_by("kind", "sequence").alias("last_kind"),
        F.expr("listagg(data) within group (order by sequence)").alias("content"), F.collect_list("sequence").alias("have"),
    ).where(F.col("first") == 1)
    missing = F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("last").cast("int")), F.col("have").cast("array<int>")))
    complete = (F.size(missing) == 0) & F.coalesce(F.col("last_kind") == "End", F.lit(False))
    return whole.select(F.concat_ws("-", "site", "volume").alias("volume_id"), "content", "n_chunks", missing.alias("missing"), complete.alias("complete"))


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there into files beside the checkpoint, written by the executors, then stops; in complete mode the last batch's rows are the result."""
    spark, folder = stream.sparkSession, f"{checkpoint}-{name}"
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", folder).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(folder)
    last = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        last[:] = [number]

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{last[0]}") if last else spark.createDataFrame([], stream.schema)
