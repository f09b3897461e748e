"""Results of streams that have run to their end: files of the executors, not tables in the driver's memory."""

from pyspark.sql import functions as F

from squall.streaming import chunk_stream


def _stream(spark, folder, n):
    spark.range(n).select("id", (F.col("id") % 3).alias("k")).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema("id long, k long").parquet(f"{folder}/in")


def test_append_goes_through_files(spark, tmp_path):
    got = chunk_stream.run_to_end(_stream(spark, tmp_path, 50), "appended", f"{tmp_path}/state")
    assert got.inputFiles() and "appended" not in [t.name for t in spark.catalog.listTables()]
    assert got.count() == 50 and got.columns == ["id", "k"]


def test_complete_keeps_the_last_result(spark, tmp_path):
    stream = _stream(spark, tmp_path, 50).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = chunk_stream.run_to_end(stream, "counted", f"{tmp_path}/state", "complete")
    assert got.inputFiles() and sorted(map(tuple, got.collect())) == [(0, 17), (1, 17), (2, 16)]


def test_an_empty_stream_has_its_columns(spark, tmp_path):
    for mode in ("append", "complete"):
        stream = _stream(spark, tmp_path / mode, 0)
        stream = stream if mode == "append" else stream.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        got = chunk_stream.run_to_end(stream, f"empty_{mode}", f"{tmp_path}/{mode}/state", mode)
        assert got.columns == stream.columns and got.count() == 0
