"""Steps whose tasks stay small however large the tables are."""

from pyspark.sql import functions as F

from squall.functions import display
from squall.plans import q_fields
from squall.sources import frames


def test_a_part_meets_one_level(spark, tmp_path):
    spark.range(700).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = q_fields.k05(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "below" in plan and "Repartition" in plan
    assert got.count() == got.select("p_partkey").distinct().count() > 600


def test_partitions_follow_the_frames(spark):
    assert "RepartitionByExpression" in _plan(spark, 6 * frames.PART_FRAMES) and ", 6" in _plan(spark, 6 * frames.PART_FRAMES)
    assert _plan(spark, 6 * frames.PART_FRAMES).count("Sort") == _plan(spark, None).count("Sort")


def _plan(spark, n):
    rows = spark.createDataFrame([], frames.FRAMES)
    return frames.reassemble(rows, n)._jdf.queryExecution().optimizedPlan().toString()


def test_runs_with_frames_that_stand_alone(spark):
    own = [(0, False, 1, 2), (1, True, 1, 1), (2, False, 2, 2), (3, False, 2, 2), (4, False, 1, 0), (5, False, 1, 3), (6, False, 1, 2), (7, False, 2, 2)]
    rows = [("v", 0, f, alone, 31 if alone else 13, 0, f, 1, 0, count, number, bytes([f])) for f, alone, number, count in own]
    got = frames.reassemble(spark.createDataFrame(rows, frames.FRAMES), len(rows)).orderBy("message_idx").collect()
    assert [b"".join(map(bytes, r.payloads)) for r in got] == [b"\1", b"\0\2", b"\4", b"\6\7"]


def test_hex_lines_are_the_dump(spark):
    df = spark.createDataFrame([(1, b"0123456789abcdefX"), (2, b""), (3, None), (4, b"0123456789abcdef")], "k long, data binary")
    want = sorted(map(tuple, df.select("k", F.posexplode(display.hex_dump(F.col("data"))).alias("line", "dump")).collect()))
    assert sorted(map(tuple, display.hex_lines(df, "data").select("k", "line", "dump").collect())) == want and len(want) == 3
    assert "transform" not in display.hex_lines(df, "data")._jdf.queryExecution().optimizedPlan().toString()
