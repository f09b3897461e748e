"""Volumes of many vectors, and how many Python workers their tasks need."""

from pyspark.sql import functions as F

from squall.plans import q_wire
from squall.sources import archive

DATA = "/root/testdata/sf0.001"


def test_trimmed_volumes_are_read_where_they_are_written(spark):
    plan = q_wire.l03(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert "RepartitionByExpression" in plan  # so many parts at every size
    v = q_wire.volumes(spark, DATA)
    want = archive.scan(archive.trim(v, {3, 6})).select("volume_id", "ordinal", "sweep_idx", "time_ms", "REF.raw")
    got = archive.scan(v, sweeps={3, 6}).select("volume_id", "ordinal", "sweep_idx", "time_ms", "REF.raw")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 0


def test_more_radials_of_a_tilt_than_a_halfword_counts(spark, tmp_path):
    n = q_wire.NUMBERS + 20
    spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.lit(0.01).cast("float")).alias("embedding"), F.lit(2).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert q_wire.l03(spark, str(tmp_path)).agg(F.sum("n")).first()[0] == n
    got = q_wire.c01(spark, str(tmp_path)).selectExpr("azimuth_number", "(time_ms - 17999 * 86400000L) div 13 as vec_id")
    assert got.where("azimuth_number = vec_id + 1").count() == got.count() == n
    first, last = q_wire.b11(spark, str(tmp_path)).agg(F.min("first_azimuth"), F.max("last_azimuth")).first()
    assert (first, last) == (1, n)


def test_volumes_are_cut_into_chunks_in_one_pass(spark):
    plan = q_wire._feed(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == plan.count("MapInArrow") == 1 and "Join" not in plan
    files = {"a": [b"\0\0\0\3BZ1", b"\xff\xff\xff\xfeBZ"], "b": [b"\0\0\0\3BZ1"], "c": [b"\0\0\0\3BZ1", b"\0\0\0\1x", b"\xff\xff\xff\xfeyz"], "d": []}
    head = archive.volume_bytes([])
    rows = [(name, head + b"".join(x)) for name, x in files.items()]
    got = archive.cut_chunks(spark.createDataFrame(rows, "volume_id string, content binary")).orderBy("volume_id", "sequence").collect()
    kinds = {"a": ["Start", "End"], "b": ["Start"], "c": ["Start", "Intermediate", "End"], "d": []}
    want = [(name, k + 1, kinds[name][k], head + x if k == 0 else x) for name, own in files.items() for k, x in enumerate(own)]
    assert [(r.volume_id, r.sequence, r.chunk_type, bytes(r.data)) for r in got] == want


def test_arrow_batches_of_bytes_are_small(spark):
    """Some fifty MB of volumes in one part come in batches of a few."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        archive.cut_chunks(spark.createDataFrame([], "volume_id string, content binary"))

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

        rows = spark.range(0, 100, 1, 1).select(F.encode(F.repeat(F.lit("x"), 500_000), "UTF-8").alias("data"))
        most = rows.mapInArrow(sizes, "n long").agg(F.max("n"), F.sum("n")).first()
        assert most[0] < 2 * archive.BATCH_BYTES and most[1] >= 50_000_000
        spark.conf.set(key, "32m")
        archive.cut_chunks(spark.createDataFrame([], "volume_id string, content binary"))
        assert spark.conf.get(key) == "32m"
    finally:
        spark.conf.set(key, was)
