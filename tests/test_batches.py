"""Rows of Python workers: gathered into batches that are bounded by bytes, spread over the cores."""

import pyarrow as pa
from pyspark.sql import functions as F

from squall.plans import adapters as A
from squall.sources import archive
from squall.sources import layouts as L


def _batches(df, work, schema):
    """Rows of each Arrow batch that work's rows come back in."""

    class Kept:
        sparkSession = df.sparkSession

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

    kept = archive._rows(Kept(), work, schema)
    return list(kept.run(iter([pa.RecordBatch.from_pylist([r.asDict() for r in df.collect()])])))


def test_small_rows_share_a_batch(spark):
    made = _batches(spark.range(3000), lambda r: [{"k": r["id"], "data": b"x"}] * 2, "k long, data binary")
    assert sum(b.num_rows for b in made) == 6000
    assert len(made) == 2


def test_large_rows_end_a_batch(spark):
    made = _batches(spark.range(6), lambda r: [{"k": r["id"], "data": bytes(archive.HELD_BYTES // 2)}], "k long, data binary")
    assert [b.num_rows for b in made] == [2, 2, 2]


def test_nulls_and_empty_lists_keep_their_place(spark):
    df = spark.createDataFrame([(1, None), (None, [b"ab", b""]), (3, [])], "k long, p array<binary>")
    got = archive._rows(df, lambda r: [r], "k long, p array<binary>").collect()
    assert {(r.k, None if r.p is None else tuple(map(bytes, r.p))) for r in got} == {(1, None), (None, (b"ab", b"")), (3, ())}


def test_words_are_spread(spark, tmp_path):
    from squall.plans import q_wire

    spark.range(500).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert A.read(spark, str(tmp_path), "orders").rdd.getNumPartitions() == 1
    assert q_wire._word_rows(spark, str(tmp_path)).rdd.getNumPartitions() >= 4


def test_adaptation_document_whole_or_cut():
    values = {"slatdeg": 35, "slatdir": "N", "slondeg": 97, "slondir": "W", "site_name": "KTLX", "atmos": [0.5] * 13, "txb_alarm_thresh": 2.0}
    whole = archive.adaptation_bytes(values)
    full, cut = archive._adaptation(whole), archive._adaptation(whole[:2600])
    assert len(L.ADAPTATION_FIELDS) + len(L.ADAPTATION_LISTS) <= len(full)
    assert (full["site_latitude"], full["site_longitude"], full["site_name"], full["txb_alarm_thresh"]) == (35.0, -97.0, "KTLX", 2.0)
    assert "site_name" not in cut and cut["atmos"] == full["atmos"] and len(cut["v_rnscale"]) == 0
    assert all(full[k] == v for k, v in cut.items() if k != "v_rnscale")
