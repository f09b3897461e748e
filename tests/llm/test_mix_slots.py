"""Slots follow words: few for tiny sources, more as the mix grows, and every source is met."""

from pyspark.sql import functions as F

from squall.llm import mixing


def test_slots_follow_words(spark):
    targets = spark.createDataFrame([(f"s{k}", 3.0) for k in range(2000)] + [("big", 9e12), ("none", 0.0), (None, 1.0)], "source string, target double")
    wanted = {r.source: r.wanted for r in mixing.shared_slots(targets).collect()}
    assert "none" not in wanted and wanted["s0"] == 11.0 and wanted[None] == 9.0
    assert 8.9e6 < wanted["big"] < 9.1e6  # one per million words


def test_tiny_sources_get_their_target(spark):
    """Thousands of sources of a few words beside a large one."""
    rows = [(k, "w " * (1 + k % 3), f"s{k:05d}") for k in range(3000)] + [(9000 + k, "w " * 400, "zz") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slots = mixing.schedule(spark, mixing.shared_slots(mixing.source_targets(df.select("source", mixing.word_count(F.col("text")).alias("size")))))
    assert slots.count() < 40 * 3000 + mixing.SLOTS
    mixed = mixing.mix(spark, df).join(df.select(F.col("doc_id").alias("d"), "source"), F.col("doc_id") == F.col("d")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
    bad = [r for r in mixed.collect() if abs(r.taken - r.target) > 1 or r.over > 0]
    assert bad == []
