"""Source mixing by a low-discrepancy schedule (DataFrame operations only).

A mix is a sequence of slots.  Slot k carries the point frac(k * golden ratio);
the source whose share of [0, 1) holds the point owns the slot.  Slots are
ranked per source, and the j-th slot of a source takes the j-th block of its
shuffled words.  Slots are shared out by target, but every source has about
``FEWEST`` at least, so small sources have smaller blocks (some of no word).  A
source's n slots cut its rounded target evenly, so that what is taken of a source
is its target to the word.  A source's sequence may be gone through twice.

Distribution: positions within a source come from sums per (source, bucket) and
from a window inside each bucket, so no window holds a whole source; the number of
buckets follows the number of rows.  Points meet shares by an equi-join on cells of
[0, 1), about one per source; slots are joined to pieces of documents on (source,
rank), which is even for hot sources.  Only sources and slots per source, never
documents, are ordered as a whole.

Defined results: a null or blank text has size 0 and is never taken; null
sources form one source, ordered last; repeated rows (also of one doc_id) are
separate documents; documents of equal hash and id are ordered by size, and ties
beyond that are alike; a very long text counts in full, and may fill many slots; an
empty table gives an empty mix; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squall.llm.common import table, written

WEIGHTS = (5.0, 2.0, 1.0)  # in the order of sources, repeating
SHARE = 1.5  # of all words
MOST = 2.0  # times a source's words
SLOTS = 1 << 16  # or one per SLOT_WORDS words of the mix, where that is more
SLOT_WORDS = 1_000_000
#: A small source has so many slots at least, but never more than SPARE beyond its words: a source with fewer than
#: a handful could be missed by all points.
FEWEST = 1000
SPARE = 8
BUCKET_ROWS = 4096  # of a bucket for prefix sums, about
GOLDEN = 0.6180339887498949
#: Up to so many sources (about 60 bytes each) are broadcast to the documents; more are joined by a shuffle.
FEW_SOURCES = 50_000

_WS = " \t\n\x0b\x0c\r"


def word_count(text):
    """Words between ASCII white space; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: words, weight and target.  Sources over their limit stop there
    and the rest is shared again by weight: in the order of limit per weight, the
    first k sources stop, for the least k that leaves none above."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(listed, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    per = per.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    per = per.withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")))
    per = per.withColumn("final", F.first("fits", ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return per.select(
        "source", "source_size", "weight",
        F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("final") * F.col("weight"))).alias("target"),
    )


def shared_slots(targets: DataFrame, slots: int = SLOTS, fewest: int = FEWEST) -> DataFrame:
    """Per source with a target: how many slots it is to have, whatever the size of the others: by words, with a least for small ones."""
    positive = targets.where(F.col("target") > 0)
    total = F.sum("target").over(Window.partitionBy())
    share = F.least(F.greatest(F.lit(float(slots)), total / SLOT_WORDS), total) * F.col("target") / total
    return positive.select("source", F.greatest(share, F.least(F.lit(float(fewest)), F.ceil("target") + SPARE)).alias("wanted"))


def schedule(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """(slot, source, rank, slots): who owns each slot, its how-manieth it is from 0, and how many it has.

    Slots are looked up in the cumulative shares by an equi-join on cells of [0, 1): as
    many rows as slots, and two per source at most, whatever the input.
    """
    sums = wanted.agg(F.sum("wanted").alias("w"), F.count(F.lit(1)).alias("n")).first()
    slots, cells = int(-(-(sums["w"] or 0) // 1)), max(1, sums["n"])
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    total = F.sum("wanted").over(Window.partitionBy())
    upper = F.sum("wanted").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total
    bounds = wanted.select("source", upper.alias("high"))
    bounds = bounds.select("source", F.coalesce(F.lag("high").over(order), F.lit(0.0)).alias("low"), F.when(F.lead("high").over(order).isNull(), F.lit(2.0)).otherwise(F.col("high")).alias("high"))

    def cell(point):
        return F.least(F.floor(point * cells), F.lit(cells - 1))

    bounds = bounds.withColumn("c", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("point")).withColumn("cell", cell(F.col("point")))
    owned = points.join(bounds, (F.col("cell") == F.col("c")) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "source")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return owned.select("slot", "source", rank.cast("long").alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("source")).alias("slots"))


def bucket_bits(rows: int) -> int:
    """Buckets of about BUCKET_ROWS rows were all rows of one source: 2 ** bits, 1024 at least."""
    return min(26, max(10, (max(rows, 1) // BUCKET_ROWS).bit_length()))


def placed(docs: DataFrame, seed: int = 7, bits: int = 10) -> DataFrame:
    """docs(doc_id, source, size) with where each document's words start in its source's shuffled sequence."""
    # Pairing the seed with the id, not with the row's place, makes reruns agree.
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    docs = docs.withColumn("key", key).withColumn("bucket", F.shiftrightunsigned("key", 64 - bits))
    sums = docs.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    runs = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(runs), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    docs = docs.withColumn("row", F.row_number().over(within))
    docs = docs.withColumn("before", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return docs.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        "doc_id", "source", "size", "bucket", "row", (F.col("base") + F.col("before")).alias("start")
    )


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, slots: int = SLOTS, seed: int = 7, few_sources: int = FEW_SOURCES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_slot."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    # Sizes are used three times and targets four: written once, as rows of a few numbers.
    sized, seen = written(sized)
    targets, told = written(source_targets(sized, weights, share, most))
    # Read twice; as many rows as slots.
    owned = schedule(spark, shared_slots(targets, slots)).checkpoint()
    # Per-source figures ride along with each document: one row per source.
    counts = owned.where("rank = 0").select(F.col("source").alias("os"), "slots")
    facts = targets.join(counts, F.col("source").eqNullSafe(F.col("os")), "left").select(
        F.col("source").alias("fs"), "source_size", "target", F.round("target").cast("long").alias("quota"), F.coalesce("slots", F.lit(0)).alias("slots")
    )
    facts = F.broadcast(facts) if told["n"] <= few_sources else facts.checkpoint()
    at = placed(sized, seed, bucket_bits(seen["n"])).join(facts, F.col("source").eqNullSafe(F.col("fs"))).drop("fs")
    rounds = int(-(-most // 1))
    begin = F.col("start") + F.col("round") * F.col("source_size")
    pieces = at.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    pieces = pieces.withColumn("begin", begin).withColumn("stop", begin + F.col("size"))
    # Block r of a source: words from r * quota div slots to before (r + 1) * quota div slots.
    lowest, highest = F.expr("((begin + 1) * slots - 1) div quota"), F.expr("least(stop * slots - 1, quota * slots - 1) div quota")
    some = (F.col("size") > 0) & (F.col("slots") > 0) & (F.col("begin") < F.col("quota"))
    nowhere = -1 - F.pmod(F.xxhash64("doc_id", "bucket", "row", "round"), F.lit(1 << 20))  # of no slot, and not all of one key
    pieces = pieces.withColumn("rank", F.explode(F.when(some, F.sequence(lowest, highest)).otherwise(F.array(nowhere))))
    first, last = F.expr("rank * quota div greatest(slots, 1)"), F.expr("(rank + 1) * quota div greatest(slots, 1)")
    words = F.when(F.col("rank") >= 0, F.least(F.col("stop"), last) - F.greatest(F.col("begin"), first)).otherwise(F.lit(0).cast("long"))
    pieces = pieces.withColumn("words", F.greatest(words, F.lit(0)))
    owned = owned.select(F.col("source").alias("os"), F.col("rank").alias("orank"), "slot")
    joined = pieces.join(owned, F.col("source").eqNullSafe(F.col("os")) & (F.col("rank") == F.col("orank")), "left")
    keys = ("source", "bucket", "row", "doc_id", "size", "source_size", "target")
    out = joined.groupBy(*keys).agg(
        F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(F.lit(0))).cast("long").alias("taken"),
        F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("first_slot"),
    )
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", "first_slot")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
