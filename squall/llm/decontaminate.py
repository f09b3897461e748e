"""Benchmark decontamination as a prefix-filtered set join.

Every item-sized window (ten words, or a whole shorter item) is a set of shingles of
three consecutive words.  Shingles are ordered by rarity, counted over all documents;
a window is contained only where all of its shingles are, so one prefix shingle, its
rarest, is necessary.  Documents are joined to windows on prefix shingles; a match
fixes where the window would start (positional bound) and must leave room for its
length (length bound); the words of that place are then compared with the window's.

Distribution.  Documents are gone through twice, whatever the size of the benchmark:
once to count the benchmark's shingles, once for matches of prefix shingles, which
travel to the windows together with the few words around them.  Texts are never
shuffled.  Only two Bloom filters (at most 16 MB each) and the prefix shingles that
hold more than 1/``HOT`` of all matches (at most ``HOT``) are broadcast; the windows
of those are repeated so that the matches of one shingle go to many tasks.

Defined results: a null or empty text has no words and is clean; items without
words are ignored; items of equal text are all named; rows of one document id, null
ids included, are judged each for itself; an empty benchmark leaves all documents
clean; a very long text is one row like any other, cut nowhere; of equally rare
shingles the one of the least hash is the prefix; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.llm import bloom
from squall.llm.common import columns, map_texts, table, written

WINDOW = 10
SHINGLE = 3
#: Prefix shingles with more than this part of all matches are dealt to several tasks.
HOT = 2000
HOT_MATCHES = 10_000  # and with more than so many
#: Up to so many windows (about 200 bytes each) are broadcast to the matches; more are joined by a shuffle.
FEW_WINDOWS = 50_000

_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(text, items): one row per distinct window, its words joined by a space, and the ids it stands in."""
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lowered, _WORD_CLASS), lambda w: w != "")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - (window - 1)))
    windows = items.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("text"))
    return windows.groupBy("text").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _shingled(batch):
    from squall.llm.textcore import Words, grams

    texts, items = columns(batch, "text", "items")
    words = Words(texts, "alnum")
    hashes = words.hashes()
    size = np.diff(words.at)
    parts: list = [None] * len(size)
    for n in np.unique(np.minimum(size, SHINGLE)).tolist():
        own = np.minimum(size, SHINGLE) == n
        g, first = grams(hashes, words.at, n)
        row = np.searchsorted(words.at, first, "right") - 1
        cuts = np.searchsorted(row, np.arange(len(size) + 1))
        for i in np.flatnonzero(own):
            parts[i] = g[cuts[i] : cuts[i + 1]].view(np.int64)
    return pa.RecordBatch.from_arrays([texts, items, pa.array(size.astype(np.int64)), pa.array(parts, pa.list_(pa.int64()))], ["text", "items", "size", "shingles"])


def _document_shingles(words, widths):
    """(hash, first word, width) of all shingles of the given widths."""
    from squall.llm.textcore import grams

    hashes = words.hashes()
    for n in widths:
        g, first = grams(hashes, words.at, n)
        yield g, first, n


def _counts(docs: DataFrame, known, widths) -> DataFrame:
    """(shingle, n): how often shingles of the benchmark (and a few others that the filter lets pass) stand in all documents."""

    def count(batch):
        from squall.llm.textcore import Words

        words = Words(columns(batch, "text")[0], "alnum")
        found = [g[known.value.has(g)] for g, _, _ in _document_shingles(words, widths)]
        shingle, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    return map_texts(docs.select("text"), count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


class Prefixes:
    """What is needed to look for matches in documents: windows and their number, filter, widths and hot prefix shingles."""

    def __init__(self, windows, n: int, known, widths: list[int], hot: dict[int, int]):
        self.windows, self.n, self.known, self.widths, self.hot = windows, n, known, widths, hot


def prefixes(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, hot: int = HOT, least: int = HOT_MATCHES) -> Prefixes:
    """The benchmark's windows with their prefix shingle: text, items, size, shift (of the prefix, in words), key."""
    spark = docs.sparkSession
    narrow = [F.count(F.when(F.col("size") == k, 1)) for k in range(1, SHINGLE)]
    windows = map_texts(benchmark_windows(benchmark, window), _shingled, "text string, items array<string>, size long, shingles array<long>")
    windows, seen = written(windows, shingles=F.sum(F.size("shingles")), **{f"of{k + 1}": x for k, x in enumerate(narrow)})
    narrower = sum(seen.get(f"of{k}", 0) for k in range(1, SHINGLE))
    widths = [k for k in range(1, SHINGLE) if seen.get(f"of{k}")] + [SHINGLE] * (seen["n"] > narrower)
    known = spark.sparkContext.broadcast(bloom.build(windows.select(F.explode("shingles")), seen.get("shingles") or 0))
    counts = _counts(docs, known, widths).withColumnRenamed("shingle", "counted") if widths else spark.createDataFrame([], "counted long, n long")
    placed = windows.select("text", "items", "size", F.posexplode("shingles").alias("shift", "key"))
    rarity = placed.join(counts, F.col("key") == F.col("counted"), "left").groupBy("text").agg(
        F.first("items").alias("items"), F.first("size").alias("size"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "shift")).alias("rarest")
    )
    chosen, seen = written(rarity.select("text", "items", "size", "rarest.*"), total=F.sum("n"), most=F.max("n"))
    # At most ``hot`` keys have more than total / hot matches each.
    share = max(least, -(-(seen.get("total") or 0) // hot))
    salts = {}
    if (seen.get("most") or 0) > share:
        salts = {r["key"]: -(-r["n"] // share) for r in chosen.where(F.col("n") > share).select("key", "n").distinct().collect()}
    return Prefixes(chosen, seen["n"], spark.sparkContext.broadcast(bloom.build(chosen.select("key"), seen["n"])), widths, salts)


_MATCHES = "array<struct<key:long,salt:int,place:long,before:long,around:string>>"


def _matches(words, p: Prefixes, window: int):
    """(text's place, match) of shingles that the filter passes: key, word of the text, words around it and how many of those stand before."""
    for g, first, n in _document_shingles(words, p.widths):
        for k in np.flatnonzero(p.known.value.has(g)):
            at = int(first[k])
            row = int(np.searchsorted(words.at, at, "right")) - 1
            a, z = max(int(words.at[row]), at - window + n), min(int(words.at[row + 1]), at + window)
            yield row, {"key": int(g[k].view(np.int64)), "place": at - int(words.at[row]), "before": at - a, "around": words.span(a, z - a).decode("utf-8", "replace")}


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, hot: int = HOT, least: int = HOT_MATCHES, few: int = FEW_WINDOWS, found: Prefixes | None = None) -> DataFrame:
    """One row per document: row (a number of its own), doc_id, n_words, hits (word places inside windows), items (ids, as strings)."""
    p = found or prefixes(docs, benchmark, window, hot, least)
    known = Prefixes(None, p.n, p.known, p.widths, p.hot)

    def probe(batch):
        from squall.llm.textcore import Words

        rows, ids, texts = columns(batch, "row", "doc_id", "text")
        words = Words(texts, "alnum")
        own: list = [[] for _ in range(len(ids))]
        numbers = rows.to_pylist()
        for k, match in _matches(words, known, window):
            own[k].append(match | {"salt": (numbers[k] + match["place"]) % known.hot.get(match["key"], 1)})
        kind = pa.list_(pa.struct([("key", pa.int64()), ("salt", pa.int32()), ("place", pa.int64()), ("before", pa.int64()), ("around", pa.string())]))
        return pa.RecordBatch.from_arrays([rows, ids.cast(pa.int64()), pa.array(np.diff(words.at).astype(np.int64)), pa.array(own, kind)], ["row", "doc_id", "n_words", "matches"])

    # Written once, so that a row's number is the same for its words and its matches.
    numbered = docs.select((F.col("row") if found else F.monotonically_increasing_id()).alias("row"), "doc_id", "text")
    probed = map_texts(numbered, probe, f"row long, doc_id long, n_words long, matches {_MATCHES}").checkpoint()
    matches = probed.where(F.size("matches") > 0).select("row", F.explode("matches").alias("m")).select("row", "m.*")
    windows = p.windows.select(F.col("key").alias("k"), "text", "items", "size", "shift")
    repeated = F.lit(1)
    if p.hot:
        repeated = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in p.hot.items() for x in pair]), F.col("k")), F.lit(1))
    windows = windows.withColumn("s", F.explode(F.sequence(F.lit(0), (repeated - 1).cast("int"))))
    joined = matches.join(F.broadcast(windows) if p.n <= few else windows, (F.col("key") == F.col("k")) & (F.col("salt") == F.col("s")))
    fits = F.col("before") >= F.col("shift")
    same = F.array_join(F.slice(F.split("around", " "), (F.col("before") - F.col("shift") + 1).cast("int"), F.col("size").cast("int")), " ") == F.col("text")
    begin = F.col("place") - F.col("shift")
    hits = joined.where(fits).where(same).groupBy("row").agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence(begin, begin + F.col("size") - 1)))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    out = probed.select("row", "doc_id", "n_words").join(hits.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    return out.select(
        "row", "doc_id", "n_words", F.array_sort(F.coalesce("hits", F.array().cast("array<long>"))).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def clean_only(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, hot: int = HOT, least: int = HOT_MATCHES, few: int = FEW_WINDOWS) -> DataFrame:
    """docs without those that hold a window; all columns stay.

    Rows without a prefix shingle pass as they are; only the others are written and judged.
    """
    p = prefixes(docs, benchmark, window, hot, least)
    known = Prefixes(None, p.n, p.known, p.widths, p.hot)

    @F.arrow_udf("boolean")
    def suspected(texts: pa.Array) -> pa.Array:
        from squall.llm.textcore import Words, slices

        out = np.zeros(len(texts), dtype=bool)
        for i, j in slices(texts):
            words = Words(texts.slice(i, j - i), "alnum")
            for g, first, _ in _document_shingles(words, known.widths):
                hit = first[known.known.value.has(g)]
                out[i + np.searchsorted(words.at, hit, "right") - 1] = True
        return pa.array(out)

    passed = docs.where(~suspected("text"))
    packed = docs.where(suspected("text")).select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("whole")).checkpoint()
    judged = contamination(packed.select("row", "whole.doc_id", "whole.text"), benchmark, few=few, window=window, found=p)
    bad = judged.where(F.size("hits") > 0).select(F.col("row").alias("bad_row"))
    return passed.unionByName(packed.join(bad, F.col("row") == F.col("bad_row"), "left_anti").select("whole.*"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
