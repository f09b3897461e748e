"""Phrases whose words keep company, per language.

1. Each shard (texts of bounded size) turns its words into ids and sorts the suffixes of its
   pieces by prefix doubling; the intervals of equal beginnings are its phrases with counts.
2. A first pass merges the counts of single words and pairs by a 64-bit key.  Only what
   is common by these goes on: equal keys of unlike phrases add up, so nothing common is missed.
3. A second pass counts the phrases that may be common by their text, merged by language
   and phrase.  Counts, scores and ranks are exact.
4. A candidate's cuts meet the counts of their parts by equi-joins.

Distribution: shards are independent, whatever the language; counts are added up within a
shard and again within a task before a shuffle, so a common word or pair is one row a task.
The filter of common keys is broadcast; it has at most 16 MB (``bloom.MOST_BITS``), beyond which
it lets more phrases into the second pass and results stay the same.  The ranking takes the best
of parts of a language first, so that no task holds all its candidates.

Defined results: a null text has no words, a null language is ``und``; a very long text is cut
into shards between its pieces, nowhere else; repeated rows count each; candidates of equal
score and count stand in byte order of the phrase; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squall.llm import bloom
from squall.llm.common import columns, ready, shared_dir, table, written
from squall.llm.textcore import TABLES, Words, mix, slices

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_IS_BREAK = np.zeros(256, dtype=bool)
_IS_BREAK[list(_BREAKS)] = True
TABLES["pieces"] = bytes(32 if c in _BREAKS + b"\t" else c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Words of a shard: its arrays take about 150 bytes a word.
SHARD_WORDS = 1 << 19
#: Candidates that one task ranks at most, about.
RANKED_ROWS = 50_000


class Shard:
    """Words of several texts: ids (of language and word), left: words from each to the end of its piece."""

    def __init__(self, words: pa.Array, hashes: np.ndarray, langs: np.ndarray, left: np.ndarray, names: list[str]):
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        both, first, self.ids = np.unique(langs * np.int64(len(coded.dictionary)) + code, return_index=True, return_inverse=True)
        self.left, self.names = left, names
        self.lang = langs[first]
        self.word = coded.dictionary.take(pa.array(code[first]))
        salt = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], dtype=np.uint64)
        self.key = mix(hashes[first] ^ mix(salt[self.lang])) if len(both) else np.zeros(0, np.uint64)

    def phrases(self, most: int):
        """(n, places, counts) for n = 1 ... most: one place of each phrase of n words, and how often it stands here."""
        order, common = suffix_array(self.ids, self.left, most)
        for n in range(1, most + 1):
            whole = self.left[order] >= n
            # Suffixes that are too short stand between their longer neighbours: the least common part counts across them.
            new = _starts(common < n, whole)
            place = order[whole]
            first = np.flatnonzero(new)
            yield n, place[first], np.diff(np.append(first, len(place)))

    def keys(self, places: np.ndarray, n: int) -> np.ndarray:
        """64-bit keys of the phrases of n words at these places."""
        key = self.key[self.ids[places]]
        for k in range(1, n):
            key = mix(key * np.uint64(0x100000001B3) ^ self.key[self.ids[places + k]] + np.uint64(k))
        return key

    def texts(self, places: np.ndarray, n: int) -> pa.Array:
        import pyarrow.compute as pc

        parts = [self.word.take(pa.array(self.ids[places + k])) for k in range(n)]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if n > 1 else parts[0]


def suffix_array(ids: np.ndarray, left: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their next words (most at least), and how many of them each has in common with the place before it."""
    rank, span, levels = ids.astype(np.int64) + 1, 1, {}
    n = len(ids)
    while True:
        levels[span] = rank
        if span >= most:
            break
        after = np.zeros(n, dtype=np.int64)
        inside = np.flatnonzero(left > span)
        after[inside] = rank[inside + span]
        rank = np.unique(rank * np.int64(rank.max(initial=0) + 1) + after, return_inverse=True)[1] + 1
        span *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, dtype=np.int64)
    a, b = order[:-1], order[1:]
    for k in range(1, most + 1):
        same = (left[a] >= k) & (left[b] >= k)
        done = 0
        for span in sorted(levels, reverse=True):
            if done + span <= k:
                same &= levels[span][np.minimum(a + done, n - 1)] == levels[span][np.minimum(b + done, n - 1)]
                done += span
        common[1:][same] = k
    return order, common


def _starts(breaks: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """For the places that are whole: is there a break at it or since the last whole one?"""
    total = np.cumsum(breaks)[whole]
    return np.diff(total, prepend=-1) > 0


def shards(batches, most_words: int = SHARD_WORDS):
    """Shards of Arrow batches with columns lang and text."""
    from squall.llm.collocations import Shard

    held, size = [], 0
    for batch in batches:
        lang, text = columns(batch, "lang", "text")
        for i, j in slices(text):
            words = Words(text.slice(i, j - i), "pieces")
            n = len(words.start)
            if not n:
                continue
            row = np.searchsorted(words.at, np.arange(n), "right") - 1
            breaks = np.concatenate([[0], np.cumsum(_IS_BREAK[np.frombuffer(words.raw, dtype=np.uint8)])])
            ends = np.ones(n, dtype=bool)  # the last word of a piece
            ends[:-1] = (row[1:] != row[:-1]) | (breaks[words.end[:-1]] != breaks[words.start[1:]])
            last = np.flatnonzero(ends)
            left = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1
            offsets = np.concatenate([[0], np.cumsum(words.end - words.start)])
            data = words.bytes[words.bytes != 32].tobytes()
            strings = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
            held.append((strings, words.hashes(), np.array(lang.slice(i, j - i).to_pylist(), dtype=object)[row], left))
            size += n
            if size >= most_words:
                yield from _cut(held, most_words)
                held, size = [], 0
    if size:
        yield from _cut(held, most_words)


def _cut(held: list, most_words: int):
    """The held words as shards: cut where a piece ends, the first time at or after so many words."""
    strings = pa.concat_arrays([h[0] for h in held])
    hashes, langs, left = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
    names, lang = np.unique(langs.astype(str), return_inverse=True)
    starts = np.append(np.flatnonzero(np.append(True, left[:-1] == 1)), len(left))
    a = 0
    while a < len(left):
        b = int(starts[np.searchsorted(starts, min(a + most_words, len(left)))])
        yield Shard(strings.slice(a, b - a), hashes[a:b], lang[a:b].astype(np.int64), left[a:b], names.tolist())
        a = b


def _hashed(batches):
    """Counts of words and pairs by key."""
    from squall.llm.collocations import shards

    for shard in shards(batches):
        for n, places, counts in shard.phrases(2):
            yield pa.RecordBatch.from_arrays([pa.array(shard.keys(places, n).view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "f"])


PHRASE = "lang string, words int, phrase string, f long"


def _counted(common, most: int):
    """Counts of phrases by text, where all words and pairs of the phrase may be common; 0 words: all words of a language."""

    def run(batches):
        from squall.llm.collocations import shards

        for shard in shards(batches):
            names = pa.array(shard.names)
            every = np.bincount(shard.lang[shard.ids], minlength=len(shard.names))
            yield _batch(names, 0, pa.array([""] * len(names)), every)
            for n, places, counts in shard.phrases(most):
                kept = np.ones(len(places), dtype=bool)
                for k in range(n - 1) if n > 1 else (0,):
                    some = np.flatnonzero(kept)
                    kept[some] = common.value.has(shard.keys(places[some] + k, min(n, 2)))
                places, counts = places[kept], counts[kept]
                yield _batch(names.take(pa.array(shard.lang[shard.ids[places]])), n, shard.texts(places, n), counts)

    def _batch(lang, n, phrase, counts):
        return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(lang), n, dtype=np.int32)), phrase.cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "words", "phrase", "f"])

    return run


def phrase_counts(docs: DataFrame, most_words: int = 3, least: int = 10) -> DataFrame:
    """lang, words, phrase, f of every phrase of up to most_words words that stands least times or more; words 0: all words of the language."""
    spark = ready(docs.sparkSession)
    shared_dir(spark)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    keys = docs.mapInArrow(_hashed, "key long, f long").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("key")
    keys, seen = written(keys)
    common = spark.sparkContext.broadcast(bloom.build(keys, seen["n"]))
    counts = docs.mapInArrow(_counted(common, most_words), PHRASE).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return counts.where((F.col("f") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, most_rows: int = 2000, covered_percent: int = 50) -> DataFrame:
    """The best most_rows phrases per language: lang, rank, phrase, a, l, r, n, score."""
    counts, seen = written(phrase_counts(docs, most_words, least))
    parts = counts.where("words > 0").select(F.col("lang").alias("plang"), F.col("phrase").alias("part"), F.col("f").alias("pf"))
    candidates = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    cuts = cuts.join(parts.select("plang", "part", F.col("pf").alias("l")), (F.col("lang") == F.col("plang")) & (F.col("first") == F.col("part"))).drop("plang", "part")
    cuts = cuts.join(parts.select("plang", "part", F.col("pf").alias("r")), (F.col("lang") == F.col("plang")) & (F.col("rest") == F.col("part"))).drop("plang", "part")
    whole = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    score = F.expr("cast(1000000 as decimal(7,0)) * (da * da) div (dl * dr)")
    cuts = cuts.withColumns({"d" + c: x for c, x in whole.items()}).withColumn("score", score.cast("long"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inner = candidates.where("words > 2").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("words") - F.col("n"))))
    inner = inner.select("lang", F.array_join(F.slice(F.split("phrase", " "), F.col("at") + 1, F.col("n")), " ").alias("phrase"), "a")
    covers = inner.groupBy(F.col("lang").alias("clang"), F.col("phrase").alias("inner")).agg(F.max("a").alias("longer"))
    scored = scored.join(covers, (F.col("lang") == F.col("clang")) & (F.col("phrase") == F.col("inner")), "left")
    scored = scored.where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a"))).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = seen["n"] // RANKED_ROWS + 1
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    for groups in (parts, math.isqrt(parts), 1):  # the best of parts, then of groups of parts, then of all
        number = F.row_number().over(Window.partitionBy("lang", F.pmod("part", F.lit(groups))).orderBy(*best))
        scored = scored.withColumn("rank", number.cast("long")).where(F.col("rank") <= most_rows)
    totals = counts.where("words = 0").select(F.col("lang").alias("tlang"), F.col("f").alias("n"))
    return scored.join(totals, F.col("lang") == F.col("tlang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
