"""Exact substring dedup by fixed-block anchors.

Every text is indexed by its non-overlapping blocks of ten words; every rolling
ten-word window probes the index.  A window of twenty words always holds a whole
block of its own text, so any repeat of twenty words hits the index from both
places.  Hits are extended word by word to the maximal repeats, which is the same
as comparing all twenty-word windows that hold a hit: a word goes if some window
over it also starts earlier (smaller doc_id, or same document, earlier start), and a
maximal repeat of twenty words or more is the union of such windows.

Distribution.  Texts are dealt once into chunks of consecutive doc_ids, so that
"earlier" between chunks is the order of chunks; that one exchange serves all three
passes.  Per chunk and hash bucket, distinct hashes travel as one sorted binary
column (four bytes a probe; twelve bytes a twenty-word window near a hit), and one
bit a hash comes back.  A passage that is in every text is one hash per chunk, so
no bucket grows with a hot passage.  Chunks grow from 3 to 24 million characters
with the input and buckets stop at 262,144, so what is sent grows as the input: a row
holds about 280 hashes at 10 GB, 31 at 1 TB, 18 at 10 TB and 14 at 100 TB, where a
bucket's rows take about 0.5 GB.  The chunks' bounds (8 bytes each, 4 million at most) are the only
thing that is broadcast; they come from percentiles in two levels.

Defined results: null and empty texts have no words and lose none; texts with a null
id come first; texts of equal id are ordered by hash, then text, so that an id with
very many rows fills several chunks; repeated rows are separate documents, of which the
later ones lose what they repeat; texts of fewer than twenty words lose nothing; a very
long text is cut nowhere; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.llm.common import ready, table

WINDOW = 20
BLOCK = 10  # any WINDOW words hold a whole block of this size: 2 * BLOCK - 1 <= WINDOW
#: Characters of text per chunk, about: the least and the greatest, and how many chunks there are before they grow.
CHUNK_CHARS = 3_000_000
MOST_CHUNK_CHARS = 24_000_000
SMALL_CHUNKS = 100_000
MOST_CHUNKS = 1 << 22
MOST_BUCKETS = 1 << 18
#: Percentiles that one aggregation is asked for.
AT_ONCE = 1000

_SENT = "chunk int, bucket int, hashes binary, marks binary"
_BITS = "chunk int, bucket int, bits binary"


def n_chunks_of(total: int, chars: int = CHUNK_CHARS) -> int:
    """How many chunks so many characters make."""
    grown = min(max(chars, total // SMALL_CHUNKS), max(chars, MOST_CHUNK_CHARS))
    return min(MOST_CHUNKS, max(1, -(-total // grown)))


def chunk_bounds(docs: DataFrame, chars: int, at_once: int = AT_ONCE) -> tuple[np.ndarray, int, int]:
    """(doc_ids that bound chunks, in order and repeated for ids of many rows; chunks of null ids; all chunks)."""
    null = F.col("doc_id").isNull()
    row = docs.agg(F.sum(F.length("text")).alias("c"), F.sum(F.when(null, F.length("text"))).alias("nulls"), F.count(F.when(null, 1)).alias("n_nulls")).first()
    total, nulls = row["c"] or 0, row["nulls"] or 0
    n_all = n_chunks_of(total, chars)
    of_nulls = -(-nulls * n_all // max(total, 1)) if row["n_nulls"] else 0
    of_nulls = max(of_nulls, 1 if row["n_nulls"] else 0)
    n = max(1, n_all - of_nulls)
    known = docs.where(~null).select("doc_id")
    if n == 1:
        return np.zeros(0, dtype=np.int64), of_nulls, 1 + of_nulls

    def between(parts: int):
        return F.percentile_approx("doc_id", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(20 * parts)).alias("b")

    coarse = min(n, at_once)
    bounds = np.array(known.agg(between(coarse)).first()["b"] or [], dtype=np.int64)
    if n > coarse:  # each coarse part again, all at once
        fine = -(-n // coarse)
        level = F.size(F.filter(F.lit(sorted({int(x) for x in bounds})), lambda e: e < F.col("doc_id")))
        parts = known.groupBy(level.alias("part")).agg(between(fine)).select("b").toArrow()
        inner = [np.array(x, dtype=np.int64) for x in parts["b"].to_pylist() if x]
        bounds = np.concatenate([bounds, *inner])
    return np.sort(bounds), of_nulls, len(bounds) + 1 + of_nulls


def _chunk_column(bounds: np.ndarray, of_nulls: int):
    """The chunk of a row: by doc_id, and by the text's hash where an id fills several."""

    @F.arrow_udf("int")
    def chunk(ids: pa.Array, keys: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        low = np.where(known, np.searchsorted(bounds, values, "left") + of_nulls, 0)
        high = np.where(known, np.searchsorted(bounds, values, "right") + of_nulls, max(of_nulls - 1, 0))
        share = (keys.to_numpy(zero_copy_only=False) >> 32) * (high - low + 1) >> 31
        return pa.array((low + share).astype(np.int32))

    return chunk("doc_id", "order")


def _in_order(table_: pa.Table) -> pa.Table:
    """A chunk's rows in the order that counts."""
    ids, texts = table_["doc_id"].combine_chunks(), table_["text"].combine_chunks().fill_null("")
    keys = [("d", "ascending"), ("o", "ascending"), ("t", "ascending")]
    place = pa.compute.sort_indices(pa.table({"d": ids, "o": table_["order"].combine_chunks(), "t": texts}), sort_keys=keys, null_placement="at_start")
    return pa.table({"doc_id": ids.take(place), "text": texts.take(place)})


class Chunk:
    """Words of a chunk, and its ten-word windows as (bucket, fingerprint)."""

    def __init__(self, table_: pa.Table, n_buckets: int):
        from squall.llm.textcore import Words, grams

        self.rows = _in_order(table_)
        self.words = Words(self.rows["text"].combine_chunks().cast(pa.large_string()), "space")
        self.hashes = self.words.hashes()
        self.at = self.words.at
        g, self.first = grams(self.hashes, self.at, BLOCK)
        self.key = (g >> np.uint64(32)) % np.uint64(n_buckets) << np.uint64(32) | (g & np.uint64(0xFFFFFFFF))
        row = np.searchsorted(self.at, self.first, "right") - 1
        self.aligned = (self.first - self.at[row]) % BLOCK == 0
        # distinct keys in order; inverse: which of them each window has
        self.distinct, self.inverse, self.counts = np.unique(self.key, return_inverse=True, return_counts=True)

    def near_hits(self, hit: np.ndarray, n_buckets: int):
        """Twenty-word windows that hold a hit: first words, and (bucket, hash, check) of each."""
        from squall.llm.textcore import grams

        total = len(self.hashes)
        marks = np.zeros(total + 1, dtype=np.int64)
        at_word = np.zeros(total, dtype=np.int64)
        at_word[self.first[hit[self.inverse]]] = 1
        np.cumsum(at_word, out=marks[1:])
        h, first = grams(self.hashes, self.at, WINDOW, 0)
        near = marks[first + WINDOW - BLOCK + 1] > marks[first]
        check = grams(self.hashes, self.at, WINDOW, 1)[0][near]
        h, first = h[near], first[near]
        return first, (h >> np.uint64(40)) % np.uint64(n_buckets), h, (check & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _sent(chunk: int, bucket: np.ndarray, hashes: np.ndarray, marks: np.ndarray) -> pa.Table:
    """One row per bucket; the columns are sorted by bucket."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket)) if len(cuts) else cuts
    return pa.table(
        {
            "chunk": pa.array([chunk] * len(cuts), pa.int32()),
            "bucket": pa.array([int(bucket[a]) for a in cuts], pa.int32()),
            "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            "marks": pa.array([marks[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
        }
    )


def _bits_of(replies: pa.Table, sizes: dict[int, int]) -> np.ndarray:
    """The chunk's bits of all buckets, in bucket order."""
    by_bucket = dict(zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist(), strict=True))
    parts = [np.unpackbits(np.frombuffer(by_bucket[b], dtype=np.uint8), count=n).astype(bool) for b, n in sorted(sizes.items())]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def _sizes(bucket: np.ndarray) -> dict[int, int]:
    names, n = np.unique(bucket, return_counts=True)
    return dict(zip(names.tolist(), n.tolist(), strict=True))


def _probe(n_buckets: int):
    def run(table_: pa.Table) -> pa.Table:
        c = Chunk(table_, n_buckets)
        aligned = np.zeros(len(c.distinct), dtype=np.uint8)
        aligned[c.inverse[c.aligned]] = 1
        marks = aligned | (np.minimum(c.counts, 2) - 1).astype(np.uint8) << 1
        return _sent(table_["chunk"][0].as_py(), (c.distinct >> np.uint64(32)).astype(np.int64), (c.distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32), marks)

    return run


def _reply(table_: pa.Table, bits: np.ndarray, sizes: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    parts = [np.packbits(bits[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
    return pa.table({"chunk": table_["chunk"].cast(pa.int32()), "bucket": table_["bucket"].cast(pa.int32()), "bits": pa.array(parts, pa.binary())})


def _hits(table_: pa.Table) -> pa.Table:
    """Fingerprints that are an indexed block somewhere and stand twice or more."""
    hashes, sizes = _flat(table_["hashes"], np.uint32)
    marks, _ = _flat(table_["marks"], np.uint8)
    out = np.zeros(len(hashes), dtype=bool)
    for part in _slices(hashes >> np.uint32(28), 16):
        _, inverse, counts = np.unique(hashes[part], return_inverse=True, return_counts=True)
        own = marks[part]
        indexed = np.zeros(len(counts), dtype=bool)
        indexed[inverse[own & 1 > 0]] = True
        twice = counts > 1
        twice[inverse[own & 2 > 0]] = True
        out[part] = (indexed & twice)[inverse]
    return _reply(table_, out, sizes)


def _flat(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and how many each row has."""
    parts = [np.frombuffer(x, dtype=kind) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(x) for x in parts], dtype=np.int64)


def _slices(number: np.ndarray, n: int):
    """Places of each of n numbers; small inputs are one slice."""
    if len(number) < 1 << 20:
        yield np.arange(len(number))
        return
    for k in range(n):
        yield np.flatnonzero(number == k)


def _windows(n_buckets: int):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _sent(0, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        _, _, key = _near(texts, replies, n_buckets)
        return _sent(texts["chunk"][0].as_py(), key["bucket"].astype(np.int64), key["hash"], key["check"])

    return run


def _near(texts: pa.Table, replies: pa.Table, n_buckets: int):
    """(chunk, windows, distinct keys): windows with first word, key number and whether it is the chunk's first of its key."""
    c = Chunk(texts, n_buckets)
    hit = _bits_of(replies, _sizes((c.distinct >> np.uint64(32)).astype(np.int64)))
    first, bucket, h, check = c.near_hits(hit, n_buckets)
    order = np.lexsort((first, check, h, bucket))
    b, x, y = bucket[order], h[order], check[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (b[1:] != b[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    number = np.cumsum(new) - 1
    return c, (first[order], number, new), {"bucket": b[new], "hash": x[new], "check": y[new]}


def _earlier(table_: pa.Table) -> pa.Table:
    """Per chunk and window: whether an earlier chunk has it."""
    h, sizes = _flat(table_["hashes"], np.uint64)
    check, _ = _flat(table_["marks"], np.uint32)
    chunk = np.repeat(table_["chunk"].to_numpy(), sizes)
    out = np.zeros(len(h), dtype=bool)
    for part in _slices(check >> np.uint32(28), 16):
        order = part[np.lexsort((chunk[part], check[part], h[part]))]
        x, y = h[order], check[order]
        out[order[1:]] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    return _reply(table_, out, sizes)


def _clean(n_buckets: int):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        found = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": []}
        if texts.num_rows:
            both = replies.to_pydict()
            kind = np.array(both["kind"])
            first_replies, second_replies = replies.filter(pa.array(kind == 1)), replies.filter(pa.array(kind == 2))
            c, (first, number, new), key = _near(texts, first_replies, n_buckets)
            earlier = _bits_of(second_replies, _sizes(key["bucket"].astype(np.int64)))
            gone = first[~new | earlier[number]]
            steps = np.zeros(len(c.hashes) + 1, dtype=np.int64)
            np.add.at(steps, gone, 1)
            np.add.at(steps, gone + WINDOW, -1)
            removed = np.cumsum(steps[:-1]) > 0
            at, w = c.at, c.words
            per = np.concatenate([[0], np.cumsum(removed)])
            n_removed = per[at[1:]] - per[at[:-1]]
            for i in range(len(at) - 1):
                a, b = int(at[i]), int(at[i + 1])
                words = w.seen[w.offsets[i] : w.offsets[i + 1]].split()
                if n_removed[i]:
                    words = [words[k] for k in np.flatnonzero(~removed[a:b])]
                found["kept_text"].append(b" ".join(words).decode("utf-8", "replace"))
            found["doc_id"], found["n_words"], found["n_removed"] = c.rows["doc_id"], np.diff(at), n_removed
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string()}
        return pa.table({k: v.cast(kinds[k]) if isinstance(v, pa.ChunkedArray) else pa.array(v, kinds[k]) for k, v in found.items()})

    return run


def remove_repeats(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, at_once: int = AT_ONCE) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by a space)."""
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1).alias("order"))
    bounds, of_nulls, n_chunks = chunk_bounds(docs, chunk_chars, at_once)
    n_buckets = min(MOST_BUCKETS, max(1, n_chunks // 2))
    texts = docs.withColumn("chunk", F.lit(0) if n_chunks == 1 else _chunk_column(bounds, of_nulls))
    sent = texts.groupBy("chunk").applyInArrow(_probe(n_buckets), _SENT)
    hits = sent.groupBy("bucket").applyInArrow(_hits, _BITS)
    near = texts.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_windows(n_buckets), _SENT)
    earlier = near.groupBy("bucket").applyInArrow(_earlier, _BITS)
    replies = hits.withColumn("kind", F.lit(1)).unionByName(earlier.withColumn("kind", F.lit(2)))
    return texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_clean(n_buckets), "doc_id long, n_words long, n_removed long, kept_text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
