"""Exact Jaccard join of n-gram sets: subsets for small sets, inverted lists for large ones.

1. Rows of equal shingle sets become one node.  Shingles have one order for all: rare before
   common, by counts of all documents in a table of counters, then by hash.
2. Two sets that reach the threshold share at least d shingles among the first
   size - least overlap + d of each; that beginning is the node's prefix (d: ``depth``).
3. Two small sets meet in a subset of ``SUBSET`` shingles, all of which are enumerated from
   the prefix.  Large sets scan the inverted lists of the prefix shingles of all sets of
   fitting size.  The boundary is the size at which both ways together cost least: subsets of
   the smaller sets, against the rows of the lists that the larger sets would read.
4. Nodes that share too few keys with others go.  The others' full sets are fetched, and their
   prefixes made anew in a second order, in which all shingles that prefixes shared come last: what
   only shares passages goes too.
5. Clusters of nodes that share keys are joined in tasks of bounded bytes: a node scans the lists
   of its task, shared prefix shingles are counted, and a pair with enough of them, of fitting
   size and not connected yet, is verified on full sets.

No pairs of a group are made as rows.  In a cluster larger than a task some hubs are compared
with all nodes first; then nodes outside the largest connected part meet the others in blocks of
the cluster, or of its keys, whichever sends fewer bytes.  The pairs that are verified are the
same either way.

Bounds: the counters (16 MB) and the filters of ``bloom`` are broadcast; both only order or spare
work.  Shingles are told apart by 64 bits within a pair, sets by 128.

Defined results: rows with a null id and texts without words are linked with nothing (their
component is their own id); a text shorter than a shingle is one shingle; very long texts are one
set, cut nowhere; repeated rows and rows that share an id are answered each; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squall.llm import bloom
from squall.llm.common import columns, map_texts, ready, shared_dir, table, written
from squall.llm.graph import components
from squall.llm.near_dedup import _gather

PERCENT = 85
WIDTH = 4
SUBSET = 2
#: Bytes of sets that a task compares, at most about.
TASK_BYTES = 8 << 20
HUB_ROUNDS = 2
#: Counters of the rarity table, and how many of them travel as one row.
COUNTERS, SEGMENT = 1 << 24, 1 << 16
#: Tasks whose tables are added up first.
FAN = 64


def least_overlap(size, percent: int):
    """Of any set that reaches the threshold with one of this size."""
    return -(-percent * size // 100)


def depth(size):
    """Shingles that prefixes share at least: two, or more for larger sets."""
    return np.clip(size // 16, SUBSET, 32)


def shared_least(size, percent: int):
    """Prefix shingles that a set of this size shares at least with any set that it links with."""
    return np.minimum(depth(least_overlap(size, percent)), size)


def prefix_length(size, percent: int):
    return np.minimum(size, size - least_overlap(size, percent) + depth(size))


# ---- rarity --------------------------------------------------------------------


def _count(width: int):
    def run(batches):
        from squall.llm.shingles import Sets
        from squall.llm.textcore import slices

        seen = np.zeros(COUNTERS, dtype=np.uint16)
        for batch in batches:
            texts = columns(batch, "text")[0]
            for i, j in slices(texts):
                place, counts = np.unique(Sets(texts.slice(i, j - i), width).hashes >> np.uint64(64 - int(math.log2(COUNTERS))), return_counts=True)
                seen[place.astype(np.int64)] += np.minimum(counts, 1000).astype(np.uint16)
                np.minimum(seen, 60_000, out=seen) if seen.max() > 60_000 else None
        rows = [(k, zlib.compress(seen[k * SEGMENT : (k + 1) * SEGMENT].tobytes(), 1)) for k in range(COUNTERS // SEGMENT)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["segment", "counts"])

    return run


def _sum(table_: pa.Table) -> pa.Table:
    total = np.zeros(SEGMENT, dtype=np.uint64)
    for x in table_["counts"]:
        raw = zlib.decompress(x.as_py())
        total += np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * SEGMENT else np.uint64)
    return pa.table({"segment": table_["segment"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()), "total": pa.array([int(total.sum())], pa.int64())})


class Rarity:
    """Level of each counter: 0 up to the mean, then one more for each doubling."""

    def __init__(self, levels: np.ndarray, mean: float):
        self.levels, self.mean = levels, mean

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return self.levels[(hashes >> np.uint64(64 - int(math.log2(COUNTERS)))).astype(np.int64)]

    def cost(self, levels: np.ndarray) -> np.ndarray:
        """Rows of a shingle's list, about."""
        return np.where(levels > 0, 2.0 ** levels.astype(np.int64) * (self.mean + 1), 1.0)


def rarity(docs: DataFrame, width: int) -> Rarity:
    """Counts of all documents' shingles: summed by the executors; the driver gets a byte a counter."""
    parts = docs.select("text").mapInArrow(_count(width), "segment int, counts binary").withColumn("part", F.floor(F.spark_partition_id() / FAN))
    parts = parts.groupBy("segment", "part").applyInArrow(_sum, "segment int, counts binary, total long")
    rows = parts.groupBy("segment").applyInArrow(_sum, "segment int, counts binary, total long").checkpoint()
    mean = (rows.agg(F.sum("total")).first()[0] or 0) / COUNTERS

    def level(batches):
        for batch in batches:
            out = [np.maximum(0, np.ceil(np.log2(np.maximum(np.frombuffer(zlib.decompress(x), dtype=np.uint64), 1) / (mean + 1)))).astype(np.uint8).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(x, 1) for x in out], pa.binary())], ["segment", "levels"])

    levels = np.zeros(COUNTERS, dtype=np.uint8)
    for row in rows.mapInArrow(level, "segment int, levels binary").collect():
        levels[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(zlib.decompress(row["levels"]), dtype=np.uint8)
    return Rarity(levels, mean)


# ---- nodes and keys ------------------------------------------------------------

SIGNED = "doc_id long, n long, k1 long, k2 long, tokens array<long>, scan double"


def _key(width: int):
    """Without prefixes: (doc_id, n, k1, k2)."""

    def run(batch):
        from squall.llm.shingles import Sets

        ids, texts = columns(batch, "doc_id", "text")
        sets = Sets(texts, width)
        k1, k2 = sets.keys()
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sets.sizes()), pa.array(k1), pa.array(k2)], ["doc_id", "n", "k1", "k2"])

    return run


def _sign(width: int, percent: int, order):
    def run(batch):
        from squall.llm.jaccard_join import prefix_length
        from squall.llm.shingles import Sets
        from squall.llm.textcore import mix

        ids, texts = columns(batch, "doc_id", "text")
        sets = Sets(texts, width)
        n = sets.sizes()
        k1, k2 = sets.keys()
        levels = order.value.of(sets.hashes)
        row = np.repeat(np.arange(len(n)), n)
        place = np.lexsort((mix(sets.hashes), levels, row))
        p = prefix_length(n, percent)
        first = (np.arange(len(place)) - np.repeat(sets.at[:-1], n)) < np.repeat(p, n)
        place = place[first]
        scan = np.bincount(row[place], weights=order.value.cost(levels[place]), minlength=len(n)) if len(place) else np.zeros(len(n))
        tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p)]).astype(np.int32)), pa.array(sets.hashes[place].view(np.int64)))
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n), pa.array(k1), pa.array(k2), tokens, pa.array(scan)], ["doc_id", "n", "k1", "k2", "tokens", "scan"])

    return run


def _prefixes(percent: int, order, common):
    """(node, n, tokens): prefixes of known sets, with the shingles that the filter knows behind all others."""

    def run(batches):
        from squall.llm.jaccard_join import prefix_length
        from squall.llm.textcore import mix

        for batch in batches:
            nodes, blobs = columns(batch, "node", "shingles")
            n, tokens = [], []
            for blob in blobs:
                h = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                place = np.lexsort((mix(h), order.value.of(h), common.value.has(h)))
                n.append(len(h))
                tokens.append(h[place[: prefix_length(np.int64(len(h)), percent)]].view(np.int64))
            yield pa.RecordBatch.from_arrays([nodes, pa.array(n, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["node", "n", "tokens"])

    return run


def size_class(size):
    """Sizes up to 64 by themselves, larger ones by eighths of a doubling: a few hundred classes at most."""
    return F.when(size <= 64, size).otherwise(64 + F.floor(8 * F.log2(size / 64.0))).cast("int")


def boundary(nodes: DataFrame, percent: int) -> int:
    """The greatest size of a small set: where subsets and lists together cost least."""
    p = F.size("tokens")
    costs = nodes.groupBy(size_class(F.col("n")).alias("c")).agg(F.max("n").alias("most"), F.sum(p * (p - 1) / 2).alias("subsets"), F.sum(p).alias("posted"), F.sum("scan").alias("scan"))
    costs = sorted(costs.collect(), key=lambda r: r["c"])
    best, least = 0, math.inf
    for k in range(len(costs) + 1):
        x = costs[k - 1]["most"] if k else 0
        fitting = sum(r["posted"] for r in costs if r["most"] >= least_overlap(x + 1, percent))
        total = sum(r["subsets"] for r in costs[:k]) + sum(r["scan"] for r in costs[k:]) + (fitting if k < len(costs) else 0)
        if total < least:
            best, least = x, total
    return best


def _keys(small: int, percent: int, shared=None):
    """KEYED; with a filter of shared keys only those of nodes that share enough of them."""

    def run(batches):
        from squall.llm.jaccard_join import least_overlap, shared_least
        from squall.llm.textcore import mix

        for batch in batches:
            nodes, n, tokens = columns(batch, "node", "n", "tokens")
            nodes, n = nodes.to_numpy(), n.to_numpy()
            at, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False).view(np.uint64)
            p = np.diff(at)
            keys, rows, probes = [], [], []
            for size in np.unique(p[n <= small]):  # sets of one prefix length at a time
                some = np.flatnonzero((n <= small) & (p == size))
                i, j = np.triu_indices(size, 1)
                own = np.sort(flat[at[some][:, None] + np.arange(size)], axis=1)
                keys.append(mix(own[:, i] * np.uint64(0x100000001B3) ^ mix(own[:, j])).ravel())
                rows.append(np.repeat(some, len(i)))
                probes.append(np.full(len(rows[-1]), SUBSETS, dtype=np.int32))
            if shared is not None and keys:
                hit = shared.value.has(np.concatenate(keys))
                keys, rows, probes = [np.concatenate(keys)[hit]], [np.concatenate(rows)[hit]], [np.concatenate(probes)[hit]]
            posted = np.repeat(n >= least_overlap(small + 1, percent), p)
            row = np.repeat(np.arange(len(n)), p)[posted]
            key = flat[at[0] : at[-1]][posted]
            if shared is not None:
                hit = shared.value.has(key)
                row, key = row[hit], key[hit]
                enough = np.bincount(row, minlength=len(n)) >= shared_least(n, percent)
                row, key = row[enough[row]], key[enough[row]]
            keys, rows = np.concatenate([*keys, key]), np.concatenate([*rows, row]).astype(np.int64)
            kind = np.concatenate([*probes, np.where(n[row] > small, PROBES, POSTED).astype(np.int32)])
            least = shared_least(n, percent).astype(np.int32)[rows]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes[rows]), pa.array(kind), pa.array(least)], ["key", "node", "kind", "least"])

    return run


#: Kinds of keys: list rows of small and of large sets, and subsets.
POSTED, PROBES, SUBSETS = 0, 1, 2
KEYED = "key long, node long, kind int, least int"


def _cold(keyed: DataFrame) -> DataFrame:
    """(key, node, kind) of keyed, without the longest lists of each node.

    Two linked sets share at least ``least`` list keys.  Where each leaves out its least - 1 longest
    lists (of equal ones, by key), the shortest list that both stand in stays with both.
    """
    lists = keyed.groupBy(F.col("key").alias("lk")).agg(F.count(F.lit(1)).alias("rows"), F.max("kind").alias("most")).where((F.col("rows") > 1) & (F.col("most") >= PROBES))
    known = keyed.join(lists, F.col("key") == F.col("lk"))
    subset = F.col("kind") == SUBSETS
    own = Window.partitionBy("node")
    place = F.row_number().over(own.orderBy(subset, F.desc("rows"), "key"))
    known = known.withColumn("place", place).withColumn("held", F.count(F.when(~subset, 1)).over(own))
    kept = known.where(subset | ((F.col("held") >= F.col("least")) & (F.col("place") >= F.col("least"))))
    return kept.select("key", "node", "kind")


def _candidates(own: DataFrame, small: int, percent: int):
    """own(node, n, tokens) -> (key, node, kind) of the nodes that may link, and a filter of the keys that nodes share."""
    spark = own.sparkSession
    rows = own.mapInArrow(_keys(small, percent), KEYED).groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("kind").alias("kind"))
    shared, seen = written(rows.where((F.col("rows") > 1) & (F.col("kind") >= PROBES)).select("key"))
    common = spark.sparkContext.broadcast(bloom.build(shared, seen["n"]))
    return _cold(own.mapInArrow(_keys(small, percent, common), KEYED).checkpoint()).checkpoint(), common


# ---- comparison ----------------------------------------------------------------


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    return int(np.count_nonzero(b[place] == a))


def join(labels, tokens, sets, left, right, percent: int) -> list[tuple[int, int]]:
    """Pairs (places) of left and right that reach the threshold and join parts that weren't connected yet.

    labels: known parts; tokens: prefixes; sets: sorted full sets.  Every pair with enough
    shared prefix shingles is verified, unless it is connected by then.
    """
    from squall.llm.jaccard_join import depth

    n = np.array([len(s) for s in sets])
    p = np.array([len(t) for t in tokens])
    part = np.unique(labels, return_inverse=True)[1]
    left, right = np.asarray(left, dtype=np.int64), np.asarray(right, dtype=np.int64)
    both = np.zeros(len(n), dtype=bool)
    both[np.intersect1d(left, right)] = True
    flat = np.concatenate([tokens[k] for k in right]) if len(right) else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(right)), p[right])[order]
    deep, rest = depth(n), n - p
    out = []
    for i in left.tolist():
        a, b = np.searchsorted(flat, tokens[i], "left"), np.searchsorted(flat, tokens[i], "right")
        lists = np.flatnonzero(b > a)
        if not len(lists):
            continue
        counts = np.bincount(np.concatenate([owner[a[k] : b[k]] for k in lists]), minlength=len(right))
        seen = np.flatnonzero(counts)
        j, counts = right[seen], counts[seen]
        # Whichever prefix ends first, all common shingles up to its end are counted; so many may follow.
        need = np.maximum(-(-percent * (n[i] + n[j]) // (100 + percent)) - np.maximum(rest[i], rest[j]), np.minimum(np.minimum(deep[i], deep[j]), np.minimum(n[i], n[j])))
        fits = (part[j] != part[i]) & (counts >= need) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ~(both[i] & both[j] & (j > i))
        j = j[fits][np.argsort(-counts[fits], kind="stable")]
        while len(j):
            x = int(j[0])
            j = j[1:]
            common = _overlap(sets[i], sets[x])
            if 100 * common >= percent * (n[i] + n[x] - common):
                out.append((int(i), x))
                part[part == part[x]] = part[i]
                j = j[part[j] != part[i]]
    return out


def _join_task(percent: int):
    def run(table_: pa.Table) -> pa.Table:
        from squall.llm.jaccard_join import join

        table_ = table_.combine_chunks()
        nodes, sides = table_["node"].to_numpy(), table_["side"].to_numpy()
        unique, place = np.unique(nodes, return_index=True)  # a node may stand on both sides
        own = table_.take(pa.array(place))
        tokens = [np.array(x, dtype=np.int64) for x in own["tokens"].to_pylist()]
        sets = [np.frombuffer(x, dtype=np.uint64) for x in own["shingles"].to_pylist()]
        left, right = (np.unique(np.searchsorted(unique, nodes[sides != s])) for s in (1, 0))
        pairs = join(own["label"].to_numpy(), tokens, sets, left, right, percent)
        return pa.table({"a": pa.array([unique[x] for x, _ in pairs], pa.int64()), "b": pa.array([unique[y] for _, y in pairs], pa.int64())})

    return run


def _links(tasks: DataFrame, percent: int) -> DataFrame:
    return tasks.groupBy("task").applyInArrow(_join_task(percent), "a long, b long")


def _tasks(df: DataFrame, task, side: int) -> DataFrame:
    place = F.struct(*[x.cast(kind).alias(name) for x, kind, name in zip(task, ("long", "int", "int"), ("id", "i", "j"), strict=True)])
    return df.select(place.alias("task"), F.lit(side).alias("side"), "node", "label", "tokens", "shingles")


# ---- clusters ------------------------------------------------------------------


def _outside(df: DataFrame, group: str, half: int) -> DataFrame:
    """Per group of several parts: its largest part, and in how many blocks the nodes outside of it meet all."""
    parts = df.groupBy("cluster", F.col(group).alias("g"), "label").agg(F.sum("bytes").alias("k"))
    parts = parts.groupBy("cluster", "g").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("all")).where(F.col("top.k") < F.col("all"))
    outside = F.col("all") - F.col("top.k")
    rounds, blocks = F.ceil(outside / half).cast("int"), F.ceil(F.col("all") / half).cast("int")
    return parts.select(F.col("cluster").alias("gc"), "g", F.col("top.label").alias("top"), rounds.alias("rounds"), blocks.alias("parts"), (F.col("all") * rounds + outside * blocks).alias("sent"), outside.alias("outside"))


def _block_tasks(whole: DataFrame, percent: int, hubs=None) -> DataFrame:
    """whole: rows of members with g, top, rounds, parts.  hubs: which of the nodes outside the top part are taken (all)."""
    row = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n))
    left = whole.where(F.col("label") != F.col("top"))
    left = left.where(hubs) if hubs is not None else left
    rounds = F.lit(1) if hubs is not None else F.col("rounds")
    left = left.withColumn("i", F.lit(0) if hubs is not None else row(1, "rounds")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = whole.withColumn("i", F.explode(F.sequence(F.lit(0), rounds - 1))).withColumn("j", row(2, "parts"))
    both = [_tasks(x, (F.col("g"), F.col("i"), F.col("j")), side) for side, x in enumerate((left, right))]
    return _links(both[0].unionByName(both[1]), percent)


def _with_sets(docs: DataFrame, members: DataFrame, n: int, width: int, again: bool) -> DataFrame:
    """n members with the shingles of their texts: only rows that may be members leave their place.  again: some rows come more than once."""
    known = docs.sparkSession.sparkContext.broadcast(bloom.build(members.select(F.xxhash64("doc_id")), n))
    hashed = docs.where(F.col("doc_id").isNotNull()).withColumn("hash", F.xxhash64("doc_id"))
    sets = map_texts(hashed, _gather(width, known), "g0 long, g1 long, g2 long, shingles binary")
    same = (F.col("g0") == F.col("doc_id")) & (F.col("g1") == F.col("k1")) & (F.col("g2") == F.col("k2"))
    joined = sets.join(members, same).drop("g0", "g1", "g2")
    return (joined.dropDuplicates(["node"]) if again else joined).select("node", "shingles")


def _stars(keyed: DataFrame) -> DataFrame:
    """(a, b): of every key with a row that probes, its other nodes and the least node that probes; at most a row for each of keyed, told in one pass along each key."""
    probes = F.col("kind") >= PROBES
    along = Window.partitionBy("key").orderBy(F.desc(probes), "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = keyed.select("node", F.first("node").over(along).alias("hub"), F.first(probes).over(along).alias("probed"))
    return first.where(F.col("probed") & (F.col("node") != F.col("hub"))).select(F.col("node").alias("a"), F.col("hub").alias("b"))


def _cluster_links(sets: DataFrame, own: DataFrame, keyed: DataFrame, percent: int, task_bytes: int) -> DataFrame:
    """(node, label) of all nodes that are linked; sets: (node, shingles), own: (node, n, tokens), keyed: (key, node, kind)."""
    clusters = components(_stars(keyed)).select(F.col("node").alias("cn"), F.col("label").alias("cluster"))
    members = own.join(clusters, F.col("node") == F.col("cn")).drop("cn")
    sizes = members.groupBy(F.col("cluster").alias("sc")).agg(F.sum(8 * F.col("n")).alias("size")).where(F.col("size") > task_bytes)
    members, seen = written(members.join(sizes, F.col("cluster") == F.col("sc"), "left").drop("sc"), large=F.count("size"))
    full = members.join(sets.select(F.col("node").alias("sn"), "shingles"), F.col("node") == F.col("sn")).drop("sn").withColumn("label", F.col("node")).withColumn("bytes", 8 * F.col("n"))
    links = _links(_tasks(full.where("size is null"), (F.col("cluster"), F.lit(0), F.lit(0)), 2), percent)
    if not seen.get("large"):
        return components(links)
    links = links.checkpoint()
    large, found = full.where("size is not null").checkpoint(), None
    half = max(1, task_bytes // 2)
    plain = large
    for k in range(HUB_ROUNDS):
        groups = _outside(large, "cluster", half)
        whole = large.join(groups, F.col("cluster") == F.col("gc"))
        chosen = F.pmod(F.xxhash64(F.lit(10 + k), "node"), F.ceil(F.col("outside") / half)) == 0
        new = _block_tasks(whole, percent, chosen)
        found = (new if found is None else found.unionByName(new)).checkpoint()
        labels = components(found).select(F.col("node").alias("fn"), F.col("label").alias("found")).checkpoint()
        large = plain.join(labels, F.col("node") == F.col("fn"), "left").withColumn("label", F.coalesce("found", "label")).drop("fn", "found")
    links = links.unionByName(found)
    by_cluster, seen = written(_outside(large, "cluster", half))
    if not seen["n"]:
        return components(links)
    listed = large.join(keyed.select(F.col("node").alias("kn"), "key"), F.col("node") == F.col("kn")).drop("kn")
    by_key = _outside(listed, "key", half).checkpoint()
    total = by_key.groupBy(F.col("gc").alias("tc")).agg(F.sum("sent").alias("by_key"))
    costs = by_cluster.select(F.col("gc").alias("cc"), "sent").join(total, F.col("cc") == F.col("tc"), "left").select("cc", (F.coalesce("by_key", F.lit(0)) < F.col("sent")).alias("keyed"))
    names = ("node", "label", "tokens", "shingles", "g", "top", "rounds", "parts")
    one = large.join(by_cluster.join(costs.where("not keyed"), F.col("gc") == F.col("cc"), "left_semi"), F.col("cluster") == F.col("gc")).select(*names)
    other = listed.join(by_key.join(costs.where("keyed"), F.col("gc") == F.col("cc"), "left_semi"), (F.col("cluster") == F.col("gc")) & (F.col("key") == F.col("g"))).select(*names)
    return components(links.unionByName(_block_tasks(one.unionByName(other), percent)))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, small: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id that it reaches).  small: the boundary, where it isn't to be chosen."""
    spark = ready(docs.sparkSession)
    shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = spark.sparkContext.broadcast(rarity(docs, width))
    linkable = map_texts(docs.where(F.col("doc_id").isNotNull()), _sign(width, percent, order), SIGNED).where("n > 0")
    nodes = linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("scan").alias("scan"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).checkpoint()
    signed = map_texts(docs, _key(width), "doc_id long, n long, k1 long, k2 long").checkpoint()
    again = not signed.where("n > 0").groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty()
    small = boundary(nodes, percent) if small is None else small
    keyed, common = _candidates(nodes.select("node", "n", "tokens"), small, percent)
    left = keyed.select(F.col("node").alias("cn")).distinct()
    members, seen = written(nodes.select("node", "doc_id", "k1", "k2").join(left, F.col("node") == F.col("cn")).drop("cn"))
    sets = _with_sets(docs, members, seen["n"], width, again).checkpoint()
    own = sets.mapInArrow(_prefixes(percent, order, common), "node long, n long, tokens array<long>").checkpoint()
    keyed, _ = _candidates(own, small, percent)
    joined = _cluster_links(sets, own, keyed, percent, task_bytes).select(F.col("node").alias("jn"), "label")
    named = nodes.select("node", "k1", "k2", "doc_id").join(joined, F.col("node") == F.col("jn"), "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy(F.col("label").alias("ll")).agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, F.col("label") == F.col("ll")).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "component_id")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    out = signed.where(~alone).join(named, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(signed.where(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
