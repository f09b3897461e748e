"""MinHash near-duplicates with sequential Bayesian verification.

1. Rows of equal shingle sets become one node (the set's 128-bit key, not the
   document's id, tells nodes apart).
2. Signatures are banded; nodes that share a band key are candidates.
3. Candidates' signatures are compared batch by batch.  A pair is pruned as soon as
   the posterior probability (uniform prior on similarity) that it reaches the
   threshold is below the miss probability; survivors are verified on the full sets.
   Pairs that are connected by then need no look.

No pairs of a group are ever made as rows.  Nodes connected over band keys form a
cluster; one of at most ``BLOCK`` nodes is a task of its own.  In a larger cluster some
hubs are compared with all nodes first, in blocks; so a tight group of m nodes costs
about m comparisons.  Nodes that stay outside the largest connected part then meet the
others in blocks, within the cluster or within each band key (a pair under the first
band that it shares), whichever sends fewer nodes: a loose cluster costs only what
shares a band.  No candidate is dropped for a group's size.

Defined results: null and empty texts (without words) have an empty set and are linked
with nothing; rows with a null id are kept and linked with nothing; a text shorter than a
shingle is one shingle; very long texts are one set like any other, cut nowhere; every
row is answered for itself, also rows that share an id: unlike texts of one id may have
unlike components, and ties between ids don't matter to what is linked; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.llm import bloom
from squall.llm.common import columns, map_texts, ready, shared_dir, table, written
from squall.llm.graph import components
from squall.llm.shingles import N_HASHES, WIDTH

PERCENT = 80
MISS = 1e-6  # of pruning a pair that reaches the threshold, per look
LOOKS = (32, 64, 96, 128)  # signature values compared so far
BLOCK = 256
HUBS = 32


def least_matches(threshold: float = PERCENT / 100, miss: float = MISS, looks=LOOKS) -> list[int]:
    """Per look, the fewest matches m of n with P(similarity >= threshold | m, n) >= miss.

    With a uniform prior the posterior is Beta(m+1, n-m+1), whose upper tail is a
    binomial sum.  Eight-bit values also agree by chance, which only adds matches.
    """
    out = []
    for n in looks:
        tail, need = 0.0, n + 1
        # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                need = m
                break
        out.append(need)
    return out


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands): a pair at the threshold shares a band but for about one in a million."""
    for rows in range(8, 1, -1):
        bands = N_HASHES // rows
        if (1 - (percent / 100) ** rows) ** bands < 1e-6:
            return rows, bands
    return 1, N_HASHES


SIGNED = "doc_id long, n long, k1 long, k2 long, sig binary, bands array<long>"


def _sign(width: int, rows: int, bands: int):
    def run(batch):
        from squall.llm.shingles import Sets, band_keys

        ids, texts = columns(batch, "doc_id", "text")
        sets = Sets(texts, width)
        n = sets.sizes()
        k1, k2 = sets.keys()
        some = n > 0
        signatures = sets.signatures()
        keys = band_keys(signatures, rows, bands)
        short = signatures.astype(np.uint8)
        place = np.cumsum(some) - 1
        sig = [short[place[i]].tobytes() if some[i] else None for i in range(len(n))]
        own = [keys[place[i]] if some[i] else None for i in range(len(n))]
        return pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(n), pa.array(k1), pa.array(k2), pa.array(sig, pa.binary()), pa.array(own, pa.list_(pa.int64()))],
            ["doc_id", "n", "k1", "k2", "sig", "bands"],
        )

    return run


# ---- comparison of two sides ---------------------------------------------------


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    return int(np.count_nonzero(b[place] == a))


def compare(names, labels, signatures, sets, left, right, percent: int = PERCENT, need=None, earlier=None) -> list[tuple[int, int]]:
    """Links between left and right members that join components; labels: known components.

    Pairs that are connected by then are passed over, most alike pairs come first.
    earlier(a, b): pairs that are looked at elsewhere.
    """
    need = need or least_matches(percent / 100)
    parent = {x: x for x in {*labels}}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = np.array([len(s) for s in sets])
    out = []
    cuts = [0, *LOOKS]
    for i0 in range(0, len(left), 64):
        rows = left[i0 : i0 + 64]
        pairs_i, pairs_j = np.meshgrid(np.arange(len(rows)), np.arange(len(right)), indexing="ij")
        a, b = np.asarray(rows, dtype=np.int64)[pairs_i.ravel()], np.asarray(right, dtype=np.int64)[pairs_j.ravel()]
        fits = (a != b) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b = a[fits], b[fits]
        matches = np.zeros(len(a), dtype=np.int32)
        for first, last, least in zip(cuts[:-1], cuts[1:], need, strict=True):
            if not len(a):
                break
            matches += (signatures[a, first:last] == signatures[b, first:last]).sum(axis=1, dtype=np.int32)
            kept = matches >= least
            a, b, matches = a[kept], b[kept], matches[kept]
        if earlier is not None and len(a):
            kept = ~earlier(a, b)
            a, b, matches = a[kept], b[kept], matches[kept]
        for p in np.argsort(-matches, kind="stable"):
            x, y = a[p], b[p]
            rx, ry = root(labels[x]), root(labels[y])
            if rx == ry:
                continue
            both = _overlap(sets[x], sets[y])
            if 100 * both >= percent * (n[x] + n[y] - both):
                parent[max(rx, ry)] = min(rx, ry)
                out.append((names[x], names[y]))
    return out


TASK = "task struct<id:long,i:int,j:int>, side int, band int, node long, label long, sig binary, bands array<long>, shingles binary"


def _compare_task(percent: int):
    def run(table_: pa.Table) -> pa.Table:
        from squall.llm.near_dedup import compare

        table_ = table_.combine_chunks()
        nodes = table_["node"].to_numpy()
        sides = table_["side"].to_numpy()
        # a node may stand on both sides
        unique, place = np.unique(nodes, return_index=True)
        at = {x: k for k, x in enumerate(unique.tolist())}
        own = table_.take(pa.array(place))
        labels = own["label"].to_numpy().tolist()
        signatures = np.frombuffer(b"".join(own["sig"].to_pylist()), dtype=np.uint8).reshape(len(place), N_HASHES)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in own["shingles"].to_pylist()]
        left = [at[x] for x in sorted(set(nodes[sides != 1].tolist()))]
        right = [at[x] for x in sorted(set(nodes[sides != 0].tolist()))]
        band = table_["band"][0].as_py()
        earlier = None
        if band:
            keys = np.array([x[:band] for x in own["bands"].to_pylist()], dtype=np.int64).reshape(len(place), band)
            earlier = lambda a, b: (keys[a] == keys[b]).any(axis=1)
        links = compare(unique.tolist(), labels, signatures, sets, left, right, percent, earlier=earlier)
        # Linked nodes in a row: a hub's links become a path, which joins the same nodes.
        groups: dict[int, int] = {}
        parent = {x: x for pair in links for x in pair}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in links:
            parent[root(x)] = root(y)
        path = []
        for x in sorted(parent):
            top = root(x)
            if top in groups:
                path.append((groups[top], x))
            groups[top] = x
        return pa.table({"a": pa.array([x for x, _ in path], pa.int64()), "b": pa.array([y for _, y in path], pa.int64())})

    return run


def _links(tasks: DataFrame, percent: int) -> DataFrame:
    """Rows like TASK: side 0 left, 1 right, 2 both; band: pairs that share an earlier one are passed over (0: none is)."""
    return tasks.groupBy("task").applyInArrow(_compare_task(percent), "a long, b long")


def _tasks(df: DataFrame, task, side: int, band=None) -> DataFrame:
    place = F.struct(*[x.cast(kind).alias(name) for x, kind, name in zip(task, ("long", "int", "int"), ("id", "i", "j"), strict=True)])
    return df.select(place.alias("task"), F.lit(side).alias("side"), (F.lit(0) if band is None else band).cast("int").alias("band"), "node", "label", "sig", "bands", "shingles")


# ---- nodes, clusters, links ----------------------------------------------------


def _gather(width: int, members):
    """Sets of the rows whose id's hash the filter knows."""

    def run(batch):
        from squall.llm.shingles import Sets

        hashes = columns(batch, "hash")[0].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        ids, texts = columns(batch.filter(pa.array(members.value.has(hashes))), "doc_id", "text")
        if not len(ids):
            return None
        sets = Sets(texts, width)
        k1, k2 = sets.keys()
        blobs = [sets.hashes[a:b].tobytes() for a, b in zip(sets.at[:-1], sets.at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(k1), pa.array(k2), pa.array(blobs, pa.binary())], ["g0", "g1", "g2", "shingles"])

    return run


def _with_sets(docs: DataFrame, members: DataFrame, n: int, width: int) -> DataFrame:
    """n members(doc_id, k1, k2, ...) with the shingles of their texts: only rows that may be members leave their place."""
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom.build(members.select(F.xxhash64("doc_id")), n))
    hashed = docs.where(F.col("doc_id").isNotNull()).withColumn("hash", F.xxhash64("doc_id"))
    sets = map_texts(hashed, _gather(width, filter_), "g0 long, g1 long, g2 long, shingles binary")
    same = (F.col("g0") == F.col("doc_id")) & (F.col("g1") == F.col("k1")) & (F.col("g2") == F.col("k2"))
    joined, seen = written(sets.join(members, same).drop("g0", "g1", "g2"))
    # Repeated rows of one id and one set give their set more than once.
    return joined.dropDuplicates(["node"]).checkpoint() if seen["n"] > n else joined


def _component_links(docs: DataFrame, nodes: DataFrame, percent: int, width: int, block: int, hubs: int) -> DataFrame:
    """nodes(node, doc_id, k1, k2, sig, bands) -> (node, label) of all that are linked."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    least = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("hk"), "hub")
    stars = keys.join(least, F.col("key") == F.col("hk")).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = components(stars).select(F.col("node").alias("cn"), F.col("label").alias("cluster"))
    sizes = clusters.groupBy(F.col("cluster").alias("sc")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block)
    members = nodes.join(clusters, F.col("node") == F.col("cn")).drop("cn").join(sizes, F.col("cluster") == F.col("sc"), "left").drop("sc")
    members, seen = written(members, large=F.count("m"))
    members = _with_sets(docs, members, seen["n"], width).withColumn("label", F.col("node"))
    links = _links(_tasks(members.where("m is null"), (F.col("cluster"), F.lit(0), F.lit(0)), 2), percent)
    large = members.where("m is not null").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    if not seen.get("large"):
        return components(links)
    block_of = F.pmod(F.xxhash64("node"), F.col("blocks"))
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    # some hubs against all nodes of a cluster
    is_hub = F.pmod(F.xxhash64(F.lit(1), F.col("node")), F.ceil(F.col("m") / hubs)) == 0
    left = _tasks(large.where(is_hub).withColumn("j", every_block), (F.col("cluster"), F.lit(0), F.col("j")), 0)
    first = _links(left.unionByName(_tasks(large, (F.col("cluster"), F.lit(0), block_of), 1)), percent).checkpoint()
    found = components(first).select(F.col("node").alias("fn"), F.col("label").alias("found"))
    large = large.join(found, F.col("node") == F.col("fn"), "left").withColumn("label", F.coalesce("found", "label")).drop("fn", "found").checkpoint()

    # groups of nodes that aren't connected yet: whole clusters, and band keys
    def unconnected(group: str, df: DataFrame) -> DataFrame:
        parts = df.groupBy("cluster", group, "label").agg(F.count(F.lit(1)).alias("k")) if group != "cluster" else df.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k"))
        parts = parts.groupBy(*{"cluster": None, group: None}).agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("all")).where(F.col("top.k") < F.col("all"))
        outside = F.col("all") - F.col("top.k")
        rounds, blocks = F.ceil(outside / block).cast("int"), F.ceil(F.col("all") / block).cast("int")
        return parts.select(F.col("cluster").alias("gc"), F.col(group).alias("gk"), F.col("top.label").alias("top"), rounds.alias("rounds"), blocks.alias("parts"), (F.col("all") * rounds + outside * blocks).alias("sent"))

    banded = large.select("cluster", "node", "label", F.posexplode("bands").alias("band", "key"))
    by_cluster, seen = written(unconnected("cluster", large))
    if not seen["n"]:
        return components(links.unionByName(first))
    by_key = unconnected("key", banded).checkpoint()
    # per cluster whichever way sends fewer nodes
    total = by_key.groupBy(F.col("gc").alias("tc")).agg(F.sum("sent").alias("by_key"))
    costs = by_cluster.select(F.col("gc").alias("cc"), "sent").join(total, F.col("cc") == F.col("tc"), "left").select("cc", (F.coalesce("by_key", F.lit(0)) < F.col("sent")).alias("keyed"))
    by_cluster = by_cluster.join(costs.where("not keyed"), F.col("gc") == F.col("cc"), "left_semi")
    by_key = by_key.join(costs.where("keyed"), F.col("gc") == F.col("cc"), "left_semi")
    one = large.join(by_cluster, F.col("cluster") == F.col("gc")).withColumn("band", F.lit(0))
    other = banded.select(F.col("node").alias("bn"), "band", "key").join(by_key.drop("gc"), F.col("key") == F.col("gk"))
    other = large.join(other, F.col("node") == F.col("bn"))
    names = ("node", "label", "sig", "bands", "shingles", "band", "gk", "top", "rounds", "parts")
    whole = one.select(*names).unionByName(other.select(*names))
    left = whole.where("label <> top").withColumn("i", F.pmod(F.xxhash64(F.lit(2), F.col("node")), F.col("rounds"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = whole.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))).withColumn("j", F.pmod(F.xxhash64("node"), F.col("parts")))
    tasks = [_tasks(x, (F.col("gk"), F.col("i"), F.col("j")), side, F.col("band")) for side, x in enumerate((left, right))]
    return components(links.unionByName(first).unionByName(_links(tasks[0].unionByName(tasks[1]), percent)))


def linked(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, block: int = BLOCK, hubs: int = HUBS) -> DataFrame:
    """One row per document: doc_id, n (size of its set), k1, k2 (the set's key), component_id (least id that it reaches), and best1, best2 (the key of the component's set of that id)."""
    shared_dir(ready(docs.sparkSession))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = map_texts(docs, _sign(width, *banding(percent)), SIGNED).checkpoint()
    linkable = signed.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    nodes = linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).checkpoint()
    joined = _component_links(docs, nodes, percent, width, block, hubs).select(F.col("node").alias("jn"), "label")
    named = nodes.select("node", "k1", "k2", "doc_id").join(joined, F.col("node") == F.col("jn"), "left").withColumn("label", F.coalesce("label", "node"))
    named = named.select("label", "k1", "k2", "doc_id")
    least = named.groupBy(F.col("label").alias("ll")).agg(F.min(F.struct("doc_id", "k1", "k2")).alias("best"))
    named = named.join(least, F.col("label") == F.col("ll")).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "best")
    whole = signed.select("doc_id", "n", "k1", "k2")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    out = whole.where(~alone).join(named, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")))
    none = F.lit(None).cast("long")
    return out.select("doc_id", "n", "k1", "k2", F.col("best.doc_id").alias("component_id"), F.col("best.k1").alias("best1"), F.col("best.k2").alias("best2")).unionByName(
        whole.where(alone).select("doc_id", "n", "k1", "k2", F.col("doc_id").alias("component_id"), none.alias("best1"), none.alias("best2"))
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, block: int = BLOCK, hubs: int = HUBS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return linked(docs, percent, width, block, hubs).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, block: int = BLOCK, hubs: int = HUBS) -> DataFrame:
    """docs with one row per component; all columns stay.

    The row of the component's least id stays; of rows that share that id, the one whose
    set has the least key, and of those the least by text and the other columns' JSON.
    Unlike texts of one id that aren't linked both stay, and so do rows that are linked
    with nothing: those with a null id or without words.
    """
    found = linked(docs, percent, width, block, hubs)
    stays = F.col("best1").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("k1") == F.col("best1")) & (F.col("k2") == F.col("best2")))
    rows = found.groupBy(F.col("doc_id").alias("fd"), "k1", "k2").agg(F.max(stays).alias("stays"), (F.count(F.when(F.col("best1").isNotNull(), 1)) > 1).alias("again"))
    rows = rows.where(~F.col("stays") | F.col("again")).select("fd", "k1", "k2", "stays").checkpoint()

    @F.arrow_udf("struct<k1:long,k2:long>")
    def keys(texts: pa.Array) -> pa.Array:
        from squall.llm.shingles import Sets
        from squall.llm.textcore import slices

        parts = [Sets(texts.slice(i, j - i), width).keys() for i, j in slices(texts)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)) for k in (0, 1)], ["k1", "k2"])

    packed = docs.select(F.col("doc_id").cast("long").alias("d"), keys("text").alias("own"), F.struct(*docs.columns).alias("whole"))
    same = (F.col("d") == F.col("fd")) & (F.col("own.k1") == F.col("k1")) & (F.col("own.k2") == F.col("k2"))
    single = packed.join(rows, same, "left_anti").select("whole.*")
    again = packed.join(rows.where("stays"), same).select("d", "own", "whole", F.struct("whole.text", F.to_json("whole").alias("json")).alias("order"))
    again = again.groupBy("d", "own").agg(F.min_by("whole", "order").alias("whole")).select("whole.*")
    return single.unionByName(again)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=3)
