"""A prefix trie over conversations that share their first turns.

Family first: conversations meet the first turns of their base conversation in one cogroup
per family (ids that differ in the last two digits only), are rebuilt there and form the
family's small trie.  Only the nodes of these tries are shuffled again: nodes of equal
paths become one.  Sums over subtrees are made inside the families; what families count
twice is put right on the nodes that several families share, by sums that double their
reach each round (as many rounds as the depth of the shared part has binary digits).

Distribution: texts stay where they are read; a turn travels as a 16-byte digest and its
length.  A family has at most 100 conversations, whatever their number in all; one task
holds the digests of one family (about 60 bytes a turn).  The root and common first turns
get one row a family, added up before the shuffle.  Paths are told apart by 128 bits of
SHA-256.  The ids that end at a shared node are hashed as a sorted stream, never as a list.

Defined results: rows with a null id belong to no conversation and are left out; a null
role or text is empty; turns of equal number (null first) stand in the order of role, then
of the text's digest, repeated rows stand one after another; a family is an id cut to
hundreds as by truncating division, so negative ids of up to two digits share that of 0;
very long texts are a digest and a length like any other; an empty table has no node, not
even a root; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.llm.common import crc, shared_dir, table, written

FAMILY = 100
#: A conversation takes fewer turns than this of its base.
MOST_BORROWED = 6

NODE = (
    "key binary, parent binary, base long, depth long, conv_id long, n_convs long, chars long, n_children long, n_leaves long, saved long, "
    "ends string, above array<binary>"
)


def turns(conversations: DataFrame) -> DataFrame:
    """base, conv_id, borrowed, turn, role, digest, chars: one row a turn, without its text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    conv = F.col("conv_id").cast("long")
    return conversations.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % FAMILY).alias("base"), conv.alias("conv_id"), (crc("conv_id") % MOST_BORROWED).cast("int").alias("borrowed"),
        F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(digest, 1, 16).alias("digest"), F.length(text).alias("chars"),
    )


def _in_order(rows: pa.Table) -> pa.Table:
    rows = rows.append_column("first", pa.array([t is not None for t in rows["turn"].to_pylist()]))
    order = [(k, "ascending") for k in ("conv_id", "first", "turn", "role", "digest")]
    return rows.sort_by(order)


class FamilyTrie:
    """Nodes in the order of their making: parents come before their children."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.key, self.parent, self.depth, self.chars, self.convs, self.least, self.ends, self.children = ([] for _ in range(8))

    def node(self, key: bytes, parent: int, chars: int, conv: int) -> int:
        k = self.at.get(key)
        if k is None:
            k = self.at[key] = len(self.key)
            depth = self.depth[parent] + 1 if parent >= 0 else 0
            for column, value in ((self.key, key), (self.parent, parent), (self.depth, depth), (self.chars, chars), (self.convs, 0), (self.least, conv), (self.ends, []), (self.children, 0)):
                column.append(value)
            if parent >= 0:
                self.children[parent] += 1
        self.convs[k] += 1
        self.least[k] = min(self.least[k], conv)
        return k

    def add(self, conv: int, sequence) -> None:
        import hashlib

        k = self.node(b"\0" * 16, -1, 0, conv)
        for digest, chars in sequence:
            k = self.node(hashlib.sha256(self.key[k] + digest).digest()[:16], k, chars, conv)
        self.ends[k].append(conv)

    def rows(self, base: int) -> pa.Table:
        n = len(self.key)
        saved = [(c - 1) * x for c, x in zip(self.convs, self.chars, strict=True)]
        leaves = [int(not c) for c in self.children]
        for k in range(n - 1, 0, -1):
            saved[self.parent[k]] += saved[k]
            leaves[self.parent[k]] += leaves[k]
        above, step = [[] for _ in range(n)], self.parent  # ancestors 1, 2, 4, ... turns above
        while any(p >= 0 for p in step):
            for k, p in enumerate(step):
                if p >= 0:
                    above[k].append(self.key[p])
            step = [step[p] if p >= 0 else -1 for p in step]
        ends = [",".join(map(str, sorted(e))) for e in self.ends]
        parents = [self.key[p] if p >= 0 else None for p in self.parent]
        columns = [self.key, parents, [base] * n, self.depth, self.least, self.convs, self.chars, self.children, leaves, saved, ends, above]
        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string(), pa.list_(pa.binary())]
        return pa.table({name.split()[0]: pa.array(c, t) for name, c, t in zip(NODE.split(", "), columns, kinds, strict=True)})


def _family(rows: pa.Table, base_turns: pa.Table) -> pa.Table:
    """The trie of one family's rebuilt conversations."""
    import numpy as np

    from squall.llm.prefix_trie import NODE, FamilyTrie, _in_order

    if not rows.num_rows:
        return pa.table({x.split()[0]: [] for x in NODE.split(", ")})
    rows, first = _in_order(rows), _in_order(base_turns)
    head = list(zip(first["digest"].to_pylist(), first["chars"].to_pylist(), strict=True))
    ids = rows["conv_id"].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
    trie = FamilyTrie()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = rows.slice(a, b - a)
        borrowed = own["borrowed"][0].as_py()
        own = own.slice(borrowed)
        trie.add(int(ids[a]), head[:borrowed] + list(zip(own["digest"].to_pylist(), own["chars"].to_pylist(), strict=True)))
    return trie.rows(rows["base"][0].as_py())


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of every family's trie (schema NODE)."""
    from pyspark.sql import Window

    whole = turns(conversations)
    place = F.row_number().over(Window.partitionBy("base").orderBy(F.col("turn").asc_nulls_first(), "role", "digest"))
    heads = whole.where(F.col("conv_id") == F.col("base")).withColumn("place", place).where(F.col("place") < MOST_BORROWED).drop("place")
    return whole.groupBy("base").cogroup(heads.groupBy("base")).applyInArrow(_family, NODE)


def _hashed_ends(batches):
    """Rows in the order of (key, base) -> the SHA-256 of each key's ends, joined by commas."""
    import hashlib

    key = digest = None
    done: list = []

    def out():
        made = pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["ekey", "ends_sha256"])
        done.clear()
        return made

    for batch in batches:
        for k, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield out()
    if key is not None:
        done.append((key, digest.hexdigest()))
    yield out()


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key, parent."""
    shared_dir(conversations.sparkSession)
    local, _ = written(family_nodes(conversations))
    leaf = (F.col("n_children") == 0).cast("long")
    merged = local.groupBy("key").agg(
        F.count(F.lit(1)).alias("families"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
        F.sum(leaf).alias("ended"), F.max("n_children").alias("n_children"), F.max("ends").alias("ends"),
        F.first(F.struct("parent", "depth", "chars", "above")).alias("same"),
    ).select("key", "families", "conv_id", "n_convs", "n_leaves", "saved", "ended", "n_children", "ends", "same.*")
    several = F.col("families") > 1
    merged, seen = written(merged, depth=F.max(F.when(several, F.col("depth"))))
    shared = merged.where(several)

    # children, and what the families count more than once
    children = merged.where(F.col("depth") > 0).groupBy(F.col("parent").alias("ckey")).agg(F.count(F.lit(1)).alias("children"))
    shared = shared.join(children, F.col("key") == F.col("ckey"), "left").withColumn("n_children", F.coalesce("children", F.lit(0).cast("long"))).drop("ckey", "children")
    again = F.col("families") - 1
    shared = shared.withColumn("more_saved", again * F.col("chars")).withColumn("less_leaves", F.when(F.col("n_children") == 0, again).otherwise(F.col("ended"))).checkpoint()
    step, reach = 0, 1
    while reach <= (seen.get("depth") or 0):
        passed = shared.where(F.size("above") > step).groupBy(F.col("above")[step].alias("pkey")).agg(F.sum("more_saved").alias("s"), F.sum("less_leaves").alias("l"))
        zero = F.lit(0).cast("long")
        shared = shared.join(passed, F.col("key") == F.col("pkey"), "left").withColumn("more_saved", F.col("more_saved") + F.coalesce("s", zero)).withColumn("less_leaves", F.col("less_leaves") + F.coalesce("l", zero))
        shared = shared.drop("pkey", "s", "l").checkpoint()
        step, reach = step + 1, reach * 2

    # ends of shared nodes, as sorted streams
    ends = local.where(F.col("ends") != "").select(F.col("key").alias("k"), "base", F.col("ends").alias("e")).join(shared.select("key"), F.col("k") == F.col("key"), "left_semi")
    ends = ends.repartition("k").sortWithinPartitions("k", "base").mapInArrow(_hashed_ends, "ekey binary, ends_sha256 string")
    shared = shared.join(ends, F.col("key") == F.col("ekey"), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    names = ["key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = shared.withColumn("n_leaves", F.col("n_leaves") - F.col("less_leaves")).withColumn("saved_tokens", F.col("saved") + F.col("more_saved")).select(*names)
    alone = merged.where(~several).withColumn("saved_tokens", F.col("saved")).withColumn("ends_sha256", F.sha2("ends", 256)).select(*names)
    nodes = shared.unionByName(alone)
    above = merged.select(F.col("key").alias("akey"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(above, F.col("parent") == F.col("akey"), "left").drop("akey")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return trie(table(spark, sf_dir, "conversations")).select(*names)
