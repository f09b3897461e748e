"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squall.llm.common import written

#: Up to so many edges one task joins them by itself; rounds of stars give the same beyond.
FEW_EDGES = 10_000


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """edges(a, b) -> (node, label): the least node of each node's component; nodes without edges are left out.

    Edges stay in the cluster; each round is written to the shared folder.  The
    number of rounds grows with the logarithm of the largest component.
    """
    e, state = _round(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if state["n"] <= few:
        return e.groupBy(F.lit(0).alias("all")).applyInArrow(_joined, "node long, label long")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join behind it is one of two plain tables, in which Spark splits a hub's edges.
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.col("u"), F.min("b")).alias("m")).checkpoint()
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select("a", "b", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        e, new = _round(small)
        if new == state:
            break
        state = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _round(edges: DataFrame) -> tuple[DataFrame, dict]:
    return written(edges.where("a <> b").distinct(), hash=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))


def _joined(edges: pa.Table) -> pa.Table:
    """Components of a few edges, by lowering labels along edges and halving paths."""
    a, b = edges["a"].to_numpy(), edges["b"].to_numpy()
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            return pa.table({"node": nodes, "label": nodes[label]})
        label = new
