"""Connected components by neighbour minima and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.plans.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Edges with a null end and loops are left out. A hub costs no task of its own: each
    round joins two stored tables (an adaptive skew join splits a hot node) and takes
    minima, which are combined before the shuffle. Nothing but one number a round
    reaches the driver. No edges give no rows.
    """
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u is not null and v is not null and u != v")
    both = cut(pairs.union(pairs.select(F.col("v"), F.col("u"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    state = _state(labels)
    while True:
        near = both.join(labels, both.v == labels.node).select(F.col("u").alias("node"), "label")
        lower = cut(near.union(labels).groupBy("node").agg(F.min("label").alias("label")))
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = cut(lower.join(up, "label").select("node", F.col("root").alias("label")))
        before, state = state, _state(labels)
        if state == before:
            return labels.select("node", F.col("label").alias("component"))


def _state(labels: DataFrame) -> tuple:
    return tuple(labels.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "label"))).first())
