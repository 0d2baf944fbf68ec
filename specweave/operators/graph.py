"""Reachability, trees, neighbours and renaming in typed edge tables."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.plans.lineage import cut

#: Levels of a closure that are kept as tables of their own.
MOST_LEVELS = 16


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, depth): what each root reaches over ``edges`` (source, target), itself included, at its least depth.

    seeds (root, node). Breadth first, a round for each level, so cycles end by themselves. Each level is stored once.
    """
    frontier = cut(seeds.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    seen, levels = frontier, [frontier]
    steps = cut(edges.select(F.col("source").alias("node"), F.col("target").alias("next")).distinct())
    for depth in count(1):
        found = frontier.join(steps, "node").select("root", F.col("next").alias("node")).distinct()
        frontier = cut(found.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        levels.append(frontier)
        if len(levels) > MOST_LEVELS:  # of a deep graph few tables, so that a round's plan stays small
            levels = [cut(reduce(DataFrame.unionByName, levels))]
        seen = reduce(DataFrame.unionByName, levels)


def contract_scope(entities: DataFrame, attributes: DataFrame, edges: DataFrame, operations: DataFrame, hinted: DataFrame | None = None) -> DataFrame:
    """(entity_id): entities that endpoints reach: those they take, return or refer to, then bases, attribute types and mappings either way.

    entities (entity_id, base_entity_id), attributes (entity_id, reference_id), edges (kind, source, target), operations
    (operation_id, entity_id: a row for each request, response and parameter), hinted (entity_id) named by a description.
    """
    seeds = operations.filter("entity_id is not null").select("entity_id")
    from_operations = edges.join(operations.select(F.col("operation_id").alias("source")).distinct(), "source", "left_semi")
    seeds = seeds.unionByName(from_operations.filter("kind in ('ACCEPTS', 'RETURNS', 'REFERENCES')").select(F.col("target").alias("entity_id")))
    if hinted is not None:
        seeds = seeds.unionByName(hinted.select("entity_id"))
    steps = entities.filter("base_entity_id is not null").select(F.col("entity_id").alias("source"), F.col("base_entity_id").alias("target"))
    steps = steps.unionByName(attributes.filter("reference_id is not null").select(F.col("entity_id").alias("source"), F.col("reference_id").alias("target")))
    maps = edges.filter("kind = 'MAPS_TO'").select("source", "target")
    steps = steps.unionByName(maps).unionByName(maps.select(F.col("target").alias("source"), F.col("source").alias("target")))
    known = entities.select(F.col("entity_id").alias("k"))
    steps = steps.join(known, F.col("target") == F.col("k"), "left_semi")
    start = seeds.distinct().join(known, F.col("entity_id") == F.col("k"), "left_semi")
    return closure(start.select(F.lit("contract").alias("root"), F.col("entity_id").alias("node")), steps).select(F.col("node").alias("entity_id"))


def scope(model: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A model's tables with what its endpoints reach, and nothing that refers to anything else.

    model: operations (id, request_entity_id), responses (operation_id, entity_id), parameters (operation_id, id, reference_id), entities (id,
    base_entity_id), attributes (id, entity_id, reference_id), enums (id), relationships (kind, source, target), validations (target_id), evidence
    and lineage (subject_id, source_id), sources (id). Enums stay if a kept attribute has them, so those
    that only parameters use go; sources stay with evidence or lineage.
    """
    m = dict(model)
    uses = m["operations"].select(F.col("id").alias("operation_id"), F.col("request_entity_id").alias("entity_id"))
    uses = uses.unionByName(m["responses"].select("operation_id", "entity_id")).unionByName(m["parameters"].select("operation_id", F.col("reference_id").alias("entity_id")))
    named = m["entities"].select(F.col("id").alias("entity_id"), "base_entity_id")
    kept = cut(contract_scope(named, m["attributes"], m["relationships"], uses))
    m["entities"] = m["entities"].join(kept, m["entities"].id == kept.entity_id, "left_semi")
    m["attributes"] = retained(m["attributes"], "entity_id", kept, "entity_id")
    m["enums"] = m["enums"].join(m["attributes"].select(F.col("reference_id").alias("k")).distinct(), F.col("id") == F.col("k"), "left_semi")
    types = cut(kept.select(F.col("entity_id").alias("k")).unionByName(m["enums"].select(F.col("id").alias("k"))))
    for table, column in (("operations", "request_entity_id"), ("responses", "entity_id"), ("parameters", "reference_id"), ("entities", "base_entity_id"), ("attributes", "reference_id")):
        m[table] = _known_or_null(m[table], column, types)
    parts = [m["operations"].select(F.col("id").alias("s")), m["parameters"].select(F.col("id").alias("s")), m["attributes"].select(F.col("id").alias("s")), types.select(F.col("k").alias("s"))]
    subjects = parts[0]
    for p in parts[1:]:
        subjects = subjects.unionByName(p)
    subjects = cut(subjects.distinct())
    m["relationships"] = retained(retained(m["relationships"], "source", subjects, "s"), "target", subjects, "s")
    m["validations"] = retained(m["validations"], "target_id", subjects, "s")
    m["evidence"], m["lineage"] = (retained(m[t], "subject_id", subjects, "s") for t in ("evidence", "lineage"))
    used = m["evidence"].select(F.col("source_id").alias("u")).unionByName(m["lineage"].select(F.col("source_id").alias("u")))
    m["sources"] = retained(m["sources"], "id", used, "u")
    return m


def _known_or_null(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    k = known.select(F.col("k").alias("_k")).distinct()
    return df.join(k, df[column] == F.col("_k"), "left").withColumn(column, F.col("_k")).drop("_k")


def retained(children: DataFrame, column: str, kept: DataFrame, key: str) -> DataFrame:
    """Children whose reference is kept."""
    return children.join(kept.select(F.col(key).alias(column)).distinct(), column, "left_semi").select(children.columns)


def neighbours(edges: DataFrame, both: bool = True) -> DataFrame:
    """(node, neighbour, kind, resolution) of edges, in both directions."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "kind", "resolution")
    back = edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "kind", "resolution")
    return out.unionByName(back).distinct() if both else out.distinct()


def expand(scores: DataFrame, seeds: DataFrame, edges: DataFrame, most_seeds: int = 12, most_neighbours: int = 100) -> DataFrame:
    """(query, node, score) with neighbours of the best seeds raised to 1, over a candidate edge to 0.5, if that is more.

    scores (query, node, score), seeds (query, node, place).
    """
    near = neighbours(edges)
    w = Window.partitionBy("node").orderBy("neighbour", "kind", "resolution")
    near = near.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most_neighbours)
    hit = seeds.filter(F.col("place") < most_seeds).select("query", "node").join(near, "node")
    raised = hit.groupBy("query", F.col("neighbour").alias("node")).agg(F.max(F.when(F.col("resolution") == "candidate", 0.5).otherwise(1.0)).alias("score"))
    return scores.select("query", "node", "score").unionByName(raised.select("query", "node", "score")).groupBy("query", "node").agg(F.max("score").alias("score"))


def dangling(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    known = nodes.select(F.col(key).alias("_k")).distinct()
    lost = [edges.join(known, edges[c] == F.col("_k"), "left_anti") for c in ("source", "target")]
    return lost[0].unionByName(lost[1]).distinct()


def rename(df: DataFrame, column: str, remap: DataFrame) -> DataFrame:
    """``df`` with ids of ``column`` replaced by remap (old, new) where it has them."""
    r = remap.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    out = df.join(r, df[column] == F.col("_old"), "left")
    return out.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def parents(nodes: DataFrame) -> DataFrame:
    """(source, target, kind, resolution): edges from a node's parent key to it. nodes (id, key, parent_key)."""
    up = nodes.select(F.col("id").alias("source"), F.col("key").alias("_k"))
    return up.join(nodes.select(F.col("id").alias("target"), F.col("parent_key").alias("_k")), "_k").select("source", "target", F.lit("CONTAINS").alias("kind"), F.lit("syntax").alias("resolution"))
