"""Groupings: summaries, nested catalogs, deduplication with its truth map, coverage and bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.functions.text import rounded


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table, in one pass over each."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def tree(rows: DataFrame, levels: list[str], leaf: list[str], children: str = "children") -> DataFrame:
    """Rows nested by ``levels``: a row for each first level, sorted at every level; leaves are structs of ``leaf``."""
    out = rows.groupBy(*levels).agg(F.sort_array(F.collect_list(F.struct(*leaf))).alias(children))
    for n in range(len(levels) - 1, 0, -1):
        out = out.groupBy(*levels[:n]).agg(F.sort_array(F.collect_list(F.struct(levels[n], children))).alias(children))
    return out


def match_summary(matches: DataFrame, status: str = "status") -> DataFrame:
    """One row: total, counts by status, matched_percent (a partial match counts half), unmatched_percent; zeros when empty."""
    n = lambda s: F.count_if(F.col(status) == s)
    one = matches.agg(F.count("*").alias("total"), n("Full match").alias("full_match"), n("Partial match").alias("partial_match"), n("Not matched").alias("not_matched"))
    part = lambda x: rounded(F.coalesce(F.try_divide(x, F.col("total")) * 100, F.lit(0.0)), 1)
    return one.withColumn("matched_percent", part(F.col("full_match") + F.col("partial_match") * 0.5)).withColumn("unmatched_percent", part(F.col("not_matched").cast("double")))


def document_frequency(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(term, df): in how many documents each term occurs. words: an array column without repeats."""
    each = docs.select(F.explode_outer(words).alias("term"))  # outer: a plain one is preceded by a filter that takes the words again
    return each.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def retain_first(members: DataFrame, group: list[str], order: list, merged: str = "Merged duplicate") -> DataFrame:
    """Members with their place in the group and what became of them: the first by ``order`` is Retained."""
    w = Window.partitionBy(*group).orderBy(*order)
    return members.withColumn("place", F.row_number().over(w)).withColumn("action", F.when(F.col("place") == 1, "Retained").otherwise(merged))


def merge_edges(edges: DataFrame) -> DataFrame:
    """(kind, source, target, evidence): edges once, with all their evidence in order."""
    evidence = F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence"))))
    return edges.groupBy("kind", "source", "target").agg(evidence.alias("evidence"))


def bands(rows: DataFrame, confidence: str, key: str, auto: float = 0.90, review: float = 0.70) -> DataFrame:
    """(key, band): what is accepted, what is to be reviewed, what needs more context; a row for each key, so a band may have any number."""
    band = F.when(F.col(confidence) >= auto, "auto").when(F.col(confidence) >= review, "review").otherwise("needsMoreContext")
    return rows.select(key, band.alias("band"))


def naming_conflicts(rows: DataFrame, scope: str, original: str, effective: str) -> DataFrame:
    """(conflict, scope, effective, n): names that several originals of one scope share, and those in several scopes."""
    inside = rows.groupBy(scope, effective).agg(F.count_distinct(original).alias("n")).filter("n > 1")
    across = rows.groupBy(effective).agg(F.count_distinct(scope).alias("n")).filter("n > 1")
    inside = inside.select(F.lit("intra").alias("conflict"), F.col(scope).cast("string").alias("scope"), F.col(effective).alias("effective"), "n")
    return inside.unionByName(across.select(F.lit("cross").alias("conflict"), F.lit(None).cast("string").alias("scope"), F.col(effective).alias("effective"), "n"))


def coverage(required: DataFrame, keys: list[str], *explained: DataFrame) -> DataFrame:
    """Required keys that none of the other tables has."""
    known = reduce(DataFrame.unionByName, [e.select(*keys) for e in explained]).distinct()
    return required.select(*keys).distinct().join(known, keys, "left_anti")


def foreign_key_violations(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """(name, violations): child rows whose non-null reference has no parent."""
    refs = child.filter(F.col(column).isNotNull()).select(F.col(column).alias("_k"))
    lost = refs.join(parent.select(F.col(key).alias("_k")).distinct(), "_k", "left_anti")
    return lost.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")


def usage_totals(calls: DataFrame, run: str, order: str, *columns: str) -> DataFrame:
    """Calls numbered through within a run, with running totals of ``columns``."""
    w = Window.partitionBy(run).orderBy(order)
    out = calls.withColumn("call", F.row_number().over(w))
    for c in columns:
        out = out.withColumn(f"total_{c}", F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out


def gap_counts(entities: DataFrame, attributes: DataFrame, endpoints: DataFrame, awaiting: str = "Awaiting API Analyzer") -> DataFrame:
    """One row: what still lacks a suggestion (none or a dash) or awaits analysis.

    entities (suggestion, domain), attributes (suggestion), endpoints (suggestion, domain, capability).
    """
    none = F.coalesce("suggestion", F.lit("—")) == "—"
    waits = lambda *cs: F.count_if(reduce(Column.__or__, [F.coalesce(F.col(c) == awaiting, F.lit(False)) for c in cs]))
    one = entities.agg(F.count_if(none).alias("entities_without_suggestion"), waits("domain").alias("entities_awaiting"))
    two = attributes.agg(F.count_if(none).alias("attributes_without_suggestion"))
    return one.crossJoin(two).crossJoin(endpoints.agg(F.count_if(none).alias("endpoints_without_suggestion"), waits("domain", "capability").alias("endpoints_awaiting")))  # one row each


def list_totals(sources: DataFrame, *lists: str) -> DataFrame:
    """One row: sources, and how many elements their lists have in all."""
    return sources.agg(F.count("*").alias("sources"), *[F.coalesce(F.sum(F.size(F.coalesce(c, F.expr("array()")))), F.lit(0)).alias(c) for c in lists])


def domain_of(own: Column, n_linked: Column, linked: Column) -> Column:
    """An entity's domain: its own, else the one its endpoints share, else that there are several, or none."""
    return F.coalesce(own, F.when(n_linked == 1, linked).when(n_linked > 1, "Multiple analyzed domains").otherwise("Awaiting API Analyzer"))


def mean_or(values: Column, other_side_empty: Column) -> Column:
    """A mean score; without scores 100 if the other side has nothing either, else 0."""
    return F.coalesce(F.avg(values), F.when(F.first(other_side_empty), 100.0).otherwise(0.0))
