"""Comparison and union of inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or changed between two snapshots with unique keys; no rows if they are equal."""
    a = old.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_l"))
    b = new.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_r"))
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def union_models(models: list[DataFrame], key: str) -> DataFrame:
    """Rows of several models, ids once: the first model's values, at the last one's place."""
    from .ranking import unique_by_id

    rows = reduce(DataFrame.unionByName, [m.withColumn("_model", F.lit(i)) for i, m in enumerate(models)])
    ordinal = F.struct("_model", key)
    return unique_by_id(rows.withColumn("_at", ordinal).drop("_model"), key, "_at").drop("_at")


def pending(contexts: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: contexts without a completed result."""
    return contexts.join(done.select(key).distinct(), key, "left_anti")


def inventory_errors(expected: DataFrame, proposed: DataFrame, key: str) -> DataFrame:
    """(key, error): proposed ids that are missing, unknown or repeated."""
    e, p = expected.select(key).distinct(), proposed.select(key)
    missing = e.join(p, key, "left_anti").withColumn("error", F.lit("missing"))
    unknown = p.distinct().join(e, key, "left_anti").withColumn("error", F.lit("unknown"))
    repeated = p.groupBy(key).count().filter("count > 1").select(key, F.lit("repeated").alias("error"))
    return missing.unionByName(unknown).unionByName(repeated)


def rows_once(df: DataFrame) -> DataFrame:
    return df.distinct()
