"""Top-k, budgets and running limits as windows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.functions.text import casefold
from specweave.plans.lineage import cut


def top_k(df: DataFrame, by: list, order: list, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 0; order must be total."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long")).filter(F.col(name) < k)


def best_run(runs: DataFrame, key: list, order: list[str]) -> DataFrame:
    """Of each identity the greatest row by ``order``, compared column by column."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return runs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def best_candidate(scored: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """The highest score of each group; of equal ones the greatest name."""
    cols = [c for c in scored.columns if c not in (*by, score, name)]
    best = scored.groupBy(*by).agg(F.max(F.struct(score, name, *cols)).alias("_b"))
    return best.select(*by, "_b.*")


def within_characters(ranked: DataFrame, by: list, order: list, text: str, limit: int, characters: int) -> DataFrame:
    """The first ``limit`` texts of each group while ``characters`` last; the text at which they run out is cut.

    Adds place (from 1), used (characters before), shown and truncated.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    out = ranked.withColumn("place", F.row_number().over(w).cast("long")).withColumn("used", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.filter((F.col("place") <= limit) & (F.col("used") < characters))
    shown = F.substring(F.col(text), F.lit(1), (F.lit(characters) - F.col("used")).cast("int"))
    return out.withColumn("shown", shown).withColumn("truncated", F.length("shown") < size)


def admitted(calls: DataFrame, by: list, order: list, estimate: str, *, run_tokens: int = 120_000, requests: int = 100, input_tokens: int = 24_000, output_tokens: int = 4_000) -> DataFrame:
    """Calls that a budget lets through, in order, up to the first that breaks it; then it stops.

    A call breaks it if it is too long, one too many, or its estimate and the most it may answer
    don't fit into what is left of the run. Adds spent (before it) and call (from 1).
    """
    w = Window.partitionBy(*by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = calls.withColumn("call", F.row_number().over(w).cast("long")).withColumn("spent", F.coalesce(F.sum(estimate).over(before), F.lit(0)))
    broken = (F.col(estimate) > input_tokens) | (F.col("call") > requests) | (F.col("spent") + F.col(estimate) + output_tokens > run_tokens)
    out = out.withColumn("_stop", F.max(broken.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.filter("_stop = 0").drop("_stop")


def first_files(files: DataFrame, most_files: int = 5_000, most_bytes: int = 1_000_000, most_total: int = 30_000_000) -> DataFrame:
    """Files (path, length) of a scan with reason: null if read, else why not. Files too large by themselves use nothing up.

    Running totals go by path over a range sort: within each part, on top of what the parts before it hold.
    """
    fits = F.col("length") <= most_bytes
    size = F.when(fits, F.col("length")).otherwise(0)
    placed = cut(files.repartitionByRange("path").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    sums = placed.groupBy("_part").agg(F.sum(fits.cast("int")).alias("_a"), F.sum(size).alias("_b"))
    sums = sums.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_a", "_b")])
    w = Window.partitionBy("_part").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(sums), "_part").withColumn("_n", F.col("_a") + F.sum(fits.cast("int")).over(w)).withColumn("_total", F.col("_b") + F.sum(size).over(w))
    reason = F.when(~fits, "file too large").when(F.col("_n") > most_files, "too many files").when(F.col("_total") > most_total, "scan too large")
    return out.withColumn("reason", reason).drop("_n", "_total", "_part", "_a", "_b")


def next_version(versions: DataFrame, by: list[str]) -> DataFrame:
    return versions.groupBy(*by).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def unique_by_id(df: DataFrame, key: str, ordinal: str, last: bool = False) -> DataFrame:
    """Of rows that repeat a key the first one's values at the last one's place; with ``last`` the last one's at the first one's."""
    own = [c for c in df.columns if c not in (key, ordinal)]
    value, place = (F.max_by, F.min) if last else (F.min_by, F.max)
    out = df.groupBy(key).agg(value(F.struct(*own), ordinal).alias("_v"), place(ordinal).alias(ordinal))
    return out.select(key, ordinal, "_v.*")


def snippet(lines: str, hit: Column, before: int, after: int) -> Column:
    """The lines from ``before`` above a hit (from 1) to ``after`` below it, as a text."""
    start = F.greatest(hit - before, F.lit(1))
    return F.array_join(F.slice(lines, start, F.least(hit + after, F.size(lines)) - start + 1), "\n")


def _turn() -> Column:
    """The order in which pairs are taken: by falling score, then names without regard to case, then ids."""
    return F.struct((-F.col("score")).alias("s"), casefold("left_name").alias("l"), casefold("right_name").alias("r"), "left_id", "right_id")


def greedy_pairs(scored: DataFrame, parent: list[str]) -> DataFrame:
    """One-to-one assignment in each parent: pairs by falling score, then names, then ids, taken while both ends are free.

    scored (*parent, left_id, right_id, score, left_name, right_name). Done in rounds over all parents at
    once: a pair that comes first among those of its left and among those of its right end is taken in any case,
    and whatever shares an end with it goes; so a parent of any size is many tasks. Pairs that repeat count once.
    """
    rows = scored.groupBy(*parent, "left_id", "right_id").agg(F.min(_turn()).alias("_t"))
    ends, taken = cut(rows.select(*parent, F.col("left_id").alias("_l"), F.col("right_id").alias("_r"), "_t")), None
    same = lambda a, b, columns: reduce(and_, [a[c].eqNullSafe(b[c]) for c in columns])
    while not ends.isEmpty():
        first = [ends.groupBy(*parent, e).agg(F.min("_t").alias("_t")) for e in ("_l", "_r")]
        least = first[0].join(first[1], same(*first, [*parent, "_t"]), "left_semi").select(*parent, "_l", F.col("_t.right_id").alias("_r"), "_t")
        least = cut(least)
        taken = least if taken is None else taken.unionByName(least)
        for e in ("_l", "_r"):
            ends = ends.join(least, same(ends, least, [*parent, e]), "left_anti")
        ends = cut(ends)
    if taken is None:
        return scored.select(*parent, "left_id", "right_id", "score").limit(0)
    return taken.select(*parent, F.col("_l").alias("left_id"), F.col("_r").alias("right_id"), (-F.col("_t.s")).alias("score"))


def greedy_lists(scored: DataFrame, parent: list[str]) -> DataFrame:
    """What greedy_pairs gives, for many parents of few pairs each: a parent's pairs are one sorted array that is gone through once."""
    rows = scored.groupBy(*parent).agg(F.sort_array(F.collect_set(_turn())).alias("_p"))
    kinds = {c: scored.schema[c].dataType.simpleString() for c in ("left_id", "right_id", "score")}
    state = F.struct(F.array().cast(f"array<{kinds['left_id']}>").alias("l"), F.array().cast(f"array<{kinds['right_id']}>").alias("r"), F.array().cast(f"array<{kinds['score']}>").alias("s"))

    def take(held: Column, p: Column) -> Column:
        more = F.struct(*[F.array_append(held[k], v).alias(k) for k, v in (("l", p["left_id"]), ("r", p["right_id"]), ("s", -p["s"]))])
        return F.when(F.array_contains(held["l"], p["left_id"]) | F.array_contains(held["r"], p["right_id"]), held).otherwise(more)

    kept = F.aggregate("_p", state, take)
    rows = rows.select(*parent, kept.alias("_k")).select(*parent, F.inline(F.arrays_zip("_k.l", "_k.r", "_k.s")))
    return rows.toDF(*parent, "left_id", "right_id", "score")
