"""Mixing sources to target weights as a time-varying curriculum, in SQL functions only.

Every source has a weight that changes in a straight line over the training run.
The integral of that weight is the source's cumulative token demand; inverting it
turns "the n-th token taken from this source" into a position of the run. Documents
are laid end to end within their source in an order fixed by a hash of doc_id, pass
after pass, and the mix is the range sort of all of them by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.plans.lineage import cut

from .common import n_words

WEIGHTS = (3, 1, 2)
#: Weight at the start and at the end of the run, relative to each other, by the source's place.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Slices of a source in hash order. Prefix sums are taken over slices, then within
#: one, so a source of any size is spread over this many tasks.
SLICES = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, ramps=RAMPS) -> DataFrame:
    """One row per source: source, source_size, target, place, ramp (-1 to 1).

    sizes: (source, size). Targets share ``share`` times all words by weight, weights
    repeating over the sources in code-point order with null last. A target stops at
    ``most`` times its source's size and the excess goes to the others by weight, until
    none is above: with sources by cap over weight, the first whose cap exceeds the
    level that remains sets the level for itself and all after it. The windows run over
    one row per source, not over documents. No rows give no rows.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filling = Window.orderBy("ratio", "place")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("place") % len(values) + 1).cast("int"))
    return (
        by_source.withColumn("place", F.row_number().over(ordered) - 1)
        .withColumn("weight", pick([float(w) for w in weights]))
        .withColumn("ramp", pick([(e - s) / (e + s) for s, e in ramps]))
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("filled", F.coalesce(F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("filled")) / F.col("rest"))
        .withColumn("level", F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "place", "level")))
        .withColumn("level", F.min("level").over(everything)["level"])
        .withColumn("target", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit")))
        .select("source", "source_size", "target", "place", "ramp")
    )


def position(taken: Column, target: Column, ramp: Column) -> Column:
    """The point of the run, 0 to 1, at which the cumulative demand reaches ``taken``.

    The share of a source's target asked for by time t is t + ramp (t^2 - t).
    """
    u = F.try_divide(taken, target)
    b = F.lit(1.0) - ramp
    return F.when(ramp == 0, u).otherwise((F.sqrt(b * b + ramp * u * 4.0) - b) / (ramp * 2.0) + 0.0)


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, ramps=RAMPS, slices: int = SLICES) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, size) with source_size, target, taken and its positions.

    taken counts the words the mix takes of the row, repeats included. A source's rows are
    gone through in hash order and begun again while its target, rounded to words, is not
    reached; the row at which it is reached gives only the words that are missing, so a
    source's taken words are its rounded target. positions holds a struct (pass, words,
    position) for each pass over the row, in order, with none when nothing is taken.
    Rows without words take nothing. Reruns agree, whatever the partitioning: the order is
    md5(doc_id), doc_id, size, and rows that tie in all of them are alike. A null doc_id
    counts as an empty one. Other columns pass through under their own names, held in
    ``docs`` as one struct named ``row`` when they clash.
    """
    keyed = docs.withColumn("mix_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    keyed = keyed.withColumn("mix_slice", F.pmod(F.conv(F.substring("mix_key", 1, 4), 16, 10).cast("int"), F.lit(slices)))
    sums = cut(keyed.groupBy("source", "mix_slice").agg(F.sum("size").alias("size")))
    before = Window.partitionBy("source").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "mix_slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    targets = source_targets(sums, weights, share, most, ramps)
    known = offsets.join(targets, offsets.source.eqNullSafe(targets.source)).select(
        offsets.source.alias("s"), F.col("mix_slice").alias("m"), "before", "source_size", "target", "ramp"
    )
    known = cut(known)
    inside = Window.partitionBy("source", "mix_slice").orderBy("mix_key", "doc_id", "size")
    end = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = keyed.withColumn("mix_end", end)
    rows = rows.join(known, rows.source.eqNullSafe(known.s) & (rows.mix_slice == known.m))
    start, wanted = F.col("mix_end") - F.col("size") + F.col("before"), F.round("target").cast("long")
    passes = F.transform(
        F.sequence(F.lit(0), F.lit(max(0, int(-(-most // 1)) - 1))),
        lambda p: F.struct(
            (p + 1).alias("pass"),
            F.greatest(F.lit(0), F.least(F.col("size"), wanted - start - p * F.col("source_size"))).alias("words"),
            position(start + p * F.col("source_size"), F.col("target"), F.col("ramp")).alias("position"),
        ),
    )
    return (
        rows.withColumn("positions", F.filter(passes, lambda x: x["words"] > 0))
        .withColumn("taken", F.aggregate("positions", F.lit(0).cast("long"), lambda n, x: n + x["words"]))
        .drop("mix_key", "mix_slice", "mix_end", "before", "ramp", "s", "m")
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row of ``docs`` for each pass that takes words of it, in training order.

    Adds mix_pass, mix_words (of this row in this pass) and mix_position to the columns of
    ``docs``; columns of those names in ``docs`` are replaced. Null texts have no words.
    """
    names = [c for c in docs.columns if c not in ("mix_pass", "mix_words", "mix_position")]
    held = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*names).alias("row"))
    taken = plan_mix(held, **how).select("row", F.explode("positions").alias("at"))
    taken = taken.orderBy(F.col("at.position"), F.col("row.doc_id"), F.col("at.pass"))
    return taken.select("row.*", F.col("at.pass").alias("mix_pass"), F.col("at.words").alias("mix_words"), F.col("at.position").alias("mix_position"))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_position; sorted by position."""
    sizes = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    first = F.try_element_at("positions", F.lit(1))["position"]
    rows = plan_mix(sizes, **how).select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
    return rows.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")
