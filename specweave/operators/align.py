"""Fuzzy alignment of a regional model with candidates: attributes, entities, domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.functions.similarity import (
    FULL,
    NONE,
    PARTIAL,
    attribute_score,
    attribute_status,
    capability_score,
    chosen_source,
    compatible_types,
    domain_score,
    entity_score,
    name_similarity,
    parent_status,
    text_similarity,
)
from specweave.functions.text import rounded, route_domain, terms

from .pairing import candidate_pairs
from .ranking import best_candidate, greedy_lists


def _product(regional: DataFrame, candidates: DataFrame) -> DataFrame:
    """(regional_id, candidate_id): all pairs of two catalogs of business domains, of which there are a few dozen."""
    x, y = regional.select("regional_id").distinct(), candidates.select("candidate_id").distinct()
    return x.crossJoin(y)


def best_by_words(regional: DataFrame, candidates: DataFrame) -> DataFrame:
    """regional_id, candidate_id, score: of every text (regional_id, name) the one of (candidate_id, name) that shares most of their words, in per cent; the greatest id of equal ones.

    Only pairs that share a word are formed, by an index of words; a text that shares none gets the greatest id, at 0.
    """
    words = lambda t, k: t.select(k, terms("name", False).alias("_w")).groupBy(k).agg(F.min("_w").alias("_w"))
    a, b = words(regional, "regional_id"), words(candidates, "candidate_id")
    each = lambda t, k, n: t.select(k, F.size("_w").alias(n), F.explode("_w").alias("_w"))
    shared = each(a, "regional_id", "_n").join(each(b, "candidate_id", "_m"), "_w").groupBy("regional_id", "candidate_id", "_n", "_m").agg(F.count("*").alias("_k"))
    scored = shared.select("regional_id", "candidate_id", F.round(F.col("_k") / (F.col("_n") + F.col("_m") - F.col("_k")) * 100, 6).alias("score"))
    best = scored.groupBy("regional_id").agg(F.max(F.struct("score", "candidate_id")).alias("_b"))
    last = b.agg(F.max("candidate_id")).first()[0]
    rows = a.select("regional_id").join(best, "regional_id", "left")
    return rows.select("regional_id", F.coalesce("_b.candidate_id", F.lit(last)).alias("candidate_id"), F.coalesce("_b.score", F.lit(0.0)).alias("score")).filter("candidate_id is not null")


def _names_compared(both: DataFrame, left: str, right: str) -> DataFrame:
    """``both`` with name_score; each pair of different names is compared once."""
    names = both.select(left, right).distinct()
    names = names.select(F.col(left).alias("_l"), F.col(right).alias("_r"), name_similarity(left, right).alias("name_score"))
    return both.join(names, both[left].eqNullSafe(names["_l"]) & both[right].eqNullSafe(names["_r"])).drop("_l", "_r")


def score_attributes(pairs: DataFrame, regional: DataFrame, candidates: DataFrame) -> DataFrame:
    """One-to-one attribute matches of each entity pair.

    pairs (regional_id, candidate_id), regional (regional_id, left_id, name, description, type), candidates
    (candidate_id, right_id, name, description, type). Returns regional_id, candidate_id, left_id, right_id, score, status.
    """
    side = lambda t, p: t.select(*[F.col(c).alias(c if c.endswith("_id") else f"{p}_{c}") for c in t.columns])
    both = pairs.join(side(regional, "left"), "regional_id").join(side(candidates, "right"), "candidate_id")
    both = _names_compared(both, "left_name", "right_name")
    score = attribute_score(F.col("name_score"), compatible_types("left_type", "right_type"), text_similarity("left_description", "right_description"))
    scored = both.withColumn("score", rounded(score, 1))
    taken = greedy_lists(scored, ["regional_id", "candidate_id"])
    return taken.withColumn("status", attribute_status(F.col("score")))


def align(regional: DataFrame, regional_attributes: DataFrame, candidates: DataFrame, candidate_attributes: DataFrame) -> DataFrame:
    """regional_id, candidate_id, score, status: the best candidate of every regional entity; null and Not matched without any.

    Entities (id, name, description), attributes as score_attributes() takes them. Only pairs that can be an
    entity's best are scored (pairing.candidate_pairs); the result is that of the product of both catalogs.
    """

    def best(pairs: DataFrame) -> DataFrame:
        matched = score_attributes(pairs, regional_attributes, candidate_attributes)
        return _best(pairs, matched, regional, regional_attributes, candidates, candidate_attributes, entity_score)

    pairs = candidate_pairs(regional, regional_attributes, candidates, candidate_attributes, best)
    return _shown(best(pairs), regional)


def align_domains(regional: DataFrame, regional_capabilities: DataFrame, candidates: DataFrame, candidate_capabilities: DataFrame) -> DataFrame:
    """regional_id, candidate_id, score, status of business domains by name and by their capabilities, matched one to one.

    Domains (id, name, description), capabilities (regional_id, left_id, name, description) and (candidate_id, right_id, ...).
    """
    pairs = _product(regional, candidates)
    side = lambda t, p: t.select(*[F.col(c).alias(c if c.endswith("_id") else f"{p}_{c}") for c in t.columns])
    both = pairs.join(side(regional_capabilities, "left"), "regional_id").join(side(candidate_capabilities, "right"), "candidate_id")
    score = capability_score(name_similarity("left_name", "right_name"), text_similarity("left_description", "right_description"))
    taken = greedy_lists(both.withColumn("score", rounded(score, 1)), ["regional_id", "candidate_id"])
    matched = taken.withColumn("status", F.when(F.col("score") >= 85, FULL).when(F.col("score") >= 45, PARTIAL).otherwise(NONE))
    best = _best(pairs, matched, regional, regional_capabilities, candidates, candidate_capabilities, lambda name, mean, _: domain_score(name, mean))
    return _shown(best, regional)


def _best(pairs: DataFrame, matched: DataFrame, regional: DataFrame, regional_children: DataFrame, candidates: DataFrame, candidate_children: DataFrame, total) -> DataFrame:
    """Each regional item's best of ``pairs`` by total(name, mean of children, description): regional_id, candidate_id, score, status."""
    size = lambda t, k: t.groupBy(k).agg(F.count("*").alias(f"n_{k}"))
    by_pair = matched.groupBy("regional_id", "candidate_id").agg(F.sum("score").alias("total"), F.count_if(F.col("status") == FULL).alias("full"), F.count_if(F.col("status") != NONE).alias("any"))
    named = lambda t, k, p: t.select(k, F.col("name").alias(f"{p}_name"), F.col("description").alias(f"{p}_description"))
    rows = pairs.join(named(regional, "regional_id", "left"), "regional_id").join(named(candidates, "candidate_id", "right"), "candidate_id")
    rows = rows.join(by_pair, ["regional_id", "candidate_id"], "left").join(size(regional_children, "regional_id"), "regional_id", "left").join(size(candidate_children, "candidate_id"), "candidate_id", "left")
    n, m = F.coalesce("n_regional_id", F.lit(0)), F.coalesce("n_candidate_id", F.lit(0))
    mean = F.when(n > 0, F.try_divide(F.coalesce("total", F.lit(0.0)), n)).when(m == 0, 100.0).otherwise(0.0)
    rows = _names_compared(rows, "left_name", "right_name")
    score = total(F.col("name_score"), mean, text_similarity("left_description", "right_description"))
    rows = rows.withColumn("score", score).withColumn("status", parent_status(F.col("score"), F.coalesce("full", F.lit(0)) == n, F.coalesce("any", F.lit(0)) > 0))
    return best_candidate(rows.select("regional_id", "score", F.col("right_name").alias("candidate_name"), "candidate_id", "status"), ["regional_id"], "score", "candidate_name")


def _shown(best: DataFrame, regional: DataFrame) -> DataFrame:
    """The best of every regional item, those without one as Not matched."""
    out = regional.select("regional_id").distinct().join(best, "regional_id", "left")
    return out.select("regional_id", "candidate_id", rounded(F.coalesce("score", F.lit(0.0)), 1).alias("score"), F.coalesce("status", F.lit(NONE)).alias("status"))


def combine(baseline: DataFrame, reference: DataFrame) -> DataFrame:
    """regional_id, source, candidate_id, score, status of two proposals for the same entities, the baseline first."""
    side = lambda t, p: t.select("regional_id", *[F.col(c).alias(f"{p}_{c}") for c in ("candidate_id", "score", "status")])
    both = side(baseline, "b").join(side(reference, "r"), "regional_id")
    source = chosen_source("b_status", "r_status", "b_candidate_id", "r_candidate_id")
    both = both.withColumn("source", source)
    pick: Column = lambda c: F.when(F.col("source") == "Canonical baseline", F.col(f"b_{c}")).otherwise(F.col(f"r_{c}"))
    return both.select("regional_id", "source", *[pick(c).alias(c) for c in ("candidate_id", "score", "status")])


def unmatched(matches: DataFrame, candidate_attributes: DataFrame) -> DataFrame:
    """(candidate_id, right_id): attributes of chosen candidates that no match uses. matches (candidate_id, right_id)."""
    chosen = candidate_attributes.join(matches.select("candidate_id").distinct(), "candidate_id", "left_semi")
    return chosen.select("candidate_id", "right_id").join(matches.select("candidate_id", "right_id"), ["candidate_id", "right_id"], "left_anti")


def endpoint_domains(endpoints: DataFrame) -> DataFrame:
    """(domain, n, text): endpoints (endpoint_id, route, tags, description) by tag, or by route where there is none; texts in order."""
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.col("tags")).otherwise(F.array(route_domain("route")))
    rows = endpoints.select("endpoint_id", F.explode(tags).alias("domain"), "description")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("endpoint_id", "description"))), lambda x: x["description"]), " ")
    return rows.groupBy("domain").agg(F.count("*").alias("n"), text.alias("text"))


def default_choice(status: Column, baseline: Column, reference: Column, generated: Column) -> Column:
    """Which candidate is selected unless a reviewer says otherwise."""
    draft = F.when(generated.isNotNull(), "Generated").otherwise("Manual")
    return (
        F.when((status == NONE) & baseline.isNotNull(), draft).when(baseline.isNotNull(), "Canonical baseline")
        .when(reference.isNotNull(), "Reference").when(generated.isNotNull(), "Generated").otherwise("Manual")
    )
