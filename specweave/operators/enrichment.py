"""Enrichment at the edge of a language model: contexts in, answers checked and merged. The model is a callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Business domains and their capabilities.
TAXONOMY = {
    "Policy": ("Quote Management", "Policy Issuance", "Policy Inquiry", "Policy Change", "Renewal", "Cancellation"),
    "Claims": ("FNOL", "Claim Registration", "Claim Assessment", "Settlement", "Claim Inquiry"),
    "Billing": ("Invoice Management", "Billing Inquiry", "Collections"),
    "Party / Customer": ("Customer Management", "Party Inquiry", "Contact Management"),
    "Product": ("Product Definition", "Product Inquiry", "Coverage Management"),
    "Underwriting": ("Risk Assessment", "Eligibility", "Referral Management"),
    "Rating": ("Rate Calculation", "Premium Calculation", "Rate Management"),
    "Distribution": ("Agent Management", "Broker Management", "Channel Management"),
    "Documents": ("Document Generation", "Document Retrieval", "Correspondence Management"),
    "Payments": ("Payment Collection", "Refunds", "Payment Inquiry"),
    "Reference Data": ("Reference Data Inquiry", "Code List Management"),
    "UNCLASSIFIED": ("UNCLASSIFIED",),
}


def taxonomy(spark, names: dict[str, tuple[str, ...]] = TAXONOMY) -> DataFrame:
    return spark.createDataFrame([(d, c) for d, cs in names.items() for c in cs], "domain string, capability string")


def contexts(targets: DataFrame, facts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, context): each target's facts in order as one JSON text."""
    cols = [c for c in facts.columns if c != key and c not in order]
    listed = facts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *cols))).alias("facts"))
    return targets.join(listed, key, "left").select(key, F.to_json(F.struct(*[c for c in targets.columns if c != key], F.coalesce("facts", F.from_json(F.lit("[]"), listed.schema["facts"].dataType)).alias("facts"))).alias("context"))


def enrich(asked: DataFrame, key: str, answer: Callable[[str], dict], schema: str) -> DataFrame:
    """(key, *schema, error): what ``answer`` returns for each context; an exception becomes the row's error.

    asked (key, context). The callable goes to the workers; it is asked once a row, in batches.
    """
    kind = asked.schema[key].dataType.simpleString()
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, context in zip(batch[key], batch["context"], strict=True):
                try:
                    found = answer(context)
                    rows.append((k, *(found.get(n) for n in names), None))
                except Exception as e:  # noqa: BLE001 - a provider's failure is that row's result
                    rows.append((k, *([None] * len(names)), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, *names, "error"])

    return asked.select(key, "context").mapInPandas(run, f"{key} {kind}, {schema}, error string")


def report_counts(discovered: DataFrame, enriched: DataFrame, contexts: DataFrame) -> DataFrame:
    """(kind, discovered, enriched, missing, domains_classified, capabilities_classified, truncated): how far an analysis got, by kind.

    discovered (kind, id), enriched (kind, id, domain, capability), contexts (kind, id, truncated).
    """
    found = enriched.groupBy("kind", "id").agg(F.max("domain").alias("domain"), F.max("capability").alias("capability"), F.lit(True).alias("_e"))
    cut = contexts.groupBy("kind", "id").agg(F.max("truncated").alias("truncated"))
    rows = discovered.select("kind", "id").distinct().join(found, ["kind", "id"], "left").join(cut, ["kind", "id"], "left")
    named = lambda c: F.count_if(F.col("_e") & F.col(c).isNotNull() & (F.col(c) != "UNCLASSIFIED"))
    return rows.groupBy("kind").agg(
        F.count("*").alias("discovered"), F.count_if("_e").alias("enriched"), F.count_if(F.col("_e").isNull()).alias("missing"),
        named("domain").alias("domains_classified"), named("capability").alias("capabilities_classified"), F.count_if("truncated").alias("truncated"),
    )


def restored_proposals(entities: DataFrame, attributes: DataFrame, proposals: DataFrame, proposed: DataFrame) -> DataFrame:
    """(entity_id, attribute_id, original_name, suggested_name, error): proposed names beside the authoritative ones.

    entities (entity_id, name), attributes (entity_id, attribute_id, name), proposals (entity_id, suggested_name), proposed (entity_id, attribute_id,
    suggested_name). Originals come from the model whatever a proposal says they are. A proposal must name every attribute of its
    entity once and no other: each that it misses, repeats or makes up is an error. Entities without a proposal have no rows.
    """
    none = F.lit(None).cast("string")
    asked = entities.join(proposals.groupBy("entity_id").agg(F.count("*").alias("n"), F.min("suggested_name").alias("suggested_name")), "entity_id")
    own = asked.select("entity_id", none.alias("attribute_id"), F.col("name").alias("original_name"), "suggested_name", F.when(F.col("n") > 1, "repeated").alias("error"))
    made_up = proposals.join(entities, "entity_id", "left_anti").select("entity_id", none.alias("attribute_id"), none.alias("original_name"), "suggested_name", F.lit("unknown").alias("error"))
    expected = attributes.join(asked.select("entity_id"), "entity_id", "left_semi").select("entity_id", "attribute_id", F.col("name").alias("original_name"))
    given = proposed.join(asked.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id", "attribute_id").agg(F.count("*").alias("n"), F.min("suggested_name").alias("suggested_name"))
    both = expected.join(given, ["entity_id", "attribute_id"], "full_outer")
    error = F.when(F.col("n").isNull(), "missing").when(F.col("original_name").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return own.unionByName(made_up).unionByName(both.select("entity_id", "attribute_id", "original_name", "suggested_name", error.alias("error")))


def inspect(targets: DataFrame, snippets: DataFrame, answer: Callable[[str], dict], schema: str) -> DataFrame:
    """(target_id, *schema, shown, error): what ``answer`` says of each target or question, from retrieved snippets alone.

    targets (target_id, question), snippets (target_id, place, doc_id, text) as retrieval shows them; schema has citations
    array<string>. An answer that cites what it wasn't shown, or was shown nothing, is an error and its text goes.
    """
    asked = contexts(targets, snippets.select("target_id", "place", "doc_id", "text"), "target_id", ["place"])
    shown = snippets.groupBy("target_id").agg(F.sort_array(F.collect_set(F.col("doc_id").cast("string"))).alias("shown"))
    said = enrich(asked, "target_id", answer, schema).join(shown, "target_id", "left")
    cites = F.size(F.array_except(F.coalesce("citations", F.array().cast("array<string>")), F.coalesce("shown", F.array().cast("array<string>"))))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("shown").isNull(), "nothing retrieved").when(cites > 0, "cites what was not shown")
    names = [c for c in said.columns if c not in ("target_id", "shown", "error")]
    said = said.withColumn("error", error)
    return said.select("target_id", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in names], "shown", "error")


def reconcile_responses(expected: DataFrame, supplied: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Every expected response with the first supplied one; what was not asked for goes."""
    w = Window.partitionBy(*keys).orderBy(place)
    first = supplied.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", place)
    return expected.join(first, keys, "left")


def stop_reason(results: DataFrame, gaps_found: DataFrame, exhausted: bool) -> DataFrame:
    """One row, stop_reason: why an analysis ended; a spent budget before failures, these before gaps."""
    n = results.agg(F.count_if(F.col("error").isNotNull()).alias("failed")).crossJoin(gaps_found.agg(F.count("*").alias("gaps")))  # one row each
    return n.select(F.when(F.lit(exhausted), "budget exhausted").when(F.col("failed") > 0, "analysis failed").when(F.col("gaps") > 0, "gaps remain").otherwise("complete").alias("stop_reason"))


def gaps(targets: DataFrame, claims: DataFrame, results: DataFrame, key: str, contexts: DataFrame | None = None) -> DataFrame:
    """(key, gap): targets without evidence, claims without citation, results that failed or are missing, contexts (key, truncated) that were cut."""
    none = lambda df, text: df.select(key).distinct().withColumn("gap", F.lit(text))
    without = targets.join(claims.select(key).distinct(), key, "left_anti")
    missing = targets.join(results.select(key).distinct(), key, "left_anti")
    return none(without, "no claims").unionByName(none(claims.filter(F.size("citations") == 0), "no citation")).unionByName(none(results.filter("error is not null"), "analysis failed")).unionByName(none(missing, "not analyzed")).unionByName(none(contexts.filter("truncated") if contexts is not None else targets.limit(0), "context cut"))


def evidence_map(**tables: DataFrame) -> DataFrame:
    """(kind, subject_id, evidence): the evidence of tables (subject_id, evidence) by kind, once and in order."""
    rows = None
    for kind, df in sorted(tables.items()):
        part = df.select(F.lit(kind).alias("kind"), "subject_id", F.explode("evidence").alias("e"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("kind", "subject_id").agg(F.sort_array(F.collect_set("e")).alias("evidence"))


def attach_drafts(matches: DataFrame, drafts: DataFrame) -> DataFrame:
    """Matches with a generated candidate where there is a draft and nothing matched."""
    d = drafts.select("regional_id", F.col("draft").alias("generated"))
    return matches.join(d, "regional_id", "left").withColumn("generated", F.when(F.col("status") == "Not matched", F.col("generated")))


def call_log(calls: DataFrame) -> DataFrame:
    """Calls as they are logged: sizes, counts and outcome, never content."""
    return calls.select("at", "provider", "operation", "model", "status", "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))
