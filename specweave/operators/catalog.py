"""Regional catalogs and reviews: what runs found, in one flat or nested view, deduplicated with its lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.functions.ids import regional_id
from specweave.functions.text import comparison_key, display_type, portfolio_route, snake_identifier

from .aggregates import domain_of, retain_first, tree
from .joins import keep_last

AWAITING = "Awaiting API Analyzer"


def latest_runs(runs: DataFrame, region: str | None = None, application: str | None = None) -> DataFrame:
    """The best run of each application and repository: most semantic entities, endpoints, entities, then run id."""
    from .ranking import best_run

    rows = runs.filter(F.col("region") == region) if region else runs
    rows = rows.filter(F.col("application") == application) if application else rows
    key = [F.col("region"), F.lower("application"), F.lower("repository")]
    return best_run(rows, key, ["semantic_entities", "semantic_endpoints", "n_entities", "run_id"])


def endpoint_rows(operations: DataFrame, semantics: DataFrame) -> DataFrame:
    """Endpoints with what an analysis says of them, or that it is awaited. operations (operation_id, ...), semantics (operation_id, summary, domain, capability)."""
    out = operations.join(semantics, "operation_id", "left")
    for c in ("summary", "domain", "capability"):
        out = out.withColumn(c, F.coalesce(c, F.lit(AWAITING)))
    return out


def model_rows(entities: DataFrame, attributes: DataFrame, usage: DataFrame) -> DataFrame:
    """entity_id, name, fields, endpoints, usage: a row for each entity. usage (entity_id, operation, usage)."""
    n = attributes.groupBy("entity_id").agg(F.count("*").alias("fields"))
    used = usage.groupBy("entity_id").agg(*[F.array_join(F.sort_array(F.collect_set(c)), ", ").alias(a) for c, a in (("operation", "endpoints"), ("usage", "usage"))])
    out = entities.select("entity_id", "name").join(n, "entity_id", "left").join(used, "entity_id", "left")
    return out.withColumn("fields", F.coalesce("fields", F.lit(0))).withColumn("endpoints", F.coalesce("endpoints", F.lit("Not linked"))).withColumn("usage", F.coalesce("usage", F.lit("Not linked")))


def entity_domains(entities: DataFrame, usage: DataFrame, domains: DataFrame) -> DataFrame:
    """(entity_id, domain): its own, or the one its endpoints share. entities (entity_id, domain), usage (entity_id, operation), domains (operation, domain)."""
    linked = usage.join(domains.filter(F.col("domain") != AWAITING), "operation").groupBy("entity_id").agg(F.count_distinct("domain").alias("_n"), F.min("domain").alias("_d"))
    out = entities.join(linked, "entity_id", "left")
    return out.select("entity_id", domain_of(F.col("domain"), F.coalesce("_n", F.lit(0)), F.col("_d")).alias("domain"))


def domain_tree(endpoints: DataFrame) -> DataFrame:
    """domain with nested capability, api and endpoint, in order at every level."""
    return tree(endpoints, ["domain", "capability", "api"], ["route", "method", "endpoint"])


def model_tree(apis: DataFrame) -> DataFrame:
    """api with nested model and field. apis (api, model, field, type, collection, nullable)."""
    shown = apis.withColumn("type", display_type("type", "collection", "nullable"))
    return tree(shown, ["api", "model"], ["field", "type"])


def review(region: str, sources: DataFrame, attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of several sources merged by approved name, and the map from every source to what became of it.

    sources (source_key, api, approved_name), attributes (source_key, attribute_id, approved_name, type, required). Members of
    a group go by api, then source key; the first is retained. Attributes merge within an
    entity by name and type. Returns (entities, truth map).
    """
    s = sources.withColumn("entity_key", comparison_key("approved_name"))
    members = retain_first(s, ["entity_key"], [F.lower("api"), "source_key"], "Merged duplicate entity")
    entity = regional_id("regional-entity", F.lit(region), "entity_key")
    a = attributes.select("source_key", "attribute_id", F.col("approved_name").alias("attribute_name"), "type", "required")
    a = members.select("entity_key", "source_key", "api").join(a, "source_key")
    a = a.withColumn("attribute_key", comparison_key("attribute_name")).withColumn("type_key", F.lower("type"))
    placed = retain_first(a, ["entity_key", "attribute_key", "type_key"], [F.lower("api"), "attribute_id"], "Merged duplicate attribute")
    merged = placed.groupBy("entity_key", "attribute_key", "type_key").agg(
        F.min_by("attribute_name", "place").alias("name"), F.min_by("type", "place").alias("type"), F.bool_and("required").alias("required_in_all"), F.count("*").alias("n_sources")
    )
    nested = merged.groupBy("entity_key").agg(F.sort_array(F.collect_list(F.struct("attribute_key", "type_key", "name", "type", "required_in_all", "n_sources"))).alias("attributes"))
    entities = members.groupBy("entity_key").agg(F.min_by("approved_name", "place").alias("name"), F.count("*").alias("n_sources"), (F.count("*") - 1).alias("n_duplicates"), F.sort_array(F.collect_set("api")).alias("apis"))
    entities = entities.join(nested, "entity_key", "left").withColumn("id", entity)
    truth = members.select(entity.alias("regional_id"), "source_key", F.lit(None).cast("string").alias("attribute_id"), "action")
    own = regional_id("regional-attribute", entity, "attribute_key", "type_key")
    return entities, truth.unionByName(placed.select(own.alias("regional_id"), "source_key", "attribute_id", "action"))


def review_summary(entities: DataFrame, sources: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row of counts."""
    n = entities.agg(F.count("*").alias("regional_entities"), F.coalesce(F.sum("n_duplicates"), F.lit(0)).alias("merged_duplicates"), F.coalesce(F.sum(F.size(F.coalesce("attributes", F.expr("array()")))), F.lit(0)).alias("regional_attributes"))
    return n.crossJoin(sources.agg(F.count("*").alias("source_entities"))).crossJoin(attributes.agg(F.count("*").alias("source_attributes")))  # one row each


def unique_endpoints(rows: DataFrame, place: str) -> DataFrame:
    """Endpoints once by api, method, route and usage; the last one's values."""
    return keep_last(rows, ["api", "method", "route", "usage"], place)


def portfolio(operations: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations and entities of many systems with normal routes and names and without internal ids."""
    ops = operations.select("region", "system", "method", portfolio_route("route").alias("route"), snake_identifier("name").alias("name")).distinct()
    ents = entities.select("region", "system", snake_identifier("name").alias("name"), F.col("name").alias("original_name")).distinct()
    return ops, ents


def normalized(model: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Models of many systems under comparison names, source names beside them, references by name and no internal ids.

    model, all keyed by (region, system): operations (id, name, method, route, request_entity_id), parameters (operation_id, name, location,
    required, type), responses (operation_id, status, entity_id), entities (id, name, original_name, base_entity_id), attributes (entity_id,
    name, original_name, type, required), enums (id, name, value), relationships (kind, source, target), diagnostics (severity, code,
    message). Names that a reference doesn't lead to are null, relationships' Unknown source and Unknown target.
    """
    at = ["region", "system"]
    called = model["entities"].select(*at, "id", "name").unionByName(model["enums"].select(*at, "id", "name")).unionByName(model["operations"].select(*at, "id", "name"))
    called = called.groupBy(*at, "id").agg(F.min("name").alias("name"))
    types = called.join(model["operations"].select(*at, "id"), [*at, "id"], "left_anti")

    def named(df: DataFrame, column: str, alias: str, names: DataFrame, default: str | None = None) -> DataFrame:
        found = df.join(names.select(*at, F.col("id").alias(column), F.col("name").alias(alias)), [*at, column], "left")
        return found.withColumn(alias, F.coalesce(alias, F.lit(default))) if default else found

    ops = named(model["operations"], "request_entity_id", "request_model", types)
    of = model["operations"].select(*at, F.col("id").alias("operation_id"), F.upper("method").alias("method"), portfolio_route("route").alias("route"))
    ents = named(model["entities"], "base_entity_id", "inherits_from", types)
    owner = model["entities"].select(*at, F.col("id").alias("entity_id"), snake_identifier("name").alias("entity"))
    edges = named(named(model["relationships"], "source", "source_name", called, "Unknown source"), "target", "target_name", called, "Unknown target")
    return {
        "operations": ops.select(*at, snake_identifier("name").alias("name"), F.col("name").alias("source_name"), F.upper("method").alias("method"), portfolio_route("route").alias("route"), F.col("route").alias("source_route"), "request_model"),
        "parameters": model["parameters"].join(of, [*at, "operation_id"]).select(*at, "method", "route", snake_identifier("name").alias("name"), F.col("name").alias("source_name"), "location", "required", "type"),
        "responses": named(model["responses"].join(of, [*at, "operation_id"]), "entity_id", "response_model", types).select(*at, "method", "route", "status", "response_model"),
        "entities": ents.select(*at, snake_identifier("name").alias("name"), F.col("original_name").alias("source_name"), "inherits_from"),
        "fields": model["attributes"].join(owner, [*at, "entity_id"]).select(*at, "entity", snake_identifier("name").alias("name"), F.col("original_name").alias("source_name"), "type", "required"),
        "enums": model["enums"].select(*at, snake_identifier("name").alias("name"), F.col("name").alias("source_name"), snake_identifier("value").alias("value"), F.col("value").alias("source_value")),
        "relationships": edges.select(*at, F.col("kind").alias("relationship"), F.col("source_name").alias("source"), F.col("target_name").alias("target")),
        "diagnostics": model["diagnostics"].select(*at, "severity", "code", "message"),
    }


def supporting_sources(evidence: DataFrame, sources: DataFrame, lineage: DataFrame) -> DataFrame:
    """(subject_id, source, location): where each subject was seen, once; of several lineages of a pair the last counts."""
    from specweave.functions.text import location

    last = keep_last(lineage, ["subject_id", "source_id"], "place")
    rows = evidence.select("subject_id", "source_id").distinct().join(sources.select("source_id", F.col("path").alias("source")), "source_id")
    rows = rows.join(last.select("subject_id", "source_id", "path", "start_line", "end_line", "pointer"), ["subject_id", "source_id"], "left")
    return rows.select("subject_id", "source", F.coalesce(location("path", "start_line", "end_line", "pointer"), "source").alias("location")).distinct()


def name_status(rows: DataFrame, original: str, suggested: str) -> DataFrame:
    """Rows with status: No suggestion, Renamed or Unchanged."""
    status = F.when(F.col(suggested).isNull() | (F.col(suggested) == ""), "No suggestion").when(F.col(suggested) == F.col(original), "Unchanged").otherwise("Renamed")
    return rows.withColumn("status", status)


def component_names(rows: DataFrame, base: str, key: str, order: list[str]) -> DataFrame:
    """Rows with component: the base name for its first user, with eight digits of the key's hash for others."""
    w = Window.partitionBy(base).orderBy(*order)
    return rows.withColumn("component", F.when(F.row_number().over(w) == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), F.substring(F.sha2(F.col(key).cast("binary"), 256), 1, 8))))
