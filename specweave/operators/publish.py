"""Review decisions, their checks, and versions of what was approved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.functions.ids import digest, joined_id, rows_digest
from specweave.functions.text import comparison_key, published_type

from .joins import keep_first

SELECTIONS = ("Canonical baseline", "Reference", "Generated", "Manual")
STATUSES = ("Full match", "Partial match", "Not matched")


def decision_errors(decisions: DataFrame, key: str = "regional_id") -> DataFrame:
    """(key, error): everything that is wrong with decisions, a row for each.

    decisions: key, status, proposed_status, selection, baseline_id, reference_id, generated_id, manual_name, constraints, reason, approved.
    """
    c = F.col
    said = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    tests = [
        (~F.coalesce(c("status").isin(*STATUSES), F.lit(False)), "unknown status"),
        (~F.coalesce(c("selection").isin(*SELECTIONS), F.lit(False)), "unknown selection"),
        ((c("selection") == "Canonical baseline") & c("baseline_id").isNull(), "no baseline candidate"),
        ((c("selection") == "Reference") & c("reference_id").isNull(), "no reference candidate"),
        ((c("selection") == "Generated") & c("generated_id").isNull(), "no generated candidate"),
        ((c("selection") == "Manual") & ~said(c("manual_name")), "a manual candidate needs a name"),
        (said(c("constraints")) & F.try_parse_json(c("constraints")).isNull(), "constraints are no JSON"),
        (((c("status") != "Full match") | ~c("status").eqNullSafe(c("proposed_status")) | c("selection").isin("Manual", "Generated")) & ~said(c("reason")), "a reason is required"),
        (~F.coalesce(c("approved"), F.lit(False)), "not approved"),
    ]
    found = F.array(*[F.when(test, F.lit(text)) for test, text in tests])
    return decisions.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("error"))


def apply_review(rows: DataFrame, decisions: DataFrame, key: str, name: str) -> DataFrame:
    """Rows renamed as decided (key, action, new_name); rejected ones go, those without decision stay as they are."""
    d = decisions.select(F.col(key).alias("_k"), "action", "new_name")
    out = rows.join(d, rows[key] == F.col("_k"), "left").filter(~F.col("action").eqNullSafe("Reject"))
    renamed = F.when((F.col("action") == "Use") & F.col("new_name").isNotNull(), F.col("new_name")).otherwise(F.col(name))
    return out.withColumn(name, renamed).drop("_k", "action", "new_name")


def drop_children(children: DataFrame, column: str, decisions: DataFrame, key: str) -> DataFrame:
    """Children of rejected parents go."""
    bad = decisions.filter("action = 'Reject'").select(F.col(key).alias(column)).distinct()
    return children.join(bad, column, "left_anti")


def append_version(versions: DataFrame, by: list[str], content: DataFrame) -> DataFrame:
    """New rows (by, ..., version) for ``content`` (by, ...), one more than the greatest of its key."""
    last = versions.groupBy(*by).agg(F.max("version").alias("_last"))
    return content.join(last, by, "left").withColumn("version", F.coalesce("_last", F.lit(0)) + 1).drop("_last")


def merge_baseline(baseline: DataFrame, regional: DataFrame, key: str, lists: list[str], values: list[str]) -> DataFrame:
    """A canonical model with a regional one merged in by key: lists united, values of the baseline first."""
    a = baseline.select(key, *[F.col(c).alias(f"_a_{c}") for c in (*lists, *values)])
    b = regional.select(key, *[F.col(c).alias(f"_b_{c}") for c in (*lists, *values)])
    empty = F.array().cast("array<string>")
    union: Column = lambda c: F.array_sort(F.array_union(F.coalesce(f"_a_{c}", empty), F.coalesce(f"_b_{c}", empty)))
    return a.join(b, key, "full_outer").select(key, *[union(c).alias(c) for c in lists], *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in values])


def absent_attributes(baseline: DataFrame, regional: DataFrame, keys: list[str]) -> DataFrame:
    """Attributes that the baseline lacks."""
    return regional.join(baseline.select(*keys).distinct(), keys, "left_anti")


def review_nodes(matches: DataFrame, children: DataFrame, statuses: list[str]) -> DataFrame:
    """(parent_id, regional_id, name, status, level): matches and their children of some statuses, in one flat list.

    matches (regional_id, name, status), children (parent_id, regional_id, name, status). A child counts by its own status.
    """
    top = matches.select(F.col("regional_id").alias("parent_id"), "regional_id", "name", "status", F.lit("parent").alias("level"))
    below = children.join(matches.select(F.col("regional_id").alias("parent_id")), "parent_id", "left_semi")
    rows = top.unionByName(below.select("parent_id", "regional_id", "name", "status", F.lit("child").alias("level")))
    return rows.filter(F.col("status").isin(*statuses))


def approve_nodes(decisions: DataFrame, nodes: DataFrame, reason: str) -> DataFrame:
    """Decisions with all ``nodes`` (regional_id, name) approved at once; the others as they are.

    decisions (regional_id, status, proposed_status, selection, reference_id, manual_name, reason, approved). A reference that isn't
    there becomes a manual candidate, one without a name takes the regional one; ``reason`` is given where one is required
    and none was said.
    """
    said = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    d = decisions.join(nodes.select("regional_id", F.col("name").alias("_name"), F.lit(True).alias("_node")), "regional_id", "left")
    node = F.coalesce("_node", F.lit(False))
    lost = node & said(F.col("_name")) & (F.col("selection") == "Reference") & F.col("reference_id").isNull()
    d = d.withColumn("selection", F.when(lost, "Manual").otherwise(F.col("selection")))
    unnamed = node & said(F.col("_name")) & (F.col("selection") == "Manual") & ~said(F.col("manual_name"))
    d = d.withColumn("manual_name", F.when(unnamed, F.col("_name")).otherwise(F.col("manual_name")))
    status = F.coalesce("status", "proposed_status")
    required = (status != "Full match") | ~status.eqNullSafe(F.col("proposed_status")) | F.col("selection").isin("Manual", "Generated")
    d = d.withColumn("reason", F.when(node & required & ~said(F.col("reason")), F.lit(reason)).otherwise(F.col("reason")))
    return d.withColumn("approved", node | F.coalesce("approved", F.lit(False))).drop("_name", "_node")


def resolved(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Matches with what was decided of each: canonical name, standard, status and reason.

    matches (regional_id, name, status, score, baseline_name, reference_name, generated_name), decisions (regional_id,
    selection, manual_name, status, reason). The selected candidate gives the name; a manual one its own.
    """
    d = decisions.select("regional_id", "selection", "manual_name", F.col("status").alias("_status"), "reason")
    rows = matches.withColumnRenamed("status", "proposed_status").join(d, "regional_id")
    name = F.when(F.col("selection") == "Canonical baseline", F.col("baseline_name")).when(F.col("selection") == "Reference", F.col("reference_name"))
    name = name.when(F.col("selection") == "Generated", F.col("generated_name")).otherwise(F.trim("manual_name"))
    return rows.select("*", name.alias("canonical_name"), F.coalesce("_status", "proposed_status").alias("status")).withColumn("reason", F.trim("reason")).drop("_status", "manual_name")


def approved_mappings(entities: DataFrame, attributes: DataFrame, domains: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(kind, regional, baseline, reference, canonical, status, proposed_status, score, selection, generated, reason): what everything became.

    Tables of resolved(); attributes and capabilities with parent_id, the regional_id of their entity or domain. Children are called parent.child.
    """
    none = F.lit("")
    facts = ["status", "proposed_status", "score", "selection"]

    def plain(kind: str, df: DataFrame) -> DataFrame:
        names = [F.coalesce(c, none).alias(a) for c, a in (("baseline_name", "baseline"), ("reference_name", "reference"))]
        return df.select(F.lit(kind).alias("kind"), F.col("name").alias("regional"), *names, F.col("canonical_name").alias("canonical"), *facts, F.coalesce("generated_name", none).alias("generated"), "reason")

    def below(kind: str, df: DataFrame, parents: DataFrame, whole_reference: bool) -> DataFrame:
        p = parents.select(F.col("regional_id").alias("parent_id"), *[F.col(c).alias(f"_{c}") for c in ("name", "baseline_name", "reference_name", "canonical_name")])
        path = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.coalesce(f"_{c}", none), F.lit("."), F.col(c))).otherwise(none)
        reference = path("reference_name") if whole_reference else F.coalesce("reference_name", none)
        return df.join(p, "parent_id").select(F.lit(kind).alias("kind"), path("name").alias("regional"), path("baseline_name").alias("baseline"), reference.alias("reference"), path("canonical_name").alias("canonical"), *facts, F.coalesce("generated_name", none).alias("generated"), "reason")

    return (
        plain("Entity", entities).unionByName(below("Attribute", attributes, entities, True))
        .unionByName(plain("Domain", domains)).unionByName(below("Capability", capabilities, domains, False))
    )


def canonical_rows(region: str, entities: DataFrame, attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approved entities (id, name, ...) and attributes (id, entity_id, name, type, ...) of resolved() with canonical identities.

    attributes also have parent_id, regional_type, reference_type, manual_type and required: the reference's type counts where it was
    selected, else a reviewer's, else the regional one.
    """
    own = joined_id("canonical-entity", F.lit(region), "canonical_name")
    ents = entities.select(own.alias("id"), F.col("canonical_name").alias("name"), F.col("selection").alias("standard"), "status", "proposed_status", "score", "reason", "regional_id")
    a = attributes.join(ents.select(F.col("regional_id").alias("parent_id"), F.col("id").alias("entity_id")), "parent_id")
    picked = F.when((F.col("selection") == "Reference") & F.col("reference_type").isNotNull(), F.col("reference_type")).otherwise(F.coalesce("manual_type", "regional_type"))
    child = joined_id("canonical-attribute", "entity_id", "canonical_name", "regional_type")
    return ents, a.select(child.alias("id"), "entity_id", F.col("canonical_name").alias("name"), picked.alias("type"), "required", F.col("selection").alias("standard"), "status", "reason")


def endpoint_entities(endpoints: DataFrame, usage: DataFrame) -> DataFrame:
    """Endpoints (api, method, route, ...) with entities: who uses them how, by usage and name; empty without any.

    usage (api, method, route, entity, usage); a null usage is Contract.
    """
    at = ["api", "method", "route"]
    used = usage.withColumn("usage", F.coalesce("usage", F.lit("Contract"))).groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("usage", "entity"))).alias("entities"))
    return endpoints.join(used, at, "left").withColumn("entities", F.coalesce("entities", F.expr("cast(array() as array<struct<usage:string,entity:string>>)")))


def merge_endpoints(baseline: DataFrame, regional: DataFrame, baseline_region: str, region: str) -> DataFrame:
    """Endpoints (region, api, operation, method, route, ...) of a baseline, then of a region, once by these five; a missing region is its side's."""
    side = lambda df, name, n: df.withColumn("region", F.coalesce("region", F.lit(name))).withColumn("_side", F.lit(n))
    rows = side(baseline, baseline_region, 0).unionByName(side(regional, region, 1))
    five = ["region", "api", "operation", "method", "route"]
    rest = [c for c in rows.columns if c not in (*five, "_side")]
    return keep_first(rows, five, "_side", *rest).drop("_side")


def merge_attributes(baseline: DataFrame, regional: DataFrame) -> DataFrame:
    """Attributes (entity, name, type) of a baseline, and those of a region that it lacks by entity and name, however they are spelled."""
    keyed = lambda df: df.withColumn("_e", comparison_key("entity")).withColumn("_n", comparison_key("name"))
    more = keyed(regional).join(keyed(baseline).select("_e", "_n").distinct(), ["_e", "_n"], "left_anti")
    return baseline.select("entity", "name", "type").unionByName(keep_first(more, ["_e", "_n"], "entity", "name", "type").select("entity", "name", "type"))


def default_review(entities: DataFrame, attributes: DataFrame, mappings: DataFrame) -> DataFrame:
    """(kind, key, action): everything a final review decides on, to be used as it is unless a reviewer says otherwise.

    entities (id), attributes (id), mappings (kind, canonical). Domains and capabilities go by their canonical name, once.
    """
    use = F.lit("Use canonical").alias("action")
    of = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").alias("key"), use)
    names = mappings.filter("kind in ('Domain', 'Capability')").select(F.when(F.col("kind") == "Domain", "domains").otherwise("capabilities").alias("kind"), F.col("canonical").alias("key"), use)
    return of(entities, "entities").unionByName(of(attributes, "attributes")).unionByName(names).distinct()


def canonical_summary(entities: DataFrame, attributes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """One row of counts: entities, attributes, endpoints (domain, capability), different domains, and capabilities within their domain."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    known = endpoints.agg(F.count("*").alias("endpoints"), F.count_distinct("domain").alias("domains"), F.count_distinct("domain", "capability").alias("capabilities"))
    return n(entities, "entities").crossJoin(n(attributes, "attributes")).crossJoin(known)  # one row each


def input_digest(inputs: dict[str, DataFrame], settings: dict[str, str]) -> DataFrame:
    """One row, digest: the identity of an alignment's inputs, whatever the order of their rows.

    Rows become JSON with sorted names and are added up by their hashes per table, so nothing is collected.
    """
    sums = None
    for name in sorted(inputs):
        df = inputs[name]
        row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        one = df.agg(F.concat(F.lit(f"{name}="), rows_digest(row)).alias("line"))
        sums = one if sums is None else sums.unionByName(one)
    fixed = "".join(f"\n{k}={settings[k]}" for k in sorted(settings))
    return sums.agg(digest(F.concat(F.array_join(F.sort_array(F.collect_list("line")), "\n"), F.lit(fixed))).alias("digest"))  # a line for each table


def latest(drafts: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last draft of each key: what an upsert leaves."""
    cols = [c for c in drafts.columns if c not in by]
    return drafts.groupBy(*by).agg(F.max_by(F.struct(*cols), order).alias("_v")).select(*by, "_v.*")


def openapi_document(title: str, version: str, operations: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row, document: canonical rows as OpenAPI JSON. operations (route, method, summary, domain, entity), attributes (entity, name, type, description, required).

    The document is one value by nature; what is collected for it is one row an operation and one an attribute.
    """
    # lists of entries can be sorted, maps cannot: they become maps last
    response = F.struct(F.struct(F.lit("Successful response").alias("description")).alias("200"))
    one = F.struct(F.col("summary"), F.array("domain").alias("tags"), response.alias("responses"))
    methods = operations.groupBy("route").agg(F.sort_array(F.collect_list(F.struct(F.lower("method").alias("k"), one.alias("v")))).alias("methods"))
    listed = methods.agg(F.sort_array(F.collect_list(F.struct("route", "methods"))).alias("x"))
    paths = listed.select(F.map_from_entries(F.transform("x", lambda r: F.struct(r["route"], F.map_from_entries(r["methods"])))).alias("paths"))
    kind = F.coalesce(published_type("type"), F.lit("string"))
    prop = F.struct("name", F.struct(kind.alias("type"), F.col("description")).alias("v"))
    schema = attributes.groupBy("entity").agg(F.sort_array(F.collect_list(prop)).alias("properties"), F.sort_array(F.collect_set(F.when(F.col("required"), F.col("name")))).alias("required"))
    listed = schema.agg(F.sort_array(F.collect_list(F.struct("entity", "properties", "required"))).alias("x"))
    body = lambda s: F.struct(F.lit("object").alias("type"), F.map_from_entries(s["properties"]).alias("properties"), s["required"].alias("required"))
    schemas = listed.select(F.map_from_entries(F.transform("x", lambda s: F.struct(s["entity"], body(s)))).alias("schemas"))
    info = F.struct(F.lit(title).alias("title"), F.lit(version).alias("version"))
    return paths.crossJoin(schemas).select(F.to_json(F.struct(F.lit("3.0.3").alias("openapi"), info.alias("info"), "paths", F.struct("schemas").alias("components"))).alias("document"))  # one row each
