"""Discovery models as tables: from code extraction, and reconciled with what an API description says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.functions.ids import discovery_id
from specweave.functions.text import clr_kind, compact_name, plain_route, route_segments
from specweave.plans.lineage import cut

from .aggregates import merge_edges
from .graph import closure
from .joins import claim_routes, keep_last, merge_lists, propagate_pairs
from .ranking import unique_by_id


def _once(df: DataFrame) -> DataFrame:
    """Rows once by id, the first extracted."""
    return df.dropDuplicates(["region", "system", "id"])


def from_extraction(raw: DataFrame) -> dict[str, DataFrame]:
    """Tables of a model, keyed by (region, system), from extraction results (region, system, sources, operations, types, diagnostics).

    Identities depend on names and routes alone. Types refer to one another by full name; a collection's
    element type is what counts.
    """
    scope = ["region", "system"]
    each = lambda column, name: raw.select(*scope, F.explode(column).alias(name))
    types, ops = each("types", "t"), each("operations", "o")
    kind = F.when(F.col("t.kind") == "enum", "enum").otherwise("entity")
    type_id = F.when(F.col("t.kind") == "enum", discovery_id("enum", "t.fullName")).otherwise(discovery_id("entity", "t.fullName"))
    known = cut(types.select(*scope, F.col("t.fullName").alias("full_name"), kind.alias("what"), F.col("t.kind").alias("type_kind"), type_id.alias("type_id")).distinct())

    def refer(df: DataFrame, column: str, name: str, only: str | None = None) -> DataFrame:
        k = (known if only is None else known.filter(F.col("type_kind") == only)).select(*scope, F.col("full_name").alias("_n"), F.col("type_id").alias(name))
        return df.withColumn("_n", F.col(column)).join(k, [*scope, "_n"], "left").drop("_n")

    entities = refer(types.filter("t.kind != 'enum'"), "t.baseType", "base_entity_id").select(*scope, type_id.alias("id"), F.col("t.name").alias("name"), F.col("t.fullName").alias("full_name"), "base_entity_id", "t.location")
    props = types.filter("t.kind != 'enum'").select(*scope, F.col("t.fullName").alias("full_name"), type_id.alias("entity_id"), F.posexplode("t.properties").alias("position", "p"))
    element = F.when(F.col("p.collection"), F.col("p.elementType")).otherwise(F.col("p.type"))
    props = refer(props.withColumn("element", element), "element", "reference_id")
    base = clr_kind("p.type")
    attribute_kind = F.when(F.col("reference_id").startswith("entity-"), "object").when(F.col("reference_id").isNotNull(), "enum").otherwise(base)
    camel = F.concat(F.lower(F.substring("p.name", 1, 1)), F.substring("p.name", 2, 1 << 30))
    attributes = props.select(*scope, discovery_id("attribute", "full_name", "p.name").alias("id"), "entity_id", camel.alias("name"), F.col("p.name").alias("original_name"), attribute_kind.alias("kind"), "reference_id", "p.nullable", "p.collection", (~F.col("p.nullable")).alias("required"), "position", "p.location")
    rules = props.select(*scope, discovery_id("attribute", "full_name", "p.name").alias("target_id"), F.explode("p.attributes").alias("r"))
    validations = rules.select(*scope, discovery_id("validation", "target_id", "r.name", F.array_join("r.arguments", chr(31))).alias("id"), "target_id", F.col("r.name").alias("rule"), F.col("r.arguments").alias("values"))
    enums = types.filter("t.kind = 'enum'").select(*scope, discovery_id("enum", "t.fullName").alias("id"), F.col("t.name").alias("name"), F.col("t.enumValues").alias("values"), "t.location")
    op_id = discovery_id("operation", "o.method", "o.route")
    operations = refer(ops, "o.requestType", "request_entity_id", "class").select(*scope, op_id.alias("id"), F.col("o.name").alias("name"), F.col("o.method").alias("method"), F.col("o.route").alias("route"), "request_entity_id", "o.location")
    params = refer(ops.select(*scope, op_id.alias("operation_id"), F.explode("o.parameters").alias("p")), "p.type", "reference_id", "class")
    parameters = params.select(*scope, discovery_id("parameter", "operation_id", "p.location", "p.name").alias("id"), "operation_id", F.col("p.name").alias("name"), F.col("p.location").alias("location"), "p.required", clr_kind("p.type").alias("kind"), "reference_id")
    gives = refer(ops.select(*scope, op_id.alias("operation_id"), F.explode("o.responses").alias("r")), "r.type", "entity_id", "class")
    responses = gives.select(*scope, discovery_id("response", "operation_id", F.col("r.statusCode").cast("string")).alias("id"), "operation_id", F.col("r.statusCode").alias("status"), "entity_id")
    edge = lambda df, name, a, b: df.filter(F.col(b).isNotNull()).select(*scope, F.lit(name).alias("kind"), F.col(a).alias("source"), F.col(b).alias("target"))
    edges = edge(attributes, "CONTAINS", "entity_id", "id").unionByName(edge(entities, "INHERITS", "id", "base_entity_id")).unionByName(edge(operations, "ACCEPTS", "id", "request_entity_id")).unionByName(edge(responses, "RETURNS", "operation_id", "entity_id"))
    relationships = edges.distinct().withColumn("id", discovery_id("relationship", "kind", "source", "target"))
    spans = None
    for df in (entities, attributes, enums, operations):
        one = df.select(*scope, F.col("id").alias("subject_id"), "location.*")
        spans = one if spans is None else spans.unionByName(one)
    source = discovery_id("source", F.lit("roslyn"), "path")
    lineage = spans.select(*scope, discovery_id("lineage", source, "subject_id").alias("id"), source.alias("source_id"), "subject_id", "path", F.col("startLine").alias("start_line"), F.col("endLine").alias("end_line"))
    sources = each("sources", "s").select(*scope, discovery_id("source", F.lit("roslyn"), "s.path").alias("id"), "s.path", "s.sha256")
    diagnostics = each("diagnostics", "d").select(*scope, discovery_id("diagnostic", "d.code", "d.message").alias("id"), "d.severity", "d.code", "d.message")
    out = {"sources": sources, "operations": operations, "parameters": parameters, "responses": responses, "entities": entities, "attributes": attributes, "enums": enums, "validations": validations, "relationships": relationships, "lineage": lineage, "diagnostics": diagnostics}
    return {name: _once(df) for name, df in out.items()}


def type_closure(types: DataFrame, roots: DataFrame) -> DataFrame:
    """(region, system, full_name, depth): the types that ``roots`` (region, system, full_name) lead to over bases and property types, themselves included.

    types (region, system, full_name, base, properties): properties holds the names of types, of elements where they are collections. Only types of
    the same system count.
    """
    scope = ["region", "system"]
    known = types.select(*scope, "full_name")
    steps = types.select(*scope, "full_name", F.explode(F.array_distinct(F.concat(F.array("base"), F.coalesce("properties", F.array().cast("array<string>"))))).alias("to")).filter("`to` is not null")
    steps = steps.join(known.withColumnRenamed("full_name", "to"), [*scope, "to"], "left_semi")
    node = lambda c: F.to_json(F.struct(*scope, F.col(c).alias("full_name")))
    start = roots.join(known, [*scope, "full_name"], "left_semi").select(F.lit("types").alias("root"), node("full_name").alias("node")).distinct()
    found = closure(start, steps.select(node("full_name").alias("source"), node("to").alias("target")))
    return found.select(F.from_json("node", "region string, system string, full_name string").alias("t"), "depth").select("t.*", "depth")


def flow_edges(operations: DataFrame, flows: DataFrame, entities: DataFrame) -> DataFrame:
    """(region, system, kind, source, target): what the trail from a command to its backends links: models mapped on models, operations to related models.

    operations (region, system, id, request_type, response_types), flows (region, system, operation_id, mappings, related): mappings are
    (from, to) type names, related ones (type, role); entities (region, system, full_name, id). Types that aren't entities link nothing;
    nor do related ones that the operation's own contract names.
    """
    scope = ["region", "system"]
    of = lambda c, alias: entities.select(*scope, F.col("full_name").alias(c), F.col("id").alias(alias))
    maps = flows.select(*scope, F.explode("mappings").alias("m")).select(*scope, F.col("m.from").alias("_a"), F.col("m.to").alias("_b"))
    maps = maps.join(of("_a", "source"), [*scope, "_a"]).join(of("_b", "target"), [*scope, "_b"]).select(*scope, F.lit("MAPS_TO").alias("kind"), "source", "target")
    related = flows.select(*scope, "operation_id", F.explode("related").alias("r")).select(*scope, "operation_id", F.col("r.type").alias("_t"))
    empty = F.array().cast("array<string>")
    own = operations.select(*scope, F.col("id").alias("operation_id"), F.explode(F.concat(F.array("request_type"), F.coalesce("response_types", empty))).alias("_t"))
    related = related.join(own.distinct(), [*scope, "operation_id", "_t"], "left_anti").join(of("_t", "target"), [*scope, "_t"])
    return maps.unionByName(related.select(*scope, F.lit("REFERENCES").alias("kind"), F.col("operation_id").alias("source"), "target")).distinct()


def merge_config(sources: DataFrame, diagnostics: DataFrame, config_sources: DataFrame, config_diagnostics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A model's sources and diagnostics with those of configuration files, ids once; the model's own count."""
    def both(own: DataFrame, more: DataFrame) -> DataFrame:
        return own.unionByName(more.select(*own.columns).join(own.select("id").distinct(), "id", "left_anti").dropDuplicates(["id"]))

    return both(sources, config_sources), both(diagnostics, config_diagnostics)


def summary(model: dict[str, DataFrame]) -> DataFrame:
    """(region, system, operations, entities, enums, relationships, diagnostics): how many of each."""
    rows = None
    for name in ("operations", "entities", "enums", "relationships", "diagnostics"):
        one = model[name].select("region", "system", F.lit(name).alias("what"))
        rows = one if rows is None else rows.unionByName(one)
    counts = [F.count_if(F.col("what") == n).alias(n) for n in ("operations", "entities", "enums", "relationships", "diagnostics")]
    return rows.groupBy("region", "system").agg(*counts)


def match_operations(code: DataFrame, spec: DataFrame) -> DataFrame:
    """(region, system, spec_id, code_id, how) of operations (region, system, id, method, route)."""
    keyed = lambda df: df.select("region", "system", "id", "method", "route").withColumn("key", plain_route("route")).withColumn("segments", route_segments("route"))
    return claim_routes(keyed(spec), keyed(code), ["region", "system"])


def match_entities(code: dict[str, DataFrame], spec: dict[str, DataFrame], operations: DataFrame) -> DataFrame:
    """(spec_id, code_id): entities of a description with those of the code they mean.

    Matched operations pair what they take and what they return under one status; pairs of different names count if their
    attributes overlap by half, and pair what their attributes refer to. All other entities pair by name.
    """
    hit = operations.filter("code_id is not null").select("spec_id", "code_id")
    request = lambda t, side: t["operations"].select(F.col("id").alias(f"{side}_id"), F.col("request_entity_id").alias(f"{side}_entity"))
    answer = lambda t, side: t["responses"].select(F.col("operation_id").alias(f"{side}_id"), "status", F.col("entity_id").alias(f"{side}_entity"))
    asked = hit.join(request(spec, "spec"), "spec_id").join(request(code, "code"), "code_id")
    given = hit.join(answer(spec, "spec"), "spec_id").join(answer(code, "code"), ["code_id", "status"])
    pick = [F.col("spec_entity").alias("left_id"), F.col("code_entity").alias("right_id")]
    seeds = asked.select(*pick).unionByName(given.select(*pick))
    facts = lambda t: t["entities"].select("id", compact_name("name").alias("name_key")).join(t["attributes"].select(F.col("entity_id").alias("id"), compact_name("name").alias("attribute_key"), "reference_id"), "id", "left")
    found = propagate_pairs(seeds, facts(spec), facts(code)).select(F.col("left_id").alias("spec_id"), F.col("right_id").alias("code_id"), F.lit(1).alias("first"))
    named = lambda t, side: t["entities"].select(F.col("id").alias(f"{side}_id"), compact_name("name").alias("k"))
    by_name = named(spec, "spec").join(keep_last(named(code, "code"), ["k"], "code_id"), "k").select("spec_id", "code_id", F.lit(0).alias("first"))
    return keep_last(found.unionByName(by_name), ["spec_id"], "first", "code_id").select("spec_id", "code_id")


def reconcile_models(code: dict[str, DataFrame], spec: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two observations of one system merged: operations, entities, attributes, enums, diagnostics and the id map (old, new).

    What both have keeps the code's values and gets the union of evidence; what only the description has is
    added. Differences become diagnostics, rows of (code, subject_id). Tables as from_extraction() makes them, with evidence lists.
    """
    operations = cut(match_operations(code["operations"], spec["operations"]))
    entities = cut(match_entities(code, spec, operations))
    out: dict[str, DataFrame] = {}
    own = lambda t, name, key: t[name].select("id", key.alias("k"), "evidence_ids", *[c for c in ("entity_id", "kind", "required", "collection", "values") if c in t[name].columns])
    at = spec["attributes"].join(entities.select(F.col("spec_id").alias("entity_id"), F.col("code_id").alias("_c")), "entity_id")
    at = at.select(F.col("id").alias("spec_id"), F.col("_c").alias("entity_id"), compact_name("name").alias("k"), *[F.col(c).alias(f"s_{c}") for c in ("kind", "required", "collection")])
    mine = keep_last(own(code, "attributes", compact_name("name")), ["entity_id", "k"], "id")
    pairs = cut(at.join(mine, ["entity_id", "k"]))
    enums = keep_last(own(code, "enums", compact_name("name")), ["k"], "id").join(own(spec, "enums", compact_name("name")).select("k", F.col("id").alias("spec_id"), F.col("values").alias("s_values")), "k")
    remap = entities.select(F.col("spec_id").alias("old"), F.col("code_id").alias("new"))
    remap = remap.unionByName(pairs.select(F.col("spec_id").alias("old"), F.col("id").alias("new"))).unionByName(enums.select(F.col("spec_id").alias("old"), F.col("id").alias("new"))).unionByName(operations.filter("code_id is not null").select(F.col("spec_id").alias("old"), F.col("code_id").alias("new")))
    remap = cut(remap)
    for name in ("operations", "entities", "attributes", "enums"):
        more = spec[name].select(F.col("id").alias("old"), F.col("evidence_ids").alias("_e")).join(remap, "old").groupBy(F.col("new").alias("id")).agg(F.flatten(F.collect_list("_e")).alias("_e"))
        kept = code[name].join(more, "id", "left").withColumn("evidence_ids", merge_lists("evidence_ids", "_e")).drop("_e")
        new = spec[name].join(remap.select(F.col("old").alias("id")), "id", "left_anti")
        out[name] = kept.unionByName(new, allowMissingColumns=True)
    differ = ~(F.col("kind").eqNullSafe(F.col("s_kind")) & F.col("required").eqNullSafe(F.col("s_required")) & F.col("collection").eqNullSafe(F.col("s_collection")))
    note = lambda df, name, c: df.select(F.lit(name).alias("code"), F.col(c).alias("subject_id"))
    found = note(pairs.filter(differ), "RECONCILE_ATTRIBUTE", "id")
    found = found.unionByName(note(enums.filter(F.array_sort(F.array_distinct("values")) != F.array_sort(F.array_distinct("s_values"))), "RECONCILE_ENUM", "id"))
    names = {"suffix": "RECONCILE_ROUTE_PREFIX", "ambiguous": "RECONCILE_ROUTE_AMBIGUOUS"}
    for how, name in names.items():
        found = found.unionByName(note(operations.filter(F.col("how") == how), name, "code_id" if how == "suffix" else "spec_id"))
    found = found.unionByName(note(operations.filter("code_id is null"), "RECONCILE_SPEC_ONLY", "spec_id"))
    lonely = code["operations"].join(operations.select(F.col("code_id").alias("id")), "id", "left_anti")
    out["diagnostics"] = found.unionByName(note(lonely, "RECONCILE_CODE_ONLY", "id")).distinct()
    out["remap"] = remap
    return out


def merge_models(models: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Models of one system as one: ids once, edges with all their evidence where they carry it."""
    out = {}
    for name in models[0]:
        rows = None
        for i, m in enumerate(models):
            one = m[name].withColumn("_at", F.struct(F.lit(i).alias("m"), F.col("id")))
            rows = one if rows is None else rows.unionByName(one)
        out[name] = merge_edges(rows.drop("_at")) if name == "relationships" and "evidence" in rows.columns else unique_by_id(rows, "id", "_at").drop("_at")
    return out
