"""Readable artifacts of a model: names instead of identities, nested as a reader wants them, a row for each item.

Tables of a model: operations (id, name, method, route, request_entity_id), parameters (operation_id, name, location, kind, required),
responses (operation_id, status, entity_id), entities (id, name, base_entity_id), attributes (id, entity_id, name, kind, reference_id,
required, nullable, collection, position), enums (id, name, values), validations (target_id, rule, values), relationships (kind, source, target), lineage
(subject_id, source_id, path, start_line, end_line), sources (id, path), diagnostics (severity, code, message).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.functions.text import location, schema_keywords, status_class
from specweave.plans.lineage import cut

from .graph import closure
from .joins import keep_last

UNKNOWN = "Unknown"


def subjects(model: dict[str, DataFrame]) -> DataFrame:
    """(id, subject, subject_type): what each identity is called."""
    ops = model["operations"].select("id", F.col("name").alias("subject"), F.concat_ws(" ", "method", "route").alias("subject_type"))
    ents = model["entities"].select("id", F.col("name").alias("subject"), F.lit("Contract model").alias("subject_type"))
    owner = model["entities"].select(F.col("id").alias("entity_id"), F.col("name").alias("_owner"))
    attrs = model["attributes"].join(owner, "entity_id").select("id", F.concat_ws(".", "_owner", "name").alias("subject"), F.lit("Attribute").alias("subject_type"))
    enums = model["enums"].select("id", F.col("name").alias("subject"), F.lit("Enum").alias("subject_type"))
    return ops.unionByName(ents).unionByName(attrs).unionByName(enums)


def _called(df: DataFrame, column: str, names: DataFrame, subject: str, kind: str) -> DataFrame:
    n = names.select(F.col("id").alias(column), F.col("subject").alias(subject), F.col("subject_type").alias(kind))
    return df.join(n, column, "left").withColumn(subject, F.coalesce(subject, F.lit(UNKNOWN))).withColumn(kind, F.coalesce(kind, F.lit(UNKNOWN)))


def relationship_graph(model: dict[str, DataFrame]) -> DataFrame:
    """(relationship, type, from, from_type, to, to_type)."""
    names = subjects(model)
    rows = _called(_called(model["relationships"].select("kind", "source", "target"), "source", names, "from", "from_type"), "target", names, "to", "to_type")
    return rows.select(F.concat_ws(" ", "from", F.lower("kind"), "to").alias("relationship"), F.col("kind").alias("type"), "from", "from_type", "to", "to_type")


def _fields(model: dict[str, DataFrame]) -> DataFrame:
    """(entity_id, fields): the attributes of each entity in their order, types by name."""
    names = model["entities"].select(F.col("id").alias("reference_id"), F.col("name").alias("_t")).unionByName(model["enums"].select(F.col("id").alias("reference_id"), F.col("name").alias("_t")))
    a = model["attributes"].join(names, "reference_id", "left")
    field = F.struct("position", "name", F.coalesce("_t", "kind").alias("type"), "required", "nullable", "collection")
    return a.groupBy("entity_id").agg(F.sort_array(F.collect_list(field)).alias("fields"))


def data_model(model: dict[str, DataFrame]) -> DataFrame:
    """(name, inherits_from, fields): a row for each entity."""
    base = model["entities"].select(F.col("id").alias("base_entity_id"), F.col("name").alias("inherits_from"))
    rows = model["entities"].select(F.col("id").alias("entity_id"), "name", "base_entity_id").join(base, "base_entity_id", "left").join(_fields(model), "entity_id", "left")
    return rows.select("name", "inherits_from", "fields")


def model_trees(model: dict[str, DataFrame]) -> DataFrame:
    """(root_id, models, relations): of each entity that an operation takes or returns, all that belong to it.

    models are in the order of a breadth-first walk, then by name; relations say contains, contains many or inherits from.
    """
    e, a = model["entities"], model["attributes"]
    parts = a.filter("reference_id is not null").select(F.col("entity_id").alias("source"), F.col("reference_id").alias("target"), F.when(F.col("collection"), "contains many").otherwise("contains").alias("relationship"), F.col("name").alias("via"))
    bases = e.filter("base_entity_id is not null").select(F.col("id").alias("source"), F.col("base_entity_id").alias("target"), F.lit("inherits from").alias("relationship"), F.lit(None).cast("string").alias("via"))
    edges = parts.unionByName(bases).join(e.select(F.col("id").alias("target")), "target", "left_semi")
    roots = model["operations"].select(F.col("request_entity_id").alias("root")).unionByName(model["responses"].select(F.col("entity_id").alias("root"))).distinct()
    roots = roots.join(e.select(F.col("id").alias("root")), "root", "left_semi")
    reach = cut(closure(roots.select("root", F.col("root").alias("node")), edges.select("source", "target")))
    named = e.select(F.col("id").alias("node"), "name").join(_fields(model).withColumnRenamed("entity_id", "node"), "node", "left")
    role = F.when(F.col("depth") == 0, "Root model").otherwise("Related model")
    models = reach.join(named, "node").groupBy("root").agg(F.sort_array(F.collect_list(F.struct("depth", "name", role.alias("role"), "fields"))).alias("models"))
    both = lambda c, n: e.select(F.col("id").alias(c), F.col("name").alias(n))
    links = reach.select("root", F.col("node").alias("source")).join(edges, "source").join(both("source", "from"), "source").join(both("target", "to"), "target")
    relations = links.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("from", "relationship", "via", "to"))).alias("relations"))
    return models.join(relations, "root", "left").withColumnRenamed("root", "root_id")


def api_catalog(model: dict[str, DataFrame]) -> DataFrame:
    """(operation, method, route, parameters, request, responses): with the model tree of what is taken and returned."""
    trees = cut(model_trees(model))
    params = model["parameters"].groupBy(F.col("operation_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("location", "name", "required", F.col("kind").alias("type")))).alias("parameters"))
    tree = lambda key, name: trees.select(F.col("root_id").alias(key), F.to_json(F.struct("models", "relations")).alias(name))
    given = model["responses"].join(tree("entity_id", "model"), "entity_id", "left")
    answers = given.groupBy(F.col("operation_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("status", status_class("status").alias("meaning"), "model"))).alias("responses"))
    rows = model["operations"].join(params, "id", "left").join(answers, "id", "left").join(tree("request_entity_id", "request"), "request_entity_id", "left")
    return rows.select(F.col("name").alias("operation"), "method", "route", "parameters", "request", "responses")


def validations_and_enums(model: dict[str, DataFrame]) -> DataFrame:
    """(target, target_type, rule, values): rules of attributes, and the values of enums under the rule enum."""
    rules = _called(model["validations"].select("target_id", "rule", "values"), "target_id", subjects(model), "target", "target_type").select("target", "target_type", "rule", "values")
    return rules.unionByName(model["enums"].select(F.col("name").alias("target"), F.lit("Enum").alias("target_type"), F.lit("enum").alias("rule"), "values"))


def lineage(model: dict[str, DataFrame]) -> DataFrame:
    """(subject, subject_type, source, location); of several places in one source the last."""
    last = keep_last(model["lineage"], ["subject_id", "source_id"], "start_line", "end_line", "path")
    paths = model["sources"].select(F.col("id").alias("source_id"), F.col("path").alias("source"))
    rows = _called(last.join(paths, "source_id", "left"), "subject_id", subjects(model), "subject", "subject_type")
    return rows.select("subject", "subject_type", F.coalesce("source", F.lit(UNKNOWN)).alias("source"), location("path", "start_line", "end_line", F.lit(None).cast("string")).alias("location"))


def artifacts(model: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All readable artifacts by name, none of which shows an identity."""
    return {"api-catalog": api_catalog(model), "data-model": data_model(model), "relationship-graph": relationship_graph(model), "validation-enums": validations_and_enums(model), "lineage": lineage(model), "diagnostics": model["diagnostics"].select("severity", "code", "message")}


def enriched_openapi(title: str, version: str, model: dict[str, DataFrame], semantics: DataFrame) -> DataFrame:
    """One row, document: the model as OpenAPI JSON with what an analysis says of operations, where it says anything.

    semantics (operation_id, summary, description, domain). Validation rules become schema keywords.
    """
    e = model["entities"].select(F.col("id").alias("entity_id"), F.col("name").alias("entity"))
    keywords = model["validations"].select(F.col("target_id").alias("id"), F.explode(schema_keywords("rule", F.lit(None).cast("string"), "values")).alias("k", "v"))
    rules = keywords.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("k", "v"))).alias("rules"))
    ref = model["entities"].select(F.col("id").alias("reference_id"), F.col("name").alias("ref"))
    a = model["attributes"].join(e, "entity_id").join(ref, "reference_id", "left").join(rules, "id", "left")
    kind = F.when(F.col("kind").isin("uuid", "date-time", "unknown", "enum"), "string").otherwise(F.col("kind"))
    form = F.when(F.col("kind").isin("uuid", "date-time"), F.col("kind"))
    one = F.struct(F.when(F.col("ref").isNull(), kind).alias("type"), form.alias("format"), F.concat(F.lit("#/components/schemas/"), "ref").alias("$ref"), F.when(F.col("nullable"), True).alias("nullable"), "rules")
    schemas = a.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("name", one.alias("v")))).alias("properties"), F.sort_array(F.collect_set(F.when(F.col("required"), F.col("name")))).alias("required"))
    rule_map = lambda r: F.when(r.isNotNull(), F.map_from_entries(r))
    shown = F.transform("properties", lambda p: F.struct(p["name"], F.struct(p["v"]["type"].alias("type"), p["v"]["format"].alias("format"), p["v"]["$ref"].alias("$ref"), p["v"]["nullable"].alias("nullable"), rule_map(p["v"]["rules"]).alias("x-rules"))))
    schemas = schemas.select(F.to_json(F.array("entity")).alias("e"), F.to_json(F.struct(F.lit("object").alias("type"), F.map_from_entries(shown).alias("properties"), "required")).alias("schema"))
    quoted = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")  # noqa: E731 - a JSON list of one text, without its brackets
    schemas = schemas.select(F.concat(quoted("e"), F.lit(":"), "schema").alias("x")).agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("schemas"))
    s = semantics.select(F.col("operation_id").alias("id"), "summary", "description", "domain")
    codes = model["responses"].select(F.col("operation_id").alias("id"), F.col("status").cast("string").alias("status"), status_class(F.col("status").cast("int")).alias("meaning"))
    codes = codes.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("status", F.struct(F.col("meaning").alias("description")).alias("d")))).alias("responses"))
    ops = model["operations"].join(s, "id", "left").join(codes, "id", "left")
    body = F.struct(F.coalesce("summary", "name").alias("summary"), "description", F.when(F.col("domain").isNotNull(), F.array("domain")).alias("tags"), F.map_from_entries(F.coalesce("responses", F.array().cast(codes.schema["responses"].dataType))).alias("responses"))
    ops = ops.select("route", F.to_json(F.array(F.lower("method"))).alias("m"), F.to_json(body).alias("body"))
    by_route = ops.groupBy("route").agg(F.array_join(F.array_sort(F.collect_list(F.concat(quoted("m"), F.lit(":"), "body"))), ",").alias("x"))
    by_route = by_route.select(F.to_json(F.array("route")).alias("r"), "x").select(F.concat(quoted("r"), F.lit(":{"), "x", F.lit("}")).alias("path"))
    paths = by_route.agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))
    info = F.to_json(F.struct(F.lit(title).alias("title"), F.lit(version).alias("version")))
    return paths.crossJoin(schemas).select(F.concat(F.lit('{"openapi":"3.0.3","info":'), info, F.lit(',"paths":{'), "paths", F.lit('},"components":{"schemas":{'), "schemas", F.lit("}}}")).alias("document"))  # one row each
