"""OpenAPI documents as normalised tables: operations, parameters, responses, entities, attributes, enums, validations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.functions.ids import discovery_id
from specweave.functions.text import openapi_kind

MOST_BYTES = 10_000_000
METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
# Schema keywords that are constraints.
CONSTRAINTS = (
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "minItems", "maxItems",
    "uniqueItems", "minProperties", "maxProperties", "additionalProperties", "readOnly", "writeOnly", "deprecated", "default", "const",
)

FACTS = "document string, fact string, owner string, name string, at string, detail string, required boolean, position int, pointer string"


def load(text: str) -> dict:
    """A document from JSON, or from YAML where a YAML reader is installed; ValueError for anything but OpenAPI 3."""
    if len(text.encode()) > MOST_BYTES:
        raise ValueError("document too large")
    try:
        doc = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("not JSON, and no YAML reader is installed") from e
        try:
            doc = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError("neither JSON nor YAML") from e
    if not isinstance(doc, dict) or not str(doc.get("openapi", "")).startswith("3."):
        raise ValueError("no OpenAPI 3 document")
    return doc


def resolve(doc: dict, node, seen: tuple = ()):
    """(node behind local references, name of the schema it came from, problem)."""
    name = None
    while isinstance(node, dict) and "$ref" in node:
        ref = str(node["$ref"])
        if not ref.startswith("#/"):
            return {}, None, f"external reference {ref}"
        if ref in seen:
            return {}, None, f"reference cycle {ref}"
        seen = (*seen, ref)
        target = doc
        for part in ref[2:].split("/"):
            part = part.replace("~1", "/").replace("~0", "~")
            if not isinstance(target, dict) or part not in target:
                return {}, None, f"broken reference {ref}"
            target = target[part]
        name, node = part, target
    return node if isinstance(node, dict) else {}, name, None


def flattened(doc: dict, node: dict, standard: bool = False, seen: tuple = ()) -> tuple[dict, list[str], list[str]]:
    """Properties and required names of a schema with those of its allOf parts; problems on the way.

    Later parts win over earlier ones; the schema's own properties win over all parts, but in a reference standard
    the parts win over them.
    """
    own = dict(node.get("properties") or {})
    properties, required, problems = dict(own) if standard else {}, list(node.get("required") or []), []
    for part in node.get("allOf") or []:
        ref = part.get("$ref") if isinstance(part, dict) else None
        if ref in seen and ref is not None:
            problems.append(f"reference cycle {ref}")
            continue
        inner, _, problem = resolve(doc, part)
        if problem:
            problems.append(problem)
            continue
        p, r, more = flattened(doc, inner, standard, (*seen, ref) if ref else seen)
        properties, required, problems = properties | p, required + r, problems + more
    return properties if standard else properties | own, required, problems


def comments(node: dict) -> list[str]:
    """What a node says in its comment, note and further description members, by name, each text once; then its external documentation."""
    said, tidy = [], lambda v: " ".join(str(v).split()) if v is not None else ""
    description = tidy(node.get("description"))
    for key in sorted(node):
        if key in ("description", "externalDocs") or not any(word in key.casefold() for word in ("comment", "note", "description")):
            continue
        value = node[key]
        if isinstance(value, (dict, list)):
            short = len(json.dumps(value, sort_keys=True)) <= 4_000
            text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if short else ""
        else:
            text = tidy(value)
        if text and text != description and text not in said:
            said.append(text)
    if isinstance(outside := node.get("externalDocs"), dict):
        if parts := [p for p in (tidy(outside.get("description")), tidy(outside.get("url"))) if p]:
            said.append("External documentation: " + " — ".join(parts))
    return said


def media_of(content, standard: bool) -> list[tuple[str, dict]]:
    """The media types whose schemas count: JSON, or in a reference standard all of them by name."""
    content = content if isinstance(content, dict) else {}
    names = sorted(content) if standard else [n for n in ("application/json",) if n in content]
    return [(n, content[n] if isinstance(content[n], dict) else {}) for n in names]


def facts(document: str, text: str, standard: bool = False) -> list[tuple]:
    """What one document says, a row for each fact; a document that can't be read is one diagnostic.

    Of a reference standard (standard) every media type counts, parts win over own properties, and comments are facts;
    of an application's description JSON bodies and numeric statuses count.
    """
    out: list[tuple] = []
    add = lambda fact, owner, name, at="", detail=None, required=None, position=0, pointer="": out.append((document, fact, owner, name, at, None if detail is None else json.dumps(detail, sort_keys=True), required, position, pointer))
    try:
        doc = load(text)
    except ValueError as e:
        add("diagnostic", "", "UNREADABLE", detail=str(e))
        return out

    def schema_of(node, owner: str, label: str, pointer: str) -> dict:
        """The type of a schema as a struct; inline objects become entities named after their place."""
        inner, name, problem = resolve(doc, node)
        if problem:
            add("diagnostic", owner, "REFERENCE", detail=problem, pointer=pointer)
        if inner.get("type") == "array" or "items" in inner:
            return schema_of(inner.get("items") or {}, owner, label, f"{pointer}/items") | {"collection": True}
        if name is None and (inner.get("properties") or inner.get("allOf")) and label:
            name = label
            entity(name, inner, pointer)
        return {"type": inner.get("type"), "format": inner.get("format"), "reference": name, "enum": bool(inner.get("enum")), "nullable": bool(inner.get("nullable")), "collection": False}

    done: set[str] = set()

    def remarks(owner: str, name: str, node: dict, pointer: str) -> None:
        for i, said in enumerate(comments(node) if standard else []):
            add("comment", owner, name, detail=said, position=i, pointer=pointer)

    def entity(name: str, node: dict, pointer: str) -> None:
        if name in done:
            return
        done.add(name)
        if node.get("enum"):
            for i, value in enumerate(node["enum"]):
                add("enum", name, str(value), detail=value, position=i, pointer=pointer)
            return
        properties, required, problems = flattened(doc, node, standard)
        add("entity", "", name, detail=node.get("description"), pointer=pointer)
        remarks("", name, node, pointer)
        for problem in dict.fromkeys(problems):
            add("diagnostic", name, "REFERENCE", detail=problem, pointer=pointer)
        for i, (key, value) in enumerate(properties.items()):
            where = f"{pointer}/properties/{key.replace('~', '~0').replace('/', '~1')}"
            value = value if isinstance(value, dict) else {}
            add("attribute", name, key, detail=schema_of(value, name, f"{name}.{key}", where), required=key in required, position=i, pointer=where)
            inner, _, _ = resolve(doc, value)
            remarks(name, key, inner, where)
            for keyword in (*CONSTRAINTS, "example"):
                if keyword in inner and len(json.dumps(inner[keyword])) <= 4_000:
                    add("validation", name, key, at=keyword, detail=inner[keyword], pointer=where)
            if inner.get("enum"):
                add("validation", name, key, at="allowedValues", detail=inner["enum"], pointer=where)

    for name, node in ((doc.get("components") or {}).get("schemas") or {}).items():
        inner, _, _ = resolve(doc, node)
        entity(name, inner, f"/components/schemas/{name}")
    for route, item in (doc.get("paths") or {}).items():
        item = item if isinstance(item, dict) else {}
        for method in METHODS:
            if not isinstance(op := item.get(method), dict):
                continue
            owner, where = f"{method.upper()} {route}", f"/paths/{route.replace('~', '~0').replace('/', '~1')}/{method}"
            add("operation", route, op.get("operationId") or owner, at=method.upper(), detail={"summary": op.get("summary"), "description": op.get("description"), "tags": op.get("tags") or []}, pointer=where)
            remarks(owner, owner, op, where)
            merged = {}
            for p in [*(item.get("parameters") or []), *(op.get("parameters") or [])]:
                p, _, _ = resolve(doc, p)
                if p.get("name"):
                    merged[p.get("in"), p["name"]] = p
            for i, ((place, name), p) in enumerate(merged.items()):
                add("parameter", owner, name, at=place or "", detail=schema_of(p.get("schema") or {}, owner, "", where), required=bool(p.get("required")) or place == "path", position=i, pointer=where)
            body, _, _ = resolve(doc, op.get("requestBody") or {})
            for kind, media in media_of(body.get("content"), standard):
                add("request", owner, "body", at=kind, detail=schema_of(media.get("schema") or {}, owner, f"{op.get('operationId') or owner}.request", where), required=bool(body.get("required")), pointer=where)
            for i, (status, r) in enumerate((op.get("responses") or {}).items()):
                if not (standard or str(status).isdigit()):
                    continue
                r, _, _ = resolve(doc, r)
                for kind, media in media_of(r.get("content"), standard) or [("", None)]:
                    detail = None if media is None else schema_of(media.get("schema") or {}, owner, f"{op.get('operationId') or owner}.{status}", where)
                    add("response", owner, str(status), at=kind, detail=detail, position=i, pointer=where)
    return out


def scan(documents: DataFrame, standard: bool = False) -> DataFrame:
    """All facts of ``documents`` (document, text), or of reference standards. References and allOf are trees within a document, so each is one Python call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        for batch in batches:
            for d, t in zip(batch["document"], batch["text"], strict=True):
                yield pd.DataFrame(facts(d, t or "", standard), columns=names).astype({"required": "object"})

    return documents.select("document", "text").mapInPandas(run, FACTS)


def tables(found: DataFrame) -> dict[str, DataFrame]:
    """The facts of scan() as tables with identities."""
    of = lambda fact: found.filter(F.col("fact") == fact)
    kind = F.from_json("detail", "type string, format string, reference string, enum boolean, nullable boolean, collection boolean")
    typed = lambda df: df.withColumn("t", kind).withColumn("kind", openapi_kind("t.type", "t.format", F.col("t.enum")))
    entity = lambda name: discovery_id("entity", "document", name)
    return {
        "operations": of("operation").select(discovery_id("operation", "document", "at", "owner").alias("id"), "document", F.col("at").alias("method"), F.col("owner").alias("route"), "name", F.get_json_object("detail", "$.summary").alias("summary"), "pointer"),
        "parameters": typed(of("parameter")).select("document", "owner", "name", F.col("at").alias("location"), "required", "kind", "t.collection", "position"),
        "requests": typed(of("request")).select("document", "owner", F.col("at").alias("media"), F.col("t.reference").alias("entity"), "required"),
        "responses": typed(of("response")).select("document", "owner", F.col("name").alias("status"), F.col("at").alias("media"), F.col("t.reference").alias("entity"), "t.collection"),
        "entities": of("entity").select(entity("name").alias("id"), "document", "name", F.try_variant_get(F.try_parse_json("detail"), "$", "string").alias("description"), "pointer"),
        "attributes": typed(of("attribute")).select(discovery_id("attribute", "document", "owner", "name").alias("id"), entity("owner").alias("entity_id"), "document", "owner", "name", "kind", F.col("t.reference").alias("reference"), "t.nullable", "t.collection", "required", "position", "pointer"),
        "enums": of("enum").select("document", F.col("owner").alias("name"), F.col("name").alias("value"), "position"),
        "validations": of("validation").select("document", "owner", "name", F.col("at").alias("rule"), F.try_parse_json("detail").alias("argument")),
        "comments": of("comment").select("document", "owner", "name", "position", F.try_variant_get(F.try_parse_json("detail"), "$", "string").alias("text")),
        "diagnostics": of("diagnostic").select("document", "owner", F.col("name").alias("code"), F.col("detail").alias("message"), "pointer"),
    }


def schema_names(documents: DataFrame) -> DataFrame:
    """(document, names): the schemas a JSON document declares, in order; empty on any error. Stays in the JVM."""
    keys = F.json_object_keys(F.get_json_object("text", "$.components.schemas"))
    return documents.select("document", F.sort_array(F.coalesce(keys, F.array().cast("array<string>"))).alias("names"))


def summaries(documents: DataFrame) -> DataFrame:
    """(document, paths, schemas, error): how much a JSON document declares, or why it isn't taken: too large, or no OpenAPI 3. Stays in the JVM."""
    n = lambda path: F.coalesce(F.size(F.json_object_keys(F.get_json_object("text", path))), F.lit(0))
    fine = F.coalesce(F.get_json_object("text", "$.openapi").startswith("3."), F.lit(False))
    error = F.when(F.octet_length("text") > MOST_BYTES, "document too large").when(F.try_parse_json("text").isNull(), "no JSON").when(~fine, "no OpenAPI 3 document")
    return documents.select("document", F.when(error.isNull(), n("$.paths")).alias("paths"), F.when(error.isNull(), n("$.components.schemas")).alias("schemas"), error.alias("error"))


def artifacts(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The readable artifacts of reference standards (tables() of their facts) by name, none of which shows an identity: endpoints, models, relationships, rules and lineage."""
    listed = lambda df, by, cols, name: df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    owner = F.concat_ws(" ", "method", "route")
    ops = found["operations"].withColumn("owner", owner)
    ops = ops.join(listed(found["requests"], ["document", "owner"], ["media", "entity", "required"], "requests"), ["document", "owner"], "left")
    ops = ops.join(listed(found["responses"], ["document", "owner"], ["status", "media", "entity", "collection"], "responses"), ["document", "owner"], "left")
    said = listed(found["comments"].filter("owner = ''"), ["document", "name"], ["position", "text"], "comments")
    fields = listed(found["attributes"], ["document", "owner"], ["position", "name", F.coalesce("reference", "kind").alias("type"), "collection", "required"], "fields").withColumnRenamed("owner", "name")
    models = found["entities"].join(said, ["document", "name"], "left").join(fields, ["document", "name"], "left")
    models = models.withColumn("comments", F.transform("comments", lambda c: c["text"]))
    how = F.when(F.col("collection"), "contains many").otherwise("contains")
    refers = found["attributes"].filter("reference is not null").select("document", F.col("owner").alias("from"), how.alias("relationship"), F.col("name").alias("via"), F.col("reference").alias("to"))
    rules = found["validations"].select("document", "owner", "name", "rule", F.to_json("argument").alias("argument"))
    values = found["enums"].groupBy("document", F.col("name").alias("owner")).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("position", "value"))), lambda v: v["value"])).alias("argument"))
    places = [found[t].select("document", name.alias("subject"), F.lit(kind).alias("kind"), "pointer") for t, name, kind in (("operations", owner, "endpoint"), ("entities", F.col("name"), "model"), ("attributes", F.concat_ws(".", "owner", "name"), "field"))]
    return {
        "endpoints": ops.select("document", "name", "method", "route", "summary", "requests", "responses"),
        "models": models.select("document", "name", "description", "comments", "fields"), "relationships": refers,
        "rules": rules.unionByName(values.select("document", "owner", F.lit("").alias("name"), F.lit("enum").alias("rule"), "argument")),
        "lineage": places[0].unionByName(places[1]).unionByName(places[2]),
    }


def constraints(rows: DataFrame, key: str, text: str, names=CONSTRAINTS, most: int = 4_000) -> DataFrame:
    """(key, rule, argument): the constraint keywords among the members of a JSON object column; arguments as JSON text."""
    parsed = F.from_json(text, "map<string,string>")
    each = rows.select(key, F.explode(parsed).alias("rule", "argument"))
    return each.filter(F.col("rule").isin(*names) & (F.length("argument") <= most))
