import json

from specweave.operators import artifacts, discovery
from specweave.sources import repository

PLACE = {"path": "Models/Quote.cs", "startLine": 1, "endLine": 9}
RAW = {
    "version": "1", "sources": [{"path": "Models/Quote.cs", "sha256": "0" * 64}],
    "operations": [{"name": "GetQuote", "method": "GET", "route": "/api/v1/quotes/{id:guid}", "requestType": None, "parameters": [{"name": "id", "type": "Guid", "location": "path", "required": True}], "responses": [{"statusCode": 200, "type": "A.QuoteDto"}], "location": PLACE}],
    "types": [
        {"name": "QuoteDto", "fullName": "A.QuoteDto", "kind": "class", "baseType": "A.Base", "properties": [
            {"name": "Status", "type": "A.Status", "nullable": False, "collection": False, "elementType": None, "attributes": [{"name": "Required", "arguments": []}], "location": PLACE},
            {"name": "Lines", "type": "List<A.Base>", "nullable": True, "collection": True, "elementType": "A.Base", "attributes": [], "location": PLACE}], "enumValues": [], "location": PLACE},
        {"name": "Base", "fullName": "A.Base", "kind": "class", "baseType": None, "properties": [{"name": "Id", "type": "Guid", "nullable": False, "collection": False, "elementType": None, "attributes": [], "location": PLACE}], "enumValues": [], "location": PLACE},
        {"name": "Status", "fullName": "A.Status", "kind": "enum", "baseType": None, "properties": [], "enumValues": ["Open", "Closed"], "location": PLACE}],
    "diagnostics": [],
}


def test_extraction_to_tables(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(RAW))
    raw = repository.sidecar(spark, str(tmp_path)).selectExpr("'eu' as region", "'quotes' as system", "*")
    m = discovery.from_extraction(raw)
    one = discovery.summary(m).first()
    assert (one.operations, one.entities, one.enums, one.relationships) == (1, 2, 1, 5)
    attributes = {r.name: r for r in m["attributes"].collect()}
    assert (attributes["status"].kind, attributes["lines"].kind, attributes["id"].kind, attributes["lines"].required) == ("enum", "object", "uuid", False)
    assert sorted(r.kind for r in m["relationships"].collect()) == ["CONTAINS", "CONTAINS", "CONTAINS", "INHERITS", "RETURNS"]
    assert m["validations"].first().rule == "Required" and m["lineage"].count() == 7


def test_reconciling_two_observations(spark):
    c = spark.createDataFrame
    op, ent = "region string, system string, id string, name string, method string, route string, request_entity_id string, evidence_ids array<string>", "id string, name string, evidence_ids array<string>"
    at, en = "id string, entity_id string, name string, kind string, required boolean, collection boolean, reference_id string, evidence_ids array<string>", "id string, name string, values array<string>, evidence_ids array<string>"
    resp = "operation_id string, status int, entity_id string"
    code = {
        "operations": c([("eu", "s", "c1", "Get", "GET", "/api/quotes/{id}", None, ["e1"]), ("eu", "s", "c2", "Old", "GET", "/api/old", None, ["e1"])], op), "responses": c([("c1", 200, "E1")], resp),
        "entities": c([("E1", "QuoteModel", ["e2"]), ("E2", "AddressDto", ["e2"])], ent),
        "attributes": c([("A1", "E1", "premium", "number", True, False, None, ["e3"]), ("A2", "E1", "address", "object", True, False, "E2", ["e3"]), ("A3", "E2", "line1", "string", True, False, None, ["e3"])], at),
        "enums": c([("N1", "Kind", ["A", "B"], ["e4"])], en),
    }
    spec = {
        "operations": c([("eu", "s", "s1", "getQuote", "GET", "/quotes/{quoteId}", None, ["f1"]), ("eu", "s", "s2", "new", "POST", "/new", None, ["f1"])], op), "responses": c([("s1", 200, "S1")], resp),
        "entities": c([("S1", "QuoteResponse", ["f2"]), ("S2", "Address", ["f2"]), ("S3", "Extra", ["f2"])], ent),
        "attributes": c([("B1", "S1", "premium", "integer", True, False, None, ["f3"]), ("B2", "S1", "address", "object", True, False, "S2", ["f3"]), ("B3", "S2", "line1", "string", True, False, None, ["f3"]), ("B4", "S3", "x", "string", False, False, None, ["f3"])], at),
        "enums": c([("M1", "kind", ["A", "C"], ["f4"])], en),
    }
    out = discovery.reconcile_models(code, spec)
    assert {(r.old, r.new) for r in out["remap"].collect()} == {("S1", "E1"), ("S2", "E2"), ("B1", "A1"), ("B2", "A2"), ("B3", "A3"), ("M1", "N1"), ("s1", "c1")}
    assert {(r.code, r.subject_id) for r in out["diagnostics"].collect()} == {("RECONCILE_ATTRIBUTE", "A1"), ("RECONCILE_ENUM", "N1"), ("RECONCILE_ROUTE_PREFIX", "c1"), ("RECONCILE_SPEC_ONLY", "s2"), ("RECONCILE_CODE_ONLY", "c2")}
    assert {r.id: r.evidence_ids for r in out["entities"].collect()} == {"E1": ["e2", "f2"], "E2": ["e2", "f2"], "S3": ["f2"]}
    assert sorted(r.id for r in out["operations"].collect()) == ["c1", "c2", "s2"] and out["attributes"].count() == 4


def test_artifacts_show_names_only(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(RAW))
    m = discovery.from_extraction(repository.sidecar(spark, str(tmp_path)).selectExpr("'eu' as region", "'quotes' as system", "*"))
    shown = artifacts.artifacts(m)
    graph = {r.relationship for r in shown["relationship-graph"].collect()}
    assert "QuoteDto inherits Base" in graph and "GetQuote returns QuoteDto" in graph and "QuoteDto contains QuoteDto.status" in graph
    model = {r.name: r for r in shown["data-model"].collect()}
    assert model["QuoteDto"].inherits_from == "Base" and [(f.name, f.type) for f in model["QuoteDto"].fields] == [("status", "Status"), ("lines", "Base")]
    catalog = shown["api-catalog"].first()
    tree = json.loads(catalog.responses[0].model)
    assert [(x["name"], x["role"]) for x in tree["models"]] == [("QuoteDto", "Root model"), ("Base", "Related model")]
    assert {x["relationship"] for x in tree["relations"]} == {"contains many", "inherits from"}
    assert shown["lineage"].filter("location = 'Models/Quote.cs:lines 1-9'").count() == 7
    assert {r.rule for r in shown["validation-enums"].collect()} == {"Required", "enum"}
    everything = "".join(str(r) for df in shown.values() for r in df.collect())
    import re

    assert not re.search(r"(entity|attribute|operation|enum)-[0-9a-f]{20}", everything)


def test_enriched_openapi(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(RAW))
    m = discovery.from_extraction(repository.sidecar(spark, str(tmp_path)).selectExpr("'eu' as region", "'quotes' as system", "*"))
    op = m["operations"].first().id
    said = spark.createDataFrame([(op, "Read a quote", 'says "hi"', "Policy")], "operation_id string, summary string, description string, domain string")
    doc = json.loads(artifacts.enriched_openapi("t", "1", m, said).first().document)
    get = doc["paths"]["/api/v1/quotes/{id:guid}"]["get"]
    assert get["summary"] == "Read a quote" and get["tags"] == ["Policy"] and get["responses"]["200"]["description"] == "Successful response"
    quote = doc["components"]["schemas"]["QuoteDto"]
    assert quote["required"] == ["status"] and quote["properties"]["lines"]["$ref"] == "#/components/schemas/Base"
    plain = json.loads(artifacts.enriched_openapi("t", "1", m, said.limit(0)).first().document)
    assert plain["paths"]["/api/v1/quotes/{id:guid}"]["get"]["summary"] == "GetQuote"
