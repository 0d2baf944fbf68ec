import json

from specweave.operators import quality
from specweave.sources import discovery_document as dd

DOC = {
    "contractVersion": "1.0", "run": {"id": "r", "status": "complete", "toolVersion": "1"}, "region": "eu", "system": "quotes",
    "sources": [{"id": "source-1", "kind": "openapi", "path": "a.yaml", "sha256": "0"}],
    "operations": [{"id": "operation-1", "name": "get", "method": "GET", "route": "/q", "parameters": [{"id": "p1", "name": "id", "location": "path", "required": True, "type": {"kind": "uuid", "name": "Guid", "nullable": False, "collection": False}}], "requestEntityId": None, "responses": [{"id": "x1", "statusCode": 200, "entityId": "entity-1"}], "evidenceIds": ["e1"]}],
    "entities": [{"id": "entity-1", "name": "Quote", "originalName": "Quote", "attributes": [{"id": "a1", "name": "id", "originalName": "Id", "type": {"kind": "uuid", "name": "Guid", "nullable": False, "collection": False}, "required": True, "evidenceIds": []}], "baseEntityId": "entity-9", "evidenceIds": []}],
    "enums": [{"id": "enum-1", "name": "K", "values": [{"name": "A", "value": 1}, {"name": "B", "value": "b"}], "evidenceIds": []}],
    "validations": [{"id": "v1", "targetId": "a1", "rule": "Range", "arguments": {"values": [1, 2]}, "evidenceIds": []}], "relationships": [], "evidence": [{"id": "e1", "sourceId": "source-1", "subjectId": "operation-1", "observedValue": {"method": "GET"}}],
    "lineage": [{"id": "l1", "sourceId": "source-1", "subjectId": "operation-1", "path": "a.yaml", "startLine": 5, "endLine": 3}, {"id": "l2", "sourceId": "source-1", "subjectId": "a1", "path": "a.yaml", "pointer": "/x"}], "diagnostics": [],
    "summary": {"operationCount": 1, "entityCount": 2, "enumCount": 1, "relationshipCount": 0, "diagnosticCount": 0},
}


def test_documents_as_tables(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(DOC))
    (tmp_path / "old.json").write_text(json.dumps(DOC | {"contractVersion": "0.9"}))
    (tmp_path / "bad.json").write_text("{")
    docs = dd.read(spark, str(tmp_path)).cache()
    assert docs.count() == 1
    m = dd.tables(docs)
    assert (m["attributes"].first().kind, m["attributes"].first().entity_id, m["parameters"].first().operation_id) == ("uuid", "entity-1", "operation-1")
    assert [v.value for v in m["enums"].first().asDict()["values"]] == ["1", "b"] and json.loads(m["evidence"].first().observed_value) == {"method": "GET"}
    keyed = {name: (df, "id") for name, df in m.items()}
    found = {r.name: r.violations for r in quality.model_violations(keyed, dd.REFERENCES).collect()}
    assert found["entities.base_entity_id in entities"] == 1 and found["responses.entity_id in entities"] == 0 and found["unique operations.id"] == 0
    assert [(r.what, r.stated, r.found) for r in dd.summary_errors(docs).collect()] == [("entities", 2, 1)]
    assert [r.id for r in dd.span_errors(docs).collect()] == ["l1"]
    again = json.loads(dd.documents(m).first().document)
    assert again["entities"][0]["attributes"][0]["name"] == "id" and again["operations"][0]["responses"][0]["status_code"] == 200
