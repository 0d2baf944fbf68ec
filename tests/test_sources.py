import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from specweave.sources import config, openapi, repository

DOC = {
    "openapi": "3.0.3",
    "paths": {"/policies/{policyId}": {"parameters": [{"name": "policyId", "in": "path", "schema": {"type": "string"}}], "get": {"operationId": "getPolicy", "responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Policy"}}}}}}}},
    "components": {"schemas": {
        "Base": {"type": "object", "properties": {"id": {"type": "string", "format": "uuid"}}, "required": ["id"]},
        "Policy": {"allOf": [{"$ref": "#/components/schemas/Base"}], "properties": {"insured": {"type": "object", "properties": {"name": {"type": "string", "maxLength": 80}}}, "tags": {"type": "array", "items": {"type": "string"}}, "kind": {"$ref": "#/components/schemas/Kind"}}},
        "Kind": {"type": "string", "enum": ["A", "B"]},
        "Loop": {"allOf": [{"$ref": "#/components/schemas/Loop"}]},
        "Broken": {"properties": {"x": {"$ref": "#/nowhere"}}},
    }},
}


def test_openapi_tables(spark):
    docs = spark.createDataFrame([("d1", json.dumps(DOC)), ("d2", "not: [json"), ("d3", None), ("d4", "{}")], "document string, text string")
    t = openapi.tables(openapi.scan(docs).cache())
    assert [(r.method, r.route, r.name) for r in t["operations"].collect()] == [("GET", "/policies/{policyId}", "getPolicy")]
    assert sorted(r.name for r in t["entities"].collect()) == ["Base", "Broken", "Loop", "Policy", "Policy.insured"]
    attributes = {(r.owner, r.name): r for r in t["attributes"].collect()}
    assert attributes["Policy", "id"].kind == "uuid" and attributes["Policy", "id"].required
    assert attributes["Policy", "tags"].collection and attributes["Policy", "kind"].kind == "enum" and attributes["Policy", "insured"].reference == "Policy.insured"
    assert [(r.name, r.value) for r in t["enums"].orderBy("position").collect()] == [("Kind", "A"), ("Kind", "B")]
    assert ("name", "maxLength") in [(r.name, r.rule) for r in t["validations"].collect()]
    assert t["parameters"].first().required and t["responses"].first().entity == "Policy"
    bad = [(r.document, r.code) for r in t["diagnostics"].collect()]
    assert {d for d, _ in bad} == {"d1", "d2", "d3", "d4"}
    assert openapi.schema_names(docs).filter("document = 'd1'").first().names == ["Base", "Broken", "Kind", "Loop", "Policy"]


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_archives(spark):
    good = archive(**{"src__A.csproj": "x", "src__host.json": "{}", "src__QuoteController.cs": "c", "App.sln": "s"})
    bad = archive(**{"..__evil.cs": "x"})
    rows = repository.read_archives(spark.createDataFrame([("good", good), ("bad", bad), ("no", b"no zip")], "path string, content binary")).cache()
    one = repository.inventory(rows).filter("archive = 'good'").first()
    assert (one.solutions, one.projects, one.controllers, one.function_projects) == (["App.sln"], ["src/A.csproj"], ["src/QuoteController.cs"], ["src/A.csproj"])
    assert {r.archive for r in rows.filter("error is not null").collect()} == {"bad", "no"}
    with pytest.raises(ValueError):
        list(repository.zip_members(bad))


def test_scan_of_a_tree(spark, tmp_path):
    for name, data in {"a/x.cs": b"class X {}\nvar password = 1;", "a/bin/y.cs": b"no", "a/z.g.cs": b"no", "b/secrets.json": b"{}", "b/bad.json": b"\xff\xfe\xfa", "b/big.cs": b"x" * 100, "c.exe": b"x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (tmp_path / "outside").mkdir()
    (tmp_path / "a" / "link.cs").symlink_to(tmp_path / "a" / "x.cs")
    (tmp_path / "linked").symlink_to(tmp_path / "a", target_is_directory=True)
    files, gaps = repository.scan(spark, str(tmp_path), most_bytes=50)
    assert [(r.path, r.text.split("\n")[1]) for r in files.collect()] == [("a/x.cs", "// [REDACTED secret-bearing line]")]
    assert sorted((r.path, r.reason) for r in gaps.collect()) == [("b/bad.json", "not UTF-8"), ("b/big.cs", "file too large")]


def test_config_facts(spark):
    df = spark.createDataFrame([("local.settings.json", '{"Values": {"B": "secret", "A": 1, "FUNCTIONS_WORKER_RUNTIME": "dotnet"}}'), ("host.json", '{"version": "2.0"}'), ("x.json", "{"), ("y.json", None)], "path string, text string")
    got = {r.path: r for r in config.config_facts(df).collect()}
    assert got["local.settings.json"].setting_keys == ["A", "B", "FUNCTIONS_WORKER_RUNTIME"] and got["local.settings.json"].runtime == "dotnet"
    assert got["host.json"].host_version == "2.0" and got["x.json"].code == "YAML002" and got["y.json"].code == "YAML001"


YAML = {
    "# build\ntrigger: main\npool:\n  vmImage: 'ubuntu'  # image\njobs:\n- job: A\n  steps:\n  - script: echo \"a # b\"\n    displayName: 'It''s'\n  - run: |\n      line: one\n        - two\n\n      # text\n- job: B\n": [
        ("trigger", "main"), ("pool", None), ("pool/vmImage", "ubuntu"), ("jobs", None), ("jobs/0/job", "A"), ("jobs/0/steps", None), ("jobs/0/steps/0/script", 'echo "a # b"'),
        ("jobs/0/steps/0/displayName", "It's"), ("jobs/0/steps/1/run", "|\nline: one\n- two\n\n# text"), ("jobs/1/job", "B"),
    ],
    "- a\n- b: 1\n  c: 2\n-\n  d: 3\n- - x\n  - y\n": [("0", "a"), ("1/b", "1"), ("1/c", "2"), ("2/d", "3"), ("3/0", "x"), ("3/1", "y")],
    "a: [1,\n  2]\nb: {x: 1}\n": [("a", "[1,\n2]"), ("b", "{x: 1}")], "a: \"x\n  y\"\n'c d': e\n": [("a", "x\ny"), ("c d", "e")],
    "": [], "# only\n": [], "---\na: 1\n...\n": [("a", "1")], "u: http://x/y:z\nv: a:b\n": [("u", "http://x/y:z"), ("v", "a:b")], "a: some\n  more\nb: 2\n": [("a", "some"), ("b", "2")],
    "trigger:\nname:   \n": [("trigger", None), ("name", None)], "hello\n": [("", "hello")], "a: >-\n  x\nb: c\n": [("a", ">-\nx"), ("b", "c")], "a: 1\r\nb:\r\n  c: 2\r\n": [("a", "1"), ("b", None), ("b/c", "2")],
    "x: &a\n  k: !t v\ny:\n  <<: *a\n": [("x", None), ("x/k", "v"), ("y", None), ("y/<<", "*a")], "a:\n- b\nd: e\n": [("a", None), ("a/0", "b"), ("d", "e")],
}
BROKEN = ["a: 1\n  b: 2\n", "a:\n    b: 1\n  c: 2\n", "a: [1, 2\nb: 3\n", 'a: "x\nb: 1\n', "a: 1\n- b\n", "a:\n\tb: 1\n", "a: 1\nplain\n", "a: 1\n---\nb: 2\n", "a: ]\n"]


def test_yaml_facts(spark):
    from specweave.sources import yaml_lines

    texts = spark.createDataFrame([(x,) for x in [*YAML, *BROKEN]], "text string")
    got = {r.text: r.y for r in texts.select("text", yaml_lines.parsed(F.col("text")).alias("y")).collect()}
    assert {x: [tuple(f) for f in got[x].facts] for x in YAML} == YAML and not any(got[x].wrong for x in YAML)
    assert [x for x in BROKEN if not got[x].wrong] == []
    files = spark.createDataFrame([("a/azure-pipelines.yml", next(iter(YAML))), ("b.yaml", BROKEN[0]), ("c.yml", None), ("d.yml", "a:\n  jobs: 1\n"), ("e.yml", "- jobs\n")], "path string, text string")
    facts = {r.path: (r.pipeline, r.code) for r in config.config_facts(files).collect()}
    assert facts == {"a/azure-pipelines.yml": (True, None), "b.yaml": (False, "YAML002"), "c.yml": (False, "YAML001"), "d.yml": (False, None), "e.yml": (False, None)}
    assert [r.path for r in config.pipelines(files).collect()] == ["a/azure-pipelines.yml"]
    long = "items:\n" + "".join(f"- name: n{i}\n  value: {i}\n" for i in range(1500))
    assert yaml_lines.yaml_facts(spark.createDataFrame([("l.yml", long)], "path string, text string")).count() == 3001


def test_zip_data_source(spark, tmp_path):
    p = tmp_path / "a.zip"
    p.write_bytes(archive(m__x="hello"))
    spark.dataSource.register(repository.ZipSource)
    r = spark.read.format("zipmembers").option("path", str(p)).load().first()
    assert (r.member, bytes(r.content)) == ("m/x", b"hello")


def test_incremental_scan(spark, tmp_path):
    from specweave.streaming import incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(DOC))
    incremental.follow(incremental.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("fact") == "operation").count() == 1


def test_yaml_texts_are_dealt_to_tasks_and_parsed_once(spark):
    from specweave.sources import yaml_lines

    files = spark.createDataFrame([(f"{i}.yml", f"a: {i}\nb:\n- c: '{i}'\n") for i in range(400)], "path string, text string").coalesce(1)
    for found in (yaml_lines.yaml_facts(files), config.config_facts(files)):
        assert found.rdd.getNumPartitions() > 1
        assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2  # the fold over lines and that over tokens
    assert yaml_lines.yaml_facts(files).count() == 1200
