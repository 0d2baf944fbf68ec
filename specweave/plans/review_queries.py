"""Registered queries over descriptions, retrieval contexts, reviews and approvals."""

from __future__ import annotations

import json
from http import HTTPStatus

from pyspark.sql import Window
from pyspark.sql import functions as F

from specweave.functions import similarity, text
from specweave.operators import aggregates, artifacts, catalog, discovery, enrichment, joins, publish, quality, ranking, retrieval, setops, sinks
from specweave.plans.lineage import cut
from specweave.plans.queries import _LEXICAL, _VECTORS, _by_vector, terms_sql
from specweave.plans.registry import query, t
from specweave.sources import config, openapi, repository, yaml_lines

# --- names and texts -----------------------------------------------------------------------------


@query(r"""
WITH x AS (SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN 'global::A.' || p_name || '[]?' WHEN 1 THEN 'List<' || p_brand || '?>' WHEN 2 THEN 'Dictionary<' || p_type || ', B>' WHEN 3 THEN 'N.M.' || p_name
  WHEN 4 THEN 'Map<List<A>, ' || p_brand || '>' ELSE p_type || '??' END AS x FROM part),
s AS (SELECT *, regexp_replace(trim(replace(x, 'global::', '')), '\?+$', '') AS t FROM x),
g AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(t, '<[^<>]+>$') THEN trim(split_part(regexp_extract(t, '<([^<>]+)>$', 1), ',', 1)) ELSE t END, '\[\]$', '') AS b FROM s)
SELECT p_partkey, lower(regexp_replace(list_last(string_split(b, '.')), '[^A-Za-z0-9_]', '', 'g')) AS bare,
  CASE WHEN p_size % 2 = 0 THEN 'List[' || x || ']' ELSE x END || CASE WHEN p_size % 3 = 0 THEN '?' ELSE '' END AS shown FROM g""")
def type_names(spark, sf_dir):
    c, k = F.col, F.col("p_partkey") % 6
    x = F.when(k == 0, F.concat(F.lit("global::A."), "p_name", F.lit("[]?"))).when(k == 1, F.concat(F.lit("List<"), "p_brand", F.lit("?>"))).when(k == 2, F.concat(F.lit("Dictionary<"), "p_type", F.lit(", B>")))
    x = x.when(k == 3, F.concat(F.lit("N.M."), "p_name")).when(k == 4, F.concat(F.lit("Map<List<A>, "), "p_brand", F.lit(">"))).otherwise(F.concat("p_type", F.lit("??")))
    rows = t(spark, sf_dir, "part").withColumn("x", x)
    return rows.select("p_partkey", text.bare_type("x").alias("bare"), text.display_type("x", c("p_size") % 2 == 0, c("p_size") % 3 == 0).alias("shown"))


_PHRASES = ", ".join(f"({int(s)}, '{s.phrase.replace(chr(39), chr(39) * 2)}')" for s in HTTPStatus)


@query(f"""
WITH s AS (SELECT o_orderkey, CAST(100 + o_orderkey % 500 AS INT) AS code FROM orders), p(code, phrase) AS (VALUES {_PHRASES})
SELECT o_orderkey, coalesce(phrase, 'Custom status') AS phrase, CASE WHEN s.code // 100 = 2 THEN 'Successful response' WHEN s.code // 100 = 4 THEN 'Client error response' WHEN s.code >= 500 THEN 'Server error response' ELSE 'Response' END AS class
FROM s LEFT JOIN p ON s.code = p.code""")
def status_texts(spark, sf_dir):
    code = (F.col("o_orderkey") % 500 + 100).cast("int")
    return t(spark, sf_dir, "orders").select("o_orderkey", text.status_phrase(code).alias("phrase"), text.status_class(code).alias("class"))


@query(r"""
WITH s AS (SELECT p_partkey, replace(p_type, ' ', CASE WHEN p_size % 2 = 0 THEN '_' ELSE '' END) || p_size || 'OrderService' || CASE p_size % 3 WHEN 0 THEN 'Async' WHEN 1 THEN 'Controller' ELSE '' END AS s, p_brand AS b, p_name AS n FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(s, '(Async|Controller)$', ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g')) AS words,
  array_to_string(regexp_extract_all('/x/{' || n || '}/{' || b || ':int}', '\{([^{}]+)\}', 1), '|') AS parameters,
  array_to_string(list_distinct(regexp_extract_all(s || ' via QuoteHandler, QuoteHandler', '\b([A-Za-z_][A-Za-z0-9_]*(?:Service|Repository|Handler|Client|Mediator))\b', 1)).list_sort(), '|') AS symbols,
  replace('"' || n || '"', '"', '''') AS shown FROM s""")
def symbol_texts(spark, sf_dir):
    p, n = t(spark, sf_dir, "part"), F.col("p_size")
    gap = F.when(n % 2 == 0, "_").otherwise("")
    s = F.concat(F.replace("p_type", F.lit(" "), gap), n, F.lit("OrderService"), F.when(n % 3 == 0, "Async").when(n % 3 == 1, "Controller").otherwise(""))
    route = F.concat(F.lit("/x/{"), "p_name", F.lit("}/{"), "p_brand", F.lit(":int}"))
    symbols = text.candidate_symbols(F.concat(s, F.lit(" via QuoteHandler, QuoteHandler")))
    return p.select("p_partkey", text.humanized(s).alias("words"), F.array_join(text.route_parameters(route), "|").alias("parameters"), F.array_join(F.sort_array(symbols), "|").alias("symbols"), text.mermaid_text(F.concat(F.lit('"'), "p_name", F.lit('"'))).alias("shown"))


@query("""
WITH r AS (SELECT p_partkey, p_size % 6 AS k, CAST(p_size AS VARCHAR) AS v FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'minimum=' || v WHEN 1 THEN 'maximum=9' || v || ';minimum=' || v WHEN 2 THEN 'maxLength=' || v || ';minLength=2' WHEN 3 THEN 'pattern=^' || v || '$' WHEN 4 THEN 'maxItems=' || v ELSE '' END AS keywords FROM r""")
def validation_keywords(spark, sf_dir):
    k, v = F.col("p_size") % 6, F.col("p_size").cast("string")
    rule = F.when(k == 0, "Minimum").when(k == 1, "Range").when(k == 2, "StringLength").when(k == 3, "RegularExpression").when(k == 4, "maxItems").otherwise("Other")
    values = F.when(k == 1, F.array(F.lit("typeof(int)"), v, F.concat(F.lit("9"), v))).when(k == 2, F.array(v, F.lit("MinimumLength=2"))).when(k == 3, F.array(F.concat(F.lit("^"), v, F.lit("$")))).otherwise(F.array().cast("array<string>"))
    rows = t(spark, sf_dir, "part").select("p_partkey", rule.alias("r"), F.when(k.isin(0, 4), v).alias("v"), values.alias("vs"))
    entries = F.sort_array(F.transform(F.map_entries(text.schema_keywords("r", "v", "vs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("p_partkey", F.array_join(entries, ";").alias("keywords"))


@query("""
WITH d AS (SELECT doc_id, text, 'src/' || source || chr(10) || lang || chr(10) || text AS document FROM documents)
SELECT doc_id, substr(text, 1, 1800) AS preview, length(text) > 1800 AS truncated, sha256(document) AS document, CAST(length(document) AS DOUBLE) AS x, CAST(length(document) - length(replace(document, 'e', '')) AS DOUBLE) AS y FROM d""")
def embedded_chunks(spark, sf_dir):
    """Previews, what is embedded, and vectors of a plain embedder: length, and how often the letter e occurs."""
    d = t(spark, sf_dir, "documents")
    preview, truncated = text.preview("text")
    chunks = d.select(F.col("doc_id").alias("id"), text.embedding_text(F.concat(F.lit("src/"), "source"), "lang", "text").alias("document"))
    vectors = retrieval.embedded(chunks, lambda texts: [[float(len(x)), float(x.count("e"))] for x in texts])
    rows = d.select("doc_id", preview.alias("preview"), truncated.alias("truncated")).join(vectors, F.col("doc_id") == F.col("id"))
    return rows.select("doc_id", "preview", "truncated", F.sha2(F.col("document").cast("binary"), 256).alias("document"), F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


@query("SELECT count(*) AS chunks, count(*) FILTER (lang = 'en') AS endpoint_chunks, count(*) FILTER (lang = 'de') AS entity_chunks, count(DISTINCT source) AS documents FROM documents")
def index_stats(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "endpoint").when(F.col("lang") == "de", "entity").otherwise("enum")
    return retrieval.index_stats(t(spark, sf_dir, "documents").select(kind.alias("kind"), F.col("source").alias("document")))


# --- descriptions ----------------------------------------------------------------------------------


def _nation_documents(spark, sf_dir):
    """An OpenAPI document for each nation: allOf over a base, several media types, comments, and a status that is no number."""
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    doc = {
        "openapi": "3.0.3",
        "paths": {"/n/{id}": {"parameters": [{"name": "id", "in": "path", "schema": {"type": "integer"}}], "post": {
            "operationId": "op@", "requestBody": {"content": {"application/xml": {"schema": {"$ref": "#/components/schemas/Base"}}, "application/json": {"schema": {"$ref": "#/components/schemas/Child"}}}},
            "responses": {"200": {"content": {"text/json": {"schema": {"$ref": "#/components/schemas/Base"}}, "application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/Child"}}}}}, "404": {"description": "no"}, "default": {"description": "else"}}}}},
        "components": {"schemas": {
            "Base": {"type": "object", "description": "Base of @", "$comment": "in %", "x-note": "Base of @", "properties": {"id": {"type": "string", "format": "uuid"}, "name": {"type": "string", "maxLength": 25, "pattern": "^@", "example": "@"}}, "required": ["id"]},
            "Child": {"allOf": [{"$ref": "#/components/schemas/Base"}, {"properties": {"name": {"type": "integer"}, "size": {"type": "boolean"}}}], "properties": {"size": {"type": "number"}}, "externalDocs": {"description": "more", "url": "http://%"}},
            "Lost": {"allOf": [{"$ref": "#/nowhere"}, {"$ref": "#/components/schemas/Lost"}]},
        }},
    }
    text_of = F.replace(F.replace(F.lit(json.dumps(doc)), F.lit("@"), F.trim("n_name")), F.lit("%"), F.trim("r_name"))
    return rows.select(F.trim("n_name").alias("document"), text_of.alias("text"))


_EACH = "FROM (SELECT trim(n_name) AS n, trim(r_name) AS r FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(" UNION ALL ".join(
    f"SELECT n AS document, '{s}' AS reading, '{o}' AS owner, '{a}' AS name, '{k}' AS kind, {q} AS required {_EACH}"
    for s, o, a, k, q in [(s, *x) for s in ("application", "standard") for x in (("Base", "id", "uuid", True), ("Base", "name", "string", False), ("Child", "id", "uuid", True), ("Child", "name", "integer", False))]
    + [("application", "Child", "size", "number", False), ("standard", "Child", "size", "boolean", False)]))
def openapi_attributes(spark, sf_dir):
    """What allOf makes of attributes: later parts win, then an application's own properties, or a standard's parts."""
    docs, out = _nation_documents(spark, sf_dir), None
    for reading in ("application", "standard"):
        rows = openapi.tables(openapi.scan(docs, reading == "standard"))["attributes"].select("document", F.lit(reading).alias("reading"), "owner", "name", "kind", "required")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""
SELECT n AS document, reading, part, media, entity {_EACH}, (VALUES ('application', 'request', 'application/json', 'Child'), ('application', '200', 'application/json', 'Child'), ('application', '404', '', NULL),
  ('standard', 'request', 'application/json', 'Child'), ('standard', 'request', 'application/xml', 'Base'), ('standard', '200', 'application/json', 'Child'), ('standard', '200', 'text/json', 'Base'), ('standard', '404', '', NULL), ('standard', 'default', '', NULL)) v(reading, part, media, entity)""")
def openapi_bodies(spark, sf_dir):
    docs, out = _nation_documents(spark, sf_dir), None
    for reading in ("application", "standard"):
        tables = openapi.tables(openapi.scan(docs, reading == "standard"))
        one = tables["requests"].select("document", F.lit(reading).alias("reading"), F.lit("request").alias("part"), "media", "entity")
        one = one.unionByName(tables["responses"].select("document", F.lit(reading).alias("reading"), F.col("status").alias("part"), "media", "entity"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT n AS document, 'Base' AS name, 'in ' || r AS text {_EACH} UNION ALL SELECT n, 'Child', 'External documentation: more — http://' || r {_EACH}")
def openapi_comments(spark, sf_dir):
    found = openapi.tables(openapi.scan(_nation_documents(spark, sf_dir), True))["comments"]
    return found.select("document", "name", "text")


@query(f"""
SELECT n AS document, rule, replace(argument, '@', n) AS argument {_EACH}, (VALUES ('maxLength', '25'), ('pattern', '"^@"'), ('example', '"@"')) v(rule, argument)""")
def openapi_constraints(spark, sf_dir):
    found = openapi.tables(openapi.scan(_nation_documents(spark, sf_dir)))["validations"].filter("owner = 'Base'")
    return found.select("document", "rule", F.to_json("argument").alias("argument"))


@query(f"SELECT n AS document, 'Base,Child,Lost' AS names, 2 AS problems {_EACH}")
def openapi_inventory(spark, sf_dir):
    docs = _nation_documents(spark, sf_dir)
    bad = openapi.tables(openapi.scan(docs))["diagnostics"].filter("owner = 'Lost'").groupBy("document").agg(F.count("*").alias("problems"))
    return openapi.schema_names(docs).join(bad, "document").select("document", F.array_join("names", ",").alias("names"), "problems")


@query(f"SELECT n AS document, 1 AS paths, 3 AS schemas, NULL AS error {_EACH} UNION ALL SELECT n || '-', NULL, NULL, 'no OpenAPI 3 document' {_EACH} UNION ALL SELECT n || '+', NULL, NULL, 'no JSON' {_EACH}")
def openapi_summaries(spark, sf_dir):
    docs = _nation_documents(spark, sf_dir)
    older = docs.select(F.concat("document", F.lit("-")).alias("document"), F.replace("text", F.lit('"3.0.3"'), F.lit('"2.0"')).alias("text"))
    return openapi.summaries(docs.unionByName(older).unionByName(docs.select(F.concat("document", F.lit("+")).alias("document"), F.substring("text", 1, 99).alias("text"))))


@query(f"""
SELECT n AS document, part, replace(replace(row, '@', n), '%', r) AS row {_EACH}, (VALUES ('endpoints', 'op@ POST /n/{{id}} 2 requests 4 responses'),
  ('models', 'Base|Base of @|in %|id uuid,name string'), ('models', 'Child|-|External documentation: more — http://%|size boolean,id uuid,name integer'), ('models', 'Lost|-||'),
  ('rules', 'Base.name example "@"'), ('rules', 'Base.name maxLength 25'), ('rules', 'Base.name pattern "^@"'),
  ('lineage', 'endpoint POST /n/{{id}}'), ('lineage', 'model Base'), ('lineage', 'model Child'), ('lineage', 'model Lost'), ('lineage', 'field Base.id'), ('lineage', 'field Base.name'), ('lineage', 'field Child.id'), ('lineage', 'field Child.name'), ('lineage', 'field Child.size')) v(part, row)""")
def standard_artifacts(spark, sf_dir):
    """What a reference standard is published as, a line of text for each row."""
    found = openapi.artifacts(openapi.tables(openapi.scan(_nation_documents(spark, sf_dir), True)))
    n = lambda c: F.size(F.coalesce(c, F.expr("array()"))).cast("string")
    fields = F.array_join(F.transform(F.coalesce("fields", F.array().cast(found["models"].schema["fields"].dataType)), lambda f: F.concat(f["name"], F.lit(" "), f["type"])), ",")
    shown = {
        "endpoints": F.concat_ws(" ", "name", "method", "route", n("requests"), F.lit("requests"), n("responses"), F.lit("responses")),
        "models": F.concat_ws("|", "name", F.coalesce("description", F.lit("-")), F.array_join(F.coalesce("comments", F.array().cast("array<string>")), ","), fields),
        "rules": F.concat_ws(" ", F.concat_ws(".", "owner", "name"), "rule", "argument"), "lineage": F.concat_ws(" ", "kind", "subject"),
    }
    out = None
    for part, row in shown.items():
        one = found[part].select("document", F.lit(part).alias("part"), row.alias("row"))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(found["relationships"].select("document", F.lit("relationships").alias("part"), F.col("via").alias("row")))


@query(r"""
SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN text END AS text, CASE WHEN doc_id % 5 = 0 THEN sha256('\xFF'::BLOB || encode(text)) WHEN doc_id % 7 = 0 THEN sha256(chr(65279) || text) ELSE sha256(text) END AS sha256 FROM documents""")
def decoded_files(spark, sf_dir):
    """Every fifth file is no UTF-8, every seventh of the others has a byte order mark."""
    d, k = t(spark, sf_dir, "documents"), F.col("doc_id")
    mark = F.when(k % 5 == 0, F.unhex(F.lit("FF"))).when(k % 7 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    files = d.select("doc_id", F.concat(mark, F.col("text").cast("binary")).alias("content"))
    return files.select("doc_id", repository.decoded("content").alias("text"), F.sha2("content", 256).alias("sha256"))


def _yaml_files(spark, sf_dir):
    """A configuration file for each customer; every seventh is broken, some describe builds."""
    k = F.col("c_custkey")
    head = F.concat(F.lit("# customer\nname: '"), "c_name", F.lit("'\naccount:\n  segment: "), "c_mktsegment", F.lit("  # as of today\nnations:\n- "), "c_nationkey", F.lit("\n- id: "), "c_nationkey", F.lit("\n  tags: [a, b]\n"))
    build = F.concat(F.when(k % 3 == 0, "trigger:\n").otherwise(""), F.when(k % 4 == 0, F.concat(F.lit("jobs:\n- job: \"build # "), k, F.lit("\"\n  steps:\n  - script: |\n      make all\n      make "), k, F.lit("\n"))).otherwise(""))
    text = F.concat(head, build, F.when(k % 7 == 0, "name: x\n  more: y\n").otherwise(""))
    return config.config_files(t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k, F.lit("/azure.YML")).alias("path"), text.alias("text")))


@query("""
WITH f AS (SELECT 'c' || c_custkey || '/azure.YML' AS path, c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_nationkey::VARCHAR AS n FROM customer WHERE c_custkey % 7 > 0)
SELECT path, unnest(['name', 'account', 'account/segment', 'nations', 'nations/0', 'nations/1/id', 'nations/1/tags']) AS key, unnest([name, NULL, seg, NULL, n, n, '[a, b]']) AS value FROM f
UNION ALL SELECT path, 'trigger', NULL FROM f WHERE k % 3 = 0
UNION ALL SELECT path, unnest(['jobs', 'jobs/0/job', 'jobs/0/steps', 'jobs/0/steps/0/script']), unnest([NULL, 'build # ' || k, NULL, '|' || chr(10) || 'make all' || chr(10) || 'make ' || k]) FROM f WHERE k % 4 = 0""")
def yaml_facts(spark, sf_dir):
    return yaml_lines.yaml_facts(_yaml_files(spark, sf_dir))


@query("""
SELECT 'c' || c_custkey || '/azure.YML' AS path, c_custkey % 7 > 0 AND (c_custkey % 3 = 0 OR c_custkey % 4 = 0) AS pipeline, CASE WHEN c_custkey % 7 = 0 THEN 'YAML002' END AS code FROM customer""")
def pipeline_files(spark, sf_dir):
    return config.config_facts(_yaml_files(spark, sf_dir)).select("path", "pipeline", "code")


@query("""
SELECT 's' || s_suppkey || '/host.json' AS path, '2.' || s_nationkey AS host_version, CASE WHEN s_suppkey % 3 > 0 THEN 'A,FUNCTIONS_WORKER_RUNTIME' ELSE '' END AS keys, CASE WHEN s_suppkey % 3 > 0 THEN 'dotnet' END AS runtime, NULL::VARCHAR AS code FROM supplier WHERE s_suppkey % 5 > 0
UNION ALL SELECT 's' || s_suppkey || '/host.json', NULL, '', NULL, 'YAML002' FROM supplier WHERE s_suppkey % 5 = 0""")
def config_facts(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    body = F.when(F.col("s_suppkey") % 5 == 0, "{not json").when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('{"version": "2.'), "s_nationkey", F.lit('"}')))
    body = body.otherwise(F.concat(F.lit('{"version": "2.'), "s_nationkey", F.lit('", "Values": {"FUNCTIONS_WORKER_RUNTIME": "dotnet", "A": "secret"}}')))
    path = F.explode(F.array(*[F.concat(F.lit("s"), "s_suppkey", F.lit(p)) for p in ("/host.json", "/other.json", "/bin/host.json")]))
    found = config.config_facts(config.config_files(s.select(path.alias("path"), body.alias("text"))))
    return found.select("path", "host_version", F.array_join("setting_keys", ",").alias("keys"), "runtime", "code")


@query("""
SELECT 'a' || n_nationkey AS archive, CASE WHEN n_nationkey % 4 > 0 THEN 'App.sln' END AS solutions, CASE WHEN n_nationkey % 4 > 0 THEN 'f/F.csproj,src/A.csproj' END AS projects, CASE WHEN n_nationkey % 4 > 0 THEN 'src/QuoteController.cs' END AS controllers,
  CASE WHEN n_nationkey % 4 > 0 THEN 'f/F.csproj' END AS function_projects, CASE WHEN n_nationkey % 4 > 0 THEN 'docs/openapi.json' END AS openapi, n_nationkey % 4 = 0 AS refused FROM nation""")
def archive_inventory(spark, sf_dir):
    """Archives built from the table: what good ones hold; those with a member outside their root are refused."""
    names = ("App.sln", "src/A.csproj", "src/QuoteController.cs", "f/F.csproj", "f/host.json", "docs/openapi.json")

    def pack(batches):
        import io
        import zipfile

        for batch in batches:
            data = []
            for key in batch["k"]:
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for name in names if key % 4 else (*names, "../evil.cs"):
                        z.writestr(name, "x")
                data.append(out.getvalue())
            yield batch.assign(path="a" + batch["k"].astype(str), content=data)[["path", "content"]]

    archives = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).mapInPandas(pack, "path string, content binary")
    members = repository.read_archives(archives)
    shown = repository.inventory(members).select("archive", *[F.array_join(c, ",").alias(c) for c in ("solutions", "projects", "controllers", "function_projects", "openapi")])
    refused = members.groupBy("archive").agg(F.max(F.col("error").isNotNull()).alias("refused"))
    return refused.join(shown, "archive", "left").select("archive", *shown.columns[1:], "refused")


# --- retrieval -----------------------------------------------------------------------------------------


@query(f"""
WITH {_LEXICAL}, {_VECTORS.format(asked='(SELECT v.* FROM v JOIN benchmark ON vec_id = item_id)')},
names AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON lower(b.text) = lower(string_split(d.text, chr(10))[1])),
exact AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 AS rank FROM names),
found AS (SELECT item_id, doc_id, sum(s) AS s, string_agg(m, '+' ORDER BY m) AS reason FROM (SELECT item_id, doc_id, score AS s, 'lexical' AS m FROM scored UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank), 'vector' FROM vector) GROUP BY ALL),
hits AS (SELECT item_id, doc_id, 100.0::DOUBLE - rank / 1000 AS s, 'exact-subject' AS reason FROM exact UNION ALL SELECT * FROM found WHERE (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM exact)),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS place FROM hits QUALIFY place <= 8),
used AS (SELECT top.*, text, coalesce(sum(length(text)) OVER (PARTITION BY item_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM top JOIN documents USING (doc_id))
SELECT item_id, place, doc_id, round(s, 6) AS relevance, reason, sha256(substr(text, 1, CAST(20000 - used AS INT))) AS shown, length(text) > 20000 - used AS truncated FROM used WHERE used < 20000""")
def reference_query(spark, sf_dir):
    d, b = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark")
    asked = b.select(F.col("item_id").alias("query_id"), "text")
    e = t(spark, sf_dir, "embeddings").join(b, F.col("vec_id") == F.col("item_id"))
    vector = cut(_by_vector(spark, sf_dir, e.select(F.col("item_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))))  # used twice
    exact = cut(retrieval.alias_hits(d.select("doc_id", F.col("doc_id").alias("place"), F.array(F.substring_index("text", "\n", 1)).alias("aliases")), asked))
    chunks = d.select("doc_id", "text", F.lit(False).alias("truncated"))
    out = retrieval.reference_query(retrieval.lexical_beside(d.select("doc_id", "text"), asked, vector.select("query_id", "doc_id").union(exact.select("query_id", "doc_id"))), vector, exact, chunks)
    return out.select(F.col("query_id").alias("item_id"), "place", "doc_id", "relevance", "reason", F.sha2(F.col("text").cast("binary"), 256).alias("shown"), "truncated")


@query("""
SELECT p_partkey, 'endpoint domain capability business purpose implementation authorization ' || p_name || ' GET /' || p_brand || ' ' || p_type AS endpoint,
  'model DTO business meaning validation mapping request response ' || p_name || ' ' || p_brand || ' ' || p_type AS entity, 'enum business meaning state status values ' || p_name AS enum,
  substr('implementation call path service handler repository authorization ' || p_name, 1, 70) AS follow_up FROM part""")
def retrieval_texts(spark, sf_dir):
    c = F.col
    return t(spark, sf_dir, "part").select(
        "p_partkey", retrieval.query_text("endpoint", c("p_name"), F.lit("GET"), F.concat(F.lit("/"), "p_brand"), F.lit(None).cast("string"), F.array("p_type")).alias("endpoint"),
        retrieval.query_text("entity", c("p_name"), F.array("p_brand", "p_type")).alias("entity"), retrieval.query_text("enum", c("p_name")).alias("enum"), retrieval.query_text("follow-up", c("p_name"), most=70).alias("follow_up"),
    )


_HITS = "SELECT o_custkey AS target, 'p' || l_suppkey % 7 AS path, CAST(l_linenumber AS INT) AS a, l_orderkey AS b, l_returnflag || ' of supplier ' || l_suppkey AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice) - 1 AS rank FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _hits(spark, sf_dir):
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    rows = o.join(li, o.o_orderkey == li.l_orderkey)
    w = Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    place = F.concat(F.lit("p"), F.col("l_suppkey") % 7)
    return rows.select(F.col("o_custkey").alias("target_id"), place.alias("path"), F.col("l_linenumber").cast("int").alias("start_line"), F.col("l_orderkey").alias("end_line"), F.concat("l_returnflag", F.lit(" of supplier "), "l_suppkey").alias("text"), (F.row_number().over(w) - 1).alias("rank"))


@query(f"""
WITH h AS (SELECT * FROM ({_HITS}) WHERE rank < 4 AND NOT (path = 'p3' AND a % 2 = 0)),
u AS (SELECT *, row_number() OVER w AS place, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h WINDOW w AS (PARTITION BY target ORDER BY rank))
SELECT target AS target_id, place, path, a AS start_line, b AS end_line, CASE WHEN length(text) > 50 - used THEN substr(text, 1, CAST(50 - used AS INT)) || chr(10) || '[retrieval truncated]' ELSE text END AS text FROM u WHERE used < 50""")
def context_assembly(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return retrieval.add_context(hits, hits.filter("path = 'p3' and start_line % 2 = 0"), characters=50)


_LEAST = "least(CASE WHEN quality = 1 THEN 0.95 ELSE 0.65 END, CASE WHEN toxic = 1 THEN 0.80 ELSE 0.92 END)"


@query(f"""
WITH r AS (SELECT doc_id AS target, {_LEAST} AS confidence, doc_id % 3 = 0 AS asks FROM labels),
f AS (SELECT target, confidence, CASE WHEN asks THEN 'Own' || target WHEN confidence < 0.7 THEN 'A' || target || 'Service' END AS symbols FROM r WHERE confidence < 0.9),
h AS (SELECT * FROM ({_HITS}) WHERE rank < 20), e AS (SELECT DISTINCT target, path FROM h WHERE path IN ('p1', 'p2')),
n AS (SELECT f.target, path, a, b, 'index' AS how FROM f JOIN h USING (target) WHERE symbols IS NOT NULL AND path NOT IN ('p1', 'p2')),
s AS (SELECT target, 'p' || target % 7 AS path, 1 AS a, 2 AS b, 'scan' AS how FROM f WHERE symbols IS NOT NULL AND target NOT IN (SELECT target FROM n) AND (target, 'p' || target % 7) NOT IN (SELECT (target, path) FROM e))
SELECT target AS target_id, confidence, symbols, path, a AS start_line, b AS end_line, how, CASE WHEN confidence >= 0.7 THEN 'review' ELSE 'needs_more_context' END AS outcome FROM f JOIN (FROM n UNION ALL FROM s) USING (target)""")
def follow_up(spark, sf_dir):
    lab, c = t(spark, sf_dir, "labels"), F.col
    least = F.array(F.when(c("quality") == 1, 0.95).otherwise(0.65), F.when(c("toxic") == 1, 0.80).otherwise(0.92), F.lit(0.99))
    named = F.array(F.concat(F.lit("Own"), "doc_id"), F.lit("not a name"))
    results = lab.select(c("doc_id").alias("target_id"), F.lit("x").alias("name"), least.alias("confidences"), F.when(c("doc_id") % 3 == 0, named).alias("requested"))
    contexts = lab.select(c("doc_id").alias("target_id"), F.concat(F.lit("calls A"), "doc_id", F.lit("Service here")).alias("text"))
    asked = retrieval.needs_follow_up(results, contexts)
    hits = _hits(spark, sf_dir)
    scanned = lab.select(c("doc_id").alias("target_id"), F.concat(F.lit("p"), c("doc_id") % 7).alias("path"), F.lit(1).alias("start_line"), F.lit(2).cast("long").alias("end_line"), F.lit("found").alias("text"))
    found = retrieval.follow_up(asked, hits, hits.filter("path in ('p1', 'p2') and rank < 20"), scanned)
    out = asked.join(found, "target_id")
    return out.select("target_id", "confidence", F.array_join("symbols", ",").alias("symbols"), "path", "start_line", "end_line", "how", retrieval.outcome(c("confidence")).alias("outcome"))


@query("""
WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'),
n AS (SELECT conv_id, count(*) AS n, first(turn ORDER BY place) AS cited FROM s WHERE place <= 3 GROUP BY conv_id), a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id AS target_id, CASE WHEN n IS NOT NULL AND conv_id % 5 > 0 AND conv_id % 7 > 0 THEN 'saw ' || n END AS summary, CASE WHEN conv_id % 5 = 0 THEN 'ValueError: refused' WHEN n IS NULL THEN 'nothing retrieved' WHEN conv_id % 7 = 0 THEN 'cites what was not shown' END AS error FROM a LEFT JOIN n USING (conv_id)""")
def inspect_targets(spark, sf_dir):
    """Answers of a plain callable: one that fails, one that cites what it wasn't shown, and others."""
    c = t(spark, sf_dir, "conversations")
    targets = c.select(F.col("conv_id").alias("target_id"), F.col("conv_id").alias("question")).distinct()
    w = Window.partitionBy("conv_id").orderBy("turn")
    snippets = c.filter("role = 'user'").withColumn("place", F.row_number().over(w)).filter("place <= 3").select(F.col("conv_id").alias("target_id"), "place", F.col("turn").alias("doc_id"), "text")

    def answer(context: str) -> dict:
        asked = json.loads(context)
        if asked["question"] % 5 == 0:
            raise ValueError("refused")
        cited = [str(f["doc_id"]) for f in asked["facts"]][:1]
        return {"summary": f"saw {len(asked['facts'])}", "citations": ["elsewhere"] if asked["question"] % 7 == 0 else cited}

    return enrichment.inspect(targets, snippets, answer, "summary string, citations array<string>").select("target_id", "summary", "error")


# --- counts ----------------------------------------------------------------------------------------------


@query("""
SELECT (SELECT count(*) FILTER (quality = 0) FROM labels) AS entities_without_suggestion, (SELECT count(*) FILTER (toxic = 1) FROM labels) AS entities_awaiting,
  (SELECT count(*) FILTER (lang IN ('de', 'fr')) FROM documents) AS attributes_without_suggestion, (SELECT count(*) FILTER (o_orderstatus = 'O') FROM orders) AS endpoints_without_suggestion,
  (SELECT count(*) FILTER (o_orderstatus = 'F' OR o_orderpriority LIKE '1%') FROM orders) AS endpoints_awaiting""")
def coverage_counts(spark, sf_dir):
    c, wait = F.col, F.lit("Awaiting API Analyzer")
    ents = t(spark, sf_dir, "labels").select(F.when(c("quality") == 1, "x").otherwise("—").alias("suggestion"), F.when(c("toxic") == 1, wait).alias("domain"))
    attrs = t(spark, sf_dir, "documents").select(F.when(c("lang") == "de", "—").when(c("lang") != "fr", "x").alias("suggestion"))
    ends = t(spark, sf_dir, "orders").select(F.when(c("o_orderstatus") == "O", "—").otherwise("x").alias("suggestion"), F.when(c("o_orderstatus") == "F", wait).otherwise("d").alias("domain"), F.when(c("o_orderpriority").startswith("1"), wait).alias("capability"))
    return aggregates.gap_counts(ents, attrs, ends)


@query("SELECT count(DISTINCT c_custkey) AS sources, count(o_orderkey) AS operations, count(DISTINCT (c_custkey, o_orderpriority)) FILTER (o_orderkey IS NOT NULL) AS entities FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def portfolio_totals(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    lists = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("operations"), F.collect_set("o_orderpriority").alias("entities"))
    return aggregates.list_totals(c.join(lists, "c_custkey", "left"), "operations", "entities")


@query("""
SELECT lang AS kind, count(*) AS discovered, count(l.doc_id) AS enriched, count(*) - count(l.doc_id) AS missing, count(*) FILTER (quality = 1) AS domains_classified, count(*) FILTER (toxic = 1) AS capabilities_classified,
  count(*) FILTER (n_chars > 3000) AS truncated FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def enrichment_report(spark, sf_dir):
    d, lab = t(spark, sf_dir, "documents").withColumnRenamed("lang", "kind").withColumnRenamed("doc_id", "id"), t(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    done = d.select("kind", "id").join(lab, "id").select("kind", "id", F.when(F.col("quality") == 1, "Policy").otherwise("UNCLASSIFIED").alias("domain"), F.when(F.col("toxic") == 1, "Renewal").otherwise("UNCLASSIFIED").alias("capability"))
    return enrichment.report_counts(d, done, d.select("kind", "id", (F.col("n_chars") > 3000).alias("truncated")))


@query("""
SELECT (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM supplier) AS attributes, count(*) AS endpoints, count(DISTINCT c_mktsegment) AS domains, count(DISTINCT (c_mktsegment, n_name)) AS capabilities FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def canonical_summary(spark, sf_dir):
    c, n = t(spark, sf_dir, "customer"), t(spark, sf_dir, "nation")
    ends = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_mktsegment").alias("domain"), F.col("n_name").alias("capability"))
    return publish.canonical_summary(t(spark, sf_dir, "part"), t(spark, sf_dir, "supplier"), ends)


@query("""
SELECT subject, gap FROM (SELECT doc_id AS subject, 'no claims' AS gap FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'not analyzed' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
  UNION ALL SELECT doc_id, 'no citation' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'analysis failed' FROM labels WHERE quality = 1 AND toxic = 1 UNION ALL SELECT doc_id, 'context cut' FROM documents WHERE n_chars > 3000)""")
def analysis_gaps(spark, sf_dir):
    d, lab = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels")
    claims = lab.select("doc_id", F.when(F.col("toxic") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("citations"))
    results = lab.filter("quality = 1").select("doc_id", F.when(F.col("toxic") == 1, "failed").alias("error"))
    found = enrichment.gaps(d.select("doc_id"), claims, results, "doc_id", d.select("doc_id", (F.col("n_chars") > 3000).alias("truncated")))
    return found.withColumnRenamed("doc_id", "subject")


# --- reviews and approvals ------------------------------------------------------------------------------------


_STATUS_OF = "CASE {} % 3 WHEN 0 THEN 'Full match' WHEN 1 THEN 'Partial match' ELSE 'Not matched' END"


def _status(c):
    return F.when(c % 3 == 0, "Full match").when(c % 3 == 1, "Partial match").otherwise("Not matched")


def _tree(spark, sf_dir):
    r, n = t(spark, sf_dir, "region"), t(spark, sf_dir, "nation")
    top = r.select(F.concat(F.lit("r"), "r_regionkey").alias("regional_id"), F.col("r_name").alias("name"), _status(F.col("r_regionkey")).alias("status"))
    return top, n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.concat(F.lit("n"), "n_nationkey").alias("regional_id"), F.col("n_name").alias("name"), _status(F.col("n_nationkey")).alias("status"))


_NODES = f"""SELECT 'r' || r_regionkey AS parent_id, 'r' || r_regionkey AS regional_id, r_name AS name, {_STATUS_OF.format('r_regionkey')} AS status, 'parent' AS level, r_regionkey AS k FROM region
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, n_name, {_STATUS_OF.format('n_nationkey')}, 'child', n_nationkey FROM nation"""


@query(f"SELECT parent_id, regional_id, name, status, level FROM ({_NODES}) WHERE status <> 'Full match'")
def review_nodes(spark, sf_dir):
    return publish.review_nodes(*_tree(spark, sf_dir), ["Partial match", "Not matched"])


@query(f"""
WITH d AS (SELECT *, status <> 'Full match' AS node, CASE k % 4 WHEN 0 THEN 'Reference' WHEN 1 THEN 'Manual' WHEN 2 THEN 'Generated' ELSE 'Canonical baseline' END AS sel, CASE WHEN k % 8 = 0 THEN 'ref' END AS ref, CASE WHEN k % 5 = 1 THEN 'given' END AS manual, CASE WHEN k % 6 = 0 THEN 'said' END AS said FROM ({_NODES})),
e AS (SELECT *, CASE WHEN node AND sel = 'Reference' AND ref IS NULL THEN 'Manual' ELSE sel END AS s FROM d)
SELECT regional_id, s AS selection, CASE WHEN node AND s = 'Manual' AND manual IS NULL THEN name ELSE manual END AS manual_name, CASE WHEN node AND said IS NULL THEN 'bulk' ELSE said END AS reason, node AS approved FROM e""")
def bulk_approval(spark, sf_dir):
    top, below = _tree(spark, sf_dir)
    k = F.substring("regional_id", 2, 9).cast("int")
    sel = F.when(k % 4 == 0, "Reference").when(k % 4 == 1, "Manual").when(k % 4 == 2, "Generated").otherwise("Canonical baseline")
    every = publish.review_nodes(top, below, ["Full match", "Partial match", "Not matched"])
    decisions = every.select("regional_id", F.lit(None).cast("string").alias("status"), F.col("status").alias("proposed_status"), sel.alias("selection"), F.when(k % 8 == 0, "ref").alias("reference_id"), F.when(k % 5 == 1, "given").alias("manual_name"), F.when(k % 6 == 0, "said").alias("reason"), F.lit(False).alias("approved"))
    out = publish.approve_nodes(decisions, publish.review_nodes(top, below, ["Partial match", "Not matched"]), "bulk")
    return out.select("regional_id", "selection", "manual_name", "reason", "approved")


_CHOSEN = """CASE {k} % 4 WHEN 0 THEN 'Canonical baseline' WHEN 1 THEN 'Reference' WHEN 2 THEN 'Generated' ELSE 'Manual' END AS sel, CASE {k} % 4 WHEN 0 THEN 'b ' || {n} WHEN 1 THEN 'r ' || {n} WHEN 2 THEN 'g ' || {n} ELSE 'm ' || {n} END AS canonical"""


def _resolved(rows, key: str, name: str, *also):
    """A table of matches with all candidates and a decision for each, resolved."""
    k, n = F.col(key), F.col(name)
    sel = F.when(k % 4 == 0, "Canonical baseline").when(k % 4 == 1, "Reference").when(k % 4 == 2, "Generated").otherwise("Manual")
    cand = lambda p: F.concat(F.lit(p), n)
    matches = rows.select(F.col(key).cast("string").alias("regional_id"), n.alias("name"), _status(k).alias("status"), F.lit(50.0).alias("score"), cand("b ").alias("baseline_name"), cand("r ").alias("reference_name"), cand("g ").alias("generated_name"), *also)
    decisions = rows.select(F.col(key).cast("string").alias("regional_id"), sel.alias("selection"), cand(" m ").alias("manual_name"), F.when(k % 5 == 0, "Full match").alias("status"), F.concat(F.lit(" why "), k).alias("reason"))
    return publish.resolved(matches, decisions)


_M_R = f"SELECT r_regionkey AS k, r_name AS n, {_CHOSEN.format(k='r_regionkey', n='r_name')} FROM region"
_M_N = f"SELECT n_nationkey AS k, n_regionkey AS up, n_name AS n, {_CHOSEN.format(k='n_nationkey', n='n_name')} FROM nation"
_TOLD = f"""CASE WHEN {{k}} % 5 = 0 THEN 'Full match' ELSE {_STATUS_OF.format('{k}')} END AS status, {_STATUS_OF.format('{k}')} AS proposed_status, 50.0::DOUBLE AS score, {{s}} AS selection, 'g ' || {{n}} AS generated, 'why ' || {{k}} AS reason"""


@query(f"""
WITH p AS ({_M_R}), c AS ({_M_N})
SELECT x AS kind, n AS regional, 'b ' || n AS baseline, 'r ' || n AS reference, canonical, {_TOLD.format(k='k', s='sel', n='n')} FROM p, (VALUES ('Entity'), ('Domain')) v(x)
UNION ALL SELECT x, p.n || '.' || c.n, 'b ' || p.n || '.b ' || c.n, CASE WHEN x = 'Attribute' THEN 'r ' || p.n || '.' ELSE '' END || 'r ' || c.n, p.canonical || '.' || c.canonical, {_TOLD.format(k='c.k', s='c.sel', n='c.n')} FROM c JOIN p ON c.up = p.k, (VALUES ('Attribute'), ('Capability')) v(x)""")
def approved_mappings(spark, sf_dir):
    top = _resolved(t(spark, sf_dir, "region"), "r_regionkey", "r_name")
    below = _resolved(t(spark, sf_dir, "nation"), "n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("parent_id"))
    return publish.approved_mappings(top, below, top, below)


@query(f"""
WITH p AS ({_M_R}), c AS ({_M_N}), e AS (SELECT *, 'canonical-entity-' || substr(sha256('canonical-entity' || chr(31) || 'eu' || chr(31) || canonical), 1, 20) AS id FROM p)
SELECT 'canonical-attribute-' || substr(sha256('canonical-attribute' || chr(31) || e.id || chr(31) || c.canonical || chr(31) || 'string'), 1, 20) AS id, e.id AS entity_id, e.canonical AS entity, c.canonical AS name,
  CASE WHEN c.sel = 'Reference' THEN 'uuid' WHEN c.k % 3 = 0 THEN 'integer' ELSE 'string' END AS type, c.sel AS standard FROM c JOIN e ON c.up = e.k""")
def canonical_rows(spark, sf_dir):
    top = _resolved(t(spark, sf_dir, "region"), "r_regionkey", "r_name")
    more = [F.col("n_regionkey").cast("string").alias("parent_id"), F.lit("string").alias("regional_type"), F.lit("uuid").alias("reference_type"), F.when(F.col("n_nationkey") % 3 == 0, "integer").alias("manual_type"), F.lit(True).alias("required")]
    ents, attrs = publish.canonical_rows("eu", top, _resolved(t(spark, sf_dir, "nation"), "n_nationkey", "n_name", *more))
    return attrs.join(ents.select(F.col("id").alias("entity_id"), F.col("name").alias("entity")), "entity_id").select("id", "entity_id", "entity", "name", "type", "standard")


@query("""
WITH u AS (SELECT DISTINCT 'S' || l_suppkey % 7 AS api, l_returnflag AS method, CAST(l_linenumber AS VARCHAR) AS route, p_brand AS entity, CASE WHEN p_size > 25 THEN 'Contract' ELSE 'Request' END AS usage FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'A'),
e AS (SELECT DISTINCT 'S' || l_suppkey % 7 AS api, l_returnflag AS method, CAST(l_linenumber AS VARCHAR) AS route FROM lineitem)
SELECT api, method, route, coalesce((SELECT string_agg(usage || ':' || entity, ',' ORDER BY usage, entity) FROM u WHERE u.api = e.api AND u.method = e.method AND u.route = e.route), '') AS entities FROM e""")
def endpoint_entities(spark, sf_dir):
    li, p = t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "part")
    at = [F.concat(F.lit("S"), F.col("l_suppkey") % 7).alias("api"), F.col("l_returnflag").alias("method"), F.col("l_linenumber").cast("string").alias("route")]
    used = li.join(p, li.l_partkey == p.p_partkey).filter("l_returnflag != 'A'").select(*at, F.col("p_brand").alias("entity"), F.when(F.col("p_size") <= 25, "Request").alias("usage")).distinct()
    out = publish.endpoint_entities(li.select(*at).distinct(), used)
    return out.withColumn("entities", F.array_join(F.transform("entities", lambda x: F.concat(x["usage"], F.lit(":"), x["entity"])), ","))


@query("""
WITH b AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'us' ELSE 'base' END AS region, o_orderstatus AS api, o_orderpriority AS operation, 'GET' AS method, 'r' || o_custkey % 9 AS route, 'old' AS note FROM orders),
r AS (SELECT 'us' AS region, o_orderstatus, o_orderpriority, 'GET', 'r' || o_custkey % 11, 'new' FROM orders)
SELECT region, api, operation, method, route, max(note) AS note FROM (SELECT DISTINCT * FROM b UNION SELECT DISTINCT * FROM r) GROUP BY ALL""")
def merge_endpoints(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    of = lambda region, n, note: o.select(region.alias("region"), F.col("o_orderstatus").alias("api"), F.col("o_orderpriority").alias("operation"), F.lit("GET").alias("method"), F.concat(F.lit("r"), F.col("o_custkey") % n).alias("route"), F.lit(note).alias("note"))
    return publish.merge_endpoints(of(F.when(F.col("o_custkey") % 2 == 0, "us"), 9, "old"), of(F.lit(None).cast("string"), 11, "new"), "base", "us")


@query("""
WITH b AS (SELECT DISTINCT p_brand || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' (old)' END AS entity, p_name AS name, 'b' AS type FROM part), r AS (SELECT DISTINCT lower(p_brand) AS entity, replace(upper(p_name), ' ', '_') AS name, 'r' AS type FROM part)
SELECT * FROM b UNION ALL SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE lower(b.entity) = r.entity AND upper(replace(b.name, ' ', '_')) = r.name)""")
def merge_attributes(spark, sf_dir):
    """The regional side spells all of its names in another way, so only keys can tell what a baseline has; of odd sizes it has other entities."""
    p = t(spark, sf_dir, "part")
    base = p.select(F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "").otherwise(" (old)")).alias("entity"), F.col("p_name").alias("name"), F.lit("b").alias("type")).distinct()
    return publish.merge_attributes(base, p.select(F.lower("p_brand").alias("entity"), F.replace(F.upper("p_name"), F.lit(" "), F.lit("_")).alias("name"), F.lit("r").alias("type")).distinct())


@query("""
SELECT 'entities' AS kind, 'r' || r_regionkey AS key, 'Use canonical' AS action FROM region UNION ALL SELECT 'attributes', 'n' || n_nationkey, 'Use canonical' FROM nation
UNION ALL SELECT DISTINCT 'domains', c_mktsegment, 'Use canonical' FROM customer UNION ALL SELECT DISTINCT 'capabilities', o_orderpriority, 'Use canonical' FROM orders""")
def default_final_review(spark, sf_dir):
    of = lambda n, kind, c: t(spark, sf_dir, n).select(F.lit(kind).alias("kind"), F.col(c).alias("canonical"))
    mappings = of("customer", "Domain", "c_mktsegment").unionByName(of("orders", "Capability", "o_orderpriority")).unionByName(of("part", "Entity", "p_name"))
    ident = lambda n, p, c: t(spark, sf_dir, n).select(F.concat(F.lit(p), c).alias("id"))
    return publish.default_review(ident("region", "r", "r_regionkey"), ident("nation", "n", "n_nationkey"), mappings)


def _sum_sql(name: str, row: str, table: str) -> str:
    parts = ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {a}, 12) AS UBIGINT)), 0) AS VARCHAR)" for a in (1, 13, 25, 37, 49))
    return f"SELECT '{name}=' || concat_ws(':', CAST(count(*) AS VARCHAR), {parts}) AS line FROM (SELECT sha256({row}) AS h FROM {table})"


_SEGMENT = """'{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}'"""
_ORDER = """'{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}'"""


@query(f"""
WITH l AS ({_sum_sql('customers', _SEGMENT, 'customer')} UNION ALL {_sum_sql('orders', _ORDER, 'orders')})
SELECT sha256(string_agg(line, chr(10) ORDER BY line) || chr(10) || 'region=eu' || chr(10) || 'run=7') AS digest FROM l""")
def alignment_digest(spark, sf_dir):
    inputs = {"customers": t(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), "orders": t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")}
    return publish.input_digest(inputs, {"run": "7", "region": "eu"})


@query("""
WITH e AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT 'e' || n_nationkey AS entity_id, NULL AS attribute_id, n_name AS original_name, lower(n_name) AS suggested_name, NULL AS error FROM nation
UNION ALL SELECT 'e99', NULL, NULL, 'made up', 'unknown'
UNION ALL SELECT 'e' || c_nationkey, 'a' || c_custkey, c_name, CASE WHEN n > 0 THEN upper(c_name) END, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END FROM customer LEFT JOIN e ON k = c_custkey
UNION ALL SELECT 'e0', 'lost', NULL, 'x', 'unknown'""")
def restored_proposals(spark, sf_dir):
    n, c, o = (t(spark, sf_dir, x) for x in ("nation", "customer", "orders"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x))
    made_up = spark.createDataFrame([("e99", "made up")], "entity_id string, suggested_name string")
    lost = spark.createDataFrame([("e0", "lost", "x")], "entity_id string, attribute_id string, suggested_name string")
    proposals = n.select(key("e", "n_nationkey").alias("entity_id"), F.lower("n_name").alias("suggested_name")).unionByName(made_up)
    attributes = c.select(key("e", "c_nationkey").alias("entity_id"), key("a", "c_custkey").alias("attribute_id"), F.col("c_name").alias("name"))
    proposed = o.join(c, o.o_custkey == c.c_custkey).select(key("e", "c_nationkey").alias("entity_id"), key("a", "c_custkey").alias("attribute_id"), F.upper("c_name").alias("suggested_name")).unionByName(lost)
    return enrichment.restored_proposals(n.select(key("e", "n_nationkey").alias("entity_id"), F.col("n_name").alias("name")), attributes, proposals, proposed)


# --- models ----------------------------------------------------------------------------------------------------------


def _nation_model(spark, sf_dir):
    """A model of every region: nations are entities with their customers as attributes, market segments are enums, suppliers operations."""
    at = [F.col("r_name").alias("region"), F.lit("Sys").alias("system")]
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    s = t(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    segment = c.select(*at, F.concat(F.lit("m"), "c_mktsegment").alias("id"), F.concat(F.initcap("c_mktsegment"), F.lit("Kind")).alias("name"), F.explode(F.array(F.lit("OpenOne"), F.lit("shut"))).alias("value")).distinct()
    return {
        "operations": s.select(*at, key("o", "s_suppkey").alias("id"), F.concat(F.lit("GetSupplier"), "s_suppkey").alias("name"), F.lit("get").alias("method"), F.concat(F.lit("/Nations/{NationId:int}/S"), "s_suppkey").alias("route"), F.when(F.col("s_suppkey") % 2 == 0, key("e", "s_nationkey")).alias("request_entity_id")),
        "parameters": s.select(*at, key("o", "s_suppkey").alias("operation_id"), F.lit("NationId").alias("name"), F.lit("path").alias("location"), F.lit(True).alias("required"), F.lit("integer").alias("type")),
        "responses": s.select(*at, key("o", "s_suppkey").alias("operation_id"), (F.col("s_suppkey") % 3 + 200).cast("int").alias("status"), key("e", "s_nationkey").alias("entity_id")),
        "entities": n.select(*at, key("e", "n_nationkey").alias("id"), F.concat(F.initcap("n_name"), F.lit("Dto")).alias("name"), F.col("n_name").alias("original_name"), F.when(F.col("n_nationkey") % 5 == 1, F.lit("e0")).alias("base_entity_id")),
        "attributes": c.select(*at, key("e", "c_nationkey").alias("entity_id"), F.concat(F.lit("HasCustomer"), "c_custkey").alias("name"), F.col("c_name").alias("original_name"), F.lit("string").alias("type"), (F.col("c_custkey") % 2 == 0).alias("required")),
        "enums": segment,
        "relationships": s.select(*at, F.lit("RETURNS").alias("kind"), key("o", "s_suppkey").alias("source"), F.when(F.col("s_suppkey") % 7 == 0, "gone").otherwise(key("e", "s_nationkey")).alias("target")),
        "diagnostics": n.filter("n_nationkey % 4 = 0").select(*at, F.lit("warning").alias("severity"), F.lit("C1").alias("code"), F.col("n_name").alias("message")),
    }


_N, _S = "nation JOIN region ON n_regionkey = r_regionkey", "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _words(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"


_TITLE = _words("n_name") + " || 'Dto'"
_SNAKE = "lower(array_to_string(regexp_extract_all(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[A-Za-z0-9]+'), '_'))"


@query(rf"""
SELECT 'operations' AS part, r_name || '|get_supplier' || s_suppkey || '|GET|/nations/{{nation_id}}/s' || s_suppkey || '|' || coalesce(CASE WHEN s_suppkey % 2 = 0 THEN {_TITLE} END, '-') AS row FROM {_S}
UNION ALL SELECT 'parameters', r_name || '|/nations/{{nation_id}}/s' || s_suppkey || '|nation_id|path' FROM {_S}
UNION ALL SELECT 'responses', r_name || '|/nations/{{nation_id}}/s' || s_suppkey || '|' || (200 + s_suppkey % 3) || '|' || {_TITLE} FROM {_S}
UNION ALL SELECT 'entities', r_name || '|' || {_SNAKE.format(x=_TITLE)} || '|' || n_name || '|' || coalesce(CASE WHEN n_nationkey % 5 = 1 THEN (SELECT {_TITLE} FROM nation b WHERE b.n_nationkey = 0 AND b.n_regionkey = x.n_regionkey) END, '-') FROM (SELECT * FROM {_N}) x
UNION ALL SELECT 'fields', r_name || '|' || {_SNAKE.format(x=_TITLE)} || '|has_customer' || c_custkey || '|' || c_name || '|' || (c_custkey % 2 = 0) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT 'enums', r_name || '|' || lower(c_mktsegment) || '_kind|' || v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (VALUES ('open_one'), ('shut')) w(v)
UNION ALL SELECT 'relationships', r_name || '|RETURNS|GetSupplier' || s_suppkey || '|' || CASE WHEN s_suppkey % 7 = 0 THEN 'Unknown target' ELSE {_TITLE} END FROM {_S}
UNION ALL SELECT 'diagnostics', r_name || '|warning|C1|' || n_name FROM {_N} WHERE n_nationkey % 4 = 0""")
def normalized_portfolio(spark, sf_dir):
    """Every table of the portfolio as text rows."""
    shown = {
        "operations": ("name", "method", "route", "request_model"), "parameters": ("route", "name", "location"), "responses": ("route", "status", "response_model"),
        "entities": ("name", "source_name", "inherits_from"), "fields": ("entity", "name", "source_name", "required"), "enums": ("name", "value"),
        "relationships": ("relationship", "source", "target"), "diagnostics": ("severity", "code", "message"),
    }
    found, out = catalog.normalized(_nation_model(spark, sf_dir)), None
    for part, columns in shown.items():
        rows = found[part].select(F.lit(part).alias("part"), F.concat_ws("|", "region", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


_REF = "'Brand#' || (1 + p_size % 5) || (1 + (p_size // 7 + {}) % 5)"


@query(f"""
WITH RECURSIVE l AS (SELECT DISTINCT p_brand AS id, CASE WHEN p_size % 6 = 0 THEN 'data' ELSE 'k' || p_size % 9 END AS a, CASE WHEN p_size % 6 = 0 THEN (SELECT min(p_brand) FROM part b WHERE b.p_brand > part.p_brand) ELSE {_REF.format(0)} END AS ref FROM part),
r AS (SELECT DISTINCT p_brand AS id, 'k' || p_size % 10 AS a, {_REF.format(1)} AS ref FROM part),
lk AS (SELECT id, list_distinct(list(a)) AS ks FROM l GROUP BY id), rk AS (SELECT id, list_distinct(list(a)) AS ks FROM r GROUP BY id),
w AS (SELECT l.id, min(ref) AS inside FROM l JOIN lk ON lk.id = ref WHERE a = 'data' GROUP BY l.id),
j AS (SELECT lk.id AS l, rk.id AS r, inside, len(list_intersect(lk.ks, rk.ks))::DOUBLE / len(list_distinct(list_concat(lk.ks, rk.ks))) AS own, coalesce(len(list_intersect(i.ks, rk.ks))::DOUBLE / len(list_distinct(list_concat(i.ks, rk.ks))), -1) AS other
  FROM lk CROSS JOIN rk LEFT JOIN w ON w.id = lk.id LEFT JOIN lk i ON i.id = w.inside),
acc AS (SELECT l, r, CASE WHEN other > own THEN inside ELSE l END AS best, greatest(own, other) AS overlap, CASE WHEN other > own THEN l END AS outer_id FROM j WHERE greatest(own, other) >= 0.5),
p(l, r) AS (SELECT DISTINCT p_brand, p_brand FROM part WHERE p_size < 8 UNION SELECT x.ref, y.ref FROM p JOIN acc USING (l, r) JOIN l x ON x.id = acc.best JOIN r y ON y.id = acc.r AND y.a = x.a WHERE x.ref IS NOT NULL AND y.ref IS NOT NULL)
SELECT DISTINCT best AS left_id, r AS right_id, round(overlap, 6) AS overlap, outer_id FROM p JOIN acc USING (l, r)""")
def propagate_pairs(spark, sf_dir):
    """Pairs of brands that pairs of brands lead to, some of which wrap the next one as data; all names differ."""
    p, n = t(spark, sf_dir, "part"), F.col("p_size")
    ref = lambda k: F.concat(F.lit("Brand#"), n % 5 + 1, (F.floor(n / 7) + k) % 5 + 1)
    after = p.select("p_brand").distinct().withColumn("next", F.lead("p_brand").over(Window.partitionBy(F.lit(0)).orderBy("p_brand")))  # some 25 brands
    rows = p.join(F.broadcast(after), "p_brand")
    left = rows.select(F.col("p_brand").alias("id"), F.concat(F.lit("l"), "p_brand").alias("name_key"), F.when(n % 6 == 0, "data").otherwise(F.concat(F.lit("k"), n % 9)).alias("attribute_key"), F.when(n % 6 == 0, F.col("next")).otherwise(ref(0)).alias("reference_id")).distinct()
    right = p.select(F.col("p_brand").alias("id"), F.concat(F.lit("r"), "p_brand").alias("name_key"), F.concat(F.lit("k"), n % 10).alias("attribute_key"), ref(1).alias("reference_id")).distinct()
    seeds = p.filter("p_size < 8").select(F.col("p_brand").alias("left_id"), F.col("p_brand").alias("right_id")).distinct()
    return joins.propagate_pairs(seeds, left, right).withColumn("overlap", F.round("overlap", 6))


@query("""
WITH RECURSIVE e AS (SELECT o_custkey % 20 AS id, 'E' || (o_custkey % 20) AS name FROM orders GROUP BY ALL), a AS (SELECT DISTINCT o_custkey % 9 AS s, 9 + o_orderkey % 11 AS t FROM orders),
w(root, node, d) AS (SELECT id, id, 0 FROM e WHERE id % 3 = 0 UNION SELECT root, t, d + 1 FROM w JOIN a ON s = node JOIN e ON t = id),
m AS (SELECT root, node, min(d) AS d FROM w GROUP BY root, node)
SELECT root AS root_id, string_agg(d || ':' || name, ',' ORDER BY d, name) AS models, (SELECT count(*) FROM m x JOIN a ON s = x.node JOIN e ON t = e.id WHERE x.root = m.root) AS relations FROM m JOIN e ON node = id GROUP BY root""")
def model_trees(spark, sf_dir):
    o, k = t(spark, sf_dir, "orders"), F.col("o_custkey") % 20
    entities = o.select(k.alias("id")).distinct().select("id", F.concat(F.lit("E"), "id").alias("name"), F.lit(None).cast("long").alias("base_entity_id"))
    edges = o.select((F.col("o_custkey") % 9).alias("entity_id"), (F.col("o_orderkey") % 11 + 9).alias("reference_id")).distinct()
    attributes = edges.select("entity_id", F.concat(F.lit("f"), "reference_id").alias("name"), "reference_id", F.lit("x").alias("kind"), F.lit(False).alias("collection"), F.lit(False).alias("nullable"), F.lit(True).alias("required"), F.lit(0).alias("position"), F.concat(F.lit("a"), "entity_id", F.lit("."), "reference_id").alias("id"))
    model = {"entities": entities, "attributes": attributes, "enums": spark.createDataFrame([], "id long, name string, values array<string>"), "operations": entities.filter("id % 3 = 0").select(F.col("id").alias("request_entity_id")), "responses": entities.limit(0).select(F.col("id").alias("entity_id"))}
    found = artifacts.model_trees(model)
    models = F.array_join(F.transform("models", lambda m: F.concat(m["depth"], F.lit(":"), m["name"])), ",")
    return found.select("root_id", models.alias("models"), F.size(F.coalesce("relations", F.expr("array()"))).cast("long").alias("relations"))


# --- merges and unions -----------------------------------------------------------------------------------------------


@query("""
WITH m AS (SELECT doc_id AS id, source AS v, 0 AS k FROM documents UNION ALL SELECT doc_id, CAST(quality AS VARCHAR), 1 FROM labels)
SELECT id, first(v ORDER BY k) AS v FROM m GROUP BY id""")
def union_models(spark, sf_dir):
    d, lab = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels")
    return setops.union_models([d.select(F.col("doc_id").alias("id"), F.col("source").alias("v")), lab.select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("v"))], "id")


@query("""
SELECT doc_id, 'missing' AS error FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id + 1000000000, 'unknown' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'repeated' FROM labels WHERE quality = 0""")
def inventory_errors(spark, sf_dir):
    lab = t(spark, sf_dir, "labels")
    proposed = lab.select("doc_id").unionByName(lab.filter("toxic = 1").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"))).unionByName(lab.filter("quality = 0").select("doc_id"))
    return setops.inventory_errors(t(spark, sf_dir, "documents"), proposed, "doc_id")


@query("SELECT DISTINCT p_brand, p_type, p_size FROM part")
def rows_once(spark, sf_dir):
    return setops.rows_once(t(spark, sf_dir, "part").select("p_brand", "p_type", "p_size"))


@query("""
WITH e AS (SELECT l_suppkey AS s, 'ship' AS kind, 'd' || l_linenumber AS e FROM lineitem UNION SELECT l_suppkey, 'flag', l_returnflag || l_linestatus FROM lineitem)
SELECT kind, s AS subject_id, string_agg(e, ',' ORDER BY e) AS evidence FROM e GROUP BY ALL""")
def evidence_map(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    found = enrichment.evidence_map(ship=li.select(F.col("l_suppkey").alias("subject_id"), F.array(F.concat(F.lit("d"), "l_linenumber")).alias("evidence")), flag=li.select(F.col("l_suppkey").alias("subject_id"), F.array(F.concat("l_returnflag", "l_linestatus")).alias("evidence")))
    return found.withColumn("evidence", F.array_join("evidence", ","))


@query(f"SELECT doc_id AS regional_id, {_STATUS_OF.format('doc_id')} AS status, CASE WHEN doc_id % 3 = 2 AND quality = 1 THEN 'draft ' || doc_id END AS generated FROM documents LEFT JOIN labels USING (doc_id)")
def attach_drafts(spark, sf_dir):
    matches = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("regional_id"), _status(F.col("doc_id")).alias("status"))
    return enrichment.attach_drafts(matches, t(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("regional_id"), F.concat(F.lit("draft "), "doc_id").alias("draft")))


@query(" UNION ALL ".join(f"SELECT '{d}' AS domain, '{c}' AS capability" for d, cs in enrichment.TAXONOMY.items() for c in cs))
def taxonomy(spark, sf_dir):
    return enrichment.taxonomy(spark)


@query("""
SELECT 'S' || l_suppkey % 7 AS api, l_returnflag AS method, CAST(l_linenumber AS VARCHAR) AS route, l_linestatus AS usage, max(l_orderkey) AS k FROM lineitem GROUP BY ALL""")
def unique_endpoints(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    rows = li.select(F.concat(F.lit("S"), F.col("l_suppkey") % 7).alias("api"), F.col("l_returnflag").alias("method"), F.col("l_linenumber").cast("string").alias("route"), F.col("l_linestatus").alias("usage"), F.col("l_orderkey").alias("k"))
    return catalog.unique_endpoints(rows, "k")


@query("""
SELECT p_partkey AS operation_id, p_name, CASE WHEN p_size > 20 THEN p_type ELSE 'Awaiting API Analyzer' END AS summary, CASE WHEN p_size > 30 THEN p_brand ELSE 'Awaiting API Analyzer' END AS domain, CASE WHEN p_size > 20 THEN 'Quote' ELSE 'Awaiting API Analyzer' END AS capability FROM part""")
def endpoint_rows(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumnRenamed("p_partkey", "operation_id")
    said = p.filter("p_size > 20").select("operation_id", F.col("p_type").alias("summary"), F.when(F.col("p_size") > 30, F.col("p_brand")).alias("domain"), F.lit("Quote").alias("capability"))
    return catalog.endpoint_rows(p.select("operation_id", "p_name"), said)


@query("""
WITH r AS (SELECT c_mktsegment AS region, n_name AS application, c_custkey AS run_id, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT * FROM r WHERE region = 'BUILDING' QUALIFY row_number() OVER (PARTITION BY lower(application) ORDER BY c_acctbal DESC, run_id DESC) = 1""")
def latest_runs(spark, sf_dir):
    c, n = t(spark, sf_dir, "customer"), t(spark, sf_dir, "nation")
    runs = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_mktsegment").alias("region"), F.col("n_name").alias("application"), F.lit("git").alias("repository"), F.col("c_acctbal").alias("semantic_entities"), F.lit(0).alias("semantic_endpoints"), F.lit(0).alias("n_entities"), F.col("c_custkey").alias("run_id"), "c_acctbal")
    return catalog.latest_runs(runs, "BUILDING").select("region", "application", "run_id", "c_acctbal")


@query(r"""
WITH f AS (SELECT page_id, regexp_extract(url, '(?s)^.*?://([^?#]*)', 1) || CASE page_id % 5 WHEN 0 THEN '/A.g.cs' WHEN 1 THEN '/B.cs' WHEN 2 THEN '/bin/c.json' WHEN 3 THEN '/secrets.json' ELSE '/OBJ/d.cs' END AS path FROM pages)
SELECT page_id, page_id % 5 = 1 AND NOT regexp_matches(lower(path), '(^|/)(\.git|bin|obj|packages|node_modules)/') AS read FROM f""")
def scanned_files(spark, sf_dir):
    k = F.col("page_id") % 5
    end = F.when(k == 0, "/A.g.cs").when(k == 1, "/B.cs").when(k == 2, "/bin/c.json").when(k == 3, "/secrets.json").otherwise("/OBJ/d.cs")
    path = F.concat(F.regexp_extract("url", r"^(?s).*?://([^?#]*)", 1), end)
    return t(spark, sf_dir, "pages").select("page_id", repository.wanted(path).alias("read"))


@query("""
SELECT conv_id, turn FROM conversations WHERE role = 'assistant' OR (role <> 'system' AND turn % 2 = 1)""")
def uncited_claims(spark, sf_dir):
    """Assistants cite what they weren't shown; other claims at odd turns cite nothing, which only the unknown may."""
    none, role = F.array().cast("array<string>"), F.col("role")
    cites = F.when(role == "assistant", F.array(F.lit("x"))).when(F.col("turn") % 2 == 1, none).otherwise(F.array(F.lit("a")))
    claims = t(spark, sf_dir, "conversations").select("conv_id", "turn", cites.alias("cited"), F.array(F.lit("a")).alias("shown"), F.when(role == "system", "unknown").otherwise("inferred").alias("status"))
    return quality.uncited(claims, "cited", "shown", "status").select("conv_id", "turn")


@query("""
SELECT doc_id, toxic = 1 AND quality = 0 AS unfinished FROM labels""")
def unfinished_targets(spark, sf_dir):
    some = lambda test: F.when(test, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "partial").otherwise("complete").alias("status"), some(F.col("quality") == 0).alias("a"), some(F.lit(False)).alias("b"))
    return rows.select("doc_id", quality.unfinished("status", "a", "b").alias("unfinished"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '(?s)^.*?://([^?#]*)', 1) AS path FROM pages), h AS (SELECT DISTINCT regexp_replace(path, '[^/]*$', '') AS f FROM p WHERE page_id % 4 = 0)
SELECT page_id FROM p WHERE regexp_replace(path, '[^/]*$', '') IN (SELECT f FROM h)""")
def same_folder(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^(?s).*?://([^?#]*)", 1).alias("path"))
    return joins.same_folder(p, p.filter("page_id % 4 = 0")).select("page_id")


@query("""
WITH b AS (SELECT DISTINCT p_partkey AS subject, p_brand AS chunk FROM part)
SELECT DISTINCT a.chunk AS source, z.chunk AS target, 'K' || l_linenumber AS kind FROM lineitem JOIN b a ON a.subject = l_partkey JOIN b z ON z.subject = l_suppkey WHERE a.chunk <> z.chunk""")
def project_edges(spark, sf_dir):
    edges = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.concat(F.lit("K"), "l_linenumber").alias("kind"))
    return joins.project_edges(edges, t(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject"), F.col("p_brand").alias("chunk")))


@query("""
WITH o AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS a, list(DISTINCT o_orderstatus) AS b FROM orders GROUP BY o_custkey)
SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS merged FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def merged_lists(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    lists = o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set("o_orderstatus").alias("b"))
    return c.join(lists, c.c_custkey == lists.o_custkey, "left").select("c_custkey", F.array_join(joins.merge_lists("a", "b"), ",").alias("merged"))


@query(r"""
SELECT count(*) AS regional_entities, CAST(sum(n - 1) AS BIGINT) AS merged_duplicates, (SELECT count(*) FROM (SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 'a' || p_size, lower(p_type) FROM part)) AS regional_attributes,
  CAST(sum(n) AS BIGINT) AS source_entities, (SELECT count(*) FROM part) AS source_attributes FROM (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k, count(DISTINCT p_brand || '/' || p_name) AS n FROM part GROUP BY k)""")
def review_summary(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumn("source_key", F.concat_ws("/", "p_brand", "p_name"))
    sources = p.select("source_key", F.col("p_brand").alias("api"), F.col("p_name").alias("approved_name")).distinct()
    attributes = p.select("source_key", F.col("p_partkey").cast("string").alias("attribute_id"), F.concat(F.lit("a"), "p_size").alias("approved_name"), F.col("p_type").alias("type"), F.lit(True).alias("required"))
    entities, _ = catalog.review("eu", sources, attributes)
    return catalog.review_summary(entities, sources, attributes)


@query("""
SELECT c_custkey, round(coalesce(avg(o_totalprice), CASE WHEN c_custkey % 2 = 0 THEN 100.0 ELSE 0.0 END), 4) AS score FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def mean_scores(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    rows = c.join(o, c.c_custkey == o.o_custkey, "left")
    return rows.groupBy("c_custkey").agg(F.round(aggregates.mean_or(F.col("o_totalprice"), F.col("c_custkey") % 2 == 0), 4).alias("score"))


@query("""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, array_to_string(l[greatest(2 - 1, 1):least(2 + 2, len(l))], chr(10)) AS snippet FROM d""")
def hit_snippets(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    return d.select("doc_id", ranking.snippet("l", F.lit(2), 1, 2).alias("snippet"))


@query(f"""
WITH n AS (SELECT DISTINCT p_name AS name, p_type AS other FROM part),
s AS (SELECT name, other, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE * 100 * 0.7 + 30, 6) AS d, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE * 100 * 0.8 + 10, 6) AS c
  FROM (SELECT *, {terms_sql('name', '[a-z0-9]+')} AS a, {terms_sql("(name || ' ' || other)", '[a-z0-9]+')} AS b FROM n))
SELECT name, other, d AS domain, c AS capability, CASE WHEN d >= 85 THEN 'Full match' WHEN d >= 40 THEN 'Partial match' ELSE 'Not matched' END AS status FROM s""")
def domain_scores(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("other")).distinct()
    same = similarity.text_similarity("name", F.concat_ws(" ", "name", "other"))
    d = F.round(similarity.domain_score(same, F.lit(100.0)), 6)
    out = p.select("name", "other", d.alias("domain"), F.round(similarity.capability_score(same, F.lit(50.0)), 6).alias("capability"))
    return out.withColumn("status", similarity.parent_status(F.col("domain"), F.lit(True), F.lit(False)))


@query("""
WITH n AS (SELECT n_name AS x FROM nation UNION SELECT r_name FROM region), e AS (SELECT n_name AS s, r_name AS t, n_nationkey % 2 = 0 AS kept FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'graph LR' AS line UNION ALL SELECT '  n' || substr(sha256(x), 1, 12) || '["' || x || '"]' FROM n UNION ALL SELECT '  n' || substr(sha256(s), 1, 12) || CASE WHEN kept THEN ' --> ' ELSE ' -. merged .-> ' END || 'n' || substr(sha256(t), 1, 12) FROM e""")
def lineage_graph(spark, sf_dir):
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    truth = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.when(F.col("n_nationkey") % 2 == 0, "Retained").otherwise("Merged duplicate entity").alias("action"))
    return sinks.lineage_graph(truth)


@query("""
SELECT c_custkey, c_name, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey), 0) + 1 AS version FROM customer""")
def append_version(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("version"))
    return publish.append_version(o, ["c_custkey"], t(spark, sf_dir, "customer").select("c_custkey", "c_name"))


@query("SELECT o_custkey, max(o_orderkey) + 1 AS at, 'new' AS note FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey UNION ALL SELECT o_custkey, max(o_orderkey), 'old' FROM orders WHERE o_custkey % 2 = 1 GROUP BY o_custkey")
def upsert_drafts(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("at"), F.lit("old").alias("note"))
    new = o.filter("o_custkey % 2 = 0").groupBy("o_custkey").agg((F.max("at") + 1).alias("at"), F.lit("new").alias("note"))
    return sinks.upsert(o, new, ["o_custkey"], "at")


@query("SELECT conv_id AS at, 'local' AS provider, role AS operation, 'm' AS model, 'ok' AS status, length(text) AS input_tokens, turn AS output_tokens, length(text) + turn AS total_tokens FROM conversations")
def call_log(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    calls = c.select(F.col("conv_id").alias("at"), F.lit("local").alias("provider"), F.col("role").alias("operation"), F.lit("m").alias("model"), F.lit("ok").alias("status"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"), "text")
    return enrichment.call_log(calls)


@query("""
SELECT r_name AS entity, n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' ELSE 'string' END AS type, n_nationkey % 2 = 0 AS required, '/' || lower(r_name) AS route, 'get' AS method, 'Successful response' AS said FROM nation JOIN region ON n_regionkey = r_regionkey""")
def published_document(spark, sf_dir):
    """The published JSON document taken apart again."""
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("n_nationkey")
    attributes = rows.select(F.col("r_name").alias("entity"), F.col("n_name").alias("name"), F.when(k % 3 == 0, "Int64?").when(k % 3 == 1, "decimal").otherwise("Guid").alias("type"), F.lit("d").alias("description"), (k % 2 == 0).alias("required"))
    operations = r.select(F.concat(F.lit("/"), F.lower("r_name")).alias("route"), F.lit("GET").alias("method"), F.lit("s").alias("summary"), F.lit("d").alias("domain"), F.col("r_name").alias("entity"))
    doc = publish.openapi_document("t", "1", operations, attributes)
    response = "struct<responses:map<string,struct<description:string>>>"
    schema = f"paths map<string,map<string,{response}>>, components struct<schemas:map<string,struct<properties:map<string,struct<type:string>>,required:array<string>>>>"
    one = doc.select(F.from_json("document", schema).alias("d"))
    ents = one.select("d", F.explode("d.components.schemas").alias("entity", "s")).select("d", "entity", "s.required", F.explode("s.properties").alias("name", "p"))
    paths = ents.select("*", F.concat(F.lit("/"), F.lower("entity")).alias("route"))
    method = F.map_keys(F.col("d.paths")[F.col("route")])[0]
    return paths.select("entity", "name", F.col("p.type").alias("type"), F.array_contains("required", F.col("name")).alias("required"), "route", method.alias("method"), F.col("d.paths")[F.col("route")][method]["responses"]["200"]["description"].alias("said"))


@query("""
WITH RECURSIVE t AS (SELECT DISTINCT r_name AS region, n_name AS full_name, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT a.region, a.full_name AS s, b.full_name AS t FROM t a JOIN t b ON a.region = b.region AND (b.k = a.k + 5 OR (a.k % 2 = 0 AND b.k = a.k + 10))),
w(region, n, d) AS (SELECT region, full_name, 0 FROM t WHERE k < 4 UNION SELECT w.region, e.t, d + 1 FROM w JOIN e ON e.region = w.region AND e.s = w.n)
SELECT region, 'Sys' AS system, n AS full_name, min(d) AS depth FROM w GROUP BY ALL""")
def type_closure(spark, sf_dir):
    n, r, k = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region"), F.col("n_nationkey")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    at = [F.col("r_name").alias("region"), F.lit("Sys").alias("system")]
    named = rows.select(*at, k.alias("k"), F.col("n_name").alias("full_name"))
    by_key = lambda d, alias: named.select("region", (F.col("k") - d).alias("k"), F.col("full_name").alias(alias))
    types = named.join(by_key(5, "base"), ["region", "k"], "left").join(by_key(10, "far"), ["region", "k"], "left")
    types = types.select("region", "system", "full_name", "base", F.when(F.col("k") % 2 == 0, F.array("far", F.lit("gone"))).alias("properties"))
    return discovery.type_closure(types, named.filter("k < 4").select("region", "system", "full_name"))


@query("""
WITH e AS (SELECT DISTINCT r_name AS region, 'T' || n_nationkey AS full_name, 'e' || n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT r_name AS region, s_suppkey AS k, s_nationkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT s.region, 'Sys' AS system, 'MAPS_TO' AS kind, a.id AS source, b.id AS target FROM s JOIN e a ON a.region = s.region AND a.full_name = 'T' || n JOIN e b ON b.region = s.region AND b.full_name = 'T' || (n + 5 * (k % 3))
UNION ALL SELECT DISTINCT s.region, 'Sys', 'REFERENCES', 'o' || k, b.id FROM s JOIN e b ON b.region = s.region AND b.full_name = 'T' || (n + 5 * (k % 4)) WHERE k % 4 > 1""")
def flow_edges(spark, sf_dir):
    n, r, s = (t(spark, sf_dir, x) for x in ("nation", "region", "supplier"))
    at = [F.col("r_name").alias("region"), F.lit("Sys").alias("system")]
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    made = s.join(rows, s.s_nationkey == rows.n_nationkey)
    key = lambda d: F.concat(F.lit("T"), F.col("s_nationkey") + d)
    k = F.col("s_suppkey")
    op = F.concat(F.lit("o"), "s_suppkey").alias("id")
    operations = made.select(*at, op, key(0).alias("request_type"), F.array(key(5)).alias("response_types"))
    mappings = F.array(F.struct(key(0).alias("from"), key(k % 3 * 5).alias("to")), F.struct(F.lit("Lost").alias("from"), key(0).alias("to")))
    related = F.array(F.struct(key(k % 4 * 5).alias("type"), F.lit("reads").alias("role")))
    flows = made.select(*at, op.alias("operation_id"), mappings.alias("mappings"), related.alias("related"))
    return discovery.flow_edges(operations, flows, rows.select(*at, F.concat(F.lit("T"), "n_nationkey").alias("full_name"), F.concat(F.lit("e"), "n_nationkey").alias("id")))


@query("""
WITH o AS (SELECT doc_id AS id, source AS v FROM documents), m AS (SELECT doc_id AS id, 'config' AS v FROM labels UNION SELECT -doc_id, 'config' FROM labels)
SELECT 'source' AS part, * FROM o UNION ALL SELECT 'source', * FROM m WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT 'diagnostic', id, v FROM m""")
def merge_config(spark, sf_dir):
    own = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("v"))
    lab = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("config").alias("v"))
    more = lab.unionByName(lab.withColumn("id", -F.col("id")))
    sources, diagnostics = discovery.merge_config(own, own.limit(0), more, more)
    return sources.select(F.lit("source").alias("part"), "*").unionByName(diagnostics.select(F.lit("diagnostic").alias("part"), "*"))


@query("SELECT user_id, min(event_id) AS event_id, last(event_type ORDER BY event_id) AS event_type, last(value ORDER BY event_id) AS value FROM events GROUP BY user_id")
def last_by_id(spark, sf_dir):
    return ranking.unique_by_id(t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id", last=True)


@query("""
WITH s AS (SELECT o_custkey AS k, o_orderkey AS span_id, o_orderdate AS a, 30 + o_orderkey % 90 AS n, o_orderstatus = 'F' AS owned, o_orderpriority LIKE '1%' AS named, o_orderpriority LIKE '%L%' AS qualified FROM orders),
p AS (SELECT o_orderkey AS point_id, s.* FROM orders JOIN s ON o_custkey = k AND o_orderdate BETWEEN a AND a + to_days(CAST(n AS INT))),
q AS (SELECT *, max(owned AND named) OVER w AS x, max(owned) OVER w AS y FROM p WINDOW w AS (PARTITION BY point_id)),
r AS (SELECT * FROM q WHERE CASE WHEN x THEN owned AND named WHEN y THEN owned ELSE true END),
u AS (SELECT *, max(qualified) OVER (PARTITION BY point_id) AS z FROM r), v AS (SELECT * FROM u WHERE qualified OR NOT z),
l AS (SELECT *, rank() OVER (PARTITION BY point_id ORDER BY n) AS rk FROM v)
SELECT point_id, span_id, count(*) OVER (PARTITION BY point_id) > 1 AS ambiguous FROM l WHERE rk = 1""")
def chunk_binding(spark, sf_dir):
    """The span that a place belongs to: named and owned ones first, then owned ones, then any; qualified ones first among these; then the smallest."""
    o = t(spark, sf_dir, "orders")
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    rest = [(F.col("o_orderstatus") == "F").alias("owned"), F.col("o_orderpriority").startswith("1").alias("named"), F.col("o_orderpriority").contains("L").alias("qualified")]
    spans = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("span_id"), day.alias("start"), (day + (F.col("o_orderkey") % 90 + 30) * 86_400_000_000).alias("end"), *rest)
    points = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("point_id"), day.alias("at"))
    owned, named = F.col("owned"), F.col("named")
    return joins.containing_spans(points, spans, ["k"], [owned & named, owned, F.col("qualified")]).select("point_id", "span_id", "ambiguous")


@query(r"""
WITH a AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS entity, 'a' || p_size AS name, p_type AS type, p_retailprice > 1000 AS required FROM part)
SELECT entity, name, lower(type) AS type_key, bool_and(required) AS required_in_all, count(*) AS n_sources FROM a GROUP BY ALL""")
def merged_attributes(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumn("source_key", F.concat_ws("/", "p_brand", "p_name"))
    sources = p.select("source_key", F.col("p_brand").alias("api"), F.col("p_name").alias("approved_name")).distinct()
    attributes = p.select("source_key", F.col("p_partkey").cast("string").alias("attribute_id"), F.concat(F.lit("a"), "p_size").alias("approved_name"), F.col("p_type").alias("type"), (F.col("p_retailprice") > 1000).alias("required"))
    entities, _ = catalog.review("eu", sources, attributes)
    rows = entities.select(text.comparison_key("name").alias("entity"), F.explode("attributes").alias("a"))
    return rows.select("entity", F.col("a.name").alias("name"), F.col("a.type_key").alias("type_key"), F.col("a.required_in_all").alias("required_in_all"), F.col("a.n_sources").alias("n_sources"))


@query("""
WITH f AS (SELECT DISTINCT p_brand AS api, p_name AS model, CASE WHEN p_size % 2 = 0 THEN 'List[' || p_type || ']' ELSE p_type END || CASE WHEN p_size > 25 THEN '?' ELSE '' END AS shown, 'f' || p_size AS field FROM part),
m AS (SELECT api, model, model || '(' || string_agg(field || ':' || shown, ',' ORDER BY field, shown) || ')' AS x FROM f GROUP BY api, model)
SELECT api, string_agg(x, ';' ORDER BY model) AS tree FROM m GROUP BY api""")
def model_tree(spark, sf_dir):
    p, n = t(spark, sf_dir, "part"), F.col("p_size")
    rows = p.select(F.col("p_brand").alias("api"), F.col("p_name").alias("model"), F.concat(F.lit("f"), n).alias("field"), F.col("p_type").alias("type"), (n % 2 == 0).alias("collection"), (n > 25).alias("nullable")).distinct()
    shown = F.transform("children", lambda m: F.concat(m["model"], F.lit("("), F.array_join(F.transform(m["children"], lambda x: F.concat(x["field"], F.lit(":"), x["type"])), ","), F.lit(")")))
    return catalog.model_tree(rows).select("api", F.array_join(shown, ";").alias("tree"))
