"""Registered queries: every operator over whole tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from specweave.functions import ids, similarity, text
from specweave.operators import aggregates, align, catalog, enrichment, graph, joins, publish, quality, ranking, retrieval, setops
from specweave.operators.vector_index import VectorIndex, build
from specweave.operators.versions import VersionTable
from specweave.plans.lineage import checkpoint_folder
from specweave.plans.registry import ORACLE_SQL, QUERIES, query, t
from specweave.sources import openapi

__all__ = ["ORACLE_SQL", "QUERIES"]


def terms_sql(x: str, word: str = "[a-z0-9_]+") -> str:
    x = f"replace({x}, 'ß', 'ss')"  # case folding, as far as these tables have it
    return f"list_distinct(regexp_extract_all(lower({x} || ' ' || regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '{word}'))"


# --- identities and scalars -----------------------------------------------------------------


@query(r"""
SELECT n_nationkey,
       'nation-' || substr(sha256('nation' || chr(30) || trim(r_name) || chr(31) || trim(n_name)), 1, 20) AS discovery_id,
       'nation-' || substr(sha256('nation' || chr(31) || r_name || chr(31) || n_name), 1, 20) AS joined_id,
       'nation-' || substr(sha256(r_name || chr(31) || n_name), 1, 20) AS regional_id, sha256(n_name) AS digest
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def stable_ids(spark, sf_dir):
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    return rows.select("n_nationkey", ids.discovery_id("nation", "r_name", "n_name").alias("discovery_id"), ids.joined_id("nation", "r_name", "n_name").alias("joined_id"), ids.regional_id("nation", "r_name", "n_name").alias("regional_id"), ids.digest("n_name").alias("digest"))


_STRINGS = """(SELECT DISTINCT s FROM (SELECT p_name AS s FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT c_mktsegment FROM customer
  UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT event_type FROM events UNION ALL SELECT c_name FROM customer))"""


@query(rf"""
SELECT s, regexp_replace(regexp_replace(lower(s), '[^a-z0-9]', '', 'g'), 'dto$', '') AS compact, regexp_replace(lower(s), '[^a-z0-9]', '', 'g') AS comparison,
  coalesce(nullif(lower(array_to_string(regexp_extract_all(regexp_replace(regexp_replace(s, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[A-Za-z0-9]+'), '_')), ''), 'unnamed') AS snake,
  regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  nullif(trim(regexp_replace(s, '\s+', ' ', 'g')), '') AS collapsed
FROM {_STRINGS}""")
def identifier_normalize(spark, sf_dir):
    cols = [("part", "p_name"), ("part", "p_type"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("events", "event_type"), ("customer", "c_name")]
    rows = None
    for name, c in cols:
        one = t(spark, sf_dir, name).select(F.col(c).alias("s")).distinct()
        rows = one if rows is None else rows.unionByName(one)
    s = "s"
    return rows.distinct().select(s, text.compact_name(s).alias("compact"), text.comparison_key(s).alias("comparison"), text.snake_identifier(s).alias("snake"), text.slug(s).alias("slug"), text.collapsed(s).alias("collapsed"))


_PATH = "regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


@query(rf"""
SELECT page_id, coalesce(nullif(regexp_replace(lower(regexp_replace(p, '/+$', '')), '\{{([^}}:]+):[^}}]+\}}', '{{\1}}', 'g'), ''), '/') AS plain,
       '/' || array_to_string(list_filter(string_split(lower(p), '/'), lambda x: x <> ''), '/') AS portfolio,
       len(list_filter(string_split(lower(p), '/'), lambda x: x <> '')) AS n_segments,
       replace(replace(p, '~', '~0'), '/', '~1') AS pointer
FROM (SELECT page_id, {_PATH} AS p FROM pages)""")
def route_normalize(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^(?s).*?://[^/?#]*([^?#]*)", 1).alias("p"))
    return p.select("page_id", text.plain_route("p").alias("plain"), text.portfolio_route("p").alias("portfolio"), F.size(text.route_segments("p")).cast("long").alias("n_segments"), text.pointer_escape("p").alias("pointer"))


@query(r"""
SELECT doc_id, array_to_string(list_transform(string_split(x, chr(10)), lambda l:
  CASE WHEN regexp_matches(l, '(?i)(password|passwd|api[_-]?key|secret|connectionstrings?|access[_-]?token)["'']?\s*[:=]') THEN '// [REDACTED secret-bearing line]' ELSE l END), chr(10)) AS redacted
FROM (SELECT doc_id, regexp_replace('api_key = ' || doc_id || chr(10) || text || chr(10) || 'use sk-abcdefghijkl' || doc_id, '(?i)\bsk-[a-z0-9_-]{12,}', '[REDACTED]', 'g') AS x FROM documents)""")
def redact_lines(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    planted = F.concat(F.lit("api_key = "), "doc_id", F.lit("\n"), "text", F.lit("\nuse sk-abcdefghijkl"), "doc_id")
    return d.select("doc_id", text.redacted(planted).alias("redacted"))


@query(r"""
SELECT p_partkey, p_name || CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 THEN '' ELSE '_' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) END AS component FROM part""")
def component_names(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_partkey").cast("string").alias("key"))
    return catalog.component_names(p, "p_name", "key", ["p_partkey"]).select("p_partkey", "component")


# --- retrieval --------------------------------------------------------------------------------


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest({terms_sql('text')}) AS term FROM documents) GROUP BY term")
def doc_frequency(spark, sf_dir):
    return aggregates.document_frequency(t(spark, sf_dir, "documents"), "doc_id", text.terms("text"))


_LEXICAL = f"""
words AS (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents),
asked AS (SELECT item_id, unnest({terms_sql('text')}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM words GROUP BY term),
scored AS (SELECT item_id, doc_id, round(sum(ln(1 + (SELECT count(*) FROM documents) / df::DOUBLE)), 6) AS score
           FROM asked JOIN words USING (term) JOIN df USING (term) GROUP BY item_id, doc_id),
lexical AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored QUALIFY rank < 40)"""


def _lexical(spark, sf_dir):
    return retrieval.lexical(t(spark, sf_dir, "documents").select("doc_id", "text"), t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(f"WITH {_LEXICAL} SELECT item_id, doc_id, score, rank FROM lexical")
def lexical_topk(spark, sf_dir):
    return _lexical(spark, sf_dir).select(F.col("query_id").alias("item_id"), "doc_id", "score", "rank")


@query("""
WITH p AS (SELECT *, row_number() OVER w AS place, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, place, CAST(used AS BIGINT) AS used, substr(text, 1, CAST(500 - used AS INT)) AS shown, length(text) > 500 - used AS truncated FROM p WHERE place <= 8 AND used < 500""")
def budget_snippets(spark, sf_dir):
    out = ranking.within_characters(t(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], "text", 8, 500)
    return out.select("conv_id", "turn", "place", "used", "shown", "truncated")


@query("""
WITH e AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS estimate FROM conversations),
r AS (SELECT *, row_number() OVER w AS call, CAST(coalesce(sum(estimate) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent
      FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, max(CASE WHEN estimate > 200 OR call > 6 OR spent + estimate + 50 > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS stop FROM r)
SELECT conv_id, turn, estimate, call, spent FROM s WHERE stop = 0""")
def token_budget_gate(spark, sf_dir):
    calls = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 4).alias("estimate"))
    return ranking.admitted(calls, ["conv_id"], [F.col("turn")], "estimate", run_tokens=300, requests=6, input_tokens=200, output_tokens=50)


_VECTORS = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score FROM {asked} q, v),
vector AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM near QUALIFY rank < 40)"""


def _by_vector(spark, sf_dir, asked):
    v = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return retrieval.by_vector(v, asked)


@query(f"WITH {_VECTORS.format(asked='(SELECT * FROM v WHERE vec_id % 20 = 0)')} SELECT query_id, doc_id, score, rank FROM vector")
def vector_topk(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0")  # the stated query set, against all vectors
    return _by_vector(spark, sf_dir, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")))


@query()
def vector_index(spark, sf_dir):
    """The queries of vector_topk against a stored index: cells as measured, so most of the same rows and no SQL."""
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    path = f"{checkpoint_folder(spark)}/vectors-{uuid4().hex}"
    build(e, path)
    return VectorIndex(spark, path).search(e.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(printf('%.1f', l_extendedprice * l_discount / 8) AS DOUBLE) AS one, CAST(printf('%.0f', l_quantity / 2) AS DOUBLE) AS none, CAST(printf('%.2f', l_extendedprice / 16) AS DOUBLE) AS two FROM lineitem""")
def exact_rounding(spark, sf_dir):
    r = text.rounded
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(F.col("l_extendedprice") * F.col("l_discount") / 8, 1).alias("one"), r(F.col("l_quantity") / 2, 0).alias("none"), r(F.col("l_extendedprice") / 16, 2).alias("two"))


@query("""
WITH a AS (SELECT o_custkey AS k, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT k, s, n, rank() OVER (PARTITION BY k ORDER BY s) AS version FROM a)
SELECT k, s, n, version FROM b""")
def versioned_records(spark, sf_dir):
    """Records of each customer, a commit for each order status: a customer's records are numbered in order of commits."""
    o = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))
    table = VersionTable(spark, f"{checkpoint_folder(spark)}/versions-{uuid4().hex}")
    for status in sorted(r[0] for r in o.select("s").distinct().collect()):  # a handful
        table.append(o.filter(F.col("s") == status), ["k"])
    return table.read().select("k", "s", "n", F.col("version").cast("long").alias("version"))


@query(f"""
WITH {_LEXICAL}, {_VECTORS.format(asked='(SELECT v.* FROM v JOIN benchmark ON vec_id = item_id)')},
lists AS (SELECT item_id, doc_id, rank, 'lexical' AS method FROM lexical UNION ALL SELECT query_id, doc_id, rank, 'vector' FROM vector)
SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(method, '+' ORDER BY method) AS reason FROM lists GROUP BY item_id, doc_id""")
def hybrid_rrf(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").join(t(spark, sf_dir, "benchmark"), F.col("vec_id") == F.col("item_id"))
    vector = _by_vector(spark, sf_dir, e.select(F.col("item_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")))
    fused = retrieval.fuse(_lexical(spark, sf_dir).withColumn("method", F.lit("lexical")), vector.withColumn("method", F.lit("vector")))
    return fused.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 9).alias("score"), "reason")


@query("""
WITH n AS (SELECT conv_id AS query, turn AS node, round(length(text) / 100000.0, 6) AS score FROM conversations),
seeds AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rn FROM n QUALIFY rn <= 3),
raised AS (SELECT query, node + d AS node, CASE WHEN role = 'user' THEN 0.5 ELSE 1.0 END AS score FROM (
  SELECT s.query, s.node, d, CASE WHEN d = 1 THEN a.role ELSE b.role END AS role FROM seeds s CROSS JOIN (VALUES (1), (-1)) x(d)
  JOIN conversations a ON a.conv_id = s.query AND a.turn = s.node JOIN conversations b ON b.conv_id = s.query AND b.turn = s.node + d))
SELECT query, node, round(max(score), 6) AS score FROM (SELECT query, node, score FROM n UNION ALL SELECT query, node, score FROM raised) GROUP BY query, node""")
def neighbor_expand(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    scores = c.select(F.col("conv_id").alias("query"), F.concat_ws(":", "conv_id", "turn").alias("node"), F.round(F.length("text") / 100000, 6).alias("score"), "turn")
    seeds = ranking.top_k(scores, ["query"], [F.desc("score"), "turn"], 3, "place")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    edges = c.join(nxt, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("source"), F.concat(F.col("conv_id"), F.lit(":"), F.col("turn") + 1).alias("target"), F.lit("NEXT").alias("kind"), F.when(F.col("role") == "user", "candidate").otherwise("syntax").alias("resolution"))
    out = graph.expand(scores, seeds, edges)
    return out.select("query", F.split_part("node", F.lit(":"), F.lit(2)).cast("long").alias("node"), F.round("score", 6).alias("score"))


@query(f"""
WITH {_LEXICAL}, fused AS (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS score FROM lexical),
bound AS (SELECT DISTINCT item_id, doc_id FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\n')) AS text FROM documents) JOIN benchmark USING (text)),
named AS (SELECT a.item_id, t.item_id AS target FROM benchmark a JOIN benchmark t ON lower(a.text) = lower(t.text)),
exact AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY place, doc_id) - 1 AS rank FROM (SELECT n.item_id, doc_id, min((target, doc_id)) AS place FROM named n JOIN bound b ON b.item_id = target GROUP BY ALL)),
scores AS (SELECT item_id, doc_id, 10.0::DOUBLE - rank / 1000 AS s, true AS hit FROM exact UNION ALL SELECT item_id, doc_id, score, false FROM fused WHERE (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM exact)),
seeds AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS n, max(hit) OVER (PARTITION BY item_id) AS any_hit FROM scores QUALIFY hit OR (NOT any_hit AND n <= 3)),
edges AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents QUALIFY b IS NOT NULL),
raised AS (SELECT item_id, doc_id, max(s) AS s FROM (SELECT item_id, doc_id, s FROM scores UNION ALL SELECT item_id, b, 1.0 FROM seeds JOIN edges ON a = doc_id UNION ALL SELECT item_id, a, 1.0 FROM seeds JOIN edges ON b = doc_id) GROUP BY ALL),
once AS (SELECT item_id, doc_id, s, text FROM raised JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id, sha256(text) ORDER BY s DESC, doc_id) = 1),
placed AS (SELECT *, row_number() OVER w AS place, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM once WINDOW w AS (PARTITION BY item_id ORDER BY s DESC, doc_id))
SELECT item_id AS query_id, place, doc_id, round(s, 6) AS relevance, substr(text, 1, CAST(12000 - used AS INT)) AS text, length(text) > 12000 - used AS truncated FROM placed WHERE place <= 8 AND used < 12000""")
def retrieve_context(spark, sf_dir):
    """Hybrid retrieval end to end: exact hits, fused ranks, neighbours, identity dedup and the character budget."""
    d = t(spark, sf_dir, "documents")
    b = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    fused = retrieval.fuse(_lexical(spark, sf_dir).withColumn("method", F.lit("lexical")))
    chunks = d.select("doc_id", ids.digest("text").alias("identity"), "text")
    targets = b.select(F.col("query_id").alias("target_id"), F.col("query_id").alias("place"), F.array("text").alias("aliases"))
    bound = d.select("doc_id", F.explode(F.split("text", r"\n\n")).alias("text")).join(b, "text").select(F.col("query_id").alias("target_id"), "doc_id", F.col("doc_id").alias("place"))
    same = d.select("source", "doc_id")
    w = Window.partitionBy("source").orderBy("doc_id")
    edges = same.select(F.col("doc_id").alias("source"), F.lead("doc_id").over(w).alias("target"), F.lit("NEXT").alias("kind"), F.lit("syntax").alias("resolution")).filter("target is not null")
    return retrieval.retrieve(fused, retrieval.exact_hits(targets, bound, b), edges, chunks)


@query("""
WITH RECURSIVE l AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) - 1 AS line FROM (
  SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS x FROM documents WHERE length(text) > 1800)),
c AS (SELECT doc_id, line, t, unnest(generate_series(0, CAST(floor(greatest(length(t) - 1, 0) / 1800) AS BIGINT))) AS n FROM l),
p AS (SELECT doc_id, line, substr(t, n * 1800 + 1, 1800) AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY line, n) AS i FROM c),
w AS (SELECT doc_id, i, line AS first, line AS last, piece AS text, 0 AS win FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN w.text <> '' AND length(w.text) + length(p.piece) + 1 > 1800 THEN p.line ELSE w.first END, p.line,
    CASE WHEN w.text <> '' AND length(w.text) + length(p.piece) + 1 > 1800 THEN p.piece ELSE w.text || CASE WHEN w.text <> '' THEN chr(10) ELSE '' END || p.piece END,
    w.win + CASE WHEN w.text <> '' AND length(w.text) + length(p.piece) + 1 > 1800 THEN 1 ELSE 0 END FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
done AS (SELECT CAST(doc_id AS VARCHAR) AS parent_id, win AS "window", CAST(first + 1 AS INT) AS start_line, CAST(last + 1 AS INT) AS end_line, text FROM w QUALIFY i = max(i) OVER (PARTITION BY doc_id, win))
SELECT *, sha256(concat_ws(':', parent_id, 'window', "window", start_line, end_line, text)) AS id FROM done WHERE text <> ''""")
def chunk_windows(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit(1).alias("start_line"), "text")
    return retrieval.windows_of(d)


@query(r"""
WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS x FROM documents),
p AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i, array_to_string(x[:2], chr(10)) AS header FROM s),
w AS (SELECT doc_id, i, trim(t, E' \t\n\r') AS cur, 0 AS ordinal FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN w.cur <> '' AND length(trim(w.cur || chr(10) || p.t, E' \t\n\r')) > 5000 THEN trim(p.header || chr(10) || p.t, E' \t\n\r') ELSE trim(w.cur || chr(10) || p.t, E' \t\n\r') END,
    w.ordinal + CASE WHEN w.cur <> '' AND length(trim(w.cur || chr(10) || p.t, E' \t\n\r')) > 5000 THEN 1 ELSE 0 END FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
SELECT doc_id, ordinal, substr(cur, 1, 5000) AS chunk FROM (SELECT * FROM w QUALIFY i = max(i) OVER (PARTITION BY doc_id, ordinal)) WHERE cur <> ''""")
def section_chunks(spark, sf_dir):
    chunks = retrieval.section_chunks(F.filter(F.split("text", "\n"), lambda s: s != ""))
    return t(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(chunks).alias("ordinal", "chunk")).filter("chunk is not null")  # outer: a plain one is preceded by a filter that packs again


@query("""
WITH u AS (SELECT label, i, e[i] / sqrt(list_dot_product(e, e)) AS x FROM (SELECT label, embedding::DOUBLE[] AS e FROM embeddings), generate_series(1, 64) g(i)),
s AS (SELECT label, i, sum(x) AS x FROM u GROUP BY label, i)
SELECT label, CAST(i - 1 AS INT) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM s""")
def pooled_embedding(spark, sf_dir):
    v = t(spark, sf_dir, "embeddings").select(F.col("label").alias("owner"), F.col("embedding").cast("array<double>").alias("vector"))
    return retrieval.pooled(v).select(F.col("owner").alias("label"), F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))


_PIECES = ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {a}, 12) AS UBIGINT)), 0) AS VARCHAR)" for a in (1, 13, 25, 37, 49))


@query(f"""
SELECT sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_PIECES}) || chr(10) || 'embedder=local' || chr(10) || 'version=1') AS fingerprint FROM (SELECT sha256(CAST(doc_id AS VARCHAR) || '=' || sha256(text)) AS h FROM documents)""")
def index_fingerprint(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), ids.digest("text").alias("sha256"))
    return retrieval.fingerprint(d, {"version": "1", "embedder": "local"})


# --- joins --------------------------------------------------------------------------------------


@query("""
WITH l AS (SELECT CASE WHEN c_nationkey < 13 THEN c_custkey ELSE -c_custkey END AS id, c_mktsegment AS kind, CASE WHEN c_nationkey > 6 THEN 'yes' ELSE 'no' END AS required FROM customer),
r AS (SELECT user_id AS id, CASE WHEN count(*) % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS kind, CASE WHEN count(*) > 60 THEN 'yes' ELSE 'no' END AS required FROM events GROUP BY user_id)
SELECT coalesce(l.id, r.id) AS id, l.kind AS left_kind, l.required AS left_required, r.kind AS right_kind, r.required AS right_required,
  CASE WHEN r.id IS NULL THEN 'CODE_ONLY' WHEN l.id IS NULL THEN 'SPEC_ONLY' ELSE 'MATCHED' END AS outcome,
  CASE WHEN r.id IS NULL OR l.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN l.kind IS DISTINCT FROM r.kind THEN 'kind' END, CASE WHEN l.required IS DISTINCT FROM r.required THEN 'required' END) END AS conflicts
FROM l FULL JOIN r ON l.id = r.id""")
def reconcile_outer(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") < 13, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("id"), F.col("c_mktsegment").alias("kind"), F.when(F.col("c_nationkey") > 6, "yes").otherwise("no").alias("required"))
    e = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.when(F.count("*") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("kind"), F.when(F.count("*") > 60, "yes").otherwise("no").alias("required"))
    return joins.reconcile(c, e, ["id"], ["kind", "required"]).withColumn("conflicts", F.array_join("conflicts", ","))


@query(rf"""
WITH codes AS (SELECT page_id, list_filter(string_split(lower(regexp_extract(url, '(?s)^.*?://([^?#]*)', 1)), '/'), lambda x: x <> '') AS seg FROM pages),
specs AS (SELECT DISTINCT list_filter(string_split(lower({_PATH}), '/'), lambda x: x <> '') AS seg FROM pages),
p AS (SELECT DISTINCT array_to_string(s.seg, '/') AS spec_id, c.page_id AS code_id FROM specs s JOIN codes c ON len(s.seg) > 0 AND len(c.seg) >= len(s.seg) AND c.seg[len(c.seg) - len(s.seg) + 1:] = s.seg)
SELECT spec_id, code_id, count(*) OVER (PARTITION BY spec_id) AS candidates FROM p""")
def suffix_join(spark, sf_dir):
    p = t(spark, sf_dir, "pages")
    whole = F.regexp_extract("url", r"^(?s).*?://([^?#]*)", 1)
    codes = p.select(F.lit("GET").alias("method"), F.col("page_id").alias("code_id"), text.route_segments(whole).alias("segments"))
    path = text.route_segments(F.regexp_extract("url", r"^(?s).*?://[^/?#]*([^?#]*)", 1))
    specs = p.select(F.lit("GET").alias("method"), path.alias("segments")).distinct().withColumn("spec_id", F.array_join("segments", "/"))
    return joins.suffix_join(specs, codes, ["method"]).select("spec_id", "code_id", "candidates")


def _route_sql(route: str) -> str:
    key = rf"CASE WHEN regexp_replace({route}, '/+$', '') = '' THEN '/' ELSE regexp_replace(lower(regexp_replace({route}, '/+$', '')), '\{{([^}}:]+):[^}}]+\}}', '{{\1}}', 'g') END"
    return f"{key} AS key, list_transform(list_filter(string_split({key}, '/'), lambda x: x <> ''), lambda x: CASE WHEN x LIKE '{{%' THEN '{{}}' ELSE x END) AS seg"


@query(rf"""
WITH RECURSIVE p AS (SELECT page_id, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT split_part(host, '.', -1) AS region, 'spec-' || page_id AS id, path AS route, {_route_sql('path')} FROM p),
c AS (SELECT split_part(host, '.', -1) AS region, 'code-' || page_id AS id, {_route_sql("('/' || host || path)")} FROM p),
e AS (SELECT region, key, max(id) AS id FROM c GROUP BY ALL),
f AS (SELECT s.region, s.id, row_number() OVER (PARTITION BY s.region ORDER BY len(s.seg) DESC, s.route, s.id) AS place, any_value(e.id) AS hit,
        list(c.id) FILTER (c.id IS NOT NULL) AS cands
      FROM s LEFT JOIN e USING (region, key) LEFT JOIN c ON c.region = s.region AND len(s.seg) > 0 AND len(c.seg) >= len(s.seg) AND c.seg[len(c.seg) - len(s.seg) + 1:] = s.seg GROUP BY s.region, s.id, s.seg, s.route),
walk AS (
  SELECT DISTINCT region, 0::BIGINT AS place, NULL::VARCHAR AS spec_id, NULL::VARCHAR AS code_id, NULL::VARCHAR AS how, []::VARCHAR[] AS used FROM f UNION ALL
  SELECT region, place, id, CASE WHEN hit IS NOT NULL THEN hit WHEN len(open) = 1 THEN open[1] END, CASE WHEN hit IS NOT NULL THEN 'exact' WHEN len(open) = 1 THEN 'suffix' WHEN len(open) > 1 THEN 'ambiguous' ELSE 'none' END,
         CASE WHEN hit IS NOT NULL THEN list_append(used, hit) WHEN len(open) = 1 THEN list_append(used, open[1]) ELSE used END
  FROM (SELECT f.*, used, list_filter(coalesce(cands, []), lambda x: NOT list_contains(used, x)) AS open FROM walk JOIN f USING (region) WHERE f.place = walk.place + 1))
SELECT region, spec_id, code_id, how FROM walk WHERE spec_id IS NOT NULL""")
def claim_routes(spark, sf_dir):
    """Order-dependent matching of spec routes to code routes, a scope for each top-level domain."""
    p = t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^(?s).*?://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", r"^(?s).*?://[^/?#]*([^?#]*)", 1).alias("path"))
    rows = p.withColumn("region", F.substring_index("host", ".", -1)).withColumn("method", F.lit("GET"))
    of = lambda route, pre: rows.select("region", F.concat(F.lit(pre), "page_id").alias("id"), "method", route.alias("route")).withColumn("key", text.plain_route("route")).withColumn("segments", text.route_segments("route"))
    return joins.claim_routes(of(F.col("path"), "spec-"), of(F.concat(F.lit("/"), "host", "path"), "code-"), ["region"])


@query(rf"""
WITH i AS (SELECT page_id, regexp_extract(url, '(?s)^.*?://([^?#]*)', 1) AS path FROM pages),
dirs AS (SELECT DISTINCT regexp_extract(path, '^[^/]*/[^/]*', 0) AS directory FROM i UNION SELECT DISTINCT regexp_extract(path, '^[^/]*', 0) FROM i),
c AS (SELECT page_id, i.path, max({{'n': length(directory), 'd': directory}}) AS b FROM i LEFT JOIN dirs ON i.path = directory OR starts_with(i.path, directory || '/') GROUP BY page_id, i.path)
SELECT page_id AS item, path, 'owner of ' || b.d AS owner FROM c""")
def longest_prefix_join(spark, sf_dir):
    items = t(spark, sf_dir, "pages").select(F.col("page_id").alias("item"), F.regexp_extract("url", r"^(?s).*?://([^?#]*)", 1).alias("path"))
    dirs = items.select(F.regexp_extract("path", "^[^/]*/[^/]*", 0).alias("directory")).union(items.select(F.regexp_extract("path", "^[^/]*", 0))).distinct()
    return joins.longest_prefix_join(items, dirs.select(F.concat(F.lit("owner of "), "directory").alias("owner"), "directory"))


@query("""
WITH s AS (SELECT o_custkey AS k, o_orderkey AS span_id, o_orderdate AS a, o_orderdate + to_days(CAST(30 + o_orderkey % 90 AS INT)) AS b FROM orders),
p AS (SELECT o_orderkey AS point_id, span_id, rank() OVER (PARTITION BY o_orderkey ORDER BY b - a) AS r FROM orders JOIN s ON o_custkey = k AND o_orderdate BETWEEN a AND b)
SELECT point_id, span_id, count(*) OVER (PARTITION BY point_id) > 1 AS ambiguous FROM p WHERE r = 1""")
def span_containment(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    spans = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("span_id"), day.alias("start"), (day + (F.col("o_orderkey") % 90 + 30) * 86_400_000_000).alias("end"))
    points = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("point_id"), day.alias("at"))
    return joins.containing_spans(points, spans, ["k"]).select("point_id", "span_id", "ambiguous")


@query("""
WITH refs AS (SELECT DISTINCT p_brand AS source, unnest(string_split(lower(p_name), ' ')) AS name FROM part),
defs AS (SELECT DISTINCT 'part ' || p_size AS target, unnest(string_split(lower(p_type || ' ' || p_name), ' ')) AS name FROM part),
hit AS (SELECT source, name, target, count(*) OVER w AS found, row_number() OVER (PARTITION BY source, name ORDER BY target) AS rn FROM refs JOIN defs USING (name) WHERE source <> target WINDOW w AS (PARTITION BY source, name))
SELECT source, name, target, found FROM hit WHERE rn <= 20
UNION ALL SELECT source, name, NULL, 0 FROM refs WHERE (source, name) NOT IN (SELECT (source, name) FROM hit)""")
def name_reference_join(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    refs = p.select(F.col("p_brand").alias("source"), F.explode(F.split(F.lower("p_name"), " ")).alias("name"))
    defs = p.select(F.concat(F.lit("part "), "p_size").alias("target"), F.explode(F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ")).alias("name"))
    return joins.reference_join(refs, defs)


@query("""
SELECT o_custkey AS entity_id, 'order ' || o_orderpriority AS operation, 'Request' AS usage FROM orders UNION
SELECT o_custkey, 'line ' || l_returnflag, 'Response ' || (200 + l_linenumber) FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def entity_usages(spark, sf_dir):
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    ops = o.select(F.col("o_custkey").alias("request_entity_id"), F.concat(F.lit("order "), "o_orderpriority").alias("operation"))
    gives = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("entity_id"), F.concat(F.lit("line "), "l_returnflag").alias("operation"), (F.col("l_linenumber") + 200).alias("status"))
    return joins.usages(ops, gives)


@query("""
SELECT n_nationkey, coalesce(last(c_name ORDER BY c_name), 'Unknown') AS c_name FROM nation LEFT JOIN customer ON CASE WHEN c_acctbal > 9000 THEN c_nationkey ELSE 100 + c_nationkey END = n_nationkey GROUP BY n_nationkey""")
def name_lookup(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 9000, F.col("c_nationkey")).otherwise(F.col("c_nationkey") + 100).alias("n_nationkey"), "c_name")
    return joins.named(t(spark, sf_dir, "nation").select("n_nationkey"), c, "n_nationkey", "c_name")


# --- aggregates, catalogs, reviews ------------------------------------------------------------------


@query("""
SELECT l_returnflag AS kind, l_suppkey AS source, p_brand AS target, string_agg(DISTINCT l_linestatus || l_linenumber, ',' ORDER BY l_linestatus || l_linenumber) AS evidence
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def evidence_union(spark, sf_dir):
    li, p = t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "part")
    e = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("source"), F.col("p_brand").alias("target"), F.array(F.concat("l_linestatus", "l_linenumber")).alias("evidence"))
    return aggregates.merge_edges(e).withColumn("evidence", F.array_join("evidence", ","))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _TABLES))
def summary_counts(spark, sf_dir):
    return aggregates.counts({n: t(spark, sf_dir, n) for n in _TABLES})


_FKS = [("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"), ("events", "user_id", "customer"), ("labels", "doc_id", "documents")]
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id"}


@query(" UNION ALL ".join(
    [f"SELECT 'unique {n}.{k}' AS name, count(*) AS violations FROM (SELECT {k} FROM {n} GROUP BY {k} HAVING count(*) > 1)" for n, k in _KEYS.items()]
    + [f"SELECT '{c}.{x} in {p}', count(*) FROM {c} WHERE {x} IS NOT NULL AND {x} NOT IN (SELECT {_KEYS[p]} FROM {p})" for c, x, p in _FKS]))
def model_violations(spark, sf_dir):
    return quality.model_violations({n: (t(spark, sf_dir, n), k) for n, k in _KEYS.items()}, _FKS)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return aggregates.duplicate_keys(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def coverage_gaps(spark, sf_dir):
    explained = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return aggregates.coverage(t(spark, sf_dir, "documents"), ["doc_id"], t(spark, sf_dir, "labels"), explained)


_CONFIDENCE = "least(CASE WHEN quality = 1 THEN 0.95 ELSE 0.75 END, CASE WHEN toxic = 1 THEN 0.60 ELSE 0.99 END)"


@query(f"""
WITH c AS (SELECT doc_id, {_CONFIDENCE} AS confidence FROM labels)
SELECT doc_id, CASE WHEN confidence >= 0.9 THEN 'auto' WHEN confidence >= 0.7 THEN 'review' ELSE 'needsMoreContext' END AS band FROM c""")
def confidence_bands(spark, sf_dir):
    own = F.when(F.col("quality") == 1, 0.95).otherwise(0.75).alias("a"), F.when(F.col("toxic") == 1, 0.60).otherwise(0.99).alias("b")
    rows = t(spark, sf_dir, "labels").select("doc_id", *own).select("doc_id", F.least("a", "b").alias("confidence"))
    return aggregates.bands(rows, "confidence", "doc_id")


@query("""
WITH o AS (SELECT CASE WHEN lang = 'fr' THEN -doc_id ELSE doc_id END AS doc_id, sha256(text) AS h FROM documents), n AS (SELECT CASE WHEN lang = 'es' THEN -doc_id ELSE doc_id END AS doc_id, sha256(CASE WHEN lang = 'de' THEN upper(source) ELSE text END) AS h FROM documents)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h""")
def snapshot_diff(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    moved = lambda lang: F.when(F.col("lang") == lang, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id")
    old = d.select(moved("fr"), ids.digest("text").alias("h"))
    new = d.select(moved("es"), ids.digest(F.when(F.col("lang") == "de", F.upper("source")).otherwise(F.col("text"))).alias("h"))
    return setops.snapshot_diff(old, new, "doc_id", "h")


@query("""
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, lower(o_orderpriority) ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey DESC) = 1""")
def best_run_per_key(spark, sf_dir):
    best = ranking.best_run(t(spark, sf_dir, "orders"), [F.col("o_custkey"), F.lower("o_orderpriority")], ["o_totalprice", "o_orderdate", "o_orderkey"])
    return best.select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@query("""
SELECT n_nationkey AS entity_id, n_name AS name, count(DISTINCT c_custkey) AS fields, coalesce(string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority), 'Not linked') AS endpoints,
       coalesce(string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus), 'Not linked') AS usage
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def catalog_rows(spark, sf_dir):
    n, c, o = (t(spark, sf_dir, x) for x in ("nation", "customer", "orders"))
    used = c.join(o, c.c_custkey == o.o_custkey).select(F.col("c_nationkey").alias("entity_id"), F.col("o_orderpriority").alias("operation"), F.col("o_orderstatus").alias("usage"))
    return catalog.model_rows(n.select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name")), c.select(F.col("c_nationkey").alias("entity_id")), used)


@query("""
WITH d AS (SELECT CAST(n_regionkey AS VARCHAR) AS entity_id, CASE WHEN c_acctbal > 9900 THEN c_mktsegment END AS domain FROM nation JOIN customer ON c_nationkey = n_nationkey)
SELECT r_name AS entity_id, CASE WHEN r_regionkey = 0 THEN 'Own' WHEN count(DISTINCT domain) = 1 THEN min(domain) WHEN count(DISTINCT domain) > 1 THEN 'Multiple analyzed domains' ELSE 'Awaiting API Analyzer' END AS domain
FROM region LEFT JOIN d ON entity_id = CAST(r_regionkey AS VARCHAR) GROUP BY r_name, r_regionkey""")
def entity_domains(spark, sf_dir):
    r, n, c = (t(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    rows = n.join(c, n.n_nationkey == c.c_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    own = r.select(F.col("r_name").alias("entity_id"), F.when(F.col("r_regionkey") == 0, "Own").alias("domain"))
    return catalog.entity_domains(own, rows.select(F.col("r_name").alias("entity_id"), F.col("c_custkey").alias("operation")), rows.select(F.col("c_custkey").alias("operation"), F.when(F.col("c_acctbal") > 9900, F.col("c_mktsegment")).otherwise(catalog.AWAITING).alias("domain")))


@query("""
WITH leaf AS (SELECT DISTINCT r_name, n_name, c_mktsegment FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey),
mid AS (SELECT r_name, n_name, n_name || '[' || string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) || ']' AS x FROM leaf GROUP BY r_name, n_name)
SELECT r_name AS domain, string_agg(x, ';' ORDER BY n_name) AS tree FROM mid GROUP BY r_name""")
def domain_tree(spark, sf_dir):
    r, n, c = (t(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    rows = r.join(n, r.r_regionkey == n.n_regionkey).join(c, n.n_nationkey == c.c_nationkey).select("r_name", "n_name", "c_mktsegment").distinct()
    nested = aggregates.tree(rows, ["r_name", "n_name"], ["c_mktsegment"])
    shown = F.transform("children", lambda x: F.concat(x["n_name"], F.lit("["), F.array_join(F.transform(x["children"], lambda y: y["c_mktsegment"]), ","), F.lit("]")))
    return nested.select(F.col("r_name").alias("domain"), F.array_join(shown, ";").alias("tree"))


@query(r"""
WITH m AS (SELECT doc_id, sha256(text) AS k, row_number() OVER (PARTITION BY sha256(text) ORDER BY lower(source), doc_id) AS place FROM documents)
SELECT 'regional-entity-' || substr(sha256('eu' || chr(31) || k), 1, 20) AS regional_id, doc_id, place, CASE WHEN place = 1 THEN 'Retained' ELSE 'Merged duplicate entity' END AS action FROM m""")
def dedup_truth_map(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "source", ids.digest("text").alias("k"))
    out = aggregates.retain_first(d, ["k"], [F.lower("source"), "doc_id"], "Merged duplicate entity")
    return out.select(ids.regional_id("regional-entity", F.lit("eu"), "k").alias("regional_id"), "doc_id", F.col("place").cast("long").alias("place"), "action")


@query(r"""
WITH s AS (SELECT DISTINCT p_brand || '/' || p_name AS source_key, p_brand AS api, p_name AS approved_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS entity_key FROM part),
a AS (SELECT entity_key, lower(p_type) AS type_key, 'a' || p_size AS name, count(*) AS n FROM s JOIN part ON source_key = p_brand || '/' || p_name GROUP BY ALL),
n AS (SELECT entity_key, count(*) AS n_attributes FROM (SELECT DISTINCT entity_key, type_key, name FROM a) GROUP BY entity_key)
SELECT 'regional-entity-' || substr(sha256('eu' || chr(31) || entity_key), 1, 20) AS id, first(approved_name ORDER BY lower(api), source_key) AS name, count(*) AS n_sources, count(*) - 1 AS n_duplicates,
       string_agg(DISTINCT api, ',' ORDER BY api) AS apis, any_value(n_attributes) AS n_attributes
FROM s JOIN n USING (entity_key) GROUP BY entity_key""")
def dedup_attributes(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumn("source_key", F.concat_ws("/", "p_brand", "p_name"))
    sources = p.select("source_key", F.col("p_brand").alias("api"), F.col("p_name").alias("approved_name")).distinct()
    attributes = p.select("source_key", F.col("p_partkey").cast("string").alias("attribute_id"), F.concat(F.lit("a"), "p_size").alias("approved_name"), F.col("p_type").alias("type"), (F.col("p_retailprice") > 1000).alias("required"))
    entities, _ = catalog.review("eu", sources, attributes)
    return entities.select("id", "name", "n_sources", "n_duplicates", F.array_join("apis", ",").alias("apis"), F.size("attributes").cast("long").alias("n_attributes"))


@query("""
SELECT 'intra' AS conflict, p_brand AS scope, p_name AS effective, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand, p_name HAVING n > 1
UNION ALL SELECT 'cross', NULL, p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY p_name HAVING n > 1""")
def naming_conflicts(spark, sf_dir):
    return aggregates.naming_conflicts(t(spark, sf_dir, "part"), "p_brand", "p_type", "p_name")


@query("SELECT p_brand, p_name, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY ALL HAVING count(DISTINCT p_type) > 1")
def conflicting_types(spark, sf_dir):
    return joins.conflicting_types(t(spark, sf_dir, "part"), ["p_brand", "p_name"], "p_type").withColumn("types", F.array_join("types", ","))


@query("""
SELECT conv_id, turn, row_number() OVER w AS call, length(text) AS tokens, CAST(sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_tokens FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def usage_totals(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("tokens"))
    return aggregates.usage_totals(c, "conv_id", "turn", "tokens").select("conv_id", "turn", F.col("call").cast("long").alias("call"), "tokens", "total_tokens")


@query("SELECT user_id, max(event_id) AS event_id, first(event_type ORDER BY event_id) AS event_type, first(value ORDER BY event_id) AS value FROM events GROUP BY user_id")
def unique_by_id(spark, sf_dir):
    return ranking.unique_by_id(t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("""
WITH r AS (SELECT printf('%012d', doc_id) AS path, n_chars AS length, n_chars <= 9000 AS fits,
  sum((n_chars <= 9000)::INT) OVER w AS n, sum(CASE WHEN n_chars <= 9000 THEN n_chars ELSE 0 END) OVER w AS total FROM documents WINDOW w AS (ORDER BY printf('%012d', doc_id) ROWS UNBOUNDED PRECEDING))
SELECT path, length, CASE WHEN NOT fits THEN 'file too large' WHEN n > 700 THEN 'too many files' WHEN total > 1000000 THEN 'scan too large' END AS reason FROM r""")
def scan_caps(spark, sf_dir):
    files = t(spark, sf_dir, "documents").select(F.format_string("%012d", "doc_id").alias("path"), F.col("n_chars").alias("length"))
    return ranking.first_files(files, 700, 9_000, 1_000_000)


# --- graphs ---------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS source, 'n' || n_nationkey AS target FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
w(root, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT root, target, depth + 1 FROM w JOIN e ON node = source)
SELECT root, depth, count(DISTINCT node) AS n FROM w GROUP BY root, depth""")
def reachable_closure(spark, sf_dir):
    r, n, c, o = (t(spark, sf_dir, x) for x in ("region", "nation", "customer", "orders"))
    key = lambda p, k: F.concat(F.lit(p), F.col(k))
    edges = n.select(key("r", "n_regionkey").alias("source"), key("n", "n_nationkey").alias("target"))
    edges = edges.union(c.select(key("n", "c_nationkey"), key("c", "c_custkey"))).union(o.select(key("c", "o_custkey"), key("o", "o_orderkey")))
    seeds = r.select(key("r", "r_regionkey").alias("root"), key("r", "r_regionkey").alias("node"))
    return graph.closure(seeds, edges).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query("SELECT 'n' || c_nationkey AS source, CASE WHEN c_acctbal > 0 THEN 'c' ELSE 'lost' END || c_custkey AS target FROM customer WHERE c_acctbal <= 0")
def dangling_edges(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    edges = c.select(F.concat(F.lit("n"), "c_nationkey").alias("source"), F.concat(F.when(F.col("c_acctbal") > 0, "c").otherwise("lost"), "c_custkey").alias("target"))
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("id")).union(c.select(F.concat(F.lit("n"), "c_nationkey")))
    return graph.dangling(edges, nodes, "id")


@query("SELECT o_orderkey, coalesce(m.new, o_custkey) AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey AS old, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS new FROM customer) m ON old = o_custkey")
def id_remap(spark, sf_dir):
    w = Window.partitionBy("c_nationkey", "c_mktsegment")
    remap = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("old"), F.min("c_custkey").over(w).alias("new"))
    return graph.rename(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", remap)


# --- alignment -------------------------------------------------------------------------------------

_NAMES = "(SELECT DISTINCT p_name AS name FROM part)"


@query(rf"""
WITH a AS (SELECT name, {terms_sql('name', '[a-z0-9]+')} AS w FROM {_NAMES}),
b AS (SELECT item_id, text, {terms_sql('text', '[a-z0-9]+')} AS w FROM benchmark UNION ALL SELECT -p_partkey, p_type || ' ' || p_name, {terms_sql("(p_type || ' ' || p_name)", '[a-z0-9]+')} FROM part),
s AS (SELECT a.name, b.text AS candidate, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE * 100, 6) AS score FROM a, (SELECT DISTINCT text, w FROM b) b)
SELECT name, max(struct_pack(score := score, candidate := candidate)).score AS score, max(struct_pack(score := score, candidate := candidate)).candidate AS candidate FROM s GROUP BY name""")
def token_jaccard_align(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    names = p.select(F.col("p_name").alias("regional_id"), F.col("p_name").alias("name"))
    texts = t(spark, sf_dir, "benchmark").select("text").union(p.select(F.concat_ws(" ", "p_type", "p_name"))).select(F.col("text").alias("candidate_id"), F.col("text").alias("name"))
    return align.best_by_words(names, texts).toDF("name", "candidate", "score")


def _ratio_sql(pairs: str) -> str:
    """CTEs that end in ratio (a, b, r): letter-sequence ratios of ``pairs`` (a, b), by halving stretches at their longest common block."""
    block = """(SELECT max(row(k, -i, -j)) FROM (SELECT i, j, list_max(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda n: substr(a, i + 1, n) = substr(b, j + 1, n))) AS k
      FROM unnest(range(alo, ahi)) x(i), unnest(range(blo, bhi)) y(j) WHERE a[i + 1] = b[j + 1]))"""
    return f"""seg AS (
  SELECT a, b, 0 AS alo, length(a) AS ahi, 0 AS blo, length(b) AS bhi FROM ({pairs}) UNION ALL
  SELECT a, b, h.alo, h.ahi, h.blo, h.bhi FROM (SELECT a, b, unnest([{{'alo': alo, 'ahi': -m[2], 'blo': blo, 'bhi': -m[3]}}, {{'alo': m[1] - m[2], 'ahi': ahi, 'blo': m[1] - m[3], 'bhi': bhi}}]) AS h
    FROM (SELECT *, {block} AS m FROM seg) WHERE m[1] IS NOT NULL) WHERE h.alo < h.ahi AND h.blo < h.bhi),
ratio AS (SELECT a, b, 2.0::DOUBLE * coalesce(sum(m[1]), 0) / (length(a) + length(b)) AS r FROM (SELECT *, {block} AS m FROM seg) GROUP BY a, b)"""


_KEYED = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_SIDES = f"""n AS (SELECT DISTINCT p_name AS x FROM part), c AS (SELECT DISTINCT p_type AS y FROM part), nb AS (SELECT DISTINCT p_name AS x, p_brand AS br FROM part), cb AS (SELECT DISTINCT p_type AS y, p_brand AS br FROM part)"""


def _words_sql(x: str, y: str) -> str:
    a, b = terms_sql(x, "[a-z0-9]+"), terms_sql(y, "[a-z0-9]+")
    return f"len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b})))"


def _greedy_sql(edges: str, parent: str) -> str:
    """CTEs that end in taken: ``edges`` ({parent}, l, r, s, place) gone through by place, one step for all parents at once."""
    return f"""e AS ({edges}),
walk AS (
  SELECT {parent}, 0::BIGINT AS place, NULL::VARCHAR AS l, NULL::VARCHAR AS r, NULL::DOUBLE AS s, []::VARCHAR[] AS ul, []::VARCHAR[] AS ur FROM (SELECT DISTINCT {parent} FROM e) UNION ALL
  SELECT {parent}, e.place, CASE WHEN free THEN e.l END, CASE WHEN free THEN e.r END, CASE WHEN free THEN e.s END, CASE WHEN free THEN list_append(ul, e.l) ELSE ul END, CASE WHEN free THEN list_append(ur, e.r) ELSE ur END
  FROM (SELECT e.*, w.ul, w.ur, NOT list_contains(w.ul, e.l) AND NOT list_contains(w.ur, e.r) AS free FROM walk w JOIN e USING ({parent}) WHERE e.place = w.place + 1) e),
taken AS (SELECT {parent}, l, r, s FROM walk WHERE l IS NOT NULL)"""


_ALIGN_SQL = f"""
WITH RECURSIVE {_SIDES},
names AS (SELECT DISTINCT {_KEYED.format('x')} AS a, {_KEYED.format('y')} AS b FROM n, c UNION SELECT DISTINCT {_KEYED.format('p.br')}, {_KEYED.format('q.br')} FROM nb p, cb q),
{_ratio_sql('SELECT * FROM names')},
scored AS (SELECT x || chr(1) || y AS pair, x, y, nb.br AS bl, cb.br AS brr, CAST(printf('%.1f', (greatest(r, {_words_sql('nb.br', 'cb.br')}) * 100) * 0.7 + 20.0) AS DOUBLE) AS s
  FROM nb, cb JOIN ratio ON b = {_KEYED.format('cb.br')} WHERE a = {_KEYED.format('nb.br')}),
{_greedy_sql("SELECT pair, bl AS l, brr AS r, s, row_number() OVER (PARTITION BY pair ORDER BY s DESC, lower(bl), lower(brr), bl, brr) AS place FROM scored", "pair")},
sums AS (SELECT pair, sum(s) AS t, count(*) FILTER (s >= 85) AS f, count(*) FILTER (s >= 50) AS g FROM taken GROUP BY pair),
full_score AS (
  SELECT x, y, k, coalesce(f, 0) AS f, coalesce(g, 0) AS g, greatest(r, {_words_sql('x', 'y')}) * 100 * 0.5 + coalesce(t, 0.0) / k * 0.4 + {_words_sql('x', 'y')} * 100 * 0.1 AS score
  FROM n JOIN (SELECT x, count(*) AS k FROM nb GROUP BY x) USING (x), c LEFT JOIN sums ON pair = x || chr(1) || y JOIN ratio ON b = {_KEYED.format('y')} WHERE a = {_KEYED.format('x')}),
best AS (SELECT x AS regional_id, arg_max(struct_pack(y := y, score := score, k := k, f := f, g := g), struct_pack(score := score, y := y)) AS m FROM full_score GROUP BY x),
aligned AS (SELECT regional_id, m.y AS candidate_id, CAST(printf('%.1f', m.score) AS DOUBLE) AS score,
  CASE WHEN m.score >= 85 AND m.f = m.k THEN 'Full match' WHEN m.score >= 40 OR m.g > 0 THEN 'Partial match' ELSE 'Not matched' END AS status FROM best)
"""


def _catalogs(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    side = lambda name, key, other: (
        p.select(F.col(name).alias(f"{key}_id"), F.col(name).alias("name"), F.col(name).alias("description")).distinct(),
        p.select(F.col(name).alias(f"{key}_id"), F.concat_ws("/", name, other).alias("left_id" if key == "regional" else "right_id"), F.col(other).alias("name"), F.lit("").alias("description"), F.lit("string").alias("type")).distinct(),
    )
    return *side("p_name", "regional", "p_brand"), *side("p_type", "candidate", "p_brand")


@query(_ALIGN_SQL + "SELECT * FROM aligned")
def sequence_ratio_align(spark, sf_dir):
    """Entities by name sequence, words and one-to-one attribute matches."""
    return align.align(*_catalogs(spark, sf_dir))


@query(_ALIGN_SQL + """SELECT count(*) AS total, count(*) FILTER (status = 'Full match') AS full_match, count(*) FILTER (status = 'Partial match') AS partial_match, count(*) FILTER (status = 'Not matched') AS not_matched,
  round((count(*) FILTER (status = 'Full match') + 0.5 * count(*) FILTER (status = 'Partial match'))::DOUBLE / count(*) * 100, 1) AS matched_percent, round(count(*) FILTER (status = 'Not matched')::DOUBLE / count(*) * 100, 1) AS unmatched_percent FROM aligned""")
def match_summary(spark, sf_dir):
    return aggregates.match_summary(align.align(*_catalogs(spark, sf_dir)))


_STATUS = "CASE WHEN quality = 1 AND toxic = 0 THEN 'Full match' WHEN quality = 1 THEN 'Partial match' ELSE 'Not matched' END"


@query(f"""
WITH m AS (SELECT {_STATUS} AS status FROM labels)
SELECT count(*) AS total, count(*) FILTER (status = 'Full match') AS full_match, count(*) FILTER (status = 'Partial match') AS partial_match, count(*) FILTER (status = 'Not matched') AS not_matched,
  round((count(*) FILTER (status = 'Full match') + 0.5 * count(*) FILTER (status = 'Partial match'))::DOUBLE / count(*) * 100, 1) AS matched_percent, round(count(*) FILTER (status = 'Not matched')::DOUBLE / count(*) * 100, 1) AS unmatched_percent FROM m""")
def label_summary(spark, sf_dir):
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "Full match").when(F.col("quality") == 1, "Partial match").otherwise("Not matched")
    return aggregates.match_summary(t(spark, sf_dir, "labels").select(status.alias("status")))


@query(f"""
WITH RECURSIVE nb AS (SELECT DISTINCT p_brand AS br, p_name AS x FROM part), cb AS (SELECT DISTINCT p_brand AS br, p_type AS y FROM part),
{_ratio_sql(f"SELECT DISTINCT {_KEYED.format('x')} AS a, {_KEYED.format('y')} AS b FROM nb JOIN cb USING (br)")},
scored AS (SELECT br, x, y, round(greatest(r, {_words_sql('x', 'y')}) * 100, 1) AS s FROM nb JOIN cb USING (br) JOIN ratio ON a = {_KEYED.format('x')} AND b = {_KEYED.format('y')}),
{_greedy_sql("SELECT br, x AS l, y AS r, s, row_number() OVER (PARTITION BY br ORDER BY s DESC, lower(x), lower(y), x, y) AS place FROM scored", "br")}
SELECT br AS brand, l AS left_id, r AS right_id, s AS score FROM taken""")
def greedy_assign(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    pairs = p.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("left_id")).distinct().join(p.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("right_id")).distinct(), "brand")
    scored = pairs.withColumn("score", F.round(similarity.name_similarity("left_id", "right_id"), 1)).withColumn("left_name", F.col("left_id")).withColumn("right_name", F.col("right_id"))
    return ranking.greedy_pairs(scored, ["brand"])


@query("""
WITH b AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS s, CASE WHEN quality = 1 THEN 'b' || doc_id END AS c FROM labels),
r AS (SELECT doc_id, CASE WHEN n_chars > 3000 THEN 2 WHEN n_chars > 500 THEN 1 ELSE 0 END AS s, CASE WHEN n_chars > 500 THEN 'r' || doc_id END AS c FROM documents),
j AS (SELECT doc_id AS regional_id, b.s AS bs, r.s AS rs, b.c AS bc, r.c AS rc, CASE WHEN b.s = 2 THEN 'Canonical baseline' WHEN r.s > b.s THEN 'Reference' WHEN b.c IS NOT NULL THEN 'Canonical baseline' WHEN r.c IS NOT NULL THEN 'Reference' ELSE 'Unresolved' END AS source FROM b JOIN r USING (doc_id))
SELECT regional_id, source, CASE WHEN source = 'Canonical baseline' THEN bc ELSE rc END AS candidate_id, ['Not matched', 'Partial match', 'Full match'][1 + CASE WHEN source = 'Canonical baseline' THEN bs ELSE rs END] AS status FROM j""")
def combine_matches(spark, sf_dir):
    name = lambda full, part: F.when(full, "Full match").when(part, "Partial match").otherwise("Not matched").alias("status")
    lab, d = t(spark, sf_dir, "labels"), t(spark, sf_dir, "documents")
    q, tox, n = F.col("quality") == 1, F.col("toxic") == 0, F.col("n_chars")
    b = lab.select(F.col("doc_id").alias("regional_id"), F.when(q, F.concat(F.lit("b"), "doc_id")).alias("candidate_id"), F.lit(0.0).alias("score"), name(q & tox, q))
    r = d.select(F.col("doc_id").alias("regional_id"), F.when(n > 500, F.concat(F.lit("r"), "doc_id")).alias("candidate_id"), F.lit(0.0).alias("score"), name(n > 3000, n > 500))
    return align.combine(b, r).drop("score")


# --- review and publication --------------------------------------------------------------------------


@query("""
WITH d AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Full match' WHEN 'O' THEN 'Partial match' ELSE 'bad' END AS status, CASE WHEN o_orderpriority LIKE '1%' THEN 'Manual' WHEN o_orderpriority LIKE '2%' THEN 'Reference' ELSE 'Canonical baseline' END AS selection,
  CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS baseline_id, CASE WHEN o_custkey % 2 > 0 THEN o_custkey END AS reference_id, CASE WHEN o_totalprice > 200000 THEN 'because' END AS reason, o_custkey % 5 > 0 AS approved FROM orders)
SELECT o_orderkey, error FROM (SELECT o_orderkey, unnest([
  CASE WHEN status NOT IN ('Full match', 'Partial match', 'Not matched') THEN 'unknown status' END, CASE WHEN selection = 'Canonical baseline' AND baseline_id IS NULL THEN 'no baseline candidate' END,
  CASE WHEN selection = 'Reference' AND reference_id IS NULL THEN 'no reference candidate' END, CASE WHEN selection = 'Manual' THEN 'a manual candidate needs a name' END,
  CASE WHEN (status <> 'Full match' OR selection = 'Manual') AND reason IS NULL THEN 'a reason is required' END, CASE WHEN NOT approved THEN 'not approved' END]) AS error FROM d) WHERE error IS NOT NULL""")
def validation_errors(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Full match").when(F.col("o_orderstatus") == "O", "Partial match").otherwise("bad")
    selection = F.when(F.col("o_orderpriority").startswith("1"), "Manual").when(F.col("o_orderpriority").startswith("2"), "Reference").otherwise("Canonical baseline")
    d = o.select("o_orderkey", status.alias("status"), status.alias("proposed_status"), selection.alias("selection"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("baseline_id"), F.when(F.col("o_custkey") % 2 > 0, F.col("o_custkey")).alias("reference_id"), F.lit(None).cast("long").alias("generated_id"), F.lit(None).cast("string").alias("manual_name"), F.lit(None).cast("string").alias("constraints"), F.when(F.col("o_totalprice") > 200000, "because").alias("reason"), (F.col("o_custkey") % 5 > 0).alias("approved"))
    return publish.decision_errors(d, "o_orderkey")


@query("""
WITH d AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Reject' WHEN quality = 1 THEN 'Use' ELSE 'Keep original' END AS action FROM labels)
SELECT doc_id, CASE WHEN action = 'Use' THEN 'doc ' || doc_id ELSE source END AS source FROM documents LEFT JOIN d USING (doc_id) WHERE action IS DISTINCT FROM 'Reject'""")
def review_apply(spark, sf_dir):
    action = F.when(F.col("toxic") == 1, "Reject").when(F.col("quality") == 1, "Use").otherwise("Keep original")
    d = t(spark, sf_dir, "labels").select("doc_id", action.alias("action"), F.concat(F.lit("doc "), "doc_id").alias("new_name"))
    return publish.apply_review(t(spark, sf_dir, "documents").select("doc_id", "source"), d, "doc_id", "source")


@query("SELECT c_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def next_version(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    rows = c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.col("o_orderkey").alias("version"))
    return ranking.next_version(rows, ["c_custkey"])


@query("SELECT conv_id, last(turn ORDER BY turn) AS turn, last(role ORDER BY turn) AS role, last(text ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def latest_draft(spark, sf_dir):
    return publish.latest(t(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role", "text")


@query("""
WITH a AS (SELECT n_name || CASE WHEN c_acctbal > 9000 THEN '' ELSE ' low' END AS k, list(DISTINCT c_mktsegment) AS l, min(c_custkey) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
b AS (SELECT n_name AS k, list(DISTINCT s_name) AS l, min(s_suppkey) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
SELECT coalesce(a.k, b.k) AS k, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.l, []), coalesce(b.l, [])))), ',') AS l, coalesce(a.v, b.v) AS v FROM a FULL JOIN b ON a.k = b.k""")
def merge_baseline(spark, sf_dir):
    n, c, s = (t(spark, sf_dir, x) for x in ("nation", "customer", "supplier"))
    a = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.concat("n_name", F.when(F.col("c_acctbal") > 9000, "").otherwise(" low")).alias("k")).agg(F.collect_set("c_mktsegment").alias("l"), F.min("c_custkey").alias("v"))
    b = s.join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("k")).agg(F.collect_set("s_name").alias("l"), F.min("s_suppkey").alias("v"))
    return publish.merge_baseline(a, b, "k", ["l"], ["v"]).withColumn("l", F.array_join("l", ","))


@query("""
WITH r AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey), e AS (SELECT CASE WHEN c_nationkey < 20 THEN c_custkey ELSE -c_custkey END AS id FROM customer)
SELECT coalesce(e.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unknown' ELSE 'repeated' END AS error FROM e FULL JOIN r ON e.id = r.id WHERE r.id IS NULL OR e.id IS NULL OR n > 1""")
def echo_errors(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    return quality.echo_errors(c.select(F.when(F.col("c_nationkey") < 20, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("id")), o.select(F.col("o_custkey").alias("id")), ["id"])


@query("""
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_targets(spark, sf_dir):
    return setops.pending(t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT event_id, 'k' AS rule, json_extract_string(props, '$.k') AS argument FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def constraint_harvest(spark, sf_dir):
    return openapi.constraints(t(spark, sf_dir, "events"), "event_id", "props", ("k",))


@query("""
WITH v AS (SELECT vec_id, CASE vec_id % 7 WHEN 0 THEN embedding[1:len(embedding) - 1] WHEN 1 THEN list_append(embedding[1:len(embedding) - 1], 'nan'::FLOAT) WHEN 2 THEN NULL WHEN 3 THEN list_append(embedding[1:len(embedding) - 1], '-inf'::FLOAT) WHEN 4 THEN list_append(embedding[1:len(embedding) - 1], NULL) ELSE embedding END AS e FROM embeddings)
SELECT vec_id FROM v WHERE e IS NULL OR len(e) <> 64 OR len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0""")
def bad_vectors(spark, sf_dir):
    """Of seven vectors five are spoilt: cut, not a number, null, infinite, with a null."""
    k, e = F.col("vec_id") % 7, F.col("embedding")
    last = lambda x: F.array_append(F.slice(e, F.lit(1), F.size(e) - 1), F.lit(x).cast("float"))
    spoilt = F.when(k == 0, F.slice(e, F.lit(1), F.size(e) - 1)).when(k == 1, last(float("nan"))).when(k == 2, None).when(k == 3, last(float("-inf"))).when(k == 4, last(None)).otherwise(e)
    return quality.bad_vectors(t(spark, sf_dir, "embeddings").select("vec_id", spoilt.alias("e")), "e", 64).select("vec_id")


@query(r"""
WITH f AS (SELECT page_id, regexp_extract(url, '(?s)^.*?://([^?#]*)', 1) || CASE page_id % 7 WHEN 0 THEN '/A.g.cs' WHEN 1 THEN '/B.cs' WHEN 2 THEN '/Bin/c.cs' WHEN 3 THEN '/Form.Designer.CS' WHEN 4 THEN '/obj/Debug/d.cs' WHEN 5 THEN '/binary/e.cs' ELSE '/x.generated.cs' END AS path FROM pages)
SELECT page_id, page_id % 7 NOT IN (1, 5) OR list_has_any(string_split(lower(path), '/'), ['bin', 'obj']) AS generated FROM f""")
def generated_files(spark, sf_dir):
    k = F.col("page_id") % 7
    ends = ["/A.g.cs", "/B.cs", "/Bin/c.cs", "/Form.Designer.CS", "/obj/Debug/d.cs", "/binary/e.cs", "/x.generated.cs"]
    path = F.concat(F.regexp_extract("url", r"^(?s).*?://([^?#]*)", 1), F.element_at(F.array(*map(F.lit, ends)), (k + 1).cast("int")))
    return t(spark, sf_dir, "pages").select("page_id", quality.generated_code(path).alias("generated"))


@query("""
WITH r AS (SELECT doc_id AS k, unnest(['original', 'id', 'sourceId']) AS key, unnest([lang, 'entity-' || substr(sha256(lang), 1, 20), source]) AS value FROM documents)
SELECT k, key, value FROM r WHERE regexp_matches(key, '(^id$|Ids?$)') OR regexp_matches(value, '^(entity)-[0-9a-f]{20}$')""")
def leaked_identifiers(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    hidden = F.concat(F.lit("entity-"), F.substring(F.sha2(F.col("lang").cast("binary"), 256), 1, 20))
    rows = d.select(F.col("doc_id").alias("k"), F.explode(F.create_map(F.lit("original"), "lang", F.lit("id"), hidden, F.lit("sourceId"), "source")).alias("key", "value"))
    return quality.leaked_keys(rows, "key", "value")


# --- scopes, statuses and selections --------------------------------------------------------------


@query("""
WITH RECURSIVE x AS (SELECT p_name AS n, p_brand || '/' || p_size % 5 AS b, p_type || '/' || p_size % 3 AS t, p_type || '/' || (p_size + 1) % 3 AS u, p_size AS z FROM part),
known AS (SELECT n FROM x UNION SELECT b FROM x UNION SELECT t FROM x),
m AS (SELECT DISTINCT CASE WHEN z = 17 THEN t ELSE t || '!' END AS source, n AS target FROM x),
step AS (SELECT DISTINCT CASE WHEN z > 25 THEN n ELSE n || '!' END AS source, b AS target FROM x UNION SELECT CASE WHEN z < 10 THEN b ELSE b || '!' END, t FROM x UNION SELECT t, u FROM x WHERE t LIKE '%/1' UNION SELECT * FROM m UNION SELECT target, source FROM m),
r(n) AS (SELECT CASE WHEN z = 3 THEN n ELSE n || '!' END FROM x UNION SELECT target FROM (SELECT * FROM r JOIN known USING (n)) JOIN step ON source = n)
SELECT DISTINCT n AS entity_id FROM r JOIN known USING (n)""")
def contract_scope(spark, sf_dir):
    """Names, brands and types by size: references, bases and mappings, most of which lead nowhere, as their ends have other names."""
    p, z = t(spark, sf_dir, "part"), F.col("p_size")
    b, k, u = F.concat("p_brand", F.lit("/"), z % 5), F.concat("p_type", F.lit("/"), z % 3), F.concat("p_type", F.lit("/"), (z + 1) % 3)
    only = lambda test, c: F.when(test, c).otherwise(F.concat(c, F.lit("!")))
    rows = p.select("p_partkey", F.col("p_name").alias("n"), b.alias("b"), k.alias("k"), u.alias("u"), z.alias("z"))
    none = F.lit(None).cast("string")
    entities = rows.select(F.col("n").alias("entity_id"), none.alias("base_entity_id")).union(rows.select("b", none)).union(rows.select("k", F.when(F.col("k").endswith("/1"), F.col("u")))).distinct()
    attributes = rows.select(only(F.col("z") > 25, F.col("n")).alias("entity_id"), F.col("b").alias("reference_id")).union(rows.select(only(F.col("z") < 10, F.col("b")), "k")).distinct()
    edges = rows.select(F.lit("MAPS_TO").alias("kind"), only(F.col("z") == 17, F.col("k")).alias("source"), F.col("n").alias("target")).distinct()
    operations = rows.select(F.col("p_partkey").cast("string").alias("operation_id"), only(F.col("z") == 3, F.col("n")).alias("entity_id"))
    return graph.contract_scope(entities, attributes, edges, operations)


@query(r"""
WITH e AS (SELECT page_id, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS route, CASE WHEN page_id % 3 = 0 THEN ['Policy', 'Claims'] WHEN page_id % 3 = 1 THEN [] END AS tags, 'page ' || page_id AS description FROM pages),
d AS (SELECT page_id, description, unnest(CASE WHEN len(coalesce(tags, [])) > 0 THEN tags ELSE [upper(substr(string_split(route, '/')[2], 1, 1)) || substr(string_split(route, '/')[2], 2)] END) AS domain FROM e)
SELECT domain, count(*) AS n, string_agg(description, ' ' ORDER BY page_id) AS text FROM d GROUP BY domain""")
def endpoint_domains(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select(F.col("page_id").alias("endpoint_id"), F.regexp_extract("url", r"^(?s).*?://[^/?#]*([^?#]*)", 1).alias("route"), F.concat(F.lit("page "), "page_id").alias("description"))
    tags = F.when(F.col("endpoint_id") % 3 == 0, F.array(F.lit("Policy"), F.lit("Claims"))).when(F.col("endpoint_id") % 3 == 1, F.array().cast("array<string>"))
    return align.endpoint_domains(p.withColumn("tags", tags))


@query("""
WITH c AS (SELECT DISTINCT p_name, p_brand FROM part), m AS (SELECT DISTINCT p_name, 'Brand#' || (p_size // 2) AS p_brand FROM part)
SELECT p_name AS candidate_id, p_brand AS right_id FROM c WHERE p_name IN (SELECT p_name FROM m) AND (p_name, p_brand) NOT IN (SELECT (p_name, p_brand) FROM m)""")
def unmatched_details(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    pick = [F.col("p_name").alias("candidate_id"), F.col("p_brand").alias("right_id")]
    half = F.concat(F.lit("Brand#"), F.floor(F.col("p_size") / 2))  # what a match uses: some of a name's brands
    return align.unmatched(p.select(pick[0], half.alias("right_id")).distinct(), p.select(*pick).distinct())


@query("""
SELECT doc_id, CASE WHEN s IS NULL OR s = '' THEN 'No suggestion' WHEN s = source THEN 'Unchanged' ELSE 'Renamed' END AS status
FROM (SELECT d.doc_id, source, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN upper(source) ELSE source END WHEN quality = 0 THEN '' END AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def name_status(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("doc_id", "source").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    s = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, F.upper("source")).otherwise(F.col("source"))).when(F.col("quality") == 0, "")
    return catalog.name_status(rows.withColumn("s", s), "source", "s").select("doc_id", "status")


@query("""
WITH l AS (SELECT * FROM (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1)
SELECT DISTINCT l_partkey AS subject_id, s_name AS source, s_name || CASE WHEN l_linenumber <> l_linenumber + l_quantity % 3 THEN ':lines ' || l_linenumber || '-' || CAST(l_linenumber + l_quantity % 3 AS INT) ELSE ':line ' || l_linenumber END AS location
FROM l JOIN supplier ON s_suppkey = l_suppkey""")
def supporting_sources(spark, sf_dir):
    li, s = t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "supplier")
    evidence = li.select(F.col("l_partkey").alias("subject_id"), F.col("l_suppkey").alias("source_id"))
    sources = s.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("path"))
    place = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), F.col("l_quantity").alias("b"))
    lines = li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("l_partkey").alias("subject_id"), F.col("l_suppkey").alias("source_id"), F.col("s_name").alias("path"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.col("l_quantity") % 3).cast("int").alias("end_line"), F.lit(None).cast("string").alias("pointer"), place.alias("place"))
    return catalog.supporting_sources(evidence, sources, lines)


@query("""
SELECT doc_id, CASE WHEN status = 'Not matched' AND b IS NOT NULL THEN CASE WHEN g IS NOT NULL THEN 'Generated' ELSE 'Manual' END WHEN b IS NOT NULL THEN 'Canonical baseline' WHEN r IS NOT NULL THEN 'Reference' WHEN g IS NOT NULL THEN 'Generated' ELSE 'Manual' END AS choice
FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Not matched' ELSE 'Full match' END AS status, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS b, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS r, CASE WHEN quality = 1 THEN doc_id END AS g FROM labels)""")
def default_choice(spark, sf_dir):
    if_ = lambda test: F.when(test, F.col("doc_id"))
    status = F.when(F.col("toxic") == 1, similarity.NONE).otherwise(similarity.FULL)
    return t(spark, sf_dir, "labels").select("doc_id", align.default_choice(status, if_(F.col("doc_id") % 2 == 0), if_(F.col("doc_id") % 3 == 0), if_(F.col("quality") == 1)).alias("choice"))


@query("""
SELECT page_id, (page_id % 4 = 0 OR page_id % 5 = 0 OR contains(s, 'api') OR s = 'web') AND NOT contains(s, 'th') AS selected, NOT starts_with(p, '/') AND p <> '' AS safe
FROM (SELECT page_id, lower(regexp_extract(url, '(?s)^.*?://([^./]*)', 1)) AS s, regexp_extract(url, '(?s)^.*?://[^/]*(.*)$', 1) AS p FROM pages)""")
def project_selection(spark, sf_dir):
    p = t(spark, sf_dir, "pages").withColumn("s", F.regexp_extract("url", r"^(?s).*?://([^./]*)", 1)).withColumn("p", F.regexp_extract("url", r"^(?s).*?://[^/]*(.*)$", 1))
    owners = F.when(F.col("page_id") % 4 == 0, 1).otherwise(0)
    stem = F.replace(F.replace("s", F.lit("test"), F.lit("")), F.lit("th"), F.lit("test"))
    return p.select("page_id", quality.selected_project(owners, F.col("page_id") % 5 == 0, stem).alias("selected"), quality.safe_member(F.col("p")).alias("safe"))


@query("""
SELECT n_regionkey AS source, n_nationkey AS target, 'CONTAINS' AS kind, 'syntax' AS resolution FROM nation""")
def hierarchy_edges(spark, sf_dir):
    r, n = t(spark, sf_dir, "region"), t(spark, sf_dir, "nation")
    nodes = r.select(F.col("r_regionkey").alias("id"), F.concat(F.lit("r"), "r_regionkey").alias("key"), F.lit(None).cast("string").alias("parent_key"))
    return graph.parents(nodes.union(n.select("n_nationkey", F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))))


@query("""
SELECT c_custkey AS id FROM customer WHERE c_nationkey IN (SELECT CASE WHEN s_acctbal > 5000 THEN s_nationkey ELSE 100 + s_nationkey END FROM supplier)""")
def retained_children(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") > 5000, F.col("s_nationkey")).otherwise(F.col("s_nationkey") + 100).alias("s_nationkey"))
    return graph.retained(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n")), "n", s, "s_nationkey").select("id")


@query("""
SELECT l_orderkey, CAST(CASE WHEN l_linenumber <= 3 THEN l_linenumber ELSE 100 + l_linenumber END AS INT) AS l_linenumber, CASE WHEN l_linenumber <= 3 THEN first(l_quantity ORDER BY l_shipdate, l_quantity) END AS l_quantity FROM lineitem GROUP BY l_orderkey, lineitem.l_linenumber""")
def reconcile_responses(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    expected = li.select("l_orderkey", F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")).otherwise(F.col("l_linenumber") + 100).cast("int").alias("l_linenumber")).distinct()
    supplied = li.select(*keys, "l_quantity", F.struct("l_shipdate", "l_quantity").alias("place"))
    return enrichment.reconcile_responses(expected, supplied, keys, "place")


from specweave.plans import review_queries  # noqa: E402, F401 - registers its own
