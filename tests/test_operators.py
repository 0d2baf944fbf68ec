import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from specweave.operators import aggregates, align, catalog, enrichment, graph, joins, publish, quality, ranking, retrieval, setops, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_reconcile_has_all_outcomes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "id int, v string")
    got = {r.id: (r.outcome, r.conflicts) for r in joins.reconcile(a, b, ["id"], ["v"]).collect()}
    assert got == {1: ("CODE_ONLY", []), 2: ("MATCHED", ["v"]), 3: ("MATCHED", []), 4: ("SPEC_ONLY", [])}


def test_lookup_takes_the_last(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, n int")
    assert rows(joins.lookup_join(a, b, ["k"], "n").select("k", "v")) == [(1, "b"), (2, None)]


def test_suffix_and_claims(spark):
    s = "region string, id string, method string, route string, key string, segments array<string>"
    code = spark.createDataFrame([("eu", "c1", "GET", "/api/v1/quotes/{id}", "/api/v1/quotes/{id}", ["api", "v1", "quotes", "{}"]), ("eu", "c2", "GET", "/b/quotes", "/b/quotes", ["b", "quotes"]), ("eu", "c3", "GET", "/c/quotes", "/c/quotes", ["c", "quotes"])], s)
    spec = spark.createDataFrame([("eu", "s1", "GET", "/quotes/{q}", "/quotes/{q}", ["quotes", "{}"]), ("eu", "s2", "GET", "/quotes", "/quotes", ["quotes"]), ("eu", "s3", "GET", "/c/quotes", "/c/quotes", ["c", "quotes"]), ("eu", "s4", "PUT", "/x", "/x", ["x"])], s)
    got = {r.spec_id: (r.code_id, r.how) for r in joins.claim_routes(spec, code, ["region"]).collect()}
    assert got == {"s1": ("c1", "suffix"), "s3": ("c3", "exact"), "s2": ("c2", "suffix"), "s4": (None, "none")}
    pairs = joins.suffix_join(spec.select("method", F.col("id").alias("spec_id"), "segments"), code.select("method", F.col("id").alias("code_id"), "segments"), ["method"])
    assert rows(pairs.filter("spec_id = 's2'").select("code_id", "candidates")) == [("c2", 2), ("c3", 2)]


def test_longest_prefix(spark):
    items = spark.createDataFrame([("i1", "a/b/c.cs"), ("i2", "z/c.cs"), ("i3", "a/bb/c.cs")], "item string, path string")
    owners = spark.createDataFrame([("p1", "a"), ("p2", "a/b")], "owner string, directory string")
    assert rows(joins.longest_prefix_join(items, owners).select("item", "owner")) == [("i1", "p2"), ("i2", None), ("i3", "p1")]


def test_smallest_span_keeps_ties(spark):
    points = spark.createDataFrame([("f", "p", 5)], "path string, point_id string, at int")
    spans = spark.createDataFrame([("f", "big", 1, 9, "Class"), ("f", "s1", 4, 6, "Method"), ("f", "s2", 5, 7, "Method"), ("g", "x", 5, 5, "Method")], "path string, span_id string, start int, end int, kind string")
    assert rows(joins.containing_spans(points, spans, ["path"]).select("span_id", "ambiguous")) == [("s1", True), ("s2", True)]
    assert rows(joins.containing_spans(points, spans, ["path"], [F.col("kind") == "Class"]).select("span_id", "ambiguous")) == [("big", False)]


def test_references_and_edges(spark):
    refs = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "X")], "source string, name string")
    defs = spark.createDataFrame([("b", "X"), ("c", "X")], "target string, name string")
    assert rows(joins.reference_join(refs, defs, 1)) == [("a", "X", "b", 2), ("a", "Y", None, 0), ("b", "X", "c", 1)]
    edges = spark.createDataFrame([("s", "t", "USES")], "source string, target string, kind string")
    bound = spark.createDataFrame([("s", "c1"), ("t", "c1"), ("t", "c2")], "subject string, chunk string")
    assert rows(joins.project_edges(edges, bound)) == [("c1", "c2", "USES")]


def test_pairs_propagate_through_references(spark):
    s = "id string, name_key string, attribute_key string, reference_id string"
    left = spark.createDataFrame([("A", "quote", "addr", "B"), ("A", "quote", "age", None), ("B", "address", "line", None)], s)
    right = spark.createDataFrame([("X", "quotemodel", "addr", "Y"), ("X", "quotemodel", "age", None), ("Y", "addressmodel", "line", None)], s)
    seeds = spark.createDataFrame([("A", "X")], "left_id string, right_id string")
    assert rows(joins.propagate_pairs(seeds, left, right).drop("outer_id")) == [("A", "X", 1.0), ("B", "Y", 1.0)]
    wrapped = left.unionByName(spark.createDataFrame([("W", "envelope", "data", "A"), ("W", "envelope", "code", None)], s))
    found = joins.propagate_pairs(spark.createDataFrame([("W", "X")], "left_id string, right_id string"), wrapped, right)
    assert sorted((r.left_id, r.right_id, r.overlap, r.outer_id) for r in found.collect()) == [("A", "X", 1.0, "W"), ("B", "Y", 1.0, None)]


def test_budgets(spark):
    texts = spark.createDataFrame([("q", 1, "aaaa"), ("q", 2, "bbbb"), ("q", 3, "cc")], "g string, n int, text string")
    assert [tuple(r) for r in ranking.within_characters(texts, ["g"], [F.col("n")], "text", 8, 6).select("n", "shown", "truncated").orderBy("n").collect()] == [(1, "aaaa", False), (2, "bb", True)]
    calls = spark.createDataFrame([("r", 1, 10), ("r", 2, 50), ("r", 3, 1)], "g string, n int, e int")
    assert [r.n for r in ranking.admitted(calls, ["g"], [F.col("n")], "e", run_tokens=40, output_tokens=5).collect()] == [1]


def test_scan_caps_skip_large_files(spark):
    files = spark.createDataFrame([("a", 5), ("b", 100), ("c", 5), ("d", 5)], "path string, length long")
    assert [r.reason for r in ranking.first_files(files, 2, 50, 1000).orderBy("path").collect()] == [None, "file too large", None, "too many files"]


def test_greedy_pairs(spark):
    s = spark.createDataFrame([("p", "a", "x", 90.0, "a", "x"), ("p", "a", "y", 80.0, "a", "y"), ("p", "b", "x", 85.0, "b", "x"), ("p", "b", "y", 10.0, "b", "y")], "parent string, left_id string, right_id string, score double, left_name string, right_name string")
    assert rows(ranking.greedy_pairs(s, ["parent"])) == [("p", "a", "x", 90.0), ("p", "b", "y", 10.0)]


def test_best_and_unique(spark):
    s = spark.createDataFrame([("r", 5.0, "a", 1), ("r", 5.0, "b", 2), ("r", 4.0, "z", 3)], "g string, score double, name string, id int")
    assert rows(ranking.best_candidate(s, ["g"], "score", "name")) == [("r", 5.0, "b", 2)]
    u = spark.createDataFrame([("k", 1, "first"), ("k", 3, "last"), ("j", 2, "x")], "k string, n int, v string")
    assert rows(ranking.unique_by_id(u, "k", "n")) == [("j", 2, "x"), ("k", 3, "first")]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    seeds = spark.createDataFrame([("a", "a")], "root string, node string")
    assert rows(graph.closure(seeds, e)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    scores = spark.createDataFrame([("q", "a", 0.03), ("q", "c", 0.01)], "query string, node string, score double")
    hit = spark.createDataFrame([("q", "a", 0)], "query string, node string, place int")
    edges = spark.createDataFrame([("a", "b", "K", "syntax"), ("c", "a", "K", "candidate")], "source string, target string, kind string, resolution string")
    assert rows(graph.expand(scores, hit, edges)) == [("q", "a", 0.03), ("q", "b", 1.0), ("q", "c", 0.5)]
    ents = spark.createDataFrame([("e1", "e2"), ("e2", None), ("e3", None), ("e4", None)], "entity_id string, base_entity_id string")
    rel = spark.createDataFrame([("MAPS_TO", "e3", "e1")], "kind string, source string, target string")
    ops = spark.createDataFrame([("o", "e1")], "operation_id string, entity_id string")
    attrs = spark.createDataFrame([("e2", "e5"), ("e2", "enum-1")], "entity_id string, reference_id string")
    assert rows(graph.contract_scope(ents, attrs, rel, ops)) == [("e1",), ("e2",), ("e3",)]


def test_scope_leaves_nothing_dangling(spark):
    c = spark.createDataFrame
    m = {
        "operations": c([("o1", "e1"), ("o2", "gone")], "id string, request_entity_id string"), "responses": c([("o1", "e1")], "operation_id string, entity_id string"),
        "parameters": c([("o1", "p1", "enum-2")], "operation_id string, id string, reference_id string"),
        "entities": c([("e1", "e2"), ("e2", None), ("e9", None)], "id string, base_entity_id string"), "attributes": c([("a1", "e2", "enum-1"), ("a9", "e9", None)], "id string, entity_id string, reference_id string"),
        "enums": c([("enum-1",), ("enum-2",)], "id string"), "relationships": c([("ACCEPTS", "o1", "e1"), ("CONTAINS", "e9", "a9")], "kind string, source string, target string"),
        "validations": c([("a1",), ("a9",)], "target_id string"), "evidence": c([("a1", "s1"), ("a9", "s9")], "subject_id string, source_id string"), "lineage": c([("e1", "s2")], "subject_id string, source_id string"), "sources": c([("s1",), ("s2",), ("s9",)], "id string"),
    }
    s = graph.scope(m)
    assert [rows(s[t]) for t in ("entities", "attributes", "enums", "validations", "sources")] == [[("e1", "e2"), ("e2", None)], [("a1", "e2", "enum-1")], [("enum-1",)], [("a1",)], [("s1",), ("s2",)]]
    assert sorted(map(str, s["operations"].select("id", "request_entity_id").collect())) == ["Row(id='o1', request_entity_id='e1')", "Row(id='o2', request_entity_id=None)"]
    assert s["parameters"].first().reference_id is None and s["relationships"].count() == 1


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, h string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "n")], "k int, h string")
    assert rows(setops.snapshot_diff(a, b, "k", "h")) == [(2, "changed"), (4, "added")]
    assert setops.same_rows(a, a) and not setops.same_rows(a, b)
    assert rows(setops.inventory_errors(a, spark.createDataFrame([(1,), (1,), (9,)], "k int"), "k")) == [(1, "repeated"), (2, "missing"), (3, "missing"), (9, "unknown")]
    m = setops.union_models([spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), spark.createDataFrame([("a", 9), ("c", 3)], "id string, v int")], "id")
    assert rows(m) == [("a", 1), ("b", 2), ("c", 3)]


def fold(text, size):
    out, buffer = [], ""
    for line in text.splitlines():
        for piece in [line[i : i + size] for i in range(0, max(1, len(line)), size)]:
            if buffer and len(buffer) + len(piece) + 1 > size:
                out.append(buffer)
                buffer = ""
            buffer += ("\n" if buffer else "") + piece
    return [*out, buffer] if buffer else out


def test_windows_equal_a_plain_fold(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(-1, ""), (-2, "x" * 50 + "\r\n\ny"), (-3, "\n\na\n"), (-4, "é" * 7), (-5, "a\x0bb\u2028c")]
    for size in (10, 400):
        some = docs if size == 400 else docs[-5:]
        df = spark.createDataFrame(some, "id long, text string").select("id", retrieval.line_windows(F.col("text"), size).alias("w"))
        got = {r.id: [w.text for w in r.w] for r in df.collect()}
        assert got == {i: fold(t, size) for i, t in some}


def test_sections_repeat_their_header(spark):
    def pack(sections, size):
        header, out, current = "\n".join(sections[:2]), [], ""
        for s in sections:
            longer = f"{current}\n{s}".strip()
            if current and len(longer) > size:
                out.append(current)
                current = f"{header}\n{s}".strip()
            else:
                current = longer
        return [c[:size] for c in ([*out, current] if current else out)]

    cases = [["h1", "h2", "aaaa", "bbbb", "cccc"], ["only"], ["x" * 30, "y"], []]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>").select("i", retrieval.section_chunks(F.col("s"), 12).alias("c"))
    assert {r.i: r.c for r in df.collect()} == {i: pack(c, 12) for i, c in enumerate(cases)}
    rng = random.Random(3)
    odd = [[rng.choice(["", " ", "a", " bb", "ccc ", "\t", "dd\nee", "x" * 9, "y" * 14, " z " * 6, "\x0b", "é" * 5]) for _ in range(rng.randrange(9))] for _ in range(300)]
    chunks = spark.createDataFrame(list(enumerate(odd)), "i int, s array<string>").select("i", F.posexplode_outer(retrieval.section_chunks(F.filter("s", lambda s: s != ""), 12)))
    got = {}
    for r in sorted(chunks.filter("col is not null").collect()):
        got.setdefault(r.i, []).append(r.col)
    assert got == {i: c for i, x in enumerate(odd) if (c := pack([s for s in x if s], 12))}


def test_texts_are_packed_once_and_by_what_sections_add(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["section_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("split(") == 1  # a chunk's header does not split the text again


def test_retrieval_prefers_neighbours_to_fused_hits(spark):
    fused = spark.createDataFrame([("q", "a", 0.03), ("q", "b", 0.02)], "query_id string, doc_id string, score double")
    exact = spark.createDataFrame([], "query_id string, doc_id string, rank int")
    edges = spark.createDataFrame([("a", "n", "CALLS", "syntax")], "source string, target string, kind string, resolution string")
    chunks = spark.createDataFrame([("a", "1", "text a"), ("b", "2", "text b"), ("n", "3", "text n")], "doc_id string, identity string, text string")
    got = retrieval.retrieve(fused, exact, edges, chunks).orderBy("place").collect()
    assert [(r.doc_id, r.relevance) for r in got] == [("n", 1.0), ("a", 0.03), ("b", 0.02)]
    hit = spark.createDataFrame([("q", "b", 0)], "query_id string, doc_id string, rank int")
    assert [r.doc_id for r in retrieval.retrieve(fused, hit, edges, chunks, limit=1).collect()] == ["b"]


def test_alignment(spark):
    e = lambda k, r: spark.createDataFrame(r, f"{k}_id string, name string, description string")
    a = lambda k, i, r: spark.createDataFrame(r, f"{k}_id string, {i}_id string, name string, description string, type string")
    out = align.align(e("regional", [("r1", "Policy", "an insurance policy"), ("r2", "Zebra", "")]), a("regional", "left", [("r1", "l1", "policyNumber", "number", "string"), ("r1", "l2", "premium", "amount", "decimal")]), e("candidate", [("c1", "Policy", "an insurance policy")]), a("candidate", "right", [("c1", "x1", "policyNumber", "number", "guid"), ("c1", "x2", "premium", "amount", "double")]))
    got = {r.regional_id: (r.candidate_id, r.score, r.status) for r in out.collect()}
    assert got["r1"] == ("c1", 100.0, "Full match") and got["r2"][2] == "Not matched"


def test_domains(spark):
    c = spark.createDataFrame
    d = "{}_id string, name string, description string"
    k = "{}_id string, {}_id string, name string, description string"
    out = align.align_domains(
        c([("r1", "Claims", ""), ("r2", "Zzz", "")], d.format("regional")), c([("r1", "l1", "Settlement", "pay a claim")], k.format("regional", "left")),
        c([("c1", "Claims", ""), ("c2", "Billing", "")], d.format("candidate")), c([("c1", "x1", "Settlement", "pay a claim"), ("c2", "x2", "Refund", "")], k.format("candidate", "right")),
    )
    got = {r.regional_id: (r.candidate_id, r.score, r.status) for r in out.collect()}
    assert got["r1"] == ("c1", 100.0, "Full match") and got["r2"][2] == "Not matched"


def test_review_and_truth_map(spark):
    s = spark.createDataFrame([("k1", "B", "Address"), ("k2", "a", "address"), ("k3", "c", "Claim")], "source_key string, api string, approved_name string")
    at = spark.createDataFrame([("k1", "a1", "Line1", "string", True), ("k2", "a2", "line1", "String", False)], "source_key string, attribute_id string, approved_name string, type string, required boolean")
    entities, truth = catalog.review("eu", s, at)
    one = {r.entity_key: r for r in entities.collect()}
    assert (one["address"].name, one["address"].n_duplicates, one["address"].apis) == ("address", 1, ["B", "a"])
    assert one["address"].attributes[0].required_in_all is False and one["claim"].attributes is None
    assert sorted((r.source_key, r.attribute_id or "", r.action) for r in truth.collect()) == [("k1", "", "Merged duplicate entity"), ("k1", "a1", "Merged duplicate attribute"), ("k2", "", "Retained"), ("k2", "a2", "Retained"), ("k3", "", "Retained")]
    assert catalog.review_summary(entities, s, at).first().merged_duplicates == 1


def test_publishing(spark):
    v = spark.createDataFrame([("eu", 1), ("eu", 2)], "region string, version int")
    assert rows(publish.append_version(v, ["region"], spark.createDataFrame([("eu",), ("us",)], "region string"))) == [("eu", 3), ("us", 1)]
    ops = spark.createDataFrame([("/q", "GET", "s", "Policy", "Quote")], "route string, method string, summary string, domain string, entity string")
    attrs = spark.createDataFrame([("Quote", "id", "string", "d", True), ("Quote", "n", None, None, False)], "entity string, name string, type string, description string, required boolean")
    import json

    doc = json.loads(publish.openapi_document("t", "1", ops, attrs).first().document)
    assert doc["openapi"] == "3.0.3" and doc["paths"]["/q"]["get"]["tags"] == ["Policy"]
    quote = doc["components"]["schemas"]["Quote"]
    assert quote["required"] == ["id"] and quote["properties"]["n"]["type"] == "string"


def test_enrichment_keeps_errors(spark):
    asked = spark.createDataFrame([("a", "x"), ("b", "fail")], "k string, context string")

    def answer(context):
        if context == "fail":
            raise ValueError("no")
        return {"summary": context.upper()}

    assert rows(enrichment.enrich(asked, "k", answer, "summary string")) == [("a", "X", None), ("b", None, "ValueError: no")]


def test_quality(spark):
    claims = spark.createDataFrame([("a", ["x"], ["x"], "inferred"), ("b", [], ["x"], "inferred"), ("c", [], [], "unknown"), ("d", ["y"], ["x"], "unknown")], "k string, cited array<string>, allowed array<string>, status string")
    assert [r.k for r in quality.uncited(claims, "cited", "allowed", "status").orderBy("k").collect()] == ["b", "d"]
    paths = spark.createDataFrame([("a/b.cs",), ("../x",), ("/abs",), ("a/obj/x.cs",), ("c:/x",)], "p string")
    assert [r.s for r in paths.select(quality.safe_member(F.col("p")).alias("s")).collect()] == [True, False, False, True, False]
    assert [r.g for r in paths.select(quality.generated_code(F.col("p")).alias("g")).collect()] == [False, False, False, True, False]


def test_tree_and_graph_text(spark):
    r = spark.createDataFrame([("d2", "c", "x"), ("d1", "b", "y"), ("d1", "a", "z")], "d string, c string, e string")
    got = {x.d: [(y.c, [z.e for z in y.children]) for y in x.children] for x in aggregates.tree(r, ["d", "c"], ["e"]).collect()}
    assert got == {"d1": [("a", ["z"]), ("b", ["y"])], "d2": [("c", ["x"])]}
    t = spark.createDataFrame([("s1", "t", "Retained"), ("s2", "t", "Merged")], "source string, target string, action string")
    lines = [x.line for x in sinks.lineage_graph(t).collect()]
    assert lines[0] == "graph LR" and len(lines) == 6 and sum("merged" in x for x in lines) == 1


def test_closure_of_a_long_chain(spark):
    from specweave.operators import graph

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 3)], "source long, target long")
    found = graph.closure(spark.createDataFrame([(0, 0), (1, 39)], "root long, node long"), edges)
    assert {(r.root, r.node): r.depth for r in found.collect()} == {(0, i): i for i in range(41)} | {(1, 39): 0, (1, 40): 1} | {(1, i): i - 1 for i in range(3, 39)}


def test_vector_queries_in_pages(spark, monkeypatch):
    from specweave.operators import retrieval

    v = spark.createDataFrame([(i, [float(i % 7) + 0.1, float(i % 5) - 2.0]) for i in range(60)], "doc_id long, vector array<double>")
    q = v.filter("doc_id < 20").withColumnRenamed("doc_id", "query_id")
    whole = sorted(map(tuple, retrieval.by_vector(v, q, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_PAGE", 7)
    assert sorted(map(tuple, retrieval.by_vector(v, q, 3).collect())) == whole and len(whole) == 60


def test_pruned_pairs_give_the_product_s_winners(spark, monkeypatch):
    from specweave.operators import align, pairing

    rng = random.Random(9)
    vocabulary = "customer order quote policy address party risk premium claim vehicle cover agent".split()

    def catalog(n, key, item):
        entities, attributes = [], []
        for i in range(n):
            name = "".join(w.title() for w in rng.sample(vocabulary, rng.randint(1, 3))) if i % 17 else rng.choice(["--", "Straße", None])
            entities.append((f"{key[0]}{i}", name, " ".join(rng.sample(vocabulary, rng.randint(0, 4))) or None))
            for j in range(rng.choice([0, 1, 2, 4])):
                attributes.append((f"{key[0]}{i}", f"{i}.{j}", rng.choice(vocabulary) + rng.choice(vocabulary).title(), rng.choice(["", None, rng.choice(vocabulary)]), rng.choice(["string", "int", "decimal", None])))
        kinds = f"{key} string, name string, description string", f"{key} string, {item} string, name string, description string, type string"
        return spark.createDataFrame(entities, kinds[0]), spark.createDataFrame(attributes, kinds[1])

    (r, ra), (c, ca) = catalog(40, "regional_id", "left_id"), catalog(50, "candidate_id", "right_id")
    monkeypatch.setattr(pairing, "PAGE", 16)
    product = align._product(r, c)
    want = align._shown(align._best(product, align.score_attributes(product, ra, ca), r, ra, c, ca, align.entity_score), r)
    assert sorted(map(str, align.align(r, ra, c, ca).collect())) == sorted(map(str, want.collect()))
    pairs = pairing.candidate_pairs(r, ra, c, ca, lambda p: align._best(p, align.score_attributes(p, ra, ca), r, ra, c, ca, align.entity_score))
    assert pairs.count() < 0.5 * product.count()
    assert align.align(r.limit(0), ra.limit(0), c, ca).count() == 0
    assert {x.status for x in align.align(r, ra, c.limit(0), ca.limit(0)).collect()} == {"Not matched"}


def test_claims_in_rounds_are_claims_in_turn(spark):
    rng = random.Random(3)
    words = ["a", "b", "{x}"]
    route = lambda n: "/" + "/".join(rng.choice(words) for _ in range(n))
    side = lambda pre, least, n: [(rng.choice("rs"), f"{pre}{i:03}", rng.choice(["GET", "PUT"]), route(rng.randint(least, 3))) for i in range(n)]
    specs, codes = side("s", 0, 60), side("c", 1, 50)
    segments = lambda r: ["{}" if x[0] == "{" else x for x in r.split("/") if x]
    want = []
    for region in "rs":
        exact, used = {}, set()
        for r, i, m, x in sorted(codes):
            if r == region:
                exact[m, x] = i
        for r, i, m, x in sorted((s for s in specs if s[0] == region), key=lambda s: (-len(segments(s[3])), s[3], s[2], s[1])):
            found = [exact[m, x]] if (m, x) in exact else [c for q, c, k, y in codes if q == r and k == m and c not in used and segments(x) and segments(y)[-len(segments(x)) :] == segments(x)]
            how = "exact" if (m, x) in exact else ("none", "suffix", "ambiguous")[min(len(found), 2)]
            if len(found) == 1:
                used.add(found[0])
            want.append((r, i, found[0] if len(found) == 1 else None, how))
    kind = "region string, id string, method string, route string, key string, segments array<string>"
    frame = lambda t: spark.createDataFrame([(*x, x[3], segments(x[3])) for x in t], kind)
    assert rows(joins.claim_routes(frame(specs), frame(codes), ["region"])) == sorted(want, key=str)
    assert {w[3] for w in want} == {"exact", "suffix", "ambiguous", "none"}
    assert rows(joins.claim_routes(frame(specs), frame([]), ["region"])) == sorted([(r, i, None, "none") for r, i, _, _ in specs], key=str)
    assert joins.claim_routes(frame([]), frame(codes), ["region"]).count() == 0


def test_spans_by_bins_equal_the_range_condition(spark):
    rng = random.Random(4)
    points = [(rng.choice("ab"), i, rng.choice([None, *range(-50, 200)])) for i in range(150)]
    spans = []
    for i in range(120):
        a = rng.randint(-60, 200)
        spans.append((rng.choice("ab"), i, a, rng.choice([a, a + rng.randint(-3, 10), a + rng.randint(0, 300), None])))
    for kind, of in (("long", lambda x: x), ("double", lambda x: None if x is None else x / 3), ("timestamp", lambda x: None if x is None else datetime(2020, 1, 1) + timedelta(seconds=x * 997))):
        p = spark.createDataFrame([(k, i, of(x)) for k, i, x in points], f"k string, point_id long, at {kind}")
        s = spark.createDataFrame([(k, i, of(a), of(b)) for k, i, a, b in spans], f"k string, span_id long, start {kind}, end {kind}")
        got = {(r.point_id, r.span_id) for r in joins.spans_around(p, s, ["k"]).collect()}
        assert got == {(i, j) for k, i, x in points for q, j, a, b in spans if k == q and None not in (x, a, b) and a <= x <= b}
        assert joins.spans_around(p, s, ["k"]).count() == len(got)
    assert joins.spans_around(p, s.limit(0), ["k"]).count() == 0


def test_bounded_lexical_search_equals_all_scores(spark, small, monkeypatch):
    from specweave.operators import retrieval

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    queries = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "nowhere-to-be-found"), (-4, "the the the")], "query_id long, text string")
    scores = retrieval.lexical_scores(docs, queries.union(odd))
    for most in (1, 7, 40):
        want = ranking.top_k(scores, ["query_id"], [F.desc("score"), "doc_id"], most)
        assert rows(retrieval.lexical(docs, queries.union(odd), most)) == rows(want)
    monkeypatch.setattr(retrieval, "FEW_TERMS", 1)
    lexicon = retrieval.Lexicon(docs, queries.union(odd))
    assert rows(lexicon.best(7)) == rows(ranking.top_k(scores, ["query_id"], [F.desc("score"), "doc_id"], 7))
    listed = spark.createDataFrame([(0, 1), (3, 5)], "query_id long, doc_id long")
    beside = {(r.query_id, r.doc_id): r.score for r in retrieval.lexical_beside(docs, queries, listed, 2).collect()}
    every = {(r.query_id, r.doc_id): r.score for r in scores.collect()}
    assert set(beside.items()) <= set(every.items()) and all(beside.get(tuple(p)) == every.get(tuple(p)) for p in listed.collect())
    assert lexicon.candidates(7).count() < len(every)
    assert retrieval.lexical(docs.limit(0), queries, 5).count() == 0 == retrieval.lexical(docs, queries.limit(0), 5).count()


def test_greedy_in_rounds_and_in_lists_is_greedy_in_turn(spark):
    rng = random.Random(1)
    rows = [(p, f"l{i}", f"r{j}", float(rng.randint(1, 4)), rng.choice(["A", "a", "ß", "ss"]), rng.choice("xyz")) for p in (1, 2, None) for i in range(rng.randint(1, 8)) for j in range(rng.randint(1, 8)) if rng.random() < 0.8]
    scored = spark.createDataFrame(rows, "p long, left_id string, right_id string, score double, left_name string, right_name string")
    used, want = set(), []
    for p, a, b, score, x, y in sorted(rows, key=lambda r: (-r[3], r[4].casefold(), r[5].casefold(), r[1], r[2])):
        if not {(p, 0, a), (p, 1, b)} & used:
            used |= {(p, 0, a), (p, 1, b)}
            want.append((p, a, b, score))
    for greedy in (ranking.greedy_pairs, ranking.greedy_lists):
        assert sorted(map(str, map(tuple, greedy(scored, ["p"]).collect()))) == sorted(map(str, want))
        assert greedy(scored.limit(0), ["p"]).count() == 0


def test_follow_ups_ask_only_for_names(spark):
    from specweave.operators import retrieval

    results = spark.createDataFrame([(1, "n", [0.95, 0.91], ["A"]), (2, "n", [0.8], ["no name", "Own"]), (3, "n", [0.6], None), (4, "n", [0.8], None)], "target_id long, name string, confidences array<double>, requested array<string>")
    contexts = spark.createDataFrame([(3, "QuoteService and PolicyHandler"), (4, "QuoteService")], "target_id long, text string")
    assert {r.target_id: r.symbols for r in retrieval.needs_follow_up(results, contexts).collect()} == {2: ["Own"], 3: ["QuoteService", "PolicyHandler"]}
