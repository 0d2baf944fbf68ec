"""The stored vector index and the table of versions."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from specweave.functions.text import terms
from specweave.operators import retrieval, vector_index, versions, word_scores


def exact(vectors, queries, most):
    return {(r.query_id, r.doc_id) for r in retrieval.by_vector(vectors, queries, most).collect()}


def test_index_finds_what_is_nearest(spark, tmp_path):
    rng = np.random.default_rng(1)
    middles = rng.standard_normal((40, 16))
    rows = [(i, (middles[i % 40] + rng.standard_normal(16) * 0.3).tolist()) for i in range(4000)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0] * 3), (None, [1.0] * 16)]
    vectors = spark.createDataFrame(rows + odd, "doc_id long, vector array<double>")
    vector_index.build(vectors.repartition(4), f"{tmp_path}/i", sample=1000)
    index = vector_index.VectorIndex(spark, f"{tmp_path}/i")
    assert index.vectors.count() == 4000 and len(index.centroids) == 15
    queries = vectors.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    want = exact(spark.createDataFrame(rows, "doc_id long, vector array<double>"), queries, 20)
    n = index.cells_for(20)
    assert 1 <= n < 15
    got = index.search(queries, 20).collect()
    assert len(want & {(r.query_id, r.doc_id) for r in got}) >= 0.93 * len(want) and len(got) == 40 * 20
    every = index.search(queries, 20, cells=15).collect()
    assert {(r.query_id, r.doc_id) for r in every} == want and {r["rank"] for r in every} == set(range(20))
    with pytest.raises(Exception, match="exist"):
        vector_index.build(vectors, f"{tmp_path}/i")


def test_index_of_few_and_of_no_vectors(spark, tmp_path):
    kind = "doc_id long, vector array<double>"
    for name, rows in (("none", []), ("one", [(1, [1.0, 2.0])]), ("same", [(i, [1.0, 2.0]) for i in range(600)])):
        vector_index.build(spark.createDataFrame(rows, kind), f"{tmp_path}/{name}")
        index = vector_index.VectorIndex(spark, f"{tmp_path}/{name}")
        found = index.search(spark.createDataFrame([(7, [1.0, 2.0]), (8, None)], "query_id long, vector array<double>"), 3).collect()
        assert [(r.query_id, r.doc_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(7, i, 1.0) for i, _ in rows[:3]]


def test_two_writers_get_two_versions(spark, tmp_path):
    table = versions.VersionTable(spark, f"{tmp_path}/t")
    assert table.read() is None and table.commits() == []
    row = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    assert table.append(row(("a", 1), ("b", 2)), ["k"]) == 1

    class Overtaken(versions.VersionTable):
        """Somebody commits between this writer's reading and its claim, once."""

        def _claim(self, number, what):
            if not hasattr(self, "late"):
                self.late = table.append(row(("a", 10)), ["k"])
            return super()._claim(number, what)

    assert Overtaken(spark, f"{tmp_path}/t").append(row(("a", 20), ("c", 3)), ["k"]) == 3
    held = {(r.k, r.v, r.version) for r in table.read().collect()}
    assert held == {("a", 1, 1), ("b", 2, 1), ("a", 10, 2), ("a", 20, 3), ("c", 3, 1)}
    assert {(r.k, r.version) for r in table.read(1).collect()} == {("a", 1), ("b", 1)}
    assert len(list((tmp_path / "t" / "data").iterdir())) == 3  # the overtaken attempt left nothing

    done = []
    writers = [threading.Thread(target=lambda i=i: done.append(table.append(row(("a", 100 + i)), ["k"]))) for i in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(done) == [4, 5, 6, 7] and sorted(r.version for r in table.read().filter("k = 'a'").collect()) == list(range(1, 8))


def test_a_failed_append_leaves_the_table_as_it_was(spark, tmp_path):
    table = versions.VersionTable(spark, f"{tmp_path}/t")
    table.append(spark.createDataFrame([("a", 1)], "k string, v long"), ["k"])
    with pytest.raises(Exception, match="lost"):
        table.append(spark.createDataFrame([("b", 1)], "k string, v long").withColumn("v", F.when(F.col("v") == 1, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v"))), ["k"])
    with pytest.raises(ValueError, match="several rows"):
        table.append(spark.createDataFrame([("b", 1), ("b", 2)], "k string, v long"), ["k"])
    assert table.commits() == [1] and table.read().count() == 1

    class Always(versions.VersionTable):
        def _claim(self, number, what):
            return False

    with pytest.raises(versions.CommitConflict):
        Always(spark, f"{tmp_path}/t").append(spark.createDataFrame([("z", 1)], "k string, v long"), ["k"], attempts=2)
    assert table.commits() == [1]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_compared_without_forming_pairs(spark):
    rows = [(i, [float(i % 7) - 3.0, float(i % 5) - 2.0, float(i % 3)]) for i in range(3000)]
    odd = [(3000, None), (3001, [1.0]), (3002, [float("nan"), 1.0, 1.0]), (3003, [1.0, None, 1.0])]
    vectors = spark.createDataFrame(rows + odd, "doc_id long, vector array<double>")
    queries = vectors.filter("doc_id in (1, 2, 500, 3000, 3002)").withColumnRenamed("doc_id", "query_id")
    zero = spark.createDataFrame([(7, [0.0, 0.0, 0.0])], "doc_id long, vector array<double>")
    got = retrieval.by_vector(vectors.filter("doc_id % 105 != 87"), queries, 50)  # the others hold a zero vector
    pairs = vectors.filter("doc_id % 105 != 87").crossJoin(queries.withColumnRenamed("vector", "q"))
    scored = pairs.select("query_id", "doc_id", F.round(retrieval.cosine(F.col("vector"), F.col("q")), 6).alias("score"))
    want = retrieval.top_k(scored, ["query_id"], [F.desc("score"), "doc_id"], 50)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 250
    assert "Join" not in plan_of(got) and "CartesianProduct" not in plan_of(got)
    assert np.isnan(retrieval.by_vector(zero, queries.filter("query_id = 1"), 5).first().score)  # an error, once
    named = vectors.filter("doc_id < 3000 and doc_id % 105 != 87").select(F.format_string("d%04d", "doc_id").alias("doc_id"), "vector")
    best = {r["rank"]: int(r.doc_id[1:]) for r in retrieval.by_vector(named, queries.filter("query_id = 1"), 9).collect()}
    assert best == {r["rank"]: r.doc_id for r in retrieval.by_vector(vectors.filter("doc_id < 3000 and doc_id % 105 != 87"), queries.filter("query_id = 1"), 9).collect()} and len(best) == 9


def test_a_search_of_the_index_forms_no_pairs(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((2000, 8)))]
    vectors = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    vector_index.build(vectors, f"{tmp_path}/i")
    index = vector_index.VectorIndex(spark, f"{tmp_path}/i")
    queries = vectors.filter("doc_id % 400 = 0").withColumnRenamed("doc_id", "query_id")
    got = index.search(queries, 10, cells=3)
    assert "Join" not in plan_of(got) and "Generate" not in plan_of(got)
    near = np.argsort(-(np.array([rows[i][1] for i in range(0, 2000, 400)]) @ index.centroids.T), axis=1)[:, :3]
    cells = {r.doc_id: r.cell for r in index.vectors.collect()}
    found = got.collect()
    assert len(found) == 50 and all(cells[r.doc_id] in near[r.query_id // 400] for r in found)
    assert {(r.query_id, r.doc_id) for r in index.search(queries, 10, cells=len(index.centroids)).collect()} == exact(vectors, queries, 10)


def test_words_in_bytes_are_the_terms_of_text(spark):
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}X1Y" for c in chars] + ["getQuoteById a_B", "", "  ", None, "xMLFile ßtraße STRAẞE ﬁxeD", "a1B2cD" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    want = docs.select("doc_id", terms("text").alias("terms"))
    every = sorted({w for r in want.collect() for w in r.terms} - {"b"})  # what is not asked for is left out
    got = {r.doc_id: [every[c] for c in r.codes] for r in word_scores.asked_words(docs, every).collect()}
    assert got == {r.doc_id: sorted(set(r.terms) - {"b"}) for r in want.collect()} and len(got) == len(texts)


def test_documents_are_searched_by_words_without_forming_pairs(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.format_string("d%03d", "doc_id").alias("doc_id"), "text")
    docs = docs.union(spark.createDataFrame([(f"e{i}", "Same words of many Copies") for i in range(90)] + [("n", None)], docs.schema))
    queries = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    queries = queries.union(spark.createDataFrame([(-1, None), (-2, "copies of many same words"), (-3, "qzxunheard")], queries.schema))
    monkeypatch.setattr(retrieval, "QUERY_PAGE", 17)
    monkeypatch.setattr(word_scores, "CELLS", 17 * 60)
    monkeypatch.setattr(word_scores, "POSTINGS", 900)
    scores = retrieval.lexical_scores(docs, queries).cache()
    for most in (1, 40, 500):
        got = retrieval.lexical(docs, queries, most)
        want = retrieval.top_k(scores, ["query_id"], [F.desc("score"), "doc_id"], most)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
        assert "Join" not in plan_of(got) and "Generate" not in plan_of(got)
    assert retrieval.lexical(docs, queries.filter("query_id = -3"), 5).count() == 0


def test_texts_of_a_reference_stay_where_they_lie(spark):
    docs = spark.createDataFrame([(i, f"Name {i}\n" + "word " * i) for i in range(40)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "name 7"), (2, "word")], "query_id long, text string")
    vector = spark.createDataFrame([(1, 3, 0), (2, 5, 0), (2, 0, 1)], "query_id long, doc_id long, rank int")
    named = retrieval.alias_hits(docs.select("doc_id", F.col("doc_id").alias("place"), F.array(F.substring_index("text", "\n", 1)).alias("aliases")), asked)
    scored = retrieval.lexical_beside(docs, asked, vector)
    got = retrieval.reference_query(scored, vector, named, docs.withColumn("truncated", F.lit(False)), limit=2)
    assert [(r.query_id, r.place, r.doc_id, r.reason) for r in got.orderBy("query_id", "place").collect()] == [(1, 1, 7, "exact-subject"), (1, 2, 3, "lexical+vector"), (2, 1, 5, "lexical+vector"), (2, 2, 1, "lexical")]
    assert "BroadcastHashJoin" in plan_of(got) and "SortMergeJoin" not in plan_of(got)
