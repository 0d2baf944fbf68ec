"""The registered corpus queries on a small table, and the pipeline against plain Python."""

import duckdb
import pytest

import corpus_pipeline
from specweave.llm import pii
from specweave.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import brute_classes, brute_simhash
from tests.test_queries import TABLES, table


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
        assert table(got) == table(c.execute(ORACLE_SQL[name]).df())


def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if name != "mixing":
            assert docs.columns == columns and ids <= set(before) and len(after) == len(ids)
        if name == "quality":
            good = [i for i, q in labels.items() if q == 1]
            assert len(ids & set(good)) >= 0.97 * len(good)
            assert len(ids & {i for i, q in labels.items() if q == 0}) <= 0.5 * sum(q == 0 for q in labels.values())
        if name == "near_dedup":
            classes = brute_classes({i: brute_simhash(r.text) for i, r in before.items()})
            assert ids == {i for i, c in classes.items() if i == c}
        if name == "decontamination":
            assert not [i for i in ids if any(t in before[i].text for t in items)]
            assert {i for i in before if any(t in before[i].text for t in items)} <= set(before) - ids
        if name == "pii":
            assert ids == set(before) and all(r.text == pii.mask(before[r.doc_id].text) and r.n_chars == len(r.text) for r in after)
        if name == "mixing":
            assert [r.mix_position for r in after] == sorted(r.mix_position for r in after) and ids <= set(before)
        before = {r.doc_id: r for r in after}


def test_near_dedup_judges_rows_that_repeat_a_doc_id(spark):
    say = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, say("a"), "x"), (2, say("b"), "x"), (3, say("b"), "x"), (3, say("c"), "x"), (3, say("d"), "y"), (3, say("d"), "x"), (3, say("d"), "x"), (9, say("c"), "x"), (9, say("e"), "x"), (None, say("a"), "x")]
    for order in (rows, rows[::-1]):
        got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3), "").collect()
        assert sorted((r.doc_id or 0, r.text[0]) for r in got) == [(0, "a"), (1, "a"), (2, "b"), (3, "c"), (3, "d"), (9, "e")]
        chosen = [r.source for r in got if r.text[0] == "d"]
        assert order is rows or chosen == last
        last = chosen


def test_run_is_the_stages(spark, small):
    first = sorted(map(tuple, corpus_pipeline.run(spark, small).collect()), key=str)
    assert first and first == sorted(map(tuple, corpus_pipeline.run(spark, small).collect()), key=str)


def test_stages_take_odd_documents(spark, small):
    odd = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "a word or two of the same text here", "en", "a", 35), (3, "a word or two of the same text here", "en", "a", 35), (None, "no id at all", "de", "b", 12), (4, "x" * 200_000, "xx", "b", 200_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema).selectExpr("*", "'k' as key", "'b' as block", "1 as size", "2.5 as target", "array(1) as row", "'f' as fp")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small)
            got = docs.collect()
            assert name == "mixing" or docs.columns == columns
            assert all(r.key == "k" and r.block == "b" and r.row == [1] for r in got)
            docs = spark.createDataFrame(got, docs.schema)
        assert len(got) == 0 or {r.doc_id for r in got} <= {None, 3, 4}
