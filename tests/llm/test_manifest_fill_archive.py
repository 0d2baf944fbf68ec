"""Merkle manifest, fill-in-middle and archives against brute force, and on odd input."""

import hashlib
import json
import os
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specweave.llm import fill_middle, merkle, warc
from tests.llm.test_operators import clash

KINDS = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- 11 manifest ---------------------------------------------------------------------------------


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows, arity=8):
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    leaves = []
    for doc, source, lang, n, text in rows:
        make = lambda t: H(*map(field, (doc, source, lang, n, t)))  # noqa: B023, E731
        forged = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        leaves.append((lang, doc, make(text), make(lower(text)) if forged else None))
    leaves.sort(key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    def way(levels, i):
        for level in levels[:-1]:
            run = i // arity * arity
            yield level[run:i], level[i + 1 : run + arity]
            i //= arity

    groups = [list(g) for _, g in groupby(leaves, key=lambda r: r[0])]
    trees = [tree([x[2] for x in g]) for g in groups]
    top = tree([t[-1][0] for t in trees]) if trees else [[None]]
    root, out = top[-1][0], []
    for k, (levels, group) in enumerate(zip(trees, groups, strict=True)):
        for i, (_, doc, leaf, forged) in enumerate(group):
            path = [*way(levels, i), *way(top, k)]
            folded = forged or leaf
            for left, right in path:
                folded = H(*left, folded, *right)
            out.append((doc, leaf, levels[-1][0], root, H(*(d for p in path for side in p for d in side)), folded, folded == root))
    return sorted(map(str, out))


@pytest.mark.parametrize(("n", "langs", "arity"), [(0, ["a"], 8), (1, [None], 8), (9, ["a"], 8), (65, ["a", None], 8), (500, [None, "a", "é", "b"], 8), (120, [None, *(f"l{i}" for i in range(70))], 8), (90, ["a", "b"], 2), (700, ["a"], 3)])
def test_manifest_equals_brute_force(spark, monkeypatch, n, langs, arity):
    monkeypatch.setattr(merkle, "DISTRICT", 2)
    monkeypatch.setattr(merkle, "TIER", 2)
    rng = random.Random(n)
    rows = [(rng.choice([i, i, i, i // 2, None]), rng.choice(["s", None]), rng.choice(langs), rng.choice([None, 5]), rng.choice([None, "", "Ab é", "xyz", "Q" * 3000])) for i in range(n)]
    rows += rows[: n // 9]
    df = clash(spark.createDataFrame(rows, KINDS)).repartition(5)
    got = merkle.merkle_report(df, arity=arity)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(got) == brute_manifest(rows, arity)


def test_manifest_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    assert rows_of(merkle.merkle_report(docs)) == brute_manifest([tuple(r) for r in docs.collect()])


def test_nodes_stand_for_few_leaves_each(spark):
    leaves = spark.range(2000).select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("at"), F.lit(2000).cast("long").alias("n"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    nodes = merkle.tree_nodes(leaves)
    assert {r.level: r.n for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()} == {1: 250, 2: 32, 3: 4, 4: 1}
    copies = merkle.by_district(nodes, 8).groupBy("level", "sibling").count()
    assert copies.agg(F.max("count")).first()[0] == 1


# --- 12 fill in middle -----------------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fill(doc, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = H(f"42:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc, len(tokens), "plain", None, None, text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc, len(tokens), form, len(p), len(m), out


def test_boundaries_and_lists():
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("ab é東 \t\n\x0b\x0c\r ") for _ in range(rng.randint(0, 40)))
        ends = fill_middle.token_ends(text.encode())
        assert ends.tolist() == [m.end() for m in TOKEN.finditer(text)]
        most = len(text)
        index = fill_middle.EliasFano.of(ends, most)
        assert index.select(list(range(len(ends)))) == ends.tolist()
    wide = np.array([3, 1 << 20, (1 << 33) + 5])
    assert fill_middle.EliasFano.of(wide, int(wide[-1])).select([2, 0, 1]) == [wide[2], wide[0], wide[1]]


@pytest.mark.parametrize("hot", [4096, 2])
def test_fill_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(fill_middle, "HOT", hot)
    monkeypatch.setattr(fill_middle, "BLOCK_BYTES", 2000 if hot == 2 else fill_middle.BLOCK_BYTES)
    rng = random.Random(12)
    texts = [None, "", " ", "one", "same text in many rows\n", " lead and trail \t\n", "with <S> inside", "<<S", "<P", "é 東京 x y", "w " * 5000, "".join(rng.choice("ab \n") for _ in range(300_000))]
    rows = [(rng.choice([i, None, i // 3]), rng.choice(texts)) for i in range(300)] + [(i, "same text in many rows\n") for i in range(1000, 1200)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    got = fill_middle.fill_in_middle(df)
    assert rows_of(got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256))) == sorted(str((*r[:5], H(r[5]))) for r in (brute_fill(*x) for x in rows))
    report = fill_middle.fill_report(df)
    assert {r.form for r in report.collect()} == {"plain", "psm", "spm"}
    assert sorted(r.restored_sha256 for r in report.collect()) == sorted(H(t or "") for _, t in rows)
    assert fill_middle.fill_report(df.limit(0)).count() == 0


def test_one_index_row_for_each_text(spark):
    rows = [(i, f"text {i % 7}") for i in range(500)]
    blocks, _ = fill_middle.by_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert fill_middle.index_texts(blocks).count() == 7


# --- 13 archives --------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def brute_archive(rows):
    seen, out = {}, []
    order = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[2] or "").encode()).hexdigest(), r[1] is not None, (r[1] or "").encode())
    for page, _, html in sorted(rows, key=order):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        if len(data) >= 100 and digest in seen:
            out.append((page, len(data), digest, "revisit", seen[digest], True))
        else:
            seen.setdefault(digest, page)
            out.append((page, len(data), digest, "response", None, True))
    return sorted(map(str, out))


def some_pages():
    rng = random.Random(13)
    htmls = [None, "", "short", "é" * 50, "y" * 100, "z" * 99, "q" * 5000, "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5, *("".join(rng.choice("ab<>") for _ in range(400)) for _ in range(40))]
    urls = [None, "http://a/b c\r\nWARC-Type: x", "http://é.org/?q=ü#f", "u", "v"]
    return [(rng.choice([None, *range(60)]), rng.choice(urls), rng.choice(htmls)) for _ in range(300)]


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 2000, "file_bytes": 600}])
def test_archives_equal_brute_force(spark, how):
    rows = some_pages()
    for n in (1, 6):
        assert rows_of(warc.warc_report(clash(spark.createDataFrame(rows, PAGES)).repartition(n), **how)) == brute_archive(rows)
    assert warc.warc_report(spark.createDataFrame([], PAGES), **how).count() == 0


def test_archives_are_the_same_bytes_again(spark, tmp_path):
    seen = []
    for n in (2, 5):
        path = f"{tmp_path}/{n}"
        warc.write_archives(spark.createDataFrame(some_pages(), PAGES).repartition(n), path, shard_bytes=4000, file_bytes=700)
        names = sorted(os.listdir(path))
        assert not [x for x in names if x.startswith(".") and not x.endswith(".crc")]
        seen.append({x: hashlib.sha256(open(f"{path}/{x}", "rb").read()).hexdigest() for x in names})
    assert seen[0] == seen[1] and len(seen[0]) > 10
    files = json.load(open(f"{tmp_path}/2/{warc.MANIFEST}"))["files"]
    assert [f["name"] for f in files] == sorted(set(seen[0]) - {warc.MANIFEST}) and sum(f["records"] for f in files) == 300
    assert all(f["bytes"] == os.path.getsize(f"{tmp_path}/2/{f['name']}") for f in files)
    assert len({f["name"].split("-")[1] for f in files}) > 2 and any(f["name"].endswith("-0001.warc.gz") for f in files)
    with pytest.raises(Exception, match="written once"):
        warc.write_archives(spark.createDataFrame(some_pages(), PAGES), f"{tmp_path}/2")


def test_a_failed_write_leaves_no_archive(spark, tmp_path):
    pages = spark.createDataFrame(some_pages(), PAGES).repartition(3)
    broken = pages.withColumn("html", F.when(F.col("page_id") == 59, F.raise_error(F.lit("lost"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="lost"):
        warc.plan_records(broken, 2000).write.format("warc").mode("append").save(f"{tmp_path}/a")
    assert not os.path.exists(f"{tmp_path}/a/{warc.MANIFEST}")
    writer = warc.ArchiveWriter(f"{tmp_path}/b", 1000, warc.DATE)
    batch = pa.RecordBatch.from_pylist([{"shard": 0, "page_id": 1, "url": "u", "html": b"x", "digest": "d", "first_id": None, "revisits": False}])
    lost, done = writer.write(iter([batch])), writer.write(iter([batch]))  # an attempt that was lost, and the one that counts
    assert lost.files[0]["temporary"] != done.files[0]["temporary"]
    writer.commit([done])
    assert sorted(x for x in os.listdir(f"{tmp_path}/b") if not x.endswith(".crc")) == [warc.MANIFEST, "part-000000-0000.warc.gz"]
    writer = warc.ArchiveWriter(f"{tmp_path}/c", 1000, warc.DATE)
    writer.abort([writer.write(iter([batch])), None])
    assert os.listdir(f"{tmp_path}/c") == []


def test_damaged_archives_are_told(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "y" * 200)], PAGES), f"{tmp_path}/a")
    name = f"{tmp_path}/a/part-000000-0000.warc.gz"
    data = zlib.decompressobj(31)
    whole, rest = b"", open(name, "rb").read()
    while rest:
        whole, rest, data = whole + data.decompress(rest), data.unused_data, zlib.decompressobj(31)
    with open(name, "wb") as out:
        out.write(warc._zipped(whole.replace(b"x" * 200, b"x" * 199 + b"!")))
    assert {r.page_id: r.intact for r in warc.read_archives(spark, f"{tmp_path}/a").collect()} == {1: False, 2: True}
    with open(name, "wb") as out:
        out.write(warc._zipped(whole[:-10]))
    with pytest.raises(Exception, match="cut short"):
        warc.read_archives(spark, f"{tmp_path}/a").collect()
