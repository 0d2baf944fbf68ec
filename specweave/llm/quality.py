"""Quality by perplexity under a modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.plans.lineage import cut

from . import kneser_ney as kn
from .blocks import block_of, in_blocks
from .common import small_batches

ORDER = 4
#: The share of trusted documents of a language and length whose perplexity is accepted.
QUANTILE = 0.995
#: Trusted documents are dealt to two halves; a document is measured by the model of the half it isn't in.
HALVES = 2
#: Lengths are told apart by powers of this, as short texts scatter more.
WIDTH = 4.0
#: The model of all languages together, for texts whose own language has none.
ANY = "*"


def half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), doc_id), F.lit(HALVES)).cast("string")


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, model, n_symbols, perplexity, threshold and kept of every row of ``docs`` (doc_id, text, lang).

    Trusted are the documents that ``labels`` (doc_id, quality) gives quality 1. They fall
    into two halves by a hash of doc_id. For each language and half a modified Kneser-Ney model of
    characters is trained on the half's trusted text, and one on that of all languages; a document is measured by
    its language's model of the other half, so never by one that has learned from it, or by the other half's common one where
    its lang is null or has no trusted text. model is the language, or *. A document is kept if its
    perplexity is at most the quantile of the trusted documents of its model's language and its length (by
    powers of four; lengths without trusted documents take the greatest limit of the language, languages without any the greatest of all). With no
    trusted text at all everything with text is kept. A null or empty text has no perplexity and is
    not kept. Repeated rows are each judged; a null doc_id is never trusted.
    """
    narrow = docs.select("doc_id", "lang", "text")
    blocks, n, model, keys, good = _trained(narrow, labels, order)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, model string, n_symbols long, loss double"
    measured = cut(_measured(blocks, n, model, keys, order, lambda b: [b.column("doc_id")], ["doc_id"], kind))
    limits = _limits(measured, good, quantile)
    own = F.broadcast(limits.withColumnRenamed("limit", "own"))  # one row for each language and power of four
    most = F.broadcast(limits.groupBy("model").agg(F.max("limit").alias("most")))
    out = measured.withColumn("model", _language(F.col("model"))).withColumn("size", _size(F.col("n_symbols")))
    out = out.join(own, ["model", "size"], "left").join(most, "model", "left")
    top = limits.agg(F.max("limit").alias("top")).first()["top"]
    threshold, perplexity = F.exp(F.coalesce("own", "most", F.lit(top).cast("double"))), F.exp("loss")
    kept = (F.col("n_symbols") > 0) & F.coalesce(perplexity <= threshold, F.lit(True))
    return out.select("doc_id", "model", "n_symbols", perplexity.alias("perplexity"), threshold.alias("threshold"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and any others) that judge() keeps, with all their columns."""
    held = {c: c if c in ("doc_id", "text", "lang") else f"_c{i}" for i, c in enumerate(docs.columns)}  # other names may clash with ours
    own = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in held.items()])
    blocks, n, model, keys, good = _trained(own, labels, order)
    if not keys:
        return docs.filter("length(text) > 0")
    short = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, model string, n_symbols long, loss double"
    limits = _limits(_measured(blocks, n, model, keys, order, lambda b: [b.column("doc_id")], ["doc_id"], short), good, quantile)
    found = limits.collect()  # one number for each language and power of four
    most = {(r.model, r["size"]): r.limit for r in found}
    for r in found:
        most[r.model] = max(r.limit, most.get(r.model, -np.inf))
    top = max((r.limit for r in found), default=np.inf)

    def finish(batch, size, sums):
        loss = -sums[:, 0] / np.maximum(size, 1)
        names = [k.rsplit("/", 1)[0] for k in batch.column("key").to_pylist()]
        limit = np.array([most.get((k, s), most.get(k, top)) for k, s in zip(names, _size_of(size).tolist(), strict=True)])
        good = (size > 0) & (np.exp(loss) <= np.exp(limit))
        return pa.Table.from_batches([batch.filter(pa.array(good)).select(list(held.values()))])

    kept = kn.score(blocks, n, model, keys, order, kn.characters, True, finish, own.schema)
    return kept.select(*[F.col(h).alias(c) for c, h in held.items()])


def _size(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.lit(np.log(WIDTH)) + 1e-9).cast("int")


def _size_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(WIDTH) + 1e-9).astype(int)


def _language(model: Column) -> Column:
    return F.regexp_replace(model, r"/\d+$", "")


def _trained(docs: DataFrame, labels: DataFrame, order: int):
    """Documents in blocks with the key of the model that measures them (language/half), the model, its keys, the trusted documents."""
    small_batches(docs.sparkSession)
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(ANY))
    own, n = in_blocks(docs.withColumn("key", F.concat_ws("/", lang, half(F.col("doc_id")))))
    chosen = good.select(block_of(F.col("doc_id").cast(docs.schema["doc_id"].dataType), n).alias("block"), F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    counts = cut(kn.count_grams(own, order, kn.characters, chosen))
    counted = sorted(r.key for r in counts.select("key").distinct().collect())  # languages x halves
    other = (F.lit(HALVES - 1) - half(F.col("doc_id")).cast("int")).cast("string")
    known = lambda keys, way: F.array_contains(F.array(*map(F.lit, keys)), way) if keys else F.lit(False)
    if docs.filter(~known(counted, F.concat_ws("/", lang, other))).isEmpty():  # nobody would ask for the common models
        counts = counts.filter(_language(F.col("key")) != ANY)
    else:
        whole = F.concat_ws("/", F.lit(ANY), F.substring_index("key", "/", -1))
        counts = counts.filter(_language(F.col("key")) != ANY).unionByName(counts.groupBy(whole.alias("key"), "gram").agg(F.sum("c").alias("c")))
    model = kn.smooth(counts, order)
    keys = kn.learned_keys(model)
    # the other half's model of the language, or of all; the own half's only where the other half trusts nothing at all
    ways = [F.concat_ws("/", a, b) for b in (other, half(F.col("doc_id"))) for a in (lang, F.lit(ANY))]
    used = F.coalesce(*[F.when(known(keys, w), w) for w in ways], F.lit(f"{ANY}/0"))
    return *in_blocks(docs.withColumn("key", used)), model, keys, good


def _measured(blocks: DataFrame, n: int, model: DataFrame, keys: list[str], order: int, carried, names: list[str], kind: str) -> DataFrame:
    def finish(batch, size, sums):
        loss = np.where(size > 0, -sums[:, 0] / np.maximum(size, 1), np.nan)
        return pa.table([*carried(batch), batch.column("key"), pa.array(size), pa.array(loss, mask=size == 0)], names=[*names, "model", "n_symbols", "loss"])

    return kn.score(blocks, n, model, keys or [f"{ANY}/0"], order, kn.characters, True, finish, kind)


def _limits(measured: DataFrame, good: DataFrame, quantile: float) -> DataFrame:
    """(model, size, limit): the quantile of trusted documents' losses, by language and power of four of the length."""
    trusted = measured.join(good, "doc_id", "left_semi").filter("loss is not null and not isnan(loss)")
    named = trusted.select(F.struct(_language(F.col("model")).alias("model"), _size(F.col("n_symbols")).alias("size")).alias("which"), "loss")
    return kn.quantile(named, "which", "loss", quantile, 1000.0).select("which.*", "limit")
