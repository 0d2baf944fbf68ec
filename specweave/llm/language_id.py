"""Language of a text by the lowest cross-entropy under Kneser-Ney character models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.plans.lineage import cut

from . import kneser_ney as kn
from .blocks import in_blocks
from .common import small_batches

ORDER = 4
UNKNOWN = "und"
#: Characters a text has at most the evidence of, as neighbours depend on one another.
EVIDENCE = 30.0
#: Predictions are rejected whose cross-entropy exceeds this quantile of the calibration documents of that language.
QUANTILE = 0.995
#: One training text in so many, chosen by its hash, is kept from the models to calibrate rejection; copies of a text stay together.
CALIBRATION = 8


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected of every row of ``docs`` (doc_id, text, lang).

    Learns from the texts of all rows with a lang that are not held out (crc32 of doc_id as
    text is not 1 modulo 3). lang_pred is the language with the lowest cross-entropy per
    character, letters in lower case and all else as spaces; und if the text is null or has
    no letter, or nothing was learned. score is its posterior with evenly likely languages
    where a text counts as 30 characters at most. rejected says that the cross-entropy is
    beyond what texts of that language reach that its model has not seen (the 0.995 quantile of the
    calibration texts; of the training texts, where a language has no others): a foreign
    or unreadable text; lang_pred keeps the best guess. lang never enters a prediction. A null
    doc_id is not held out. Repeated rows each get a row.
    """
    small_batches(docs.sparkSession)
    lang = F.col("lang").cast("string")
    aside = F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.lit(CALIBRATION)) == 0
    taught = docs.filter(~held_out() & lang.isNotNull() & ~aside & F.col("text").isNotNull()).select(lang.alias("lang")).distinct()
    taught = [r[0] for r in taught.collect()]  # languages; those that would have no text left keep all
    calibrates = ~held_out() & aside & lang.isin(taught)
    key = F.when(~held_out() & lang.isNotNull() & ~calibrates, lang)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    own = docs.select("doc_id", "text", key.alias("key"), held_out().alias("held_out"), lettered.alias("lettered"), F.when(calibrates, lang).alias("calibrates"))
    blocks, n = in_blocks(own)
    model = kn.smooth(kn.count_grams(own.filter("key is not null"), order, kn.letters), order, modified=False)
    keys = kn.learned_keys(model)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang string, calibrates string, lettered boolean, n long, sums array<double>"

    def finish(batch, size, sums):
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
        return pa.table([*(batch.column(c) for c in ("doc_id", "held_out", "key", "calibrates", "lettered")), pa.array(size), lists], names=["doc_id", "held_out", "lang", "calibrates", "lettered", "n", "sums"])

    scored = kn.score(blocks, n, model, keys or [UNKNOWN], order, kn.letters, False, finish, kind)
    if not keys:
        scored = scored.withColumn("lettered", F.lit(False))
    best = F.array_max("sums")
    at = F.array_position("sums", best).cast("int")
    scale = F.least(F.col("n"), F.lit(EVIDENCE)) / F.greatest("n", F.lit(1))
    odds = F.aggregate("sums", F.lit(0.0), lambda a, x: a + F.exp((x - best) * scale))
    loss = F.try_divide(-best, F.col("n"))
    guess = F.try_element_at(F.array(*map(F.lit, keys or [UNKNOWN])), at)
    judged = scored.select(
        "doc_id", "held_out", "lang", "calibrates", F.when(F.col("lettered"), guess).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), 1.0 / odds).otherwise(0.0).alias("score"), F.when(F.col("lettered"), loss).alias("cross_entropy"),
    )
    judged = cut(judged)
    right = lambda c: kn.quantile(judged.filter(f"not held_out and {c} = lang_pred and cross_entropy is not null"), "lang_pred", "cross_entropy", quantile, 1000.0)
    limits = right("lang").withColumnRenamed("limit", "seen").join(right("calibrates"), "lang_pred", "full").select("lang_pred", F.coalesce("limit", "seen").alias("limit"))
    beyond = F.col("cross_entropy").isNull() | (F.col("cross_entropy") > F.col("limit"))
    out = judged.join(F.broadcast(limits), "lang_pred", "left")  # one row for each language
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", F.coalesce(beyond, F.lit(True)).alias("rejected"))
