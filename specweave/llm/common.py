"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: What a row costs besides its text.
ROW_BYTES = 64
#: Bytes of text that a Python worker gets at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so very long texts cannot fill a Python worker; let workers find this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, the text as UTF-8 bytes (null as empty) and what else is named; other columns go."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *also)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_bytes(docs: DataFrame, column: str) -> int:
    """Bytes of a column over all rows; each row counts as ROW_BYTES more, so empty ones fill parts too."""
    return int(docs.agg(F.sum(F.coalesce(F.octet_length(column), F.lit(0)) + ROW_BYTES).alias("n")).first()["n"] or 0)


def parts_of(total: int, bytes_each: int) -> int:
    """How many parts hold ``bytes_each`` of them."""
    return max(1, -(-total // bytes_each))


def chunks(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``limit`` bytes of text, or one row that is longer."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def flat(batch: pa.RecordBatch, column: str = "text"):
    """A binary column as (one byte array, offsets into it)."""
    import numpy as np

    values = batch.column(column)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    buffer = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return buffer, offsets - offsets[0]


def binary_rows(data: bytes, bounds) -> pa.Array:
    """A binary column whose rows are data[bounds[i]:bounds[i + 1]]."""
    import numpy as np

    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int32)), pa.py_buffer(data)])
