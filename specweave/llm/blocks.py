"""Documents dealt to blocks in compressed batches, for steps that meet them more than once.

A block is the unit in which texts are shuffled: a third of their size, and steps in one
query that read the same blocks share one exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_bytes, parts_of

#: Bytes of text in a block, and bytes that a task gathers before it sends them to blocks.
BLOCK_BYTES = 16 << 20
GATHER_BYTES = 24 << 20


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, deal=None, total: int | None = None) -> tuple[DataFrame, int]:
    """(block, data): the rows of ``docs`` (doc_id, text, ...) in compressed batches, by doc_id; how many blocks, a prime.

    deal(doc_id, n) is the block of a row; block_of unless given. total is what held_bytes says of the texts, if that is known.
    """
    n = parts_of(held_bytes(docs, "text") if total is None else total, block_bytes)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    names = docs.columns

    def run(batches):
        held, size = [], 0
        for batch in chunks(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= GATHER_BYTES:
                yield dealt(held)
                held, size = [], 0
        if held:
            yield dealt(held)

    def dealt(held):
        t = pa.Table.from_batches(held)
        blocks = t.column("_block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        t = t.select(names).take(pa.array(order)).combine_chunks()
        found, starts = np.unique(blocks[order], return_index=True)
        data = [compressed(t.slice(a, b - a)) for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    block = F.coalesce((deal or block_of)(F.col("doc_id"), n), F.lit(0)).alias("_block")
    return docs.select("*", block).mapInArrow(run, "block int, data binary"), n


def block_of(doc_id: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int")


def compressed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def batches_of(blobs: pa.Table, step_bytes: int):
    """The documents of a block, some at a time."""
    for data in blobs.column("data"):
        for batch in pa.ipc.open_stream(data.as_buffer()):
            yield from chunks([batch], step_bytes)
