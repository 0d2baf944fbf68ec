"""The vectors nearest to each query: matrix products say which pairs may be among the best, and these alone are scored.

A page of queries goes to every task; a task keeps the best of each query over all the vectors that it sees, so
what is sent on grows with tasks and queries, not with pairs. Scores are added up component by component, as
retrieval.cosine does, and compared as rounded, so the rows are those of a cross join.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Vectors and queries that meet in one product; pairs that are scored at once.
BLOCK, PAIRS = 2_048, 1 << 16
#: What a product may be off by, and the unit to which scores are rounded.
MARGIN, UNIT = 1e-9, 10**6


def flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, which are whole): those that are null, of another length or hold null are zeros."""
    column = flat(column)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    held = column.flatten()
    values = held.to_numpy(zero_copy_only=False).astype(np.float64)
    whole = (sizes == width) & pc.is_valid(column).to_numpy(zero_copy_only=False)
    if whole.all() and not held.null_count:
        return values.reshape(len(column), width), whole
    at = (np.cumsum(sizes) - sizes)[whole, None] + np.arange(width)
    out = np.zeros((len(column), width))
    out[whole] = values[at]
    whole[whole] = ~held.is_null().to_numpy(zero_copy_only=False)[at].any(1)
    out[~whole] = 0
    return out, whole


class Vectors:
    """Vectors by component, with lengths, units, and which are no plain numbers."""

    def __init__(self, column, width: int):
        rows, self.whole = matrix(column, width)
        self.parts = np.ascontiguousarray(rows.T)
        square = np.zeros(len(rows))
        with np.errstate(all="ignore"):
            for part in self.parts:
                square += part * part
            self.length = np.sqrt(square)
            self.odd = self.whole & ~(np.isfinite(self.length) & (self.length > 0))
            self.unit = rows / self.length[:, None]
        self.unit[self.odd | ~self.whole] = 0


def keys(scores: np.ndarray) -> np.ndarray:
    """Scores in units as Spark rounds them; what is no number comes first."""
    with np.errstate(invalid="ignore"):
        size = np.abs(scores) * UNIT
        out = np.copysign(np.floor(size + 0.5), scores)
        halves = np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-6)
    for i in halves:
        out[i] = float(Decimal(repr(float(scores[i]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(scores), np.inf, out)


def _codes(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of ids, null first."""
    if ids.dtype != object:
        return ids
    known = np.array([i is not None for i in ids], bool)
    out = np.zeros(len(ids), np.int64)
    out[known] = np.unique(ids[known], return_inverse=True)[1] + 1
    return out


class Best:
    """The ``most`` best pairs so far of each of ``n`` queries: by rounded score, ties to the smaller id."""

    def __init__(self, n: int, most: int):
        self.most, self.low = most, np.full(n, -np.inf)
        self.kept, self.new, self.n_new = None, [], 0

    def add(self, who: np.ndarray, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.new.append((who, key, score, ids))
        self.n_new += len(who)
        if self.n_new >= max(PAIRS, len(self.low) * self.most // 2):
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        who, key, score, ids = (np.concatenate(x) for x in zip(*([self.kept] if self.kept else []), *self.new, strict=True))
        order = np.lexsort((_codes(ids), -key, who))
        counts = np.bincount(who, minlength=len(self.low))
        place = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
        kept = order[place < self.most]
        self.kept, self.new, self.n_new = (who[kept], key[kept], score[kept], ids[kept]), [], 0
        last = order[place == self.most - 1]
        self.low[who[last]] = np.maximum(self.low[who[last]], key[last])

    def meet(self, queries: Vectors, asked: np.ndarray, some: Vectors, rows: np.ndarray, ids: np.ndarray) -> None:
        """Queries ``asked`` against ``rows`` of some vectors, which bear ``ids``."""
        unit, odd, apart = some.unit[rows].T, some.odd[rows], ~some.whole[rows]
        for a in range(0, len(asked), BLOCK):
            own = asked[a : a + BLOCK]
            near = queries.unit[own] @ unit
            near[:, odd | apart] = -np.inf
            near[queries.odd[own] | ~queries.whole[own]] = -np.inf
            if len(rows) >= self.most and (first := np.flatnonzero(np.isneginf(self.low[own]))).size:
                least = np.partition(near[first], len(rows) - self.most, axis=1)[:, len(rows) - self.most]
                self.low[own[first]] = least * UNIT - 1
            near[:, odd] = np.inf
            near[queries.odd[own]] = np.inf
            near[:, apart] = -np.inf
            near[~queries.whole[own]] = -np.inf
            q, v = np.nonzero(near >= ((self.low[own] - 0.5) / UNIT - MARGIN)[:, None])
            for b in range(0, len(q), PAIRS):
                self._score(queries, own[q[b : b + PAIRS]], some, rows[v[b : b + PAIRS]], ids)

    def _score(self, queries: Vectors, q: np.ndarray, some: Vectors, v: np.ndarray, ids: np.ndarray) -> None:
        dot = np.zeros(len(q))
        with np.errstate(all="ignore"):
            for x, y in zip(some.parts, queries.parts, strict=True):
                dot += x[v] * y[q]
            score = dot / (some.length[v] * queries.length[q])
        key = np.where(some.whole[v] & queries.whole[q], keys(score), -np.inf)
        may = key >= self.low[q]
        self.add(q[may], key[may], score[may], ids[v[may]])

    def rows(self, names, kind: pa.DataType):
        """Batches (query_id, doc_id, score) of what is kept; names are the ids of queries, ``kind`` is that of the others."""
        self.settle()
        for at in range(0, len(self.kept[0]) if self.kept else 0, PAIRS):
            who, key, score, ids = (x[at : at + PAIRS] for x in self.kept)
            own = flat(names.take(pa.array(who)))
            yield pa.RecordBatch.from_arrays([own, pa.array(ids.tolist() if ids.dtype == object else ids, kind), pa.array(score, mask=np.isneginf(key))], ["query_id", "doc_id", "score"])


def doc_ids(column) -> np.ndarray:
    column = flat(column)
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def candidates(vectors: DataFrame, page: pa.Table, query_id: str, most: int, cells: np.ndarray | None = None) -> DataFrame:
    """(query_id, doc_id, score): pairs among which are the ``most`` best of each query of a page, scores not rounded.

    vectors (doc_id, vector); page (query_id, vector), whose ids are of Spark's type ``query_id``. With ``cells``, a bit for each cell of each query
    (numpy.packbits), vectors have a column cell, and a query meets those of its cells alone.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((page.combine_chunks(), cells))

    def run(batches):
        page, cells = shared.value
        sizes = pc.fill_null(pc.list_value_length(page.column("vector")), -1).to_numpy()
        groups = []  # queries of one length meet all vectors; as a rule there is one
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            groups.append((max(0, int(size)), which, Vectors(page.column("vector").take(pa.array(which)), max(0, int(size))), Best(len(which), most)))
        kind = None
        for batch in batches:
            ids, kind = doc_ids(batch.column("doc_id")), batch.column("doc_id").type
            cell = batch.column("cell").to_numpy() if cells is not None else np.zeros(batch.num_rows, np.int32)
            order = np.argsort(cell, kind="stable")
            bounds = np.append(np.flatnonzero(np.append(True, np.diff(cell[order]) != 0)), len(order)) if len(order) else [0]
            for width, which, queries, best in groups:
                some = Vectors(batch.column("vector"), width)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    c = int(cell[order[a]])
                    asked = np.arange(len(which)) if cells is None else np.flatnonzero(cells[which, c >> 3] >> (7 - (c & 7)) & 1)
                    for at in range(a, b if len(asked) else a, BLOCK):
                        best.meet(queries, asked, some, order[at : min(at + BLOCK, b)], ids)
        for _, which, _, best in groups:
            yield from best.rows(page.column("query_id").take(pa.array(which)), kind)

    doc_id = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"query_id {query_id}, doc_id {doc_id}, score double")


def tasks(vectors: DataFrame, n: int) -> int:
    """Tasks for ``n`` vectors: two for each core of the session, none for less than a block."""
    return max(1, min(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK)))
