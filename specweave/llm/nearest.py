"""Nearest vectors by cosine: a forest of random-projection trees, one queue over all of them, exact reranking."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from specweave.plans.lineage import cut

from .common import small_batches

TREES = 4
#: Vectors that a leaf is to hold, and how many of a bounded sample the planes are fit on, so many to a leaf at least.
LEAF = 256
SAMPLE = 32_768
SAMPLED = 16
#: Leaves that a query visits: so many that this share of the nearest is found, measured for so many probes against every row.
RECALL = 0.95
PROBES = 100
#: Vectors of a tree that are held together: many leaves, or a part of one.
PAGE = 1 << 14
#: Products that are held at once.
PRODUCTS = 1 << 22
#: How far a product of unit vectors may be from the cosine in double precision, with room to spare.
ROUNDING = 1e-9


@dataclass
class Forest:
    """Trees of equal depth in heap order: planes[t, node] and cuts[t, node] split at node, children 2 node + 1 and + 2."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int

    @property
    def inner(self) -> int:
        return (1 << self.depth) - 1

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(self.planes), len(unit)), np.int64)
        for t in range(len(self.planes)):
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", unit, self.planes[t][out[t]]) >= self.cuts[t][out[t]]
                out[t] = 2 * out[t] + 1 + side
        return out - self.inner

    def search(self, unit: np.ndarray, n_leaves: int) -> list[tuple[int, int]]:
        """The (tree, leaf) to look into, nearest first: one queue over all trees, by the widest margin on the way."""
        queue, out = [(-1.0, t, 0) for t in range(len(self.planes))], []
        margins = (self.planes @ unit - self.cuts).tolist() if self.depth else None
        while queue and len(out) < n_leaves:
            far, t, node = heapq.heappop(queue)
            while node < self.inner:
                m = margins[t][node]
                right = int(m >= 0)
                heapq.heappush(queue, (max(far, abs(m)), t, 2 * node + 2 - right))
                node = 2 * node + 1 + right
            out.append((t, node - self.inner))
        return out


def grow(unit: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
    """A forest for ``n`` vectors fit on a sample: each plane lies between two sampled vectors, cut at the median."""
    depth = max(0, min(int(np.ceil(np.log2(max(1, n) / leaf))), int(np.log2(max(1, len(unit)) / SAMPLED))))
    dims = unit.shape[1] if unit.ndim == 2 else 0
    rng = np.random.default_rng(seed)
    planes, cuts = np.zeros((trees, (1 << depth) - 1, dims)), np.zeros((trees, (1 << depth) - 1))
    for t in range(trees):
        sets = {0: np.arange(len(unit))}
        for node in range((1 << depth) - 1):
            own = sets.pop(node)
            normal = rng.standard_normal(dims)
            if len(own) > 1:
                a, b = unit[rng.choice(own, 2, replace=False)]
                normal = a - b if (a != b).any() else normal
            normal /= np.linalg.norm(normal)
            along = unit[own] @ normal
            planes[t, node], cuts[t, node] = normal, np.median(along) if len(own) else 0.0
            sets[2 * node + 1], sets[2 * node + 2] = own[along < cuts[t, node]], own[along >= cuts[t, node]]
    return Forest(planes, cuts, depth)


def leaves_for(entries: DataFrame, forest: Forest, shared, points: np.ndarray, k: int, recall: float, probes: int = PROBES) -> int:
    """How many leaves find ``recall`` of the ``k`` nearest of all entries, measured for some of the sample against every entry."""
    every = len(forest.planes) << forest.depth
    if len(points) <= k + 1:
        return every
    asked = points[np.linspace(0, len(points) - 1, min(probes, len(points))).astype(int)]
    spark = entries.sparkSession
    wanted = spark.sparkContext.broadcast(asked)  # PROBES vectors

    def best(batches):
        """The k + 1 nearest entries of each probe in a partition, one of which may be the probe, by their leaves."""
        scores, leaves = np.full((len(asked), k + 1), -2.0), np.zeros((len(asked), k + 1, len(forest.planes)), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column("vector")))
            own = wanted.value @ unit.T
            top = np.argpartition(-own, min(k, own.shape[1] - 1), axis=1)[:, : k + 1]
            mine = np.take_along_axis(own, top, axis=1)
            at = shared.value.leaves(unit[top.ravel()]).T.reshape(*top.shape, -1)
            scores, leaves = np.concatenate([scores, mine], axis=1), np.concatenate([leaves, at], axis=1)
            keep = np.argsort(-scores, axis=1)[:, : k + 1]
            scores, leaves = np.take_along_axis(scores, keep, axis=1), np.take_along_axis(leaves, keep[..., None], axis=1)
        probe, place = np.nonzero(scores > -2.0)
        at = pa.array(leaves[probe, place].tolist(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(probe, pa.int32()), pa.array(scores[probe, place]), at], ["probe", "score", "leaves"])

    near = entries.select("vector").mapInArrow(best, "probe int, score double, leaves array<int>")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "leaves")
    near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).collect()  # probes x (k + 1) rows
    found: list[int] = []
    for i, probe in enumerate(asked):
        place = np.zeros((len(forest.planes), 1 << forest.depth), np.int64)
        ranked = np.array(forest.search(probe, every))
        place[ranked[:, 0], ranked[:, 1]] = np.arange(1, every + 1)
        found += [min(place[t, at] for t, at in enumerate(r.leaves)) for r in near if r.probe == i and r.n > 1]
    return int(sorted(found)[min(len(found) - 1, int(np.ceil(recall * len(found))))])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part: all components finite, not zero; floats stay floats."""
    kind = vectors.schema["embedding"].dataType
    own = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{own}>").alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return rows.filter(fine)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query in ``vectors`` (vec_id, embedding).

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows but the
    query's own; score is the cosine of the original vectors in double precision, ties go
    to the smaller vec_id. Planes are fit on about ``sample`` vectors chosen by a hash of vec_id; every row is indexed.
    How many leaves a query visits is measured by probes: few where vectors have structure.
    Copies of one vector are one entry that carries its k + 1 smallest ids,
    enough for any query, so they cannot fill a leaf. Vectors of different lengths are not compared: each length
    is searched by a forest of its own. Null and zero vectors, those with null or non-finite components and null
    vec_ids take no part; rows that repeat a vec_id count once, with the vector of the least hash. Without queries or other rows there are no rows.
    """
    small_batches(vectors.sparkSession)
    rows = usable(vectors)
    lengths = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())
    if len(lengths) > 1:  # a vec_id counts once over all lengths
        size = F.size("vector")
        least = rows.groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("vector"), F.hash("vector"), size.alias("size"))).alias("c")).select(F.col("vec_id").alias("i"), F.col("c.size").alias("s"))
        rows = rows.join(least, (F.col("vec_id") == F.col("i")) & (size == F.col("s"))).drop("i", "s")
    found = [_nearest(rows.filter(F.size("vector") == n) if len(lengths) > 1 else rows, k, every, trees, leaf, recall, sample) for n in lengths or [0]]
    return reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, k: int, every: int, trees: int, leaf: int, recall: float, sample: int) -> DataFrame:
    """``nearest`` of usable vectors (vec_id, vector) of one length."""
    spark = rows.sparkSession
    content = [F.xxhash64("vector").alias("h"), F.hash("vector").alias("h2")]
    rows = rows.select("vec_id", *content, "vector")
    chosen = rows.groupBy("vec_id").agg(F.min(F.struct("h", "h2")).alias("c")).select("vec_id", "c.*")
    slim, salt = cut(chosen), F.pmod(F.xxhash64("vec_id"), F.lit(64))
    own = slim
    for w in (Window.partitionBy("h", "h2", salt), Window.partitionBy("h", "h2")):
        own = own.withColumn("n", F.row_number().over(w.orderBy("vec_id"))).filter(F.col("n") <= k + 1).drop("n")
    members = own.groupBy("h", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    firsts = members.select(F.element_at("ids", 1).alias("vec_id"), "h", "h2", "ids")
    wanted = firsts.unionByName(slim.filter(F.col("vec_id") % every == 0).select("*", F.lit(None).cast("array<bigint>").alias("ids")))
    wanted = wanted.groupBy("vec_id", "h", "h2").agg(F.max("ids").alias("ids"))
    once = rows.groupBy("vec_id", "h", "h2").agg(F.first("vector").alias("vector"))  # rows that are repeated are alike
    keyed = cut(once.join(wanted, ["vec_id", "h", "h2"]).select("vec_id", "ids", "vector"))
    entries = keyed.filter("ids is not null").select("ids", "vector")
    n = entries.count()
    fit = keyed.filter(F.col("ids").isNotNull() & (F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n))) < sample)).select("vec_id", "vector").toArrow().sort_by("vec_id")
    points = _unit(_matrix(fit.column("vector"))) if fit.num_rows else np.zeros((0, 0))
    forest = grow(points, n, trees, leaf)
    shared = spark.sparkContext.broadcast(forest)  # trees x 2^depth planes; the sample bounds the depth
    n_leaves = leaves_for(entries, forest, shared, points, k, recall)
    in_leaf = max(1, n >> forest.depth)
    together, splits = max(1, PAGE // in_leaf), -(-in_leaf // PAGE)
    pages = -(-(1 << forest.depth) // together)
    number = np.float32 if isinstance(keyed.schema["vector"].dataType.elementType, FloatType) else np.float64

    def index(batches):
        """A row for each page that some vectors of a batch belong to: their leaves, how many ids each, ids, vectors."""
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("vector"))
            at = shared.value.leaves(_unit(v))
            ids, counts = batch.column("ids").flatten().to_numpy(), batch.column("ids").value_lengths().to_numpy().astype(np.uint8)
            first = np.cumsum(counts, dtype=np.int64) - counts
            page = ((np.arange(trees)[:, None] * pages + at // together) * splits + ids[first] % splits).ravel()
            order, v = np.argsort(page, kind="stable"), v.astype(number)
            starts = np.flatnonzero(np.append(True, np.diff(page[order]) != 0))
            out = []
            for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
                row = order[a:b] % len(v)
                which = np.repeat(first[row], counts[row]) + _within(counts[row])
                out.append((int(page[order[a]]), at.ravel()[order[a:b]].astype("<i4").tobytes(), counts[row].tobytes(), ids[which].tobytes(), v[row].tobytes()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["page", "leaf", "counts", "ids", "vectors"])

    def search(batches):
        for batch in batches:
            out = []
            for i, v in enumerate(_unit(_matrix(batch.column("vector"))) if batch.num_rows else []):
                wanted: dict[int, list[int]] = {}
                for t, at in shared.value.search(v, n_leaves):
                    for part in range(splits):
                        wanted.setdefault((t * pages + at // together) * splits + part, []).append(at)
                out += [(i, page, at) for page, at in wanted.items()]
            where, page, at = zip(*out, strict=True) if out else ([], [], [])
            own = batch.take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int32()), own.column("vec_id"), own.column("vector"), pa.array(at, pa.list_(pa.int32()))], ["page", "vec_id", "vector", "leaves"])

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if asked.num_rows and held.num_rows:
            leaf, counts, ids, v = (np.frombuffer(b"".join(held.column(c).to_pylist()), d) for c, d in (("leaf", "<i4"), ("counts", np.uint8), ("ids", "<i8"), ("vectors", number)))
            out = _ranked(_matrix(asked.column("vector")), asked.column("vec_id").to_numpy(), asked.column("leaves").combine_chunks(), leaf, counts, ids, v.reshape(len(leaf), -1), k)
        return pa.table([pa.array(c) for c in out], names=["query_id", "vec_id", "score"])

    indexed = entries.mapInArrow(index, "page int, leaf binary, counts binary, ids binary, vectors binary")
    queries = keyed.filter(F.col("vec_id") % every == 0).select("vec_id", "vector")
    element = keyed.schema["vector"].dataType.simpleString()
    asked = queries.mapInArrow(search, f"page int, vec_id bigint, vector {element}, leaves array<int>")
    found = asked.groupBy("page").cogroup(indexed.groupBy("page")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    counts = counts.astype(np.int64)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _ranked(queries, names, leaves, leaf, counts, ids, vectors, k: int) -> list[np.ndarray]:
    """(query_id, vec_id, score) of each query's ``k`` nearest in the leaves that it looks into, ties to the smaller id."""
    order = np.argsort(leaf, kind="stable")
    leaf, first = leaf[order], np.cumsum(counts, dtype=np.int64) - counts
    held = vectors[order].astype(np.float64)
    unit = _unit(held)
    who = np.repeat(np.arange(len(queries)), leaves.value_lengths().to_numpy())
    where = leaves.flatten().to_numpy()
    by_leaf = np.argsort(where, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(where[by_leaf]) != 0)) if len(where) else []
    asked, entry = [], []
    for a, b in zip(starts, np.append(starts[1:], len(where)), strict=True):
        lo, hi = np.searchsorted(leaf, [where[by_leaf[a]], where[by_leaf[a]] + 1])
        if lo == hi:
            continue
        own, step = who[by_leaf[a:b]], max(1, PRODUCTS // (hi - lo))
        for c in range(0, len(own), step):
            some = own[c : c + step]
            scores = queries[some] @ unit[lo:hi].T
            if hi - lo > k + 1:  # all that may tie with the last of the best, as the products are rounded
                scale = ROUNDING * np.linalg.norm(queries[some], axis=1)[:, None]
                near = scores >= np.partition(scores, -(k + 1), axis=1)[:, -(k + 1), None] - scale
            else:
                near = np.ones(scores.shape, bool)
            row, column = np.nonzero(near)
            asked.append(some[row])
            entry.append(column + lo)
    if not asked:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    asked, entry = np.concatenate(asked), np.concatenate(entry)
    score = np.empty(len(asked))
    for a in range(0, len(asked), 1 << 16):
        q, v = queries[asked[a : a + (1 << 16)]], held[entry[a : a + (1 << 16)]]
        dot = lambda x, y: np.einsum("ij,ij->i", x, y)
        score[a : a + (1 << 16)] = dot(q, v) / (np.sqrt(dot(q, q)) * np.sqrt(dot(v, v)))
    entry = order[entry]
    times = counts[entry]
    who, score = np.repeat(asked, times), np.repeat(score, times)
    found = ids[np.repeat(first[entry], times) + _within(times)]
    other = found != names[who]
    who, score, found = who[other], score[other], found[other]
    order = np.lexsort((found, -score, who))
    who, score, found = who[order], score[order], found[order]
    best = _within(np.bincount(who, minlength=len(queries))) < k
    return [names[who[best]], found[best], score[best]]
