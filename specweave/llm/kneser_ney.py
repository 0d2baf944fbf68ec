"""Interpolated Kneser-Ney n-gram models of characters, counted, smoothed and looked up in shards.

Documents are dealt to blocks once, compressed, and every step meets them there.
Blocks count their n-grams; counts are added up by n-gram; continuation counts,
discounts and probabilities follow by joins. Nobody gets the whole model: a block
asks for the different n-grams that occur in it, each question goes to the shard that
holds what its answer needs, kept as sorted hash arrays, and the answers meet the
block again, where its texts are looked up.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.plans.lineage import cut

from .blocks import batches_of
from .common import chunks

#: Parts of the model at least, entries of a part, and blocks that ask one copy of it; there are as many parts and copies as that takes.
SHARDS = 24
SHARD_ROWS = 200_000
BLOCKS_A_COPY = 64
#: Bytes of text whose n-grams are taken at once.
STEP_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


@cache
def letters() -> np.ndarray:
    """Code point to symbol: letters in lower case, everything else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(65, 0x30000):
        if (ch := chr(c)).isalpha():
            table[c] = ord(low) if len(low := ch.lower()) == 1 else c
    return table


@cache
def characters() -> np.ndarray:
    """Code point to symbol: as it is, digits as 0, white space and controls as a space."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x3001):
        if (ch := chr(c)).isspace() or c < 32:
            table[c] = 32
        elif ch.isdecimal():
            table[c] = 48
    return table


class Grams:
    """All n-grams that end at a character of some texts; each text is preceded by spaces."""

    def __init__(self, texts: list[str], order: int, symbols: np.ndarray):
        pad = " " * (order - 1)
        joined = pad + pad.join(texts)
        self.symbols = symbols[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
        self.order = order
        codes = self.symbols[: len(self.symbols) - order + 1].astype(np.uint64)
        for j in range(1, order):
            codes = codes * _MULT + self.symbols[j : len(self.symbols) - order + 1 + j]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths + order - 1) - self.lengths - order + 1  # of the gram that ends at a text's first character
        inside = np.zeros(len(codes) + 1, np.int8)
        np.add.at(inside, self.starts[self.lengths > 0], 1)
        np.add.at(inside, (self.starts + self.lengths)[self.lengths > 0], -1)
        self.at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
        coded = pa.array(codes[self.at]).dictionary_encode()
        self.codes = coded.dictionary.to_numpy()
        self.which = coded.indices.to_numpy()

    def strings(self) -> np.ndarray:
        """The different n-grams as a matrix of code points."""
        first = np.empty(len(self.codes), np.int64)
        first[self.which[::-1]] = self.at[::-1]
        return self.symbols[first[:, None] + np.arange(self.order)]

    def counts(self) -> np.ndarray:
        return np.bincount(self.which, minlength=len(self.codes))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value for each different n-gram over all its n-grams."""
        running = np.concatenate(([0.0], np.cumsum(values[self.which], dtype=np.float64)))
        ends = np.cumsum(self.lengths)
        return running[ends] - running[ends - self.lengths]


def as_strings(points: np.ndarray) -> np.ndarray:
    """A matrix of code points as an array of strings."""
    n = points.shape[1]
    return np.ascontiguousarray(points.astype("<u4")).view(f"<U{n}").reshape(len(points)) if len(points) else np.zeros(0, "<U1")


def count_grams(docs: DataFrame, order: int, symbols: Callable[[], np.ndarray], only: DataFrame | None = None) -> DataFrame:
    """(key, gram, c) over all texts of ``docs`` (key, text) that have a key, added up in each partition before the shuffle.

    With ``only`` (block, doc_id), ``docs`` are blocks, and of these documents alone.
    """

    def run(batches) -> pa.Table:
        held: dict[str, list] = {}
        for batch in batches:
            for key, own in _by_key(batch):
                g = Grams(own, order, symbols())
                parts = held.setdefault(key, [])
                parts.append((g.codes, g.strings(), g.counts()))
                if len(parts) >= 8:
                    held[key] = [_added(parts)]
        keys, grams, counts = [], [], []
        for key, parts in held.items():
            _, points, n = _added(parts)
            grams += as_strings(points).tolist()
            keys += [key] * len(points)
            counts.append(n)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return pa.table({"key": pa.array(keys, pa.string()), "gram": pa.array(grams, pa.string()), "c": pa.array(n, pa.int64())})

    def chosen_of(blobs: pa.Table, chosen: pa.Table) -> pa.Table:
        ids = pa.array(sorted({*chosen.column("doc_id").to_pylist()}), chosen.schema.field("doc_id").type)
        return run(batch.filter(pc.is_in(batch.column("doc_id"), ids)) for batch in batches_of(blobs, STEP_BYTES))

    kind = "key string, gram string, c long"
    if only is None:
        counted = docs.select("key", "text").mapInArrow(lambda batches: run(chunks(batches, STEP_BYTES)).to_batches(50_000), kind)
    else:
        counted = docs.groupBy("block").cogroup(only.groupBy("block")).applyInArrow(chosen_of, kind)
    return counted.groupBy("key", "gram").agg(F.sum("c").alias("c"))


def _by_key(batch: pa.RecordBatch):
    """(key, its texts) of a batch's rows that have a key and a text."""
    held: dict[str, list[str]] = {}
    for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
        if key is not None and text:
            held.setdefault(key, []).append(text)
    return sorted(held.items())


def _added(parts):
    codes, first, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    points = np.concatenate([p[1] for p in parts])[first]
    return codes, points, np.bincount(back, np.concatenate([p[2] for p in parts]), len(codes)).astype(np.int64)


def smooth(counts: DataFrame, order: int, modified: bool = True) -> DataFrame:
    """(key, gram, p, g): interpolated probability of each n-gram of 1 to ``order`` characters, back-off weight of each context.

    The highest order uses counts, the lower ones the number of different characters
    seen before. modified takes three discounts per order and key, by counts of one, two and more,
    from the counts of counts; else one. The least model is uniform over the characters
    seen and one unseen; the gram of no characters carries its share.
    """
    levels = {order: cut(counts)}
    for n in range(order - 1, 0, -1):
        longer = levels[n + 1]
        levels[n] = cut(longer.groupBy("key", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c")))
    alphabet = levels[1].groupBy("key").agg((1.0 / (F.count("*") + 1)).alias("lower"))
    out = alphabet.select("key", F.lit("").alias("gram"), F.col("lower").alias("p"), F.lit(None).cast("double").alias("g"))
    below = alphabet.select("key", F.lit("").alias("suffix"), "lower")
    for n in range(1, order + 1):
        seen = levels[n]
        of = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in range(1, 5)]
        d = seen.groupBy("key").agg(*of)
        y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        if modified:
            step = lambda i: F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.lit(float(i)) - (i + 1) * y * F.coalesce(F.try_divide(f"n{i + 1}", f"n{i}"), F.lit(0.5))))
            d = d.select("key", step(1).alias("d1"), step(2).alias("d2"), step(3).alias("d3"))
        else:
            y = F.greatest(F.lit(0.05), F.least(F.lit(0.95), y))
            d = d.select("key", y.alias("d1"), y.alias("d2"), y.alias("d3"))
        # d and, for n = 1, what it joins have one row for each language
        seen = seen.join(F.broadcast(d), "key").withColumn("context", F.substring("gram", 1, n - 1)).withColumn("suffix", F.substring("gram", 2, n - 1))
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = seen.groupBy("key", "context").agg(F.sum("c").cast("double").alias("total"), (F.sum(off) / F.sum("c")).alias("g"))
        p = seen.join(context, ["key", "context"]) if n > 1 else seen.join(F.broadcast(context.drop("context")), "key")
        p = p.join(below, ["key", "suffix"]) if n > 1 else p.join(F.broadcast(below.drop("suffix")), "key")
        p = cut(p.select("key", "gram", ((F.col("c") - off) / F.col("total") + F.col("g") * F.col("lower")).alias("p")))
        out = out.unionByName(p.withColumn("g", F.lit(None).cast("double")))
        out = out.unionByName(context.select("key", F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), "g"))
        below = p.select("key", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
    return cut(out.groupBy("key", "gram").agg(F.max("p").alias("p"), F.max("g").alias("g")))


class Table:
    """A share of the model: for n-grams of each length, sorted hashes with p and g for each key."""

    def __init__(self, rows: pa.Table, keys: list[str], order: int):
        self.order = order
        lengths = pc.utf8_length(rows.column("gram")).to_numpy()
        place = pc.index_in(rows.column("key"), pa.array(keys, pa.string())).to_numpy(zero_copy_only=False)
        p, g = (rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("p", "g"))
        grams = np.array(rows.column("gram").to_pylist(), object)
        self.hashes, self.p, self.g = [], [], []
        for n in range(order + 1):
            own = np.flatnonzero(lengths == n)
            hashes, at = np.unique(_codes(grams[own].tolist(), n), return_inverse=True)
            self.hashes.append(hashes)
            for values, out in ((p, self.p), (g, self.g)):
                matrix = np.full((len(hashes), len(keys)), np.nan)
                there = ~np.isnan(values[own])
                matrix[at[there], place[own][there]] = values[own][there]
                out.append(matrix)

    def _find(self, points: np.ndarray):
        codes = hashed(points)
        if not len(self.hashes[points.shape[1]]):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.hashes[points.shape[1]], codes), len(self.hashes[points.shape[1]]) - 1)
        return at, self.hashes[points.shape[1]][at] == codes

    def log_p(self, points: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each n-gram given the others, for each key."""
        at, found = self._find(points[:, :0])
        p = np.where(found[:, None], self.p[0][at] if len(self.p[0]) else np.nan, np.nan)
        for n in range(1, self.order + 1):
            own, seen = self._find(points[:, self.order - n :])
            context, known = self._find(points[:, self.order - n : self.order - 1])
            weight = self.g[n - 1][context] if len(self.g[n - 1]) else np.full_like(p, np.nan)
            backed = np.where(known[:, None] & ~np.isnan(weight), weight, 1.0) * p
            full = self.p[n][own] if len(self.p[n]) else np.full_like(p, np.nan)
            p = np.where(seen[:, None] & ~np.isnan(full), full, backed)
        return np.log(p)


def hashed(points: np.ndarray) -> np.ndarray:
    """The code of each row of code points, as Grams has it."""
    codes = points[:, 0].astype(np.uint64) if points.shape[1] else np.zeros(len(points), np.uint64)
    for j in range(1, points.shape[1]):
        codes = codes * _MULT + points[:, j]
    return codes


def _codes(grams: list[str], n: int) -> np.ndarray:
    if not (grams and n):
        return np.zeros(len(grams), np.uint64)
    return hashed(np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n))


def shard_of(points: np.ndarray, shards: int) -> np.ndarray:
    """By the two characters before the last: p of the n-gram and of its ends, and g of their contexts, agree in these."""
    return ((hashed(points[:, -3:-1]) * _MULT) >> np.uint64(40)).astype(np.int64) % shards


def in_shards(model: DataFrame, shards: int, copies: int) -> DataFrame:
    """(shard, key, gram, p, g): each entry where it is asked for, in each copy; those too short to tell are in every shard."""

    def run(batches):
        for batch in batches:
            grams, lengths = batch.column("gram"), pc.utf8_length(batch.column("gram")).to_numpy()
            there = {c: batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("p", "g")}
            rows, where, use = [], [], []
            for n in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == n)
                points = _points(grams.take(pa.array(own)).to_pylist(), n)
                for c, least in (("p", 3), ("g", 2)):  # p is asked for under the two characters before the last, g under the last two
                    some = there[c][own]
                    row = own[some]
                    if n >= least:
                        at = shard_of(points[some] if c == "p" else np.pad(points[some], ((0, 0), (0, 1))), shards)
                    else:
                        row, at = np.repeat(row, shards), np.tile(np.arange(shards), len(row))
                    rows.append(np.repeat(row, copies))
                    where.append(np.repeat(at, copies) + shards * np.tile(np.arange(copies), len(at)))
                    use.append(np.full(len(row) * copies, c == "g"))
            rows, where, use = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, where, use))
            t = batch.take(pa.array(rows, pa.int64()))
            p, g = (pc.if_else(pa.array(mask.astype(bool)), t.column(c), pa.scalar(None, pa.float64())) for c, mask in (("p", use == 0), ("g", use != 0)))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), t.column("key"), t.column("gram"), p, g], ["shard", "key", "gram", "p", "g"])

    return model.select("key", "gram", "p", "g").mapInArrow(run, "shard int, key string, gram string, p double, g double")


def _points(grams: list[str], n: int) -> np.ndarray:
    """Strings of n characters as a matrix of code points."""
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(grams), n).astype(np.uint64)


def _codes(grams: list[str], n: int) -> np.ndarray:
    return hashed(_points(grams, n))


def packed_points(points: np.ndarray) -> bytes:
    """A matrix of code points, byte place by byte place, compressed: mostly zeros."""
    planes = np.ascontiguousarray(points.astype("<u4").view(np.uint8).reshape(len(points), -1).T)
    return len(points).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked_points(data: bytes, order: int) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = pa.decompress(data[4:], 4 * order * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4 * order, n).T).view("<u4")


def _distinct(points: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate(points)
    return both[np.unique(hashed(both), return_index=True)[1]]


def score(blocks: DataFrame, n_blocks: int, model: DataFrame, keys: list[str], order: int, symbols: Callable[[], np.ndarray], own_key: bool, finish: Callable, kind: str) -> DataFrame:
    """finish(batch, n, sums) for some rows at a time: their characters and the log probabilities of their texts.

    With ``own_key`` each text is measured by the model of its row's key, and sums has one
    column; else by all models, in order of ``keys``. A null text has no characters.
    """

    copies = -(-n_blocks // BLOCKS_A_COPY)
    shards = max(SHARDS, -(-model.count() // SHARD_ROWS))

    def ask(blobs: pa.Table) -> pa.Table:
        block = blobs.column("block")[0].as_py()
        held: dict[str, list] = {}
        for batch in batches_of(blobs, STEP_BYTES):
            for key, own in _by_key(batch) if own_key else [("", [t for t in batch.column("text").to_pylist() if t])]:
                if own:
                    parts = held.setdefault(key, [])
                    parts.append(Grams(own, order, symbols()).strings())
                    if len(parts) >= 8:
                        held[key] = [_distinct(parts)]
        rows = []
        for key, parts in held.items():
            points = _distinct(parts)
            shard = shard_of(points, shards)
            for k in np.unique(shard).tolist():
                rows.append((block, k + shards * (block % copies), key, packed_points(points[shard == k])))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=["block", "shard", "key", "data"])

    def answer(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows:
            lookup = Table(rows, keys, order)
            for block, key, data in zip(*(asked.column(c).to_pylist() for c in ("block", "key", "data")), strict=True):
                points = unpacked_points(data, order)
                logs = lookup.log_p(points)
                if own_key:
                    logs = logs[:, [keys.index(key)]]
                out.append((block, key, hashed(points).tobytes() + logs.astype("<f4").tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.binary()), strict=True)], names=["block", "key", "data"])

    def tell(blobs: pa.Table, told: pa.Table) -> pa.Table:
        width = 1 if own_key else len(keys)
        parts: dict[str, list] = {}
        for key, data in zip(told.column("key").to_pylist(), told.column("data").to_pylist(), strict=True):
            n = len(data) // (8 + 4 * width)
            parts.setdefault(key, []).append((np.frombuffer(data, "<u8", n), np.frombuffer(data, "<f4", n * width, 8 * n).reshape(n, width)))
        known = {}
        for key, some in parts.items():
            codes, values = (np.concatenate(x) for x in zip(*some, strict=True))
            o = np.argsort(codes)
            known[key] = codes[o], values[o].astype(np.float64)
        out = []
        for batch in batches_of(blobs, STEP_BYTES):
            texts = batch.column("text").to_pylist()
            names = batch.column("key").to_pylist() if own_key else [""] * len(texts)
            sums = np.zeros((len(texts), width))
            for key in {k for k, t in zip(names, texts, strict=True) if t and k is not None}:
                rows = [i for i, (k, t) in enumerate(zip(names, texts, strict=True)) if t and k == key]
                g = Grams([texts[i] for i in rows], order, symbols())
                values = known[key][1][np.searchsorted(known[key][0], g.codes)]
                for c in range(width):
                    sums[rows, c] = g.sums(values[:, c])
            out.append(finish(batch, np.array([len(t or "") for t in texts], np.int64), sums))
        return pa.concat_tables(out)

    entries = in_shards(model, shards, copies)
    asked = blocks.groupBy("block").applyInArrow(ask, "block int, shard int, key string, data binary")
    told = asked.groupBy("shard").cogroup(entries.groupBy("shard")).applyInArrow(answer, "block int, key string, data binary")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tell, kind)


def learned_keys(model: DataFrame) -> list[str]:
    """The keys that have a model: one for each language."""
    return sorted(r.key for r in model.filter("gram = ''").select("key").collect())


def quantile(rows: DataFrame, key: str, value: str, q: float, bins: float) -> DataFrame:
    """(key, limit): the least multiple of 1 / bins that q of a key's values do not exceed; over all rows, in bounded memory."""
    binned = rows.groupBy(key, F.ceil(F.col(value) * bins).alias("bin")).agg(F.count("*").alias("n"))
    order: Column = Window.partitionBy(key).orderBy("bin")
    up_to = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(key))
    placed = binned.withColumn("up_to", up_to).withColumn("total", total).filter(F.col("up_to") >= F.col("total") * q)
    return placed.groupBy(key).agg((F.min("bin") / bins).alias("limit"))
