"""Benchmark passages in documents, edited ones too: q-gram counts in diagonal bands, then banded alignment."""

from __future__ import annotations

from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches

#: Characters of a gram. Eight bytes are one machine word, so grams are compared as they are.
Q = 8
#: Edits allowed per byte of an item.
EDIT_RATE = 0.1
#: Items that are shorter than this when normalised are looked for as they are, at word borders.
LEAST_ITEM = 24
#: Hits of grams that are counted at once.
HITS = 1 << 19
#: Bytes of items in one index, which takes some 40 times as much, and indexes that one pass over the documents searches for.
BLOCK_BYTES = 3 << 19
BLOCKS_A_PASS = 4

_PLAIN = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> bytes:
    """Lower-case UTF-8 with every run of ASCII characters that are no letter or digit as one space."""
    return b" ".join((text or "").lower().encode().translate(_PLAIN).split())


def grams(data: bytes) -> np.ndarray:
    """The Q-grams at each place, as words, without copying."""
    n = max(0, len(data) - Q + 1)
    return np.ndarray((n,), "<u8", buffer=data, strides=(1,)) if n else np.zeros(0, np.uint64)


@dataclass
class ItemIndex:
    """Items by their grams. A hit at item place j counts for the diagonal: document place - j."""

    ids: list
    items: list[bytes]
    budget: np.ndarray
    need: np.ndarray
    words: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    band: int
    least: int
    tiny: dict[int, tuple[np.ndarray, np.ndarray]]

    @property
    def shift(self) -> np.uint64:
        return np.uint64(64 - (len(self.seen) * 8).bit_length() + 1)

    def may_have(self, word: np.ndarray) -> np.ndarray:
        """Where grams may be ones of an item: their bit is set."""
        h = (word * _MIX) >> self.shift
        return np.flatnonzero((self.seen[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & np.uint8(1))


def build_index(rows, edit_rate: float = EDIT_RATE, least: int = LEAST_ITEM) -> ItemIndex | None:
    """rows: (item_id, text). An occurrence of an item of m bytes within k edits keeps m + 1 - Q - k Q grams at least.

    k is edit_rate m, or less where that count would fall under one. Each item's grams that
    most other items share are left out, up to half of that count, and the count is
    lowered by as many: no occurrence is lost. Items under ``least`` bytes have no edits, those
    too short for a gram are kept by their length, as words. Items without letters and digits are left out.
    """
    ids, items = [], []
    for i, text in rows:
        if data := normalised(text):
            ids.append(i)
            items.append(data)
    if not items:
        return None
    m = np.array([len(x) for x in items])
    n_grams = np.maximum(0, m - Q + 1)
    budget = np.where(m < least, 0, np.clip((m * edit_rate).astype(int), 0, np.maximum(0, m - Q) // Q))
    need = np.maximum(1, m + 1 - Q - budget * Q)
    tiny = {}
    for size in range(1, Q):
        own = np.flatnonzero(m == size)
        if len(own):
            as_word = np.array([int.from_bytes(items[i], "little") for i in own], np.uint64)
            order = np.argsort(as_word, kind="stable")
            tiny[size] = as_word[order], own[order]
    word = np.concatenate([grams(x) for x in items])
    item = np.repeat(np.arange(len(items), dtype=np.int32), n_grams)
    place = np.concatenate([np.arange(n, dtype=np.int32) for n in n_grams])
    order = np.lexsort((item, word))
    first_of_item = np.ones(len(order), bool)
    first_of_item[1:] = (word[order[1:]] != word[order[:-1]]) | (item[order[1:]] != item[order[:-1]])
    shared, many = np.unique(word[order[first_of_item]], return_counts=True)
    common = many[np.searchsorted(shared, word)]
    order = np.lexsort((place, -common, item))
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams)
    out = (common > 1) & (rank < (need // 2)[item])
    need = need - np.bincount(item[out], minlength=len(items))
    word, item, place = word[~out], item[~out], place[~out]
    order = np.argsort(word, kind="stable")
    word, item, place = word[order], item[order], place[order]
    words, first = np.unique(word, return_index=True)
    bits = max(20, int(len(words) * 64).bit_length())
    seen = np.zeros(1 << (bits - 3), np.uint8)
    h = (words * _MIX) >> np.uint64(64 - bits)
    np.bitwise_or.at(seen, h >> np.uint64(3), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
    return ItemIndex(ids, items, budget, need, words, np.append(first, len(word)).astype(np.int32), item, place, seen, int(budget.max()) + 1, least, tiny)


def candidate_bands(index: ItemIndex, texts: list[bytes]):
    """(text, item, lowest diagonal) of the bands with enough grams. Bands are two budgets wide and overlap by one."""
    data = (b"\0" * Q).join(texts) + b"\0" * Q
    starts = np.cumsum([0, *(len(t) + Q for t in texts)])
    word = grams(data)
    at = index.may_have(word)
    word = word[at]
    which = np.minimum(np.searchsorted(index.words, word), len(index.words) - 1)
    good = index.words[which] == word
    at, which = at[good], which[good]
    counts = (index.first[which + 1] - index.first[which]).astype(np.int64)
    shift = int(max(map(len, index.items))) + 1
    found, tally, done = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.cumsum(counts)
    lo = 0
    while lo < len(at):  # so many hits at a time, however often texts repeat a gram that many items have
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + HITS)))
        n = counts[lo:hi]
        posting = np.repeat(index.first[which[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        here = np.repeat(at[lo:hi], n)
        text = np.searchsorted(starts, here, side="right") - 1
        low = (here - starts[text] - index.place[posting] + shift) // index.band
        keys = ((text * len(index.items) + index.item[posting]) << 32) + low
        keys, n = np.unique(np.concatenate((keys, keys + 1)), return_counts=True)  # band b holds steps b - 1 and b
        found.append(keys)
        tally.append(n)
        lo = hi
    both, back = np.unique(np.concatenate(found), return_inverse=True)
    n = np.bincount(back, np.concatenate(tally), len(both)).astype(np.int64)
    pair = both >> 32
    keep = n >= index.need[pair % len(index.items)]
    pair, band = pair[keep], (both & 0xFFFFFFFF)[keep]
    return zip((pair // len(index.items)).tolist(), (pair % len(index.items)).tolist(), ((band - 1) * index.band - shift).tolist(), strict=True)


def banded(item: bytes, text: bytes, low: int, width: int, most: int) -> tuple[int, int]:
    """(edits, end) of the best alignment of the whole item with some stretch of text whose diagonals are low .. low + width.

    Given up, with more than ``most`` edits, once no alignment can have fewer.
    """
    pad = len(item) + width + abs(low) + 2
    padded = np.full(len(text) + 2 * pad, -1, np.int16)
    padded[pad : pad + len(text)] = np.frombuffer(text, np.uint8)
    steps = np.arange(width + 1)
    out = 1 << 20
    cost = np.where((low + steps >= 0) & (low + steps <= len(text)), 0, out)
    for r, c in enumerate(item, 1):
        new = cost + (padded[pad + r - 1 + low : pad + r + low + width] != c)
        np.minimum(new[:-1], cost[1:] + 1, out=new[:-1])
        end = r + low + steps
        new[(end < 0) | (end > len(text))] = out
        cost = np.minimum.accumulate(new - steps) + steps
        cost[(end < 0) | (end > len(text))] = out
        if r % 16 == 0 and cost.min() > most:
            break
    best = int(cost.argmin())
    return int(cost[best]), len(item) + low + best


@lru_cache(maxsize=1 << 12)
def own_grams(item: bytes) -> np.ndarray:
    return np.unique(grams(item))


def shared_grams(item: bytes, text: bytes) -> int:
    """How many of a stretch's grams are among an item's: with the common ones, which the bands leave out."""
    own, word = own_grams(item), grams(text)
    return int((own[np.minimum(np.searchsorted(own, word), len(own) - 1)] == word).sum())


def bordered(text: bytes, a: int, b: int) -> bool:
    """Whether text[a:b] starts and ends no ASCII word in its middle; other scripts may write words without spaces."""
    plain = lambda i: 0 <= i < len(text) and text[i] < 128 and text[i] != 32
    return not (plain(a - 1) and plain(a)) and not (plain(b - 1) and plain(b))


def find_bordered(item: bytes, text: bytes, a: int, b: int) -> int:
    at = text.find(item, a, b)
    while at >= 0 and not bordered(text, at, at + len(item)):
        at = text.find(item, at + 1, b)
    return at


def tiny_hits(index: ItemIndex, texts: list[bytes]):
    """(text, item, place) of the items too short for a gram, in order of the place."""
    for t, text in enumerate(texts if index.tiny else []):
        word = grams(text + b"\0" * (Q - 1))
        for size, (known, own) in index.tiny.items():
            low = word & np.uint64((1 << 8 * size) - 1)
            first, last = np.searchsorted(known, low), np.searchsorted(known, low, side="right")
            for at in np.flatnonzero(last > first).tolist():
                if bordered(text, at, at + size):
                    yield from ((t, i, at) for i in own[first[at] : last[at]].tolist())


def leaks(index: ItemIndex, texts: list[bytes]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(text, item) -> (edits, start, end) in normalised bytes: the fewest edits, then the first place."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for t, i, at in tiny_hits(index, texts):
        found.setdefault((t, i), (0, at, at + len(index.items[i])))
    for t, i, low in candidate_bands(index, texts):
        item, text, k = index.items[i], texts[t], int(index.budget[i])
        width = 2 * index.band + 2 * k
        a, b = max(0, low - k), min(len(text), low + width + len(item))
        short = len(item) < index.least
        at = find_bordered(item, text, a, b) if short else text.find(item, a, b)
        if at >= 0:
            hit = (0, at, at + len(item))
        elif short:
            continue
        elif shared_grams(item, text[a:b]) < len(item) + 1 - Q - k * Q:
            continue
        else:
            edits, end = banded(item, text, low - k, width, k)
            if edits > k:
                continue
            back, begin = banded(item[::-1], text[max(0, end - len(item) - k) : end][::-1], 0, k + k, k)
            hit = (edits, end - begin, end)
        if (t, i) not in found or hit < found[t, i]:
            found[t, i] = hit
    return found


def source_offsets(text: str) -> tuple[array, array]:
    """For each byte of the normalised text, where the character it comes from starts and ends."""
    starts, ends, gap = array("q"), array("q"), -1
    for n, ch in enumerate(text):
        for b in ch.lower().encode().translate(_PLAIN):
            if b == 32:
                gap = n if starts and gap < 0 else gap
                continue
            if gap >= 0:
                starts.append(gap)
                ends.append(n)
                gap = -1
            starts.append(n)
            ends.append(n + 1)
    return starts, ends


def passes(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, edit_rate: float = EDIT_RATE):
    """The benchmark as broadcast indexes of bounded size, some at a time: items are dealt to as many blocks as their bytes ask for."""
    rows = benchmark.select("item_id", "text").filter("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks, held = max(1, -(-int(size) // block_bytes)), []
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        if index := build_index([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()], edit_rate):
            held.append(benchmark.sparkSession.sparkContext.broadcast(index))
        if held and (len(held) == BLOCKS_A_PASS or b == blocks - 1):
            yield held
            held = []


def find_leaks(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the best occurrence of each benchmark item in each whole document.

    docs (doc_id, text), benchmark (item_id, text). Texts are compared in lower case and
    without punctuation; edits counts UTF-8 bytes, start and end are code points of the
    document. An item occurs where edit_rate of its bytes at most are edited. Null and
    empty texts leak nothing, items under 24 normalised bytes are found as they are at word borders, and
    repeated rows of documents or items are each reported. Without documents, items or occurrences
    there are no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own, theirs = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    kind = f"doc_id {own}, item_id {theirs}, edits int, start int, end int"
    schema, out = _arrow(spark, kind), spark.createDataFrame([], kind)
    for indexes in passes(benchmark, block_bytes, edit_rate):

        def run(batches, indexes=indexes):
            for batch in chunks(batches):
                ids, source = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                plain = [normalised(t) for t in source]
                rows, last = [], None
                hits = sorted((t, n, i, *hit) for n, shared in enumerate(indexes) for (t, i), hit in leaks(shared.value, plain).items())
                for t, n, i, edits, a, b in hits:
                    if t != last:
                        last, (starts, ends) = t, source_offsets(source[t])
                    rows.append((ids[t], indexes[n].value.ids[i], edits, starts[a], ends[b - 1] if b > a else starts[a]))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], schema=schema)

        out = out.union(docs.select("doc_id", "text").filter("text is not null").mapInArrow(run, kind))
    return out


def _arrow(spark, kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(kind))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; the rest as it is, null texts included."""
    small_batches(docs.sparkSession)
    for indexes in passes(benchmark, block_bytes, edit_rate):

        def run(batches, indexes=indexes):
            for batch in chunks(batches):
                for shared in indexes:
                    bad = {t for t, _ in leaks(shared.value, [normalised(t) for t in batch.column("text").to_pylist()])}
                    batch = batch.filter(pa.array([t not in bad for t in range(batch.num_rows)], pa.bool_()))
                yield batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs
