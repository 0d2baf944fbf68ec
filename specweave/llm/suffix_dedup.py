"""Removal of 50-byte strings that an earlier document has, by a hash-compared sort of suffixes.

Prefix polynomial hashes give the hash of any stretch of text in constant time, so a binary
search over them finds how far two suffixes agree, and a mergesort of suffixes needs a
logarithmic number of probes for each comparison; where hashes agree to the full 50 bytes,
the bytes are compared. Sorting the suffixes of a whole corpus in one place
would move every byte many times over, so they are dealt out by their anchor, the
smallest hash of any 24 bytes among their first 50: suffixes that agree in 50 bytes share it.
Consecutive suffixes with one anchor form a run. A run that is met by an equal one in an
earlier document, as inside any long passage, is settled as a whole once its bytes are compared: the earlier
document sends them, a stretch of runs at a time. The suffixes of runs that differ
under a shared anchor, at the edges of what is repeated, are sorted one by one, as are those of runs
whose hashes agree and whose bytes do not. Where very many
runs differ under one anchor, as around a line that everybody quotes, their suffixes are dealt
out once more, by the hash of their first 50 bytes. Hashes only say what to compare: nothing is
removed whose bytes were not found equal, and unequal bytes under equal hashes cost time alone.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, batches_of, in_blocks
from .common import BATCH_BYTES, binary_rows, chunks, flat, held_bytes, parts_of, small_batches

LENGTH = 50
#: Bytes of an anchor. Any window holds LENGTH - ANCHOR + 1 of them.
ANCHOR = 24
#: Bytes of text whose runs are combined before they are sent on, and that make a bucket.
COMBINE_BYTES = 6 << 20
BUCKET_BYTES = 12 << 20
#: Bytes of text in a block: half of what other operators take, as what a block is told and sends takes several times its texts.
OWN_BLOCK_BYTES = BLOCK_BYTES // 2
#: Anchors are sorted where these bits of them say.
SPREAD = (1 << 24) - 1
#: Different runs under one anchor that are sorted in one place; of more, each suffix goes its own way.
WIDE_RUNS = 2048
#: Bytes of text that are hashed at once.
HASH_BYTES = 64 << 10
#: Bytes that documents of a block send to later ones before they are compressed.
SEND_BYTES = 16 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: What a document is told of a run (first window s, n after it, anchor m): to remove it, to send its text, or to send each of its windows.
SETTLED, OPEN, WIDE = 0, 1, 2
#: Messages to a block: what its documents are told; runs that later documents claim to share with them; bytes that earlier documents sent for that.
TOLD, CLAIMS, BYTES = 0, 1, 2
#: Documents that one document sends its bytes of a run to; those compare them and send on their own.
FAN_OUT = 64


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out, m = np.ones(n, np.uint64), 1
    while m < n:
        q = min(m, n - m)
        out[m : m + q] = out[:q] * _U(pow(base, m, 1 << 64))
        m += q
    return out


def _grown(n: int) -> int:
    return 1 << max(18, int(n).bit_length())


def mixed(h: np.ndarray) -> np.ndarray:
    h = h.copy()
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h ^= h >> _U(shift)
        h *= _U(factor)
    h ^= h >> _U(32)
    return h


class Prefixes:
    """Prefix polynomial hashes of a byte array, modulo 2^64 over a random value for each byte."""

    def __init__(self, buffer: np.ndarray, bits: int = 64):
        n, self.mask = len(buffer), _U((1 << bits) - 1)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), _grown(n))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[buffer] * _powers(_BASE, _grown(n))[:n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """The hash of each stretch of this length."""
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n]) & self.mask

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal for equal stretches of one length."""
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts] & self.mask

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * _U(_BASE)) & self.mask


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    s, out = 1, values
    while 2 * s <= width:
        out, s = np.minimum(out[:-s], out[s:]), 2 * s
    return np.minimum(out[: len(out) - (width - s)], out[width - s :]) if width > s else out


def anchored_runs(buffer: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, bits: int = 64):
    """(text index, first window, windows after it, anchor hash, content hash) of each run, in text order."""
    none = np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    long = lengths >= length
    if not long.any():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefixes = Prefixes(buffer, bits)
    least = sliding_min(prefixes.every(anchor), length - anchor + 1)
    first = np.append(True, least[1:] != least[:-1])
    first[offsets[:-1][long]] = True
    starts = np.flatnonzero(first)
    which = np.searchsorted(offsets, starts, side="right") - 1
    ends = (offsets[1:] - length + 1)[which]  # of the windows of its text
    inside = starts < ends
    starts, which, ends = starts[inside], which[inside], ends[inside]
    after = np.minimum(ends, np.append(starts[1:], len(least))) - starts - 1
    return which, starts - offsets[which], after, least[starts], prefixes.of(starts, starts + after + length)


#: Columns of runs and what is told of them; others have 32 bits.
_KINDS = {"doc": np.int64, "td": np.int64, "m": np.uint64, "k": np.uint8}
_FIELDS = (("doc", 8), ("h", 4))
#: Of an anchor's hash the bucket has the rest; n has a bit more, whether the run is settled.
_ENTRY = (("m", 4), ("c", 3), ("s", 4), ("n", 4))
_LOW, _LOW_BITS = _U(32), _U((1 << 32) - 1)
_TELL = (("s", 4), ("n", 4), ("m", 8), ("k", 1))
#: A claim on a run (s, n) of this document by the run at s + shift of another (td; th is its h exclusive or this one's); k is what becomes of both if bytes differ.
_CLAIM = (("s", 4), ("n", 4), ("k", 1), ("td", 8), ("th", 4), ("shift", 4))


def _places(at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item of parts of these sizes that begin at these places: its place, and the size of its part."""
    return np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), np.repeat(sizes, sizes)


def _pack(x: dict[str, np.ndarray], bounds: np.ndarray, entry=_ENTRY) -> pa.Array:
    """Rows as bytes, a message for each bounds[i]:bounds[i + 1], all made in one pass; rows of one document beside each other name it once.

    Numbers of a message are laid down byte place by byte place, so that compression sees like with like; of doc_ids, the steps between them.
    """
    sizes = np.diff(bounds)
    if not len(sizes):
        return pa.array([], pa.binary())
    new = np.append(True, (x["doc"][1:] != x["doc"][:-1]) | (x["h"][1:] != x["h"][:-1]))
    new[bounds[:-1]] = True
    heads = np.flatnonzero(new)
    docs = np.diff(np.searchsorted(heads, bounds))
    counts = np.diff(np.append(heads, len(new)))
    ends = np.cumsum(8 + docs * 16 + sizes * sum(w for _, w in entry))
    at = ends - np.diff(ends, prepend=0)
    out = np.empty(ends[-1], np.uint8)
    out[at[:, None] + np.arange(8)] = np.stack([docs, sizes], 1).astype("<u4").view(np.uint8)
    at = at + 8
    steps = x["doc"][heads].astype(np.uint64)
    steps[1:] -= steps[:-1].copy()
    own = np.searchsorted(heads, bounds[:-1])
    steps[own] = x["doc"][heads[own]].astype(np.uint64)
    for values, width, n in [(steps, 8, docs), (x["h"][heads], 4, docs), (counts, 4, docs), *((x[f], w, sizes) for f, w in entry)]:
        place, step = _places(at, n)
        low = values.astype(f"<u{8 if width > 4 else 4}").view(np.uint8).reshape(len(values), -1)
        for k in range(width):
            out[place] = low[:, k]
            place += step
        at = at + n * width
    return binary_rows(out, np.append(0, ends))


def _unpack(data: pa.Array, entry=_ENTRY) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The rows of such messages, and how many each message has."""
    packed, offsets = flat(pa.RecordBatch.from_arrays([data], ["text"]))
    at = offsets[:-1]
    docs, sizes = packed[at[:, None] + np.arange(8)].view("<u4").astype(np.int64).T if len(at) else np.zeros((2, 0), np.int64)
    at, x = at + 8, {}
    for f, width, n in [*((f, w, docs) for f, w in _FIELDS), ("count", 4, docs), *((f, w, sizes) for f, w in entry)]:
        place, step = _places(at, n)
        kind = np.dtype(_KINDS.get(f, np.uint32))
        out = np.zeros((len(place), kind.itemsize), np.uint8)
        for k in range(width):
            out[:, k] = packed[place]
            place += step
        x[f], at = out.view(kind.newbyteorder("<")).reshape(-1), at + n * width
    counts = x.pop("count").astype(np.int64)
    begin = np.cumsum(docs) - docs  # doc_ids from their steps, modulo 2^64
    sums = np.append(_U(0), np.cumsum(x["doc"].view(np.uint64)))
    x["doc"] = (sums[1:] - np.repeat(sums[begin], docs)).view(np.int64)
    return x | {f: np.repeat(x[f], counts) for f, _ in _FIELDS}, sizes


def _joined(many: list[dict]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([x[k] for x in many]) for k in many[0]}


def _take(x: dict, which) -> dict:
    return {k: v[which] for k, v in x.items()}


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal keys begin in sorted columns."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two columns of 32 bits as one."""
    return a.astype(np.uint64) << _U(32) | b


def _earliest(x: dict) -> tuple[dict, np.ndarray]:
    """Runs sorted by anchor and content, then document, its text and place; for each whether an earlier document has its anchor and content."""
    x = _take(x, np.lexsort((_both(x["h"], x["s"]), x["doc"], _both(x["c"], x["n"]), x["m"])))
    starts = _groups(x["m"], x["c"], x["n"])
    least = np.repeat(x["doc"][starts], np.diff(np.append(starts, len(x["doc"]))))
    return x, x["doc"] > least


def _shared(m: np.ndarray) -> np.ndarray:
    """Which rows have an anchor that others have, by anchor."""
    order = np.argsort(m)
    starts = _groups(m[order])
    counts = np.diff(np.append(starts, len(order)))
    return order[np.repeat(counts > 1, counts)]


def _marked(x: dict, kind: int) -> dict:
    return x | {"k": np.full(len(x["doc"]), kind, np.uint8)}


def _dealt(doc_id, n: int):
    return F.pmod(doc_id, F.lit(n)).cast("int")


def _by_block(x: dict, blocks: int, entry=_TELL) -> pa.RecordBatch:
    """What documents are told, or claims on them, a row for each block that holds some of them: block, data, kind."""
    block = np.mod(x["doc"], blocks)
    # rows of one document come together
    order = np.argsort(block.astype(np.uint64) << _U(40) | (x["doc"] // blocks).astype(np.uint64) & _U((1 << 40) - 1))
    block = block[order]
    bounds = np.append(_groups(block), len(block))
    return _messages(block[bounds[:-1]], _pack(_take(x, order), bounds, entry), CLAIMS if entry is _CLAIM else TOLD)


def _messages(block, data, kind: int) -> pa.RecordBatch:
    arrays = [pa.array(block, pa.int32()), data if isinstance(data, pa.Array) else pa.array(data, pa.binary()), pa.array([kind] * len(data), pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, ["block", "data", "kind"])


_NOTHING = _messages([], [], TOLD)


def _same_bytes(buffer: np.ndarray, at: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``at`` and from ``other`` on agree; overlapping stretches of one distance are compared once, and judged together."""
    order = np.lexsort((at, at - other))
    a, d, end = at[order], (at - other)[order], (at + size)[order]
    new = np.append(True, (d[1:] != d[:-1]) | (a[1:] > end[:-1])) if len(a) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    ends = np.maximum.reduceat(end, starts) if len(starts) else end
    same = [np.array_equal(buffer[x:y], buffer[x - k : y - k]) for x, y, k in zip(a[starts].tolist(), ends.tolist(), d[starts].tolist(), strict=True)]
    out = np.zeros(len(at), bool)
    out[order] = np.array(same, bool)[np.cumsum(new) - 1] if len(same) else False
    return out


def _send(length: int, anchor: int, buckets: int, bits: int):
    """Texts to runs by bucket of their anchor. Of equal runs met here, all but the earliest are settled at once, their bytes compared."""

    def flush(held, buffers):
        x = _joined(held)
        p, settled = x.pop("p"), np.zeros(len(x["m"]), bool)
        which = _shared(x["m"])
        if len(which):
            some, covered = _earliest({**_take(x, which), "row": which})
            first = _groups(some["m"], some["c"], some["n"])
            source = np.repeat(some["row"][first], np.diff(np.append(first, len(which))))[covered]
            which = some["row"][covered]
            settled[which] = _same_bytes(np.concatenate(buffers), p[which], p[source], x["n"][which].astype(np.int64) + length)
        x["n"] = x["n"] << 1 | settled
        bucket = (x["m"] >> _LOW) % _U(buckets)
        order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.uint32), kind="stable")  # text by text within a bucket
        bucket = bucket[order]
        bounds = np.append(_groups(bucket), len(bucket))
        return pa.RecordBatch.from_arrays([pa.array(bucket[bounds[:-1]].astype(np.int32)), _pack(_take(x, order), bounds)], ["bucket", "data"])

    def run(batches):
        held, buffers, size = [], [], 0
        for batch in chunks(batches, HASH_BYTES):
            buffer, offsets = flat(batch)
            which, s, n, m, c = anchored_runs(buffer, offsets, length, anchor, bits)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint32)
            if len(which):
                held.append({"doc": ids[which], "h": h[which], "s": s.astype(np.uint32), "n": n.astype(np.uint32), "m": m, "c": c.astype(np.uint32) & np.uint32(0xFFFFFF), "p": size + offsets[which] + s})
            buffers.append(buffer)
            if (size := size + len(buffer)) >= COMBINE_BYTES and held:
                yield flush(held, buffers)
                held, buffers, size = [], [], 0
        if held:
            yield flush(held, buffers)

    return run


def _meet(blocks: int, wide: int):
    """Runs of whole buckets, one bucket at a time."""

    def run(batches):
        held: dict[int, list[pa.Array]] = {}
        for batch in batches:
            own = batch.column("bucket").to_numpy()
            for bucket in np.unique(own).tolist():
                held.setdefault(bucket, []).append(batch.column("data").filter(pa.array(own == bucket)))
        while held:
            bucket, data = held.popitem()
            x, _ = _unpack(pa.concat_arrays(data))
            x["m"] |= _U(bucket) << _LOW
            yield from _met(x, blocks, wide)
        yield _NOTHING

    return run


def _met(x: dict, blocks: int, wide: int):
    """Runs of a bucket: those that an earlier document seems to have are claimed from it, those that only share an anchor stay open.

    Of the documents that have a run, each claims it from one before it, FAN_OUT of them from one. Of equal runs all in the earliest document stay open: its repeats lose as much as the first of them.
    """
    settled = (x["n"] & 1).astype(bool)
    x["n"] >>= 1
    told = ("doc", "h", "s", "n", "m", "k")
    out = [_marked({k: x[k][settled] for k in told[:-1]}, SETTLED)]
    x = _take(x, ~settled) if settled.any() else x
    x = _take(x, _shared(x["m"]))
    if len(x["m"]):
        x, covered = _earliest(x)
        first = np.zeros(len(covered), bool)
        first[_groups(x["m"], x["c"], x["n"])] = True
        starts = _groups(x["m"])
        counts = np.diff(np.append(starts, len(first)))
        contents = np.add.reduceat(first.astype(np.int64), starts)
        mixed_docs = np.minimum.reduceat(x["doc"], starts) != np.maximum.reduceat(x["doc"], starts)
        once = np.zeros(len(covered), bool)  # equal rows tell the same
        once[_groups(x["m"], x["c"], x["n"], x["doc"], x["h"], x["s"])] = True
        # the first document's other runs of the same hashes are held against its first, unless all of them are open anyway
        again = ~covered & once & ~first & np.repeat(mixed_docs & (contents == 1), counts)
        claims = _claims(x, covered | again, np.repeat(np.where(contents > wide, WIDE, OPEN), counts))
        yield _by_block(claims, blocks, _CLAIM)
        for kind, some in ((OPEN, (contents > 1) & (contents <= wide)), (WIDE, contents > wide)):
            out.append(_marked({k: v[~covered & once & np.repeat(some & mixed_docs, counts)] for k, v in x.items() if k in told}, kind))
    yield _by_block(_joined(out), blocks)


def _claims(x: dict, covered: np.ndarray, kind: np.ndarray) -> dict:
    """For each such run, in order of _earliest: the place of an earlier document's run of the same hashes (of the first document, its first), as a claim on it."""
    docs = _groups(x["m"], x["c"], x["n"], x["doc"])  # first row of each document that has a run
    classes = _groups(x["m"], x["c"], x["n"])
    sizes = np.diff(np.append(classes, len(covered)))
    nth = np.zeros(len(covered), np.int64)
    nth[docs] = 1
    nth = np.cumsum(nth) - 1  # of all those documents
    first = np.repeat(nth[classes], sizes)
    source = docs[first + (nth - first) // FAN_OUT][covered]
    shift = x["s"][covered] - x["s"][source]  # modulo 2^32
    named = {"td": x["doc"][covered], "th": x["h"][covered] ^ x["h"][source], "shift": shift, "k": kind[covered].astype(np.uint8), "n": x["n"][covered]}
    return {k: x[k][source] for k in ("doc", "h", "s")} | named


def _of_kind(got: pa.Table, kind: int) -> pa.Array:
    """The messages of one kind."""
    return got.filter(pc.equal(got.column("kind"), kind)).column("data").combine_chunks()


def _answers(length: int, blocks: int):
    """Claims on documents of a block to the bytes of the runs, in stretches, for the blocks that claim them (see _sent). What the block is told stays."""

    def run(blobs, got):
        claims, _ = _unpack(_of_kind(got, CLAIMS), _CLAIM)
        out = [got.filter(pc.equal(got.column("kind"), TOLD)).select(["block", "data", "kind"])]
        if len(claims["doc"]):
            x, known = _stretches(claims, length)
            target, starts, ends = np.mod(x["td"], blocks).tolist(), x["s"].tolist(), x["end"].tolist()
            rows, held = {}, 0
            for batch in batches_of(blobs, BATCH_BYTES):
                for doc, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text")), strict=True):
                    for i in known.pop((doc, h), ()):
                        rows.setdefault(target[i], []).append((i, text[starts[i] : ends[i]]))
                        held += ends[i] - starts[i]
                if held >= SEND_BYTES:
                    out.append(pa.Table.from_batches([_messages(list(rows), [_sent(x, some) for some in rows.values()], BYTES)]))
                    rows, held = {}, 0
            out.append(pa.Table.from_batches([_messages(list(rows), [_sent(x, some) for some in rows.values()], BYTES)]))
        return pa.concat_tables(t.cast(_NOTHING.schema) for t in out)

    return run


def _stretches(claims: dict, length: int) -> tuple[dict, dict[tuple[int, int], list[int]]]:
    """The claims on a block as stretches (doc, h, s, end, and for whom) of runs that follow each other in both documents, with their runs; those of each document."""
    claims["th"] ^= claims["h"]
    parties = ("doc", "h", "td", "th", "shift")
    key = np.zeros(len(claims["doc"]), np.uint64)
    for f in parties:
        key = mixed(key * _U(_BASE) + claims[f].astype(np.uint64))
    # claims of one pair and shift come together, by place; where two pairs share these 32 bits, their stretches are shorter
    c = _take(claims, np.argsort(_both(key >> _U(32), claims["s"])))
    s, n = c["s"].astype(np.int64), c["n"].astype(np.int64)
    new = np.append(True, s[1:] > (s + n)[:-1] + length)
    for f in parties:
        new[1:] |= c[f][1:] != c[f][:-1]
    begin = np.flatnonzero(new)
    bounds = np.append(begin, len(s))
    gap = s - np.append(0, (s + n + 1)[:-1])  # between a run and the one before it
    gap[begin] = 0
    x = {"doc": c["doc"][begin], "h": c["h"][begin].view(np.int32), "s": s[begin], "end": np.maximum.reduceat(s + n, begin) + length}
    x |= {"td": c["td"][begin], "th": c["th"][begin].view(np.int32), "shift": c["shift"][begin].view(np.int32), "bounds": bounds, "gap": gap, "n": n, "k": c["k"]}
    known: dict[tuple[int, int], list[int]] = {}
    for i, name in enumerate(zip(x["doc"].tolist(), x["h"].tolist(), strict=True)):
        known.setdefault(name, []).append(i)
    return x, known


def _sent(x: dict, rows: list[tuple[int, bytes]]) -> bytes:
    """Stretches and their bytes for one block, compressed: whose they are to be (doc, h, s), whose they are (doc, h, s), and their runs."""
    which = np.array([i for i, _ in rows])
    sizes = np.diff(x["bounds"])[which]
    runs, _ = _places(x["bounds"][which], sizes)
    names = [x["td"], x["th"], x["s"] + x["shift"], x["doc"], x["h"], x["s"]]
    head = np.stack([*(a[which].astype(np.int64) for a in names), np.array([len(t) for _, t in rows]), sizes])
    parts = [np.array(head.shape[1], "<i8"), head.astype("<i8"), x["gap"][runs].astype("<i4"), x["n"][runs].astype("<i4"), x["k"][runs]]
    data = b"".join([*(a.tobytes() for a in parts), *(t for _, t in rows)])
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _sent_bytes(messages: pa.Array) -> dict[tuple[int, int], list[tuple]]:
    """The stretches that earlier documents sent, by the document (doc_id, h) that they are for: s, bytes, the earlier document's (doc_id, h, s), and its runs."""
    out: dict[tuple[int, int], list[tuple]] = {}
    for message in messages.to_pylist():
        data = pa.decompress(memoryview(message)[8:], int.from_bytes(message[:8], "little"), "zstd", asbytes=True)
        n = int(np.frombuffer(data, "<i8", 1)[0])
        head = np.frombuffer(data, "<i8", 8 * n, 8).reshape(8, n)
        runs, at = int(head[7].sum()), 8 + 64 * n
        gap, after = np.frombuffer(data, "<i4", 2 * runs, at).reshape(2, runs)
        kind = np.frombuffer(data, np.uint8, runs, at + 8 * runs)
        ends, last = at + 9 * runs + np.cumsum(head[6]), np.cumsum(head[7])
        for td, th, s, doc, h, es, size, count, end, stop in zip(*head.tolist(), ends.tolist(), last.tolist(), strict=True):
            own = slice(stop - count, stop)
            out.setdefault((td, th), []).append((s, data[end - size : end], (doc, h, es), (gap[own], after[own], kind[own])))
    return out


def _runs_of(s: int, runs: tuple) -> zip:
    """The runs (place, windows after the first, kind) of a stretch from s on."""
    gap, after, kind = (a.astype(np.int64) for a in runs)
    return zip((s + np.cumsum(gap) + np.cumsum(after + 1) - after - 1).tolist(), after.tolist(), kind.tolist(), strict=True)


def _by_document(x: dict) -> dict[tuple[int, int], dict]:
    """Rows by (doc_id, h)."""
    x = _take(x, np.lexsort((x["s"], x["h"], x["doc"])))
    starts = _groups(x["doc"], x["h"])
    bounds = np.append(starts, len(x["doc"])).tolist()
    names = zip(x["doc"][starts].tolist(), x["h"][starts].astype(np.uint32).view(np.int32).tolist(), strict=True)
    return {name: _take(x, slice(a, b)) for name, a, b in zip(names, bounds[:-1], bounds[1:], strict=True)}


def _told(told: pa.Table) -> dict[str, np.ndarray]:
    """The runs that the rows of a block tell of."""
    return _unpack(_of_kind(told, TOLD), _TELL)[0]


def _settled(runs: list[tuple[int, int, int, int]]) -> dict:
    """Settled runs (doc, h, s, n)."""
    doc, h, s, n = np.array(runs, np.int64).reshape(-1, 4).T
    return _marked(_alone(doc, h, s, n), SETTLED)


def _alone(doc, h, s, n) -> dict:
    """Runs without an anchor."""
    return {"doc": doc, "h": h.astype(np.int32).view(np.uint32), "s": s.astype(np.uint32), "n": n.astype(np.uint32), "m": np.zeros(len(doc), np.uint64)}


def _open_windows(length: int, anchor: int, buckets: int, blocks: int, bits: int):
    """The text of each open run of a block's documents, by bits of the anchor; the settled ones as they came.

    Rows: doc_id, h, first windows, anchor, text, bucket; or for settled runs of the block: data as text, no anchor.
    A run that a document before has by its hashes is settled if the bytes that it sent are the same; else the runs of
    both are open, or wide. A run that its document repeats is one row with all its first windows. A wide run is a row for each of its
    windows, under the window's own hash as anchor; of equal ones in a block those of later documents are settled at once.
    """

    def unlike(doc, h, at, own, earlier, other, kind, rows, wide):
        """A run of two documents that only agrees in its hashes."""
        m = int(anchored_runs(np.frombuffer(own, np.uint8), np.array([0, len(own)]), length, anchor, bits)[3][0])
        m = (m & int(_LOW_BITS)) | ((m >> int(_LOW)) % buckets) << int(_LOW)
        for doc, h, s, text in ((doc, h, at, own), (*earlier, other)):
            if kind == WIDE:
                places, windows = _each_window(text, np.array([0]), np.array([len(text) - length]), length)
                wide.append((doc, h, places + s, windows))
            else:
                m64 = int(np.uint64(m).view(np.int64))
                rows.append((doc, h, [s], m64, text, m & SPREAD))

    def run(blobs, told):
        x, rows, alike, wide = _told(told), [], [], []
        settled = [_take(x, x["k"] == SETTLED)]
        known = _by_document(_take(x, x["k"] != SETTLED))
        sent = _sent_bytes(_of_kind(told, BYTES))
        for batch in batches_of(blobs, BATCH_BYTES):
            for doc, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text")), strict=True):
                for start, data, (e, eh, es), runs in sent.pop((doc, h), ()):
                    if text[start : start + len(data)] == data:
                        alike += [(doc, h, start, len(data) - length)] if e != doc else []
                        continue
                    for at, n, kind in _runs_of(start, runs):
                        own, other = text[at : at + n + length], data[at - start : at - start + n + length]
                        if own == other:
                            alike += [(doc, h, at, n)] if e != doc else []
                        else:
                            unlike(doc, h, at, own, (e, eh, es + at - start), other, kind, rows, wide)
                if (x := known.get((doc, h))) is not None:
                    here = x["k"] == OPEN
                    apart = x["k"] == WIDE
                    if apart.any():
                        wide.append((doc, h, *_each_window(text, x["s"][apart].astype(np.int64), x["n"][apart].astype(np.int64), length)))
                    copies: dict[tuple[int, bytes], list[int]] = {}
                    for s, n, m in zip(*(x[f][here].tolist() for f in ("s", "n", "m")), strict=True):
                        copies.setdefault((m, text[s : s + n + length]), []).append(s)
                    rows += [(doc, h, at, m, run, m & SPREAD) for (m, run), at in copies.items()]
        if wide:
            more, covered = _first_windows(wide)
            rows += more
            settled.append(_take(covered, np.mod(covered["doc"], blocks) == told.column("block")[0].as_py()))
        settled = _joined([*settled, _settled(alike)])
        if len(settled["doc"]):
            block = told.column("block")[0].as_py()
            settled = _take(settled, np.lexsort((settled["h"], settled["doc"])))
            rows.append((block, 0, None, None, _pack(settled, np.array([0, len(settled["doc"])]), _TELL)[0].as_py(), block))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int32())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "h", "s", "m", "text", "bucket"])

    return run


def _each_window(text: bytes, starts: np.ndarray, after: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of some runs of a text, each place once: where they start, and their bytes."""
    at = np.unique(np.repeat(starts, after + 1) + _within(after + 1))
    return at, np.frombuffer(text, np.uint8)[at[:, None] + np.arange(length)]


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _first_windows(wide: list[tuple]) -> tuple[list[tuple], dict]:
    """Windows of a block, as (doc, h, places, bytes) of each document: a row for each different one with its earliest document's places; the others as settled."""
    sizes = np.array([len(at) for _, _, at, _ in wide])
    doc, h = (np.repeat(np.array([w[i] for w in wide], np.int64), sizes) for i in (0, 1))
    at, windows = np.concatenate([w[2] for w in wide]), np.concatenate([w[3] for w in wide])
    names = np.ascontiguousarray(windows).view(f"V{windows.shape[1]}").ravel()
    _, which = np.unique(names, return_inverse=True)
    order = np.lexsort((at, h, doc, which))
    which, doc, h, at, windows = which[order], doc[order], h[order], at[order], windows[order]
    starts = _groups(which)
    later = doc > np.repeat(doc[starts], np.diff(np.append(starts, len(which))))
    covered = _marked(_take(_alone(doc, h, at, np.zeros(len(at))), later), SETTLED)
    which, doc, h, at, windows = which[~later], doc[~later], h[~later], at[~later], windows[~later]
    flat_windows = np.ascontiguousarray(windows).ravel()
    hashes = Prefixes(flat_windows).of(*(np.arange(len(which) + 1)[i : len(which) + i] * windows.shape[1] for i in (0, 1)))
    hashes = (hashes & _U((1 << 63) - 1)).astype(np.int64)
    bounds = np.append(_groups(which, doc, h), len(which))
    rows = [(int(doc[a]), int(h[a]), at[a:b].tolist(), int(hashes[a]), windows[a].tobytes(), int(hashes[a]) & SPREAD) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return rows, covered


def common_extension(prefixes: Prefixes, a: np.ndarray, b: np.ndarray, most: int, known: int = 0) -> np.ndarray:
    """How many bytes from places a and b on agree, of which ``known`` do, up to ``most``: a binary search over prefix hashes for all pairs at once."""
    low, high = np.full(len(a), known), np.full(len(a), most)
    while (high > low).any():
        middle = (low + high + 1) >> 1
        same = prefixes.raw(a, a + middle) == prefixes.raw(b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def exact_order(buffer: np.ndarray, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """What suffix_sorted promises, by the bytes alone."""
    words = np.zeros((len(at), -(-most // 8) * 8), np.uint8)
    words[:, :most] = buffer[at[:, None] + np.arange(most)]
    words = words.view(">u8")
    return np.lexsort((*(words[:, k] for k in reversed(range(words.shape[1]))), group))


def beside(buffer: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix but the first, whether its ``most`` bytes are those of the one before, and whether they are less."""
    same, less = np.zeros(len(at), bool), np.zeros(len(at), bool)
    stretches = np.lib.stride_tricks.sliding_window_view(buffer, most)
    for a in range(1, len(at), 1 << 12):
        b = min(a + (1 << 12), len(at))
        rows = stretches[at[a - 1 : b]]
        x, y = rows[:-1], rows[1:]
        differ = x != y
        first, row = differ.argmax(1), np.arange(b - a)
        same[a:b], less[a:b] = ~differ[row, first], y[row, first] < x[row, first]
    return same, less


def shared_windows(prefixes: Prefixes, at: np.ndarray, length: int) -> np.ndarray:
    """Which of these suffixes have the hash of their first bytes in common with another; no other can be equal to one."""
    hashes = prefixes.raw(at, at + length)
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    out = np.zeros(len(at), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def suffix_sorted(prefixes: Prefixes, buffer: np.ndarray, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """The order of suffixes that begin at ``at`` by group, then by their first ``most`` bytes; equal ones stay in place.

    Of suffixes of a group whose first bytes have one hash, the first stands for all. These are sorted as numbers by their first eight bytes;
    a bottom-up mergesort of those that agree there, all at once, does the rest: on each level every suffix finds its
    rank in the run beside its own by binary search. Two are compared by their common extension and the byte after it.
    group is in order, ``most`` at least eight.
    """
    whole = prefixes.raw(at, at + most)
    alike = np.lexsort((whole, group))
    heads = _groups(group[alike], whole[alike])
    copies, at, group = np.diff(np.append(heads, len(at))), at[alike[heads]], group[alike[heads]]
    first = np.ndarray((max(0, len(buffer) - 7),), ">u8", buffer=np.ascontiguousarray(buffer), strides=(1,))[at].astype(np.uint64)
    order = np.lexsort((first, group))
    starts = _groups(group[order], first[order])
    sizes = np.diff(np.append(starts, len(group)))
    base, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    width = 1
    while width < sizes.max(initial=0):
        here = np.flatnonzero(size > width)  # places in groups that have runs to merge
        place = here - base[here]
        run = place // width
        beside = (run ^ 1) * width
        there = np.clip(size[here] - beside, 0, width)
        own, begin = order[here], base[here] + beside
        low, high = np.zeros(len(here), np.int64), there.copy()
        while len(todo := np.flatnonzero(low < high)):
            middle = (low[todo] + high[todo]) >> 1
            a, b = at[own[todo]], at[order[begin[todo] + middle]]
            last = np.minimum(common_extension(prefixes, a, b, most, 8), most - 1)
            after = buffer[b + last] < buffer[a + last]
            low[todo], high[todo] = np.where(after, middle + 1, low[todo]), np.where(after, high[todo], middle)
        merged = order.copy()
        merged[base[here] + (run >> 1) * 2 * width + place % width + low] = order[here]
        order, width = merged, 2 * width
    return alike[_places(heads[order], copies[order])[0]]


def _sort_windows(length: int, blocks: int, bits: int):
    """Open runs of whole buckets: sort their windows as suffixes within each anchor, verify the order and equal ones by their bytes, and tell later documents.

    Windows whose hash no other has are left out, as none can be equal to them. Where bytes say otherwise than hashes did, bytes sort. Settled runs pass through.
    """

    def run(batches):
        held = []
        for batch in batches:
            settled = batch.filter(pc.is_null(batch.column("m")))
            yield _messages(settled.column("doc_id").cast(pa.int32()), settled.column("text").to_pylist(), TOLD)
            batch = batch.filter(pc.is_valid(batch.column("m")))
            if batch.num_rows:
                held.append(batch)
        if not held:
            yield _NOTHING
            return
        t = pa.Table.from_batches(held).combine_chunks().sort_by([("m", "ascending"), ("doc_id", "ascending"), ("h", "ascending")])
        batch = t.combine_chunks().to_batches()[0]
        anchors, ids, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "doc_id", "h"))
        copies = batch.column("s").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        s, first = batch.column("s").flatten().to_numpy(zero_copy_only=False), np.cumsum(copies) - copies
        buffer, offsets = flat(batch)
        out, lo = [], 0
        for hi in [*_groups(anchors)[1:].tolist(), len(anchors)]:  # some anchors at a time
            if offsets[hi] - offsets[lo] < (1 << 18) and hi < len(anchors):
                continue
            part, bounds = buffer[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            row, off = _windows(bounds, length)
            at = bounds[row] + off
            prefixes = Prefixes(part, bits)
            shared = shared_windows(prefixes, at, length)
            row, off, at = row[shared], off[shared], at[shared]
            group = anchors[lo + row]
            order = suffix_sorted(prefixes, part, at, group, length)
            alike, less = beside(part, at[order], length)
            if (less[1:] & (group[order[1:]] == group[order[:-1]])).any() or (np.bincount(order, minlength=len(at)) != 1).any():
                order = exact_order(part, at, group, length)
                alike, _ = beside(part, at[order], length)
            alike[1:] &= group[order[1:]] == group[order[:-1]]
            at, off, own = at[order], off[order], lo + row[order]
            lo = hi
            if len(at):
                begin = np.flatnonzero(~alike)
                counts = np.diff(np.append(begin, len(at)))
                which = np.flatnonzero(ids[own] > np.repeat(np.minimum.reduceat(ids[own], begin), counts))
                out.append({"row": own[which], "off": off[which]})
        x = _joined(out) if out else {"row": []}
        if not len(x["row"]):
            yield _NOTHING
            return
        x = _take(x, np.lexsort((x["off"], x["row"])))  # stretches of windows of each run, then at all places of the run
        begin = np.flatnonzero(np.append(True, (np.diff(x["row"]) != 0) | (np.diff(x["off"]) > 1)))
        n = x["off"][np.append(begin[1:], len(x["off"])) - 1] - x["off"][begin]
        row, times = x["row"][begin], copies[x["row"][begin]]
        place = np.repeat(first[row] - np.cumsum(times) + times, times) + np.arange(times.sum())
        row, at, n = np.repeat(row, times), s[place] + np.repeat(x["off"][begin], times), np.repeat(n, times)
        x = {"doc": ids[row], "h": h[row].view(np.uint32), "s": at, "n": n}
        x = _take(x, np.lexsort((x["s"], x["h"], x["doc"])))
        begin = np.flatnonzero(np.append(True, (np.diff(x["doc"]) != 0) | (np.diff(x["h"].astype(np.int64)) != 0) | (x["s"][1:] > (x["s"] + x["n"])[:-1] + 1)))
        n = np.maximum.reduceat(x["s"] + x["n"], begin) - x["s"][begin]
        yield _by_block(_marked(_alone(x["doc"][begin], x["h"][begin], x["s"][begin], n), SETTLED), blocks)

    return run


def _windows(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window of each row: the row and the window's place in it."""
    counts = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def removed_ranges(starts: np.ndarray, after: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The stretches of bytes that runs of windows cover, as [start, end), in order; runs sorted by their start."""
    out: list[list[int]] = []
    for s, n in zip(starts.tolist(), after.tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n + length)
        else:
            out.append([s, s + n + length])
    return [(a, b) for a, b in out]


def _kept(length: int, with_text: bool):
    def run(blobs, told):
        known, rows, ids = _by_document(_told(told)), [], []
        for batch in batches_of(blobs, BATCH_BYTES):
            ids.append(batch.column("doc_id"))
            for doc, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text")), strict=True):
                ranges = removed_ranges(x["s"], x["n"], length) if (x := known.get((doc, h))) is not None else []
                at, kept = 0, []
                for a, b in ranges:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                rows.append((len(text), len(text) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        arrays = [pa.chunked_array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
        return pa.table(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = False, wide: int = WIDE_RUNS, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text); kept with ``with_text``.

    Every byte goes that is covered by a string of ``length`` bytes which also starts in a
    document with a smaller doc_id; strings are judged on the input. kept holds the bytes that
    stay. A null text is empty and loses nothing, as does one shorter than ``length``. Rows that repeat a doc_id
    do not count against each other; a row with a null doc_id neither loses bytes nor
    counts against others. Other columns are not looked at. ``wide`` and ``bits`` (of all hashes)
    bear on time alone.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("h"), text.alias("text"))
    total = held_bytes(docs, "text")
    buckets = parts_of(total, BUCKET_BYTES)
    some = own.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    blocks, n = in_blocks(own, OWN_BLOCK_BYTES, _dealt, total)
    message = "block int, data binary, kind int"
    sent = some.mapInArrow(_send(length, anchor, buckets, bits), "bucket int, data binary")
    met = sent.repartition(buckets, "bucket").mapInArrow(_meet(n, wide), message)
    answered = blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(_answers(length, n), message)
    opening = _open_windows(length, anchor, buckets, n, bits)
    opened = blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(opening, "doc_id long, h int, s array<long>, m long, text binary, bucket int")
    found = opened.repartition(buckets, "bucket").mapInArrow(_sort_windows(length, n, bits), message)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_kept(length, with_text), kind)
    return out if with_text else out.drop("kept")
