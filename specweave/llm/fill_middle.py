"""Fill-in-middle examples cut at token boundaries that are found once for each different text.

Documents are dealt to compressed blocks by their text. An index holds, for each
different text of a block, the ends of its tokens as an Elias-Fano list (about
2 + log2(characters a token) bits each); equal texts are told by their bytes. The
index then meets the documents again, each of which selects the two boundaries that its
own seed asks for, whatever the number of its copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, batches_of, in_blocks
from .common import BATCH_BYTES, small_batches, texts

SEED = 42
#: Of 100 documents, how many are rearranged, and how many of those in the order suffix, prefix, middle.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts whose copies hold more than a block and more than this part of all bytes are dealt to many blocks; there are no more such texts than that.
HOT = 4096


class EliasFano:
    """A rising list of n numbers up to ``most``: low bits packed, high parts as a row of bits with a one for each number."""

    def __init__(self, n: int, most: int, low: bytes, high: bytes):
        self.n, self.most, self.low, self.high = n, most, low, high

    @staticmethod
    def width(n: int, most: int) -> int:
        """Low bits of each number."""
        return max(0, (most // n).bit_length() - 1) if n else 0

    @classmethod
    def of(cls, values: np.ndarray, most: int) -> EliasFano:
        n, k = len(values), cls.width(len(values), most)
        bits = (values[:, None] >> np.arange(k)[None, :] & 1).astype(np.uint8)
        high = np.zeros(n + (most >> k) + 1, np.uint8)
        high[(values >> k) + np.arange(n)] = 1
        return cls(n, most, np.packbits(bits.ravel()).tobytes(), np.packbits(high).tobytes())

    def select(self, which: list[int]) -> list[int]:
        """The numbers at these places of the list."""
        k = self.width(self.n, self.most)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8)))
        out = []
        for i in which:
            first = i * k // 8
            low = np.unpackbits(np.frombuffer(self.low, np.uint8)[first : ((i + 1) * k + 7) // 8])[i * k - 8 * first :][:k]
            out.append((int(ones[i]) - i << k) + sum(int(b) << j for j, b in enumerate(low)))
        return out


def token_ends(text: bytes) -> np.ndarray:
    """Where the tokens of a text end, in characters: words with the white space before them, and white space at the end of the text."""
    data = np.frombuffer(text, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    last = np.append(space[1:], True)
    ends = np.flatnonzero((~space & last) | (space & (np.arange(len(data)) == len(data) - 1)))
    return np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)[ends]


def draws(doc_id, seed: int = SEED) -> list[int]:
    """Four numbers of a document, from the seed and its id (null as nothing)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def by_text(docs: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of documents (doc_id, text) dealt by text, and how many. Texts with very many copies go to several."""
    rows = texts(docs).withColumn("lot", F.xxhash64("text"))
    size = F.sum(F.octet_length("text") + 64)
    held, total = rows.groupBy("lot").agg(size.alias("bytes")), rows.agg(size).first()[0] or 0
    hot = held.filter(F.col("bytes") > max(BLOCK_BYTES, total / HOT)).select("lot", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("ways"))
    way = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("ways", F.lit(1)))
    rows = rows.join(F.broadcast(hot), "lot", "left").select("doc_id", "text", F.xxhash64("lot", way).alias("lot"))
    return in_blocks(rows, deal=lambda _, n: F.pmod(F.col("lot"), F.lit(n)).cast("int"))


_INDEX = "block int, content binary, n long, n_chars long, low binary, high binary"


def index_texts(blocks: DataFrame) -> DataFrame:
    """A row for each different text of each block: its digest, tokens, characters and the Elias-Fano list of its token ends.

    Texts of one digest are compared byte by byte; two that differ are an error.
    """

    def run(key, blobs):
        seen: dict[bytes, bytes] = {}
        rows: dict[str, list] = {name.split()[0]: [] for name in _INDEX.split(", ")}
        for batch in batches_of(blobs, BATCH_BYTES):
            for text in batch.column("text").to_pylist():
                content = hashlib.sha256(text).digest()
                if content in seen:
                    if seen[content] != text:
                        raise ValueError(f"two texts have the digest {content.hex()}")
                    continue
                seen[content] = text
                ends = token_ends(text)
                n_chars = int(ends[-1]) if len(ends) else 0
                index = EliasFano.of(ends, n_chars)
                for name, value in zip(rows, (key[0].as_py(), content, len(ends), n_chars, index.low, index.high), strict=True):
                    rows[name].append(value)
        types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(rows.items(), types, strict=True)})

    return blocks.groupBy("block").applyInArrow(run, _INDEX)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of ``docs`` (doc_id, text).

    The text is cut after two of its n tokens, drawn by seed and doc_id, into prefix,
    middle and suffix. form is plain (the text as it is) for empty texts, texts that
    hold a sentinel, and those not drawn; psm and spm name the order of the parts. A
    null text is empty, a null doc_id draws as an empty one, equal rows are all
    returned, other columns are not looked at, no rows give none.
    """
    small_batches(docs.sparkSession)
    blocks, _ = by_text(docs)

    def run(_, blobs, index):
        known = {row["content"]: row for row in index.to_pylist()}
        made = []
        for batch in batches_of(blobs, BATCH_BYTES):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                made.append((doc_id, *_example(text, known[hashlib.sha256(text).digest()], draws(doc_id, seed), rate, spm_rate)))
        columns = list(zip(*made, strict=True)) or [()] * 6
        types = [ids, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, columns, types, strict=True)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = pa.int32() if kind == "int" else pa.string() if kind == "string" else pa.int64()
    found = blocks.groupBy("block").cogroup(index_texts(blocks).groupBy("block"))
    rows = found.applyInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return rows.withColumn("output", F.col("output").cast("string"))


def _example(text: bytes, index: dict, drawn: list[int], rate: int, spm_rate: int) -> tuple:
    n = index["n"]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or drawn[2] % 100 >= rate or p in text or s in text or m in text:
        return n, "plain", None, None, text
    places = sorted(d % (n + 1) for d in drawn[:2])
    ends = EliasFano(n, index["n_chars"], index["low"], index["high"])
    chosen = iter(ends.select([i - 1 for i in places if i]))
    a, b = (next(chosen) if i else 0 for i in places)
    chars = text.decode("utf-8", "surrogateescape")
    prefix, middle, suffix = (part.encode("utf-8", "surrogateescape") for part in (chars[:a], chars[a:b], chars[b:]))
    if drawn[3] % 100 < spm_rate:
        return n, "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Parts hold no sentinel, so the first of each is the one that was put there."""

    def part(mark: str, until: str | None) -> Column:
        rest = F.substring(output, F.instr(output, mark) + len(mark), F.length(output))
        return F.substring_index(rest, until, 1) if until else rest

    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row of ``docs``; the last is of the text rebuilt from output and form."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = fill_in_middle(docs, **how)
    shas = digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *shas)
