"""SimHash near-duplicates by an inverted index over fingerprint bytes with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.plans.lineage import cut

from .common import chunks, small_batches, texts
from .components import components

SHINGLE = 3
MOST_BITS = 2
#: Posting lists of up to this many different fingerprints are compared pair by pair.
LIST_LIMIT = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of UTF-8 bytes; zero without words."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], "<u8")
    by_byte = h.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ _BITS for j in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every text as a signed 64-bit number. Null texts count as empty."""

    def run(batches):
        for batch in chunks(batches):
            fps = np.array([simhash(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, fp long")


def fingerprint_links(classes: DataFrame, most_bits: int = MOST_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(a, b) between the reps of ``classes`` (fp, rep), whose closure is that of all pairs within ``most_bits``.

    Two fingerprints that differ in k bits share at least 8 - k of their 8 positional
    bytes. A list for one byte of one position would hold 1/256 of the corpus, so lists are
    keyed by positional bytes taken together: the bytes in 2 k groups of equal width, any
    k groups at once; a pair within k bits shares one of these lists at least. In a list
    each of the other bytes is posted by its position, pairs meet under every such byte that they share, these
    meetings are tallied on top of the bytes of the list, pairs that reach 8 - k are retained,
    and their differing bits are counted. Lists over ``list_limit`` are not
    paired: there every member posts itself under each value of its other bits that one
    flip can reach. Two members within 2 bits meet under such a value, and any two that
    meet are within 2 bits, so linking all of them to the least one is exact, and linear.
    """
    if most_bits != 2:
        raise ValueError("the index is built for fingerprints within 2 bits")
    group = lambda g: F.shiftrightunsigned("fp", 16 * g).bitwiseAND(F.lit(0xFFFF))
    chosen = list(combinations(range(4), 2))
    keys = [F.struct(F.lit(i).alias("part"), (group(a) * 65536 + group(b)).alias("value")) for i, (a, b) in enumerate(chosen)]
    postings = classes.filter("rep is not null").select("fp", "rep", F.explode(F.array(*keys)).alias("list")).select("fp", "rep", "list.*")
    sizes = cut(postings.groupBy("part", "value").agg(F.count("*").alias("n")).filter("n > 1"))
    small = postings.join(sizes.filter(F.col("n") <= list_limit).select("part", "value"), ["part", "value"])
    other = [[j for j in range(8) if j // 2 not in pair] for pair in chosen]
    byte = lambda j: F.shiftrightunsigned("fp", 8 * j).bitwiseAND(F.lit(255))
    posted = F.element_at(F.array(*[F.array(*[F.lit(j * 256) + byte(j) for j in places]) for places in other]), F.col("part") + 1)
    bytes_at = small.select("part", "value", "fp", "rep", F.explode(posted).alias("byte"))
    x, y = bytes_at.alias("x"), bytes_at.alias("y")
    met = (F.col("x.part") == F.col("y.part")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.byte") == F.col("y.byte")) & (F.col("x.fp") < F.col("y.fp"))
    meetings = x.join(y, met).groupBy(F.col("x.part"), F.col("x.fp"), F.col("x.rep").alias("a"), F.col("y.fp").alias("other"), F.col("y.rep").alias("b"))
    tallied = meetings.agg((F.count("*") + 4).alias("tally")).filter(F.col("tally") >= 8 - most_bits)
    pairs = tallied.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most_bits).select("a", "b")
    large = postings.join(sizes.filter(F.col("n") > list_limit).select("part", "value"), ["part", "value"])
    rest = [[16 * g + i for g in range(4) if g not in pair for i in range(16)] for pair in chosen]
    flips = F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in bits]) for bits in rest])
    reach = F.concat(F.array("fp"), F.transform(F.element_at(flips, F.col("part") + 1), lambda bit: F.col("fp").bitwiseXOR(bit)))
    at = large.select("part", "rep", F.explode(reach).alias("middle"))
    met = at.groupBy("part", "middle").agg(F.collect_set("rep").alias("reps"))  # at most 33 fingerprints reach one value
    far = met.filter("size(reps) > 1").select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).filter("a != b")
    return pairs.union(far)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each component of fingerprints the row with the smallest doc_id, of equal ones the least by hashes of text and row.

    Rows are judged one by one: those that repeat a doc_id with unrelated texts each stay. No null doc_id.
    """
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]
    key = F.struct(F.col("doc_id").alias("i"), F.hash("text").alias("t"), F.xxhash64(*[f"`{c}`" for c in hashed]).alias("r"))
    # of the very type that comes back from workers: then the join and the dropping of equal rows share one shuffle of the rows
    keyed = docs.select("*", key.cast(f"struct<i:{docs.schema['doc_id'].dataType.simpleString()},t:int,r:bigint>").alias("_near_key"))
    prints = cut(fingerprints(keyed.select(F.col("_near_key").alias("doc_id"), "text")))
    links = fingerprint_links(prints.select("fp", F.col("fp").alias("rep")).distinct())
    found = components(links)
    roots = prints.join(found, prints.fp == found.node, "left").select("doc_id", F.coalesce("component", "fp").alias("root"))
    first = roots.groupBy("root").agg(F.min("doc_id").alias("_near_key")).select("_near_key")
    return keyed.join(first, "_near_key", "left_semi").dropDuplicates(["_near_key"]).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    Fingerprints within ``most_bits`` bits link their documents; component_id is the
    smallest doc_id that links lead to. Documents of one fingerprint are one class from
    the start, so copies are never paired. A null text is an empty one; texts without
    words have fingerprint zero and link like any other. Rows that repeat a doc_id each
    get a row; a null doc_id gets a fingerprint and a component of its class, null where
    the class has no other. No rows give no rows; other columns are not looked at.
    """
    prints = cut(fingerprints(docs, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(fingerprint_links(classes, most_bits, list_limit))
    roots = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(roots, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
