"""Pairs of entities that can still win: an exact search by upper bounds on the similarity of names, attributes and descriptions.

An entity's best candidate is the one of the highest score. What a letter-sequence ratio can reach is bounded
by the letters that two names share, whatever their order, and by their lengths; the words of names and descriptions
are counted exactly; what attributes can add is bounded by their number, their types, letters and words. Candidates
are searched in pages: words by an inverted index, letters as counts. A first pass takes the few candidates
of the highest bound for each entity and scores them in full; the best of these is what any other must
reach. A second pass lets through only pairs whose bound reaches it, and asks for a letter-sequence ratio
only where letters and words alone do not decide.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.functions.text import common_type, comparison_key, terms
from specweave.plans.lineage import cut

from .ranking import top_k

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Entities of a page of either side.
PAGE = 1024
#: Candidates of an entity that are scored in full before all others are bounded.
SEEDS = 3
#: Bounds are lowered by no rounding error of this size.
CLOSE = 1e-6
#: Attribute scores are rounded to one digit before they count.
ROUNDED = 0.05


def features(entities: DataFrame, attributes: DataFrame, key: str, item: str) -> DataFrame:
    """(key, name key, words, description words, attributes): what bounds need of each entity (key, name, description) and its attributes (key, item, name, description, type)."""
    own = attributes.groupBy(key).agg(
        F.collect_list(
            F.struct(
                comparison_key(F.coalesce("name", F.lit(""))).alias("key"), terms("name", False).alias("words"), F.coalesce(common_type("type"), F.lit("")).alias("type"),
                (F.size(terms("description", False)) > 0).alias("described"),
            )
        ).alias("attributes")
    )
    rows = entities.groupBy(key).agg(F.min(F.struct(F.coalesce("name", F.lit("")).alias("name"), "description")).alias("x"))
    rows = rows.select(key, comparison_key("x.name").alias("key"), terms("x.name", False).alias("words"), terms("x.description", False).alias("about"))
    return rows.join(own, key, "left").withColumn("attributes", F.coalesce("attributes", F.array().cast(own.schema["attributes"].dataType)))


def paged(rows: DataFrame, page: int = PAGE) -> DataFrame:
    """``rows`` with page: stretches of entities in order of the length of their names, a range sort and no window over all."""
    n = rows.count()
    parts = max(1, -(-n // page))
    return rows.repartitionByRange(parts, F.length("key"), "key").withColumn("page", F.spark_partition_id())


class Counted:
    """Entities of a page as arrays."""

    def __init__(self, rows: list[dict], key: str):
        self.ids, self.keys = [r[key] for r in rows], [r["key"] for r in rows]
        self.letters, self.lengths = letter_counts(self.keys)
        self.words, self.about = [frozenset(r["words"]) for r in rows], [frozenset(r["about"]) for r in rows]
        self.attributes = [r["attributes"] for r in rows]
        self.n = np.array([len(a) for a in self.attributes])
        self.n_words, self.n_about = np.array([len(w) for w in self.words]), np.array([len(w) for w in self.about])

    def as_candidates(self) -> Counted:
        """With postings of words and types, and with what the attributes of each have at most."""
        self.by_word, self.by_about = _postings(self.words), _postings(self.about)
        self.by_type: dict[str, np.ndarray] = {}
        for k, own in enumerate(self.attributes):
            for x in own:
                self.by_type.setdefault(x["type"], np.zeros(len(self.ids), np.int64))[k] += 1
        self.most, self.least = np.zeros((len(self.ids), len(LETTERS)), np.int16), np.zeros(len(self.ids), np.int64)
        for k, own in enumerate(self.attributes):
            if named := [a["key"] for a in own if a["key"]]:
                counts, lengths = letter_counts(named)
                self.most[k], self.least[k] = counts.max(0), lengths.min()
        self.by_attribute_word = _postings([frozenset(w for a in own for w in a["words"]) for own in self.attributes])
        self.described = np.array([any(a["described"] for a in own) for own in self.attributes], bool)
        return self


def letter_counts(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([[k.count(c) for c in LETTERS] for k in keys], np.int16).reshape(len(keys), len(LETTERS)), np.array([len(k) for k in keys], np.int64)


def _postings(sets: list[frozenset]) -> dict[str, np.ndarray]:
    out = defaultdict(list)
    for k, words in enumerate(sets):
        for w in words:
            out[w].append(k)
    return {w: np.array(ks) for w, ks in out.items()}


def _shared(postings: dict[str, np.ndarray], words, n: int) -> np.ndarray:
    """How many of ``words`` each candidate has."""
    out = np.zeros(n, np.int64)
    for w in words:
        if (at := postings.get(w)) is not None:
            out[at] += 1
    return out


def _jaccard(shared: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    union = n + sizes - shared
    return np.divide(shared, union, out=np.zeros(len(sizes)), where=union > 0)


def bounds(a: Counted, i: int, b: Counted) -> tuple[np.ndarray, ...]:
    """Of entity i with every candidate of a page, in per cent: the words that names share, the most that names and attributes can score, the description's score."""
    both = a.lengths[i] + b.lengths
    reach = np.divide(2.0 * np.minimum(a.letters[i], b.letters).sum(1), both, out=np.zeros(len(both)), where=both > 0)
    words = _jaccard(_shared(b.by_word, a.words[i], len(b.ids)), a.n_words[i], b.n_words)
    named = (a.lengths[i] > 0) & (b.lengths > 0)
    about = _jaccard(_shared(b.by_about, a.about[i], len(b.ids)), a.n_about[i], b.n_about)
    pairs, alike = np.minimum(a.n[i], b.n), np.zeros(len(b.ids), np.int64)
    for kind, n in Counter(x["type"] for x in a.attributes[i]).items():
        if (own := b.by_type.get(kind)) is not None:
            alike += np.minimum(own, n)
    if a.n[i]:  # names and descriptions at their best, a type only as often as both sides have it
        most = np.minimum(100.0, (80.0 * pairs + 20.0 * np.minimum(alike, pairs)) / a.n[i] + ROUNDED)
    else:
        most = np.where(b.n == 0, 100.0, 0.0)
    return np.where(named, words * 100, 0.0), np.where(named, np.maximum(reach, words) * 100, 0.0), most, about * 100


def attribute_bounds(a: Counted, i: int, b: Counted, some: np.ndarray) -> np.ndarray:
    """The most that the attributes of entity i can score on average with each of ``some`` candidates, from the letters, words and types of each."""
    n = len(some)
    counts, lengths = letter_counts([x["key"] for x in a.attributes[i]])
    best = np.zeros((len(lengths), n))
    for k, x in enumerate(a.attributes[i]):
        shared = np.minimum(counts[k], b.most[some]).sum(1)
        name = np.divide(2.0 * shared, lengths[k] + np.maximum(b.least[some], shared), out=np.zeros(n), where=shared > 0)
        words = _shared(b.by_attribute_word, x["words"], len(b.ids))[some] / max(1, len(x["words"]))
        typed = (b.by_type[x["type"]][some] > 0) if x["type"] in b.by_type else np.zeros(n, bool)
        best[k] = np.minimum(1.0, np.maximum(name, words)) * 70 * (lengths[k] > 0) + typed * 20.0 + (b.described[some] & x["described"]) * 10.0
    best = -np.sort(-best, axis=0) * (np.arange(len(lengths))[:, None] < b.n[some])  # one candidate attribute each
    return np.minimum(100.0, best.sum(0) / len(lengths) + ROUNDED)


def total(name, attributes, about):
    return name * 0.5 + attributes * 0.4 + about * 0.1


def _best_bounds(left: list[dict], right: list[dict]) -> list[tuple]:
    """Of two pages: the candidates of the highest bounds for each entity, as (regional_id, candidate_id, bound)."""
    a, b, out = Counted(left, "regional_id"), Counted(right, "candidate_id").as_candidates(), []
    for i in range(len(a.ids)):
        _, name, attributes, about = bounds(a, i, b)
        most = total(name, attributes, about)
        out += [(a.ids[i], b.ids[k], float(most[k])) for k in np.argsort(-most, kind="stable")[:SEEDS].tolist()]
    return out


def _survivors(left: list[dict], right: list[dict]) -> list[tuple]:
    """Of two pages: the pairs whose bound reaches the entity's floor, as (regional_id, candidate_id, bound)."""
    a, b, out, ratios = Counted(left, "regional_id"), Counted(right, "candidate_id").as_candidates(), [], {}
    for i, floor in enumerate(r["floor"] for r in left):
        words, name, attributes, about = bounds(a, i, b)
        some = np.flatnonzero(total(name, attributes, about) >= floor - CLOSE)
        if len(some) and a.n[i]:
            attributes[some] = np.minimum(attributes[some], attribute_bounds(a, i, b, some))
            some = some[total(name, attributes, about)[some] >= floor - CLOSE]
        for k in some.tolist():
            exact = words[k]
            if name[k] > exact:  # letters in order may do better than words
                pair = (a.keys[i], b.keys[k])
                if pair not in ratios:
                    ratios[pair] = SequenceMatcher(None, *pair).ratio() * 100
                exact = max(exact, ratios[pair])
            if (bound := total(exact, attributes[k], about[k])) >= floor - CLOSE:
                out.append((a.ids[i], b.ids[k], float(bound)))
    return out


def _page_pairs(left: DataFrame, right: DataFrame, find: Callable) -> DataFrame:
    """``find`` of every page of one side with every page of the other."""
    pages = [t.agg(F.max("page")).first()[0] for t in (left, right)]
    kind = f"regional_id {left.schema['regional_id'].dataType.simpleString()}, candidate_id {right.schema['candidate_id'].dataType.simpleString()}, bound double"
    if None in pages:
        return left.sparkSession.createDataFrame([], kind)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    a, b = left.withColumn("other", each(pages[1])), right.withColumnRenamed("page", "other").withColumn("page", each(pages[0]))

    def run(x, y):
        found = find(x.to_pylist(), y.to_pylist())
        columns = list(zip(*found, strict=True)) or [[], [], []]
        types = [x.schema.field("regional_id").type, y.schema.field("candidate_id").type, pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["regional_id", "candidate_id", "bound"])

    return a.groupBy("page", "other").cogroup(b.groupBy("page", "other")).applyInArrow(run, kind)


def candidate_pairs(regional: DataFrame, regional_attributes: DataFrame, candidates: DataFrame, candidate_attributes: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(regional_id, candidate_id): every pair of the two catalogs that may be an entity's best, and few others.

    Entities (id, name, description), attributes as align.score_attributes takes them;
    score(pairs) gives (regional_id, score) of the best of some pairs, not rounded. The
    result holds all pairs whose score is an entity's highest, ties included.
    """
    left = cut(paged(features(regional, regional_attributes, "regional_id", "left_id")))
    right = cut(paged(features(candidates, candidate_attributes, "candidate_id", "right_id")))
    seeds = top_k(_page_pairs(left, right, _best_bounds), ["regional_id"], [F.desc("bound"), "candidate_id"], SEEDS)
    floors = score(cut(seeds.select("regional_id", "candidate_id"))).select("regional_id", F.col("score").alias("floor"))
    left = left.join(floors, "regional_id")
    return cut(_page_pairs(left, right, _survivors).select("regional_id", "candidate_id"))
