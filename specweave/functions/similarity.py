"""Similarity of names and descriptions, and the scores and statuses of alignment."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import _c, common_type, comparison_key, terms

FULL, PARTIAL, NONE = "Full match", "Partial match", "Not matched"


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def text_similarity(a, b) -> Column:
    """Per cent of words shared by two texts; 0 if either has none."""
    x, y = terms(a, underscore=False), terms(b, underscore=False)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), jaccard(x, y) * 100).otherwise(0.0)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; nothing built in has these semantics, and equal pairs are computed once a batch."""
    done: dict[tuple[str, str], float] = {}
    for pair in set(zip(a, b, strict=True)):
        done[pair] = None if None in pair else SequenceMatcher(None, *pair).ratio()
    return pd.Series([done[p] for p in zip(a, b, strict=True)], dtype="float64")


def name_similarity(a, b) -> Column:
    """Per cent: the better of sequence ratio of the compact names and words shared; 0 if either has no letter or digit."""
    x, y = comparison_key(a), comparison_key(b)
    both = (x != "") & (y != "")
    return F.when(both, F.greatest(sequence_ratio(x, y), jaccard(terms(a, False), terms(b, False))) * 100).otherwise(0.0)


def compatible_types(a, b) -> Column:
    return common_type(a) == common_type(b)


def attribute_score(name: Column, types: Column, description: Column) -> Column:
    return name * 0.7 + F.when(types, 100.0).otherwise(0.0) * 0.2 + description * 0.1


def attribute_status(score: Column) -> Column:
    return F.when(score >= 85, FULL).when(score >= 50, PARTIAL).otherwise(NONE)


def entity_score(name: Column, attributes: Column, description: Column) -> Column:
    return name * 0.5 + attributes * 0.4 + description * 0.1


def domain_score(name: Column, capabilities: Column) -> Column:
    return name * 0.7 + capabilities * 0.3


def capability_score(name: Column, text: Column) -> Column:
    return name * 0.8 + text * 0.2


def parent_status(score: Column, every_full: Column, any_matched: Column, full: float = 85, partial: float = 40) -> Column:
    """A parent matches fully only if all its children do, and in part if any does."""
    return F.when((score >= full) & every_full, FULL).when((score >= partial) | any_matched, PARTIAL).otherwise(NONE)


def status_rank(status) -> Column:
    s = _c(status)
    return F.when(s == FULL, 2).when(s == PARTIAL, 1).otherwise(0)


def chosen_source(baseline_status, reference_status, baseline_candidate, reference_candidate) -> Column:
    """Whose candidate is taken: a full baseline, a strictly better reference, a baseline, a reference, else none."""
    b, r = status_rank(baseline_status), status_rank(reference_status)
    return (
        F.when(b == 2, "Canonical baseline").when(r > b, "Reference").when(_c(baseline_candidate).isNotNull(), "Canonical baseline")
        .when(_c(reference_candidate).isNotNull(), "Reference").otherwise("Unresolved")
    )
