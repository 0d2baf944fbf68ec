"""Checks: identities, references, coverage, leaks, echoes and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import duplicate_keys, foreign_key_violations

INTERNAL_ID = r"^(operation|entity|attribute|enum|parameter|response|source|evidence|lineage|validation|relationship|diagnostic)-[0-9a-f]{20}$"


def leaked_keys(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of (key, value) that show an internal identifier: by name (id, ...Id, ...Ids) or by form."""
    named = F.col(key).rlike(r"(^id$|Ids?$)")
    return rows.filter(named | F.coalesce(F.col(value).rlike(INTERNAL_ID), F.lit(False)))


def model_violations(tables: dict[str, tuple[DataFrame, str]], references: list[tuple[str, str, str]]) -> DataFrame:
    """(name, violations) of a model: repeated ids of each table and references (table, column, parent) without one."""
    checks = []
    for name, (df, key) in tables.items():
        checks.append(duplicate_keys(df, [key]).agg(F.count("*").alias("violations")).select(F.lit(f"unique {name}.{key}").alias("name"), "violations"))
    for name, column, parent in references:
        p, key = tables[parent]
        checks.append(foreign_key_violations(tables[name][0], column, p, key, f"{name}.{column} in {parent}"))
    return reduce(DataFrame.unionByName, checks)


def echo_errors(expected: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, error): what a result leaves out, makes up or repeats of what it was asked for."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    r = returned.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = e.join(r, keys, "full_outer")
    error = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unknown").when(F.col("_n") > 1, "repeated")
    return both.select(*keys, error.alias("error")).filter("error is not null")


def uncited(claims: DataFrame, cited: str, allowed: str, status: str) -> DataFrame:
    """Claims that cite what they were not shown, or claim something without citing."""
    outside = F.size(F.array_except(cited, allowed)) > 0
    return claims.filter(outside | ((F.col(status) != "unknown") & (F.size(cited) == 0)))


def unfinished(status: str, *missing: str) -> Column:
    """A partial target with something in one of its lists of what is missing."""
    return (F.col(status) == "partial") & reduce(lambda a, b: a | b, [F.size(m) > 0 for m in missing])


def bad_vectors(vectors: DataFrame, vector: str, size: int) -> DataFrame:
    """Vectors that are null, empty, of another size or not finite."""
    fine = (F.size(vector) == size) & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(~F.coalesce(fine, F.lit(False)))


def selected_project(owners: Column, is_function: Column, stem: Column) -> Column:
    """Whether a project is discovered: it owns controllers, is a function project or is named for an api or the web, and is no test."""
    s = F.lower(stem)
    return ((owners > 0) | is_function | F.contains(s, F.lit("api")) | (s == "web")) & ~F.contains(s, F.lit("test"))


def generated_code(path: Column) -> Column:
    p = F.lower(path)
    return F.arrays_overlap(F.split(p, "/"), F.array(F.lit("bin"), F.lit("obj"))) | p.rlike(r"\.(g|generated|designer)\.cs$")


def safe_member(path: Column) -> Column:
    """Whether an archive's member stays below its root."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & ~F.array_contains(F.split(p, "/"), "..") & (p != "")
