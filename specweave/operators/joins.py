"""Joins: reconciliation, suffixes, prefixes, spans, references and lookups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

from specweave.plans.lineage import cut

MATCHED, LEFT_ONLY, RIGHT_ONLY = "MATCHED", "CODE_ONLY", "SPEC_ONLY"


def keep_last(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key, the last by ``order``: a dictionary's build side."""
    return _ranked(df, keys, [o.desc() if isinstance(o, Column) else F.col(o).desc() for o in order])


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key, the first by ``order``; give a total order."""
    return _ranked(df, keys, [o if isinstance(o, Column) else F.col(o).asc() for o in order])


def _ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], *order) -> DataFrame:
    """Left rows with the last right row of the same key, nulls where there is none."""
    return left.join(keep_last(right, keys, *order), keys, "left")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Full outer join of two observations: outcome, and for each compared column whether both are there and differ.

    keys identify a row on either side and are unique there. Compared columns appear as left_x
    and right_x; conflicts lists the names of those that differ, null against a value counting as different.
    """
    a = left.select(*keys, *[F.col(c).alias(f"left_{c}") for c in compare], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(c).alias(f"right_{c}") for c in compare], F.lit(True).alias("_r"))
    both = a.join(b, keys, "full_outer")
    outcome = F.when(F.col("_r").isNull(), LEFT_ONLY).when(F.col("_l").isNull(), RIGHT_ONLY).otherwise(MATCHED)
    differ = [F.when(~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")), F.lit(c)) for c in compare]
    found = F.filter(F.array(*differ), lambda x: x.isNotNull()) if compare else F.array().cast("array<string>")
    return both.withColumn("outcome", outcome).withColumn("conflicts", F.when(F.col("outcome") == MATCHED, found).otherwise(F.array().cast("array<string>"))).drop("_l", "_r")


def suffix_join(specs: DataFrame, codes: DataFrame, on: list[str]) -> DataFrame:
    """Pairs whose code segments end with the spec segments, as an equi-join on exploded suffixes.

    specs (*on, spec_id, segments), codes (*on, code_id, segments); segments are arrays, parameters as {}.
    Adds candidates, the number of code rows that a spec row meets: 1 is a match, more are ambiguous.
    """
    tails = codes.select(*on, "code_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("segments"), F.lit(1))), lambda n: F.slice("segments", -n, n))).alias("tail")).filter(F.size("tail") > 0)
    heads = specs.filter(F.size("segments") > 0).select(*on, "spec_id", F.col("segments").alias("tail"))
    pairs = heads.join(tails, [*on, "tail"]).select(*on, "spec_id", "code_id").distinct()
    return pairs.withColumn("candidates", F.count("*").over(Window.partitionBy("spec_id")))


def claim_routes(specs: DataFrame, codes: DataFrame, scope: list[str]) -> DataFrame:
    """Spec operations with the code operation each is matched to, in the order that claiming depends on.

    specs and codes (*scope, id, method, route, key, segments), key being the normal route. Within a scope,
    longer spec routes go first, then by route, method and id; an exact route matches whether claimed
    or not (of several the greatest id), else exactly one unclaimed code route of the method that ends with the spec's.
    Returns (*scope, spec_id, code_id, how): exact, suffix, ambiguous or none. Done in rounds over all scopes at once: a
    spec is decided as soon as it comes first among the undecided ones of each code operation that it may claim.
    """
    same = lambda x, y, columns: reduce(and_, [x[c].eqNullSafe(y[c]) for c in columns])
    turn = F.struct((-F.size("segments")).alias("n"), "route", "method", F.col("id").alias("spec_id"))
    spec = cut(specs.select(*scope, "method", "key", "segments", F.col("id").alias("spec_id"), turn.alias("_t")))
    exact = codes.groupBy(*scope, "method", "key").agg(F.max("id").alias("code_id"))
    matched = spec.join(exact, same(spec, exact, [*scope, "method", "key"])).select(*[spec[c] for c in (*scope, "spec_id", "_t")], "code_id")
    rest = spec.join(matched.select("spec_id"), "spec_id", "left_anti")
    pairs = suffix_join(rest.select(*scope, "method", "spec_id", "segments"), codes.select(*scope, "method", F.col("id").alias("code_id"), "segments"), [*scope, "method"])
    pairs = pairs.select("spec_id", "code_id").join(rest.select("spec_id", "_t"), "spec_id")
    # what an exact match claims is gone for the specs after it
    gone = matched.groupBy("code_id").agg(F.min("_t").alias("_first"))
    pairs = pairs.join(gone, "code_id", "left").filter(F.col("_first").isNull() | (F.col("_first") > F.col("_t"))).select("spec_id", "code_id", "_t")
    pairs, decided = cut(pairs.distinct()), []
    while not pairs.isEmpty():
        first = pairs.groupBy("code_id").agg(F.min("_t").alias("_first"))
        due = pairs.join(first, "code_id").groupBy("spec_id").agg(F.every(F.col("_t") == F.col("_first")).alias("due"), F.count("*").alias("n"), F.min("code_id").alias("code_id"))
        due = cut(due.filter("due").select("spec_id", F.when(F.col("n") == 1, F.col("code_id")).alias("code_id")))
        decided.append(due)
        claimed = due.select(F.col("code_id").alias("c")).filter("c is not null")
        pairs = cut(pairs.join(due.select("spec_id"), "spec_id", "left_anti").join(claimed, F.col("code_id") == F.col("c"), "left_anti"))
    out = matched.select(*scope, "spec_id", "code_id", F.lit("exact").alias("how"))
    other = rest.select(*scope, "spec_id")
    if decided:
        found = reduce(DataFrame.unionByName, decided).select("spec_id", "code_id", F.when(F.col("code_id").isNotNull(), "suffix").otherwise("ambiguous").alias("how"))
        other = other.join(found, "spec_id", "left").withColumn("how", F.coalesce("how", F.lit("none")))
    else:
        other = other.withColumn("code_id", F.lit(None).cast(codes.schema["id"].dataType)).withColumn("how", F.lit("none"))
    return out.unionByName(other.select(*scope, "spec_id", "code_id", "how"))


def longest_prefix_join(items: DataFrame, owners: DataFrame) -> DataFrame:
    """Each item with the owner whose directory is its deepest ancestor; null without one.

    items (item, path), owners (owner, directory). Paths explode into their directories, which join
    by equality; directories may repeat, the greater owner then counts.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    at = items.select("item", "path", F.explode(prefixes).alias("directory"))
    found = at.join(owners, "directory")
    best = found.groupBy("item", "path").agg(F.max_by("owner", F.struct(F.length("directory"), "owner")).alias("owner"))
    return items.join(best, ["item", "path"], "left")


def _place(c: str, kind: DataType) -> Column:
    """A point or end of a span as a whole number."""
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp"))
    return F.floor(c).cast("long")


def spans_around(points: DataFrame, spans: DataFrame, on: list[str]) -> DataFrame:
    """Every point with every span around it, ends included: points (*on, at, ...), spans (*on, start, end, ...).

    An equi-join: a span is dealt to the one or two bins that it touches on the level at which bins are as long as it is
    or up to twice that, a point to its bin on every level that spans have, at most 63. So a key with very many points and spans
    is many tasks, and only spans of about the right length and place are looked at.
    """
    start, end, at = (_place(c, t.schema[c].dataType) for t, c in ((spans, "start"), (spans, "end"), (points, "at")))
    level = F.when(end <= start, 0).otherwise(F.length(F.conv((end - start).cast("string"), 10, 2))).cast("int")
    bin_of = lambda place, n: F.call_function("shiftright", place, n)
    placed = spans.filter("start <= end").withColumn("_level", level)
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())  # 63 at most
    dealt = placed.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(start, F.col("_level")), bin_of(end, F.col("_level"))))))
    asked = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", bin_of(at, F.col("_level")))
    return asked.join(dealt, [*on, "_level", "_bin"]).filter((F.col("start") <= F.col("at")) & (F.col("at") <= F.col("end"))).drop("_level", "_bin")


def containing_spans(points: DataFrame, spans: DataFrame, on: list[str], prefer: list[Column] | None = None) -> DataFrame:
    """Each point with the smallest span around it; spans that tie are all kept.

    points (*on, point_id, at), spans (*on, span_id, start, end), joined by spans_around().
    prefer: tests in order, of which the first that any span of a point passes restricts them.
    """
    pairs = spans_around(points, spans, on)
    by_point = Window.partitionBy("point_id")
    for n, test in enumerate(prefer or []):
        pairs = pairs.withColumn(f"_t{n}", F.coalesce(test, F.lit(False)))
        pairs = pairs.withColumn("_any", F.max(f"_t{n}").over(by_point)).filter(F.col(f"_t{n}") | ~F.col("_any")).drop("_any", f"_t{n}")
    least = by_point.orderBy(F.col("end") - F.col("start"))
    ranked = pairs.withColumn("_rank", F.rank().over(least)).filter("_rank = 1").drop("_rank")
    return ranked.withColumn("ambiguous", F.count("*").over(by_point) > 1)


def reference_join(references: DataFrame, definitions: DataFrame, most: int = 20) -> DataFrame:
    """(source, name, target, found): references by name to definitions elsewhere, the first ``most`` of each by target.

    references (source, name), definitions (target, name). found counts all targets, so found > most tells of a
    gap; a reference without any has a null target.
    """
    refs = references.distinct()
    pairs = refs.join(definitions.distinct(), "name").filter(F.col("source") != F.col("target"))
    w = Window.partitionBy("source", "name")
    pairs = pairs.withColumn("found", F.count("*").over(w)).withColumn("_rn", F.row_number().over(w.orderBy("target"))).filter(F.col("_rn") <= most)
    missing = refs.join(pairs.select("source", "name").distinct(), ["source", "name"], "left_anti")
    rows = pairs.select("source", "name", "target", "found")
    return rows.unionByName(missing.select("source", "name", F.lit(None).cast(definitions.schema["target"].dataType).alias("target"), F.lit(0).cast("long").alias("found")))


def project_edges(edges: DataFrame, bindings: DataFrame) -> DataFrame:
    """Edges between subjects (source, target, kind) as edges between what the subjects are bound to (subject, chunk)."""
    a = bindings.select(F.col("subject").alias("source"), F.col("chunk").alias("source_chunk"))
    b = bindings.select(F.col("subject").alias("target"), F.col("chunk").alias("target_chunk"))
    out = edges.join(a, "source").join(b, "target").filter("source_chunk != target_chunk")
    return out.select(F.col("source_chunk").alias("source"), F.col("target_chunk").alias("target"), "kind").distinct()


def same_folder(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Files (path) in whose folder a marker (path) lies."""
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    return files.withColumn("_f", folder("path")).join(markers.select(folder("path").alias("_f")).distinct(), "_f", "left_semi").drop("_f")


def named(facts: DataFrame, names: DataFrame, key: str, name: str, default: str = "Unknown") -> DataFrame:
    """Facts with the name of what ``key`` refers to, or a default. names (key, name), last of equal keys by name."""
    return lookup_join(facts, names.select(key, name), [key], name).withColumn(name, F.coalesce(name, F.lit(default)))


def usages(operations: DataFrame, responses: DataFrame) -> DataFrame:
    """(entity_id, operation, usage): entities that operations take (Request) and return (Response N)."""
    asks = operations.filter("request_entity_id is not null").select(F.col("request_entity_id").alias("entity_id"), "operation", F.lit("Request").alias("usage"))
    gives = responses.filter("entity_id is not null").select("entity_id", "operation", F.concat(F.lit("Response "), F.col("status").cast("string")).alias("usage"))
    return asks.unionByName(gives).distinct()


def conflicting_types(attributes: DataFrame, keys: list[str], kind: str = "type") -> DataFrame:
    """Keys under which a name has several types, with the types in order: one aggregation instead of a self join."""
    return attributes.groupBy(*keys).agg(F.sort_array(F.collect_set(kind)).alias("types")).filter(F.size("types") > 1)


def missing_keys(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return required.join(present.select(*keys).distinct(), keys, "left_anti")


def merge_lists(*lists: str) -> Column:
    """Union of evidence lists in order, nulls as empty."""
    return F.array_sort(reduce(F.array_union, [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists]))


def propagate_pairs(seeds: DataFrame, left: DataFrame, right: DataFrame, least: float = 0.5, envelope: str | None = "data") -> DataFrame:
    """(left_id, right_id, overlap, outer_id): entity pairs that matched pairs lead to, round by round until none is new.

    seeds (left_id, right_id); left and right (id, name_key, attribute_key, reference_id), a row
    for each attribute. A pair of equal name keys is settled and leads nowhere; one of different names is
    accepted if the attribute keys overlap by ``least`` (Jaccard), and then the references of its
    attributes of equal key are pairs to look at. A left entity with an attribute ``envelope`` that refers to an entity may
    stand for that one: the better of both overlaps counts, its own on a tie; outer_id then names the wrapper. The frontier is stored in shared
    storage each round.
    """
    names = lambda t, side: t.select(F.col("id").alias(f"{side}_id"), F.col("name_key").alias(f"{side}_name")).distinct()
    keys = lambda t, side: t.groupBy(F.col("id").alias(f"{side}_id")).agg(F.collect_set("attribute_key").alias(f"{side}_keys"))
    own = cut(names(left, "left").join(keys(left, "left"), "left_id"))
    inside = own.select(F.col("left_id").alias("inner_id"), F.col("left_keys").alias("inner_keys"))
    first = Window.partitionBy("left_id").orderBy("inner_id")
    wraps = left.filter(F.col("attribute_key") == F.lit(envelope)).select(F.col("id").alias("left_id"), F.col("reference_id").alias("inner_id")).join(inside, "inner_id")
    wraps = cut(wraps.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n"))
    other = cut(names(right, "right").join(keys(right, "right"), "right_id"))
    a = left.select(F.col("id").alias("left_id"), "attribute_key", F.col("reference_id").alias("l")).filter("l is not null and attribute_key is not null")
    b = right.select(F.col("id").alias("right_id"), "attribute_key", F.col("reference_id").alias("r")).filter("r is not null")

    def shared(c: str) -> Column:
        both = F.size(F.array_union(c, "right_keys"))
        return F.when(both > 0, F.size(F.array_intersect(c, "right_keys")) / both).otherwise(0.0)

    frontier = cut(seeds.filter("left_id is not null and right_id is not null").select("left_id", "right_id").distinct())
    seen, accepted = frontier, None
    while True:
        pairs = frontier.join(own, "left_id").join(other, "right_id").filter("left_name != right_name").join(wraps, "left_id", "left")
        mine, theirs = shared("left_keys"), F.coalesce(F.when(F.col("inner_id").isNotNull(), shared("inner_keys")), F.lit(-1.0))
        pairs = pairs.select(F.when(theirs > mine, F.col("inner_id")).otherwise(F.col("left_id")).alias("best"), "right_id", F.greatest(mine, theirs).alias("overlap"), F.when(theirs > mine, F.col("left_id")).alias("outer_id"))
        new = cut(pairs.filter(F.col("overlap") >= least).withColumnRenamed("best", "left_id"))
        accepted = new if accepted is None else accepted.unionByName(new)
        found = new.join(a, "left_id").join(b, ["right_id", "attribute_key"]).select(F.col("l").alias("left_id"), F.col("r").alias("right_id")).distinct()
        frontier = cut(found.join(seen, ["left_id", "right_id"], "left_anti"))
        if frontier.isEmpty():
            return accepted.distinct()
        seen = seen.unionByName(frontier)  # frontiers are stored already
