"""A Merkle manifest of a dataset, with a proof for every row by coordinate lookup.

Every row is a leaf. The leaves of a group ascend by id and are folded, ``arity`` at a
time, up to the group's subroot; the subroots are folded the same way up to the root.
All nodes are kept as one table (tree, level, at, digest). From its own place and the
size of its tree a leaf knows the coordinates of every sibling on its way up: it
explodes them, joins the node table, orders what comes back and folds it.

Leaves of one run differ only in their siblings of level 0, so the coordinates above
are exploded once for each run. How often a node is asked for grows with its level;
the node table therefore holds a copy of a node for each ``district`` of leaves below
its run, so that no key of the join is asked for more than ``arity`` ** 4 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.plans.lineage import cut

from .common import ascii_lower

ARITY = 8
#: Levels that one grouping folds, so a group holds arity ** TIER nodes at most; levels below a district.
TIER = 4
DISTRICT = 5
#: Levels of the tree over subroots are counted from here.
TOP = 100
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as it enters a leaf: byte count, colon, value; a dash if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def tampered(doc_id: Column) -> Column:
    """Rows whose text the check tampers with."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """``df``, stored, with part and slot: rows in order of ``by`` over parts, and within a part by slot from 0.

    Rows that tie are dealt by where they were read, so ties of any number are many tasks.
    """
    ranged = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by, "tie").sortWithinPartitions(*by, "tie").drop("tie")
    stored = cut(ranged.withColumn("place", F.monotonically_increasing_id()))
    return stored.select(*df.columns, F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("slot"))


def with_places(leaves: DataFrame, group: str, *by: str) -> DataFrame:
    """``leaves`` with tree (rank of its group, nulls first), trees, at (rank in its tree) and n (leaves of its tree).

    Offsets come from one count for each part and group. The windows run over parts of one group, and over groups by part.
    """
    placed = in_order(leaves, group, *by)
    parts = placed.groupBy("part", group).agg(F.min("slot").alias("first"), F.count("*").alias("n_part"))
    groups = in_order(parts.groupBy(group).agg(F.sum("n_part").alias("n")), group)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = groups.groupBy("part").agg(F.count("*").alias("k"))
    sizes = sizes.select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"), F.sum("k").over(Window.partitionBy()).alias("trees"))
    trees = groups.join(sizes, "part").select(F.col(group).alias("g"), "n", (F.col("base") + F.col("slot")).alias("tree"), "trees")
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", group, (F.coalesce(F.sum("n_part").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    offsets = offsets.join(trees, F.col(group).eqNullSafe(F.col("g"))).select(F.col("part").alias("p"), "g", "shift", "n", "tree", "trees")
    found = placed.join(offsets, (placed.part == offsets.p) & placed[group].eqNullSafe(offsets.g))
    return found.select(*leaves.columns, "tree", "trees", (F.col("slot") + F.col("shift")).alias("at"), "n")


def _powers(arity: int) -> Column:
    """arity ** k by k, as far as a long goes."""
    return F.array(*[F.lit(arity**k).cast("long") for k in range(63) if arity**k < 1 << 62])


def height(n: Column, arity: int) -> Column:
    """Foldings that n leaves need."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv(F.greatest(n - 1, F.lit(1)).cast("string"), 10, arity))).cast("int")


def tree_nodes(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """All nodes above ``leaves`` (tree, at, n, digest): (tree, level, at, n, digest), level from 1; n is the tree's leaves.

    A task's group is what stands below one node TIER levels up. Trees of one leaf, and no leaves, have no nodes.
    """
    width, below, base, nodes = arity**TIER, leaves.select("tree", "at", "n", "digest"), 0, None
    while nodes is None or not below.isEmpty():
        runs = below.filter(height(F.col("n"), arity) > base).groupBy("tree", "n", _div(F.col("at"), F.lit(width)).alias("run"))
        runs = runs.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: _hex(x["digest"])).alias("d0"))
        levels = []
        for k in range(1, TIER + 1):
            runs = runs.withColumn(f"d{k}", _folded(F.col(f"d{k - 1}"), arity))
            levels.append(_as_nodes(F.col(f"d{k}"), base + k, F.col("run") * arity ** (TIER - k)))
        tier = cut(runs.select("tree", "n", F.inline(F.flatten(F.array(*levels)))).filter(F.col("level") <= height(F.col("n"), arity)))
        base += TIER
        below = tier.filter((F.col("level") == base) & (height(F.col("n"), arity) > base))
        nodes = tier if nodes is None else nodes.unionByName(tier)
    return nodes.select("tree", "level", "at", "n", "digest")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(nodes: Column, keep) -> Column:
    """The digests of the nodes that ``keep`` holds for, as one text."""
    return F.concat_ws("", F.transform(F.filter(nodes, keep), lambda x: _hex(x["digest"])))


def _folded(digests: Column, arity: int) -> Column:
    """The next level: each ``arity`` consecutive digests as one."""
    runs = F.sequence(F.lit(0), F.call_function("div", F.size(digests) - 1, F.lit(arity)).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.concat_ws("", F.slice(digests, r * arity + 1, arity)).cast("binary"), 256))


def _as_nodes(digests: Column, level: int, first: Column) -> Column:
    return F.transform(digests, lambda d, i: F.struct(F.lit(level).alias("level"), (first + i).alias("at"), F.unhex(d).alias("digest")))


def _levels(first: int, end: Column) -> Column:
    """The levels from ``first`` to below ``end``; none if there are none."""
    return F.when(end > first, F.sequence(F.lit(first), end - 1)).otherwise(F.array().cast("array<int>"))


def coordinates(at: Column, n: Column, levels: Column, arity: int) -> Column:
    """(level, sibling) of every node beside a leaf's own ancestor, from the leaf's place and the size of its tree."""
    power = _powers(arity)

    def beside(k):
        own, last = _div(at, F.element_at(power, k + 1)), _div(n - 1, F.element_at(power, k + 1))
        first = own - own % arity
        run = F.filter(F.sequence(first, F.least(first + arity - 1, last)), lambda j: j != own)
        return F.transform(run, lambda j: F.struct(k.cast("int").alias("level"), j.alias("sibling")))

    return F.flatten(F.transform(levels, beside))


def by_district(nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, level, sibling, district, digest): nodes (tree, level, at, n, digest), once for each district of leaves below their run."""
    power, width = _powers(arity), arity**DISTRICT
    reach = F.element_at(power, F.col("level") + 2)
    first = _div(F.col("at"), F.lit(arity)) * reach
    districts = F.sequence(_div(first, F.lit(width)), _div(F.least(first + reach, F.col("n")) - 1, F.lit(width)))
    return nodes.select("tree", "level", F.col("at").alias("sibling"), F.explode(districts).alias("district"), "digest")


def prove(docs: DataFrame, fields=FIELDS, by: str = "doc_id", group: str = "lang", arity: int = ARITY, forge=tampered) -> DataFrame:
    """A row for each row of ``docs``: id, at, n, leaf, forged, left, right, path, subroot, root.

    ``fields`` make the leaf. Leaves of a ``group`` (null is one) ascend by ``by``, nulls
    first, then by digest. forged is the leaf of the row with its text lower-cased (A-Z)
    where ``forge`` chooses the row, else null. left and right are the digests of the
    siblings in the leaf's own run, joined; path has (left, right) for each further level
    up to the root. Equal rows are leaves of their own. No rows give no proofs. Other
    columns are not looked at.
    """
    other = [ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in fields]
    made = F.when(forge(F.col(by)), F.unhex(leaf(other)))
    leaves = docs.select(F.col(by).alias("id"), F.col(group).alias("group"), F.unhex(leaf([F.col(f) for f in fields])).alias("digest"), made.alias("forged"))
    leaves = with_places(leaves, "group", "id", "digest")
    nodes = tree_nodes(leaves, arity)
    single = leaves.filter("n = 1").select("tree", "n", "digest")
    subroots = cut(nodes.filter(F.col("level") == height(F.col("n"), arity)).select("tree", "n", "digest").union(single))
    trees = subroots.count()
    tops = subroots.select(F.lit(0).alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("at"), F.lit(trees).cast("long").alias("n"), "digest")
    tops = tops.unionByName(tree_nodes(tops, arity))
    top_height = next(k for k in range(64) if arity**k >= trees)
    root = tops.filter(F.col("level") == top_height).select(_hex(F.col("digest"))).first()
    root = F.lit(root[0] if root else None).cast("string")
    above = _levels(0, F.lit(top_height))
    own_root = F.array(F.struct(F.lit(0).alias("level"), F.col("tree").alias("sibling")))
    asked = subroots.select("tree", "n", F.inline(F.concat(own_root, coordinates(F.col("tree"), F.lit(trees).cast("long"), above, arity))))
    asked = asked.withColumn("district", _div(F.col("tree"), F.lit(arity**DISTRICT)))
    found = asked.join(by_district(tops, arity).drop("tree"), ["level", "sibling", "district"])
    last = _div(F.col("n") - 1, F.lit(arity**DISTRICT))
    found = found.select("tree", (F.col("level") + TOP).alias("level"), "sibling", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("district"), "digest")
    table = by_district(nodes, arity).unionByName(found)
    run = _div(F.col("at"), F.lit(arity))
    within = coordinates(F.col("at"), F.col("n"), _levels(1, height(F.col("n"), arity)), arity)
    beyond = F.transform(F.concat(own_root, coordinates(F.col("tree"), F.lit(trees).cast("long"), above, arity)), lambda x: F.struct((x["level"] + TOP).alias("level"), x["sibling"].alias("sibling")))
    asked = leaves.filter(F.col("at") % arity == 0).select("tree", "n", run.alias("run"), _div(F.col("at"), F.lit(arity**DISTRICT)).alias("district"), F.inline(F.concat(within, beyond)))
    none = [F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in ("id", "forged")]
    siblings = asked.join(table, ["tree", "level", "sibling", "district"]).select("tree", "n", "run", "level", "sibling", "digest", *none)
    own = leaves.select("tree", "n", run.alias("run"), F.lit(0).alias("level"), F.col("at").alias("sibling"), "digest", "id", "forged")
    runs = own.unionByName(siblings).groupBy("tree", "n", "run").agg(F.sort_array(F.collect_list(F.struct("level", "sibling", "digest", "id", "forged"))).alias("found"))
    power = _powers(arity)
    up = F.filter("found", lambda x: x["level"] > 0)
    ways = F.concat(
        F.transform(_levels(1, height(F.col("n"), arity)), lambda k: F.struct(k.alias("level"), _div(F.col("run"), F.element_at(power, k)).alias("own"))),
        F.transform(above, lambda k: F.struct((k + TOP).alias("level"), _div(F.col("tree"), F.element_at(power, k + 1)).alias("own"))),
    )
    side = lambda w, before: _joined(F.col("up"), lambda x: (x["level"] == w["level"]) & ((x["sibling"] < w["own"]) if before else (x["sibling"] > w["own"])))
    runs = runs.select("tree", "n", "run", F.filter("found", lambda x: x["level"] == 0).alias("own"), up.alias("up"), ways.alias("ways"))
    subroot = F.filter("up", lambda x: (x["level"] == TOP) & (x["sibling"] == F.col("tree")))
    runs = runs.select(
        "n", "own", F.transform("ways", lambda w: F.struct(side(w, True).alias("left"), side(w, False).alias("right"))).alias("path"), _hex(F.get(subroot, F.lit(0))["digest"]).alias("subroot")
    )
    rows = runs.select("n", "own", "path", "subroot", F.explode("own").alias("x"))
    return rows.select(
        F.col("x.id").alias("id"), F.col("x.sibling").alias("at"), "n", _hex(F.col("x.digest")).alias("leaf"), _hex(F.col("x.forged")).alias("forged"),
        _joined(F.col("own"), lambda y: y["sibling"] < F.col("x.sibling")).alias("left"), _joined(F.col("own"), lambda y: y["sibling"] > F.col("x.sibling")).alias("right"),
        "path", "subroot", root.alias("root"),
    )


def folded(start: Column) -> Column:
    """The root that a proof of ``prove`` leads to from the digest ``start``."""
    sha = lambda *parts: F.sha2(F.concat(*parts).cast("binary"), 256)
    first = F.when(F.col("n") > 1, sha(F.col("left"), start, F.col("right"))).otherwise(start)
    return F.aggregate("path", first, lambda acc, p: sha(p["left"], acc, p["right"]))


def merkle_report(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    proof_sha256 is of all siblings, in order; folded_root starts from the forged leaf
    where there is one, so verified is false where tampering changed the row.
    """
    rows = prove(docs, arity=arity)
    proof = F.concat("left", "right", F.concat_ws("", F.transform("path", lambda p: F.concat(p["left"], p["right"]))))
    rows = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("forged", "leaf")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
