"""Merkle manifest of a dataset, with proofs by look-up of coordinates.

Every row is a leaf: the hash of its fields, each with its length before it. The leaves of
a group, in order, are level 0 of the group's tree; ARITY consecutive nodes become one of
the next level, until one is left, the subroot; the subroots, in the order of their groups,
are level 0 of the top tree, whose last node is the root. A node's coordinate is (tree,
level, place); all nodes are one table.

A leaf's proof follows from its place and the size of its group by arithmetic: it explodes
the coordinates of its siblings on each level, these are joined with the node table, put in
order, concatenated and folded. Nodes that many leaves need are few: the levels from which
on all trees together have FEW nodes at most are broadcast, so that a node of the levels
below is needed by a bounded share of the leaves. The way from a subroot to the root is
looked up once a group and comes to the leaves with the group's offsets, one row for each
part of the sorted leaves, so a group of any share of the rows is never in one task.

Defined results: a null field is `-`; null groups are one group, before all others; rows
with a null order key stand first in their group; rows that are equal in the order key
stand in the order of their hashes, and equal rows are leaves of their own; a group of one
row has that leaf for its subroot, a single group's subroot is the root; an empty table has
no rows. Other columns of the table play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import offsets, placed
from .workspace import Workspace

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Nodes that are broadcast, at most.
FEW = 50_000
#: The top tree's number; the groups' trees are numbered from 0 in their order.
TOP = -1


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Hex SHA-256 of the fields, each `-` if null, else its bytes' count, `:` and itself."""
    texts = [value.cast("string") for value in fields.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


@dataclass
class Manifest:
    """leaves: group, order key, carried columns, leaf, _row, _part, tree, at, size. nodes: tree, level, at, size (of the level), digest. groups: group, _part, tree, size, subroot."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    root: str | None
    trees: int
    few: int
    work: Workspace


def _powers() -> list[int]:
    return [ARITY**k for k in range(40) if ARITY**k < 1 << 62]


def _depth(size: int) -> int:
    return sum(size > p for p in _powers())


def _levels(leaves: DataFrame, size: int, work: Workspace) -> DataFrame:
    """All nodes over level 0 (tree, at, size, digest); size: the largest tree's leaves."""
    level = leaves.select("tree", F.lit(0).alias("level"), "at", "size", "digest")
    out = level
    for k in range(_depth(size)):
        # Up to ARITY digests a group, in their order.
        runs = level.where("size > 1").groupBy("tree", "size", F.floor(F.col("at") / ARITY).cast("long").alias("run")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("parts"))
        joined = F.array_join(F.transform("parts", lambda p: F.lower(F.hex(p["digest"]))), "")
        level = work.keep(runs.select("tree", F.lit(k + 1).alias("level"), F.col("run").alias("at"), F.ceil(F.col("size") / ARITY).cast("long").alias("size"), F.unhex(F.sha2(joined, 256)).alias("digest")))
        out = out.unionByName(level)
    return out


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None, few: int = FEW) -> Manifest:
    """The manifest of all rows; carry: more columns, from those of docs, that the leaves keep."""
    work = Workspace(docs.sparkSession)
    more = carry or {}
    rows = work.keep(docs.select(group, order, leaf_hash({f: F.col(f) for f in fields}).alias("leaf"), *[c.alias(name) for name, c in more.items()]))
    sorted_rows = placed(rows, [group, order, "leaf"], work)
    parts = work.keep(offsets(sorted_rows, group))
    # Groups in their order have the numbers of their trees.
    groups = placed(work.keep(parts.select(F.col(group).alias("_group"), F.col("_size").alias("size")).distinct().withColumn("all", F.lit(0))), ["_group"], work)
    off = offsets(groups, "all").withColumnRenamed("all", "_all")
    trees = work.keep(groups.join(off.select("_part", "_first", "_before"), "_part").select("_group", "size", (F.col("_row") - F.col("_first") + F.col("_before")).alias("tree")))
    count, largest = trees.agg(F.count("*"), F.max("size")).first()
    parts = work.keep(parts.join(trees, parts[group].eqNullSafe(trees["_group"])).select(parts[group].alias("_group"), F.col("_part").alias("_of"), "_first", "_before", "tree", "size"))
    leaves = work.keep(sorted_rows.join(parts, sorted_rows[group].eqNullSafe(parts["_group"]) & (sorted_rows["_part"] == parts["_of"])).select(*rows.columns, "_row", "_part", "tree", (F.col("_row") - F.col("_first") + F.col("_before")).alias("at"), "size"))
    if not count:
        return Manifest(leaves, leaves.select("tree", F.lit(0).alias("level"), "at", "size", F.unhex("leaf").alias("digest")), parts.withColumn("subroot", F.lit("")), None, 0, few, work)
    nodes = _levels(leaves.withColumn("digest", F.unhex("leaf")), largest, work)
    subroots = work.keep(nodes.where("size = 1").select(F.col("tree").alias("of"), "digest"))
    top = _levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("of").alias("at"), F.lit(count).alias("size"), "digest"), count, work)
    root = top.where("size = 1").select(F.lower(F.hex("digest"))).first()[0]
    groups = parts.join(subroots, parts["tree"] == subroots["of"]).select("_group", "_of", "tree", "size", F.lower(F.hex("digest")).alias("subroot"))
    return Manifest(leaves, nodes.unionByName(top), groups, root, count, few, work)


def sibling_coordinates(tree: Column, at: Column, size: Column) -> Column:
    """Array of (tree, level, at, mine): the other nodes of each run on the way up from place at of a level with size nodes; mine: the place on the way."""
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(p).cast("long").alias("width")) for k, p in enumerate(_powers())])

    def run(level: Column) -> Column:
        mine, last = F.floor(at / level["width"]).cast("long"), F.floor((size - 1) / level["width"]).cast("long")
        first = mine - F.pmod(mine, F.lit(ARITY))
        places = F.filter(F.transform(F.array(*[F.lit(k) for k in range(ARITY)]), lambda k: first + k), lambda p: (p != mine) & (p <= last))
        return F.transform(places, lambda p: F.struct(tree.alias("tree"), level["level"].alias("level"), p.alias("at"), mine.alias("mine")))

    return F.flatten(F.transform(F.filter(levels, lambda level: size > level["width"]), run))


def _looked_up(items: DataFrame, nodes: DataFrame, shared: int, work: Workspace) -> DataFrame:
    """item and its siblings, from the lowest level up and left to right: (level, at, left, hex); items without any are left out. items: item, tree, at, size. shared: the level from which on nodes are broadcast."""
    wanted = items.select("item", F.explode(sibling_coordinates(F.col("tree"), F.col("at"), F.col("size"))).alias("c")).select("item", "c.*")
    digests = nodes.select("tree", "level", "at", "digest")
    low = wanted.where(F.col("level") < shared).join(digests.where(F.col("level") < shared), ["tree", "level", "at"])
    high = wanted.where(F.col("level") >= shared).join(F.broadcast(digests.where(F.col("level") >= shared)), ["tree", "level", "at"])
    found = work.keep(low.unionByName(high).select("item", "level", "at", (F.col("at") < F.col("mine")).alias("left"), "digest"))
    ordered = found.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("level", "at", "left", "digest"))).alias("s"))
    return ordered.select("item", F.transform("s", lambda s: F.struct(s["level"].alias("level"), s["left"].alias("left"), F.lower(F.hex(s["digest"])).alias("hex"))).alias("siblings"))


def _shared_level(nodes: DataFrame, few: int) -> int:
    """The least level from which on there are few nodes at most."""
    total, level = 0, len(_powers())
    for k, n in sorted(nodes.where("size > 1").groupBy("level").count().collect(), reverse=True):  # a row for each level
        total += n
        if total > few:
            break
        level = k
    return level


def proofs(m: Manifest) -> DataFrame:
    """The leaves with depth and siblings (level, left, hex; from the leaf's level to the subroot's, left to right), top_depth and above (the same from the subroot to the root), and subroot."""
    none = F.array().cast("array<struct<level:int,left:boolean,hex:string>>")
    inner, top = m.nodes.where(F.col("tree") != TOP), m.nodes.where(F.col("tree") == TOP)
    mine = m.work.keep(_looked_up(m.leaves.select(F.col("_row").alias("item"), "tree", "at", "size"), inner, _shared_level(inner, m.few), m.work))
    one_each = m.groups.select(F.col("tree").alias("item")).distinct().select("item", F.lit(TOP).cast("long").alias("tree"), F.col("item").alias("at"), F.lit(m.trees).cast("long").alias("size"))
    above = _looked_up(one_each, top, _shared_level(top, m.few), m.work)
    groups = m.work.keep(m.groups.join(above.withColumnsRenamed({"item": "tree", "siblings": "above"}), "tree", "left").select(F.col("tree").alias("_tree"), "_of", "subroot", F.coalesce("above", none).alias("above")))
    found = m.leaves.join(groups, (m.leaves["tree"] == groups["_tree"]) & (m.leaves["_part"] == groups["_of"])).join(mine.withColumnRenamed("item", "_row"), "_row", "left")
    depth = F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in _powers()]), lambda p: F.col("size") > p))
    return found.select(*m.leaves.columns, depth.alias("depth"), F.lit(_depth(m.trees)).alias("top_depth"), F.coalesce("siblings", none).alias("siblings"), "above", "subroot")


def proof_hash(*siblings: Column) -> Column:
    return F.sha2(F.concat(*[F.array_join(F.transform(s, lambda x: x["hex"]), "") for s in siblings]), 256)


def folded(leaf: Column, siblings: Column, depth: Column) -> Column:
    """The node depth levels above a leaf, from the siblings on the way."""
    levels = F.slice(F.array(*[F.lit(k) for k in range(len(_powers()))]), F.lit(1), depth)

    def side(level: Column, left: bool) -> Column:
        return F.array_join(F.transform(F.filter(siblings, lambda s: (s["level"] == level) & (s["left"] == F.lit(left))), lambda s: s["hex"]), "")

    return F.aggregate(levels, leaf, lambda h, level: F.sha2(F.concat(side(level, True), h, side(level, False)), 256))
