"""Merkle manifest of a dataset: digests of rows, of runs of rows, of groups, up to one root, with a proof for each row.

Every level of a tree is one table. A parent's children are spread into one column for each slot by conditional
aggregates (slot pivot); concatenating the columns gives the parent's digest, leaving out a child's own column gives the
siblings that its proof needs. Parents of one level are built from all groups at once, so the number of jobs is the
height of the tallest tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FANOUT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sha(text: Column) -> Column:
    """Digest as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 (32 bytes) of the fields in order: ``-`` for null, else UTF-8 byte count, colon, value as text."""
    parts = []
    for c in columns:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return _sha(F.concat(*parts))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``pos``, the place from 0 of a row in its group by ``order`` (nulls first), and ``size``, the group's rows.

    Rows are dealt by range of group and order, so a group of any size is spread over tasks. What a place needs beyond
    its own partition is the number of the group's rows in earlier ones: a table of at most partitions + groups rows.
    """
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    laid = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(laid.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).select(
        "part", group, "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy(group)).alias("size")))
    return laid.join(runs, ["part", group]).select(
        *df.columns, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "size")


@dataclass
class Tree:
    """Levels from the leaves' parents up: group, pos, size (leaves of the group), c0 .. (children), digest, hashed."""

    levels: list[DataFrame]
    fanout: int

    @property
    def top(self) -> DataFrame:
        """group, digest: what remains of each group."""
        return self.levels[-1].select("group", "digest")


def build_tree(nodes: DataFrame, fanout: int = FANOUT) -> Tree:
    """``nodes``: group, pos, size and ``child``, a struct whose field ``digest`` is hashed and whose others are kept.

    A group with one node left at a level passes it on unchanged, so all groups share the levels of the largest.
    """
    largest = nodes.agg(F.max("size")).first()[0] or 0
    slots = range(fanout)
    levels, reach = [], 1
    while not levels or largest > reach:
        pivot = nodes.groupBy("group", F.expr(f"pos div {fanout}").alias("pos")).agg(
            F.max("size").alias("size"),
            *[F.expr(f"max(if(pos % {fanout} = {s}, child, null)) AS c{s}") for s in slots])
        joined = F.expr(f"concat({', '.join(f"coalesce(lower(hex(c{s}.digest)), '')" for s in slots)})")
        hashed = F.col("size") > reach
        level = stored(pivot.select("*", hashed.alias("hashed"),
                                    F.when(hashed, _sha(joined)).otherwise(F.col("c0.digest")).alias("digest")))
        levels.append(level)
        nodes = level.select("group", "pos", "size", F.struct("digest").alias("child"))
        reach *= fanout
    return Tree(levels, fanout)


#: One step of a proof: digests before and after the node's own place, concatenated.
STEP_TYPE = "array<struct<left:binary,right:binary>>"


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """Each leaf's ``child`` with ``path``, its steps from the leaf up, followed by those of ``above``.

    ``above``: group, path and ``top`` (any columns to hand down, as one struct) of what remains of each group. Goes down
    level by level: a parent's row holds all its children, so leaves are read off their parents without a join of their own.
    """
    digest = [f"coalesce(c{s}.digest, X'')" for s in range(tree.fanout)]
    children = []
    for s in range(tree.fanout):
        left, right = ", ".join(["X''", *digest[:s]]), ", ".join(["X''", *digest[s + 1:]])
        children.append(f"struct(pos * {tree.fanout} + {s} AS pos, c{s} AS child, if(hashed, "
                        f"concat(array(struct(concat({left}) AS left, concat({right}) AS right)), path), path) AS path)")
    children = F.expr(f"explode(filter(array({', '.join(children)}), x -> x.child IS NOT NULL))").alias("x")
    below = above.withColumn("pos", F.lit(0).cast("long"))
    for level in reversed(tree.levels):
        below = level.join(below, ["group", "pos"]).select("group", "top", children).select("group", "top", "x.*")
    return below


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its steps lead to."""
    return F.aggregate(path, leaf, lambda node, s: _sha(F.concat(_hex(s["left"]), _hex(node), _hex(s["right"]))))


def proof_digest(path: Column) -> Column:
    """SHA-256 (hex) of all siblings of a proof as hex text, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)


@dataclass
class Manifest:
    """Trees of the groups' rows and of the groups; ``group`` is ``=`` and the group's value, or empty for null."""

    rows: Tree
    groups: Tree

    def root(self) -> DataFrame:
        """One row: the dataset's root as hex; none for an empty table."""
        return self.groups.top.select(_hex(F.col("digest")).alias("root"))

    def nodes(self) -> DataFrame:
        """All nodes above the rows: tree (``rows`` or ``groups``), group, level (from 1), pos, digest (hex)."""
        out = None
        for name, tree in (("rows", self.rows), ("groups", self.groups)):
            for k, level in enumerate(tree.levels):
                part = level.select(F.lit(name).alias("tree"), "group", F.lit(k + 1).alias("level"), "pos",
                                    _hex(F.col("digest")).alias("digest"))
                out = part if out is None else out.unionByName(part)
        return out

    def proofs(self) -> DataFrame:
        """One row per input row: id, leaf, altered (null unless given), subroot, root (32 bytes each) and path."""
        end = self.groups.top.select("group", F.col("digest").alias("root"), F.array().cast(STEP_TYPE).alias("path"))
        top = paths(self.groups, end.select("group", "path", F.struct("root").alias("top")))
        top = top.select(F.col("child.group").alias("group"), "path",
                         F.struct(F.col("top.root").alias("root"), F.col("child.digest").alias("subroot")).alias("top"))
        return paths(self.rows, top).select(
            F.col("child.id").alias("id"), F.col("child.digest").alias("leaf"), F.col("child.altered").alias("altered"),
            F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"), "path")


def build_manifest(docs: DataFrame, columns: list[str], group_col: str, id_col: str, fanout: int = FANOUT,
                   altered: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """Build the manifest of ``docs``: leaves from ``columns``, one tree for each value of ``group_col``, one over these.

    Leaves ascend by ``id_col`` (nulls first), repeated ids by digest; equal rows share their digest, so any order of these
    gives the same tree. ``altered`` replaces columns for a second digest of the rows that satisfy ``where``: what a reader
    of changed data would compute, to be folded with the original siblings. A null group is a group of its own, first in
    order. Only digests and ids are shuffled, never the columns. An empty table has no nodes; extra columns are ignored.
    """
    own = lambda c: F.col(f"`{c}`")
    value = own(group_col).cast("string")
    leaf = row_digest([own(c) for c in columns])
    other = F.lit(None).cast("binary") if altered is None else F.when(
        F.coalesce(where, F.lit(False)), row_digest([altered.get(c, own(c)) for c in columns]))
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), value), F.lit("")).alias("group"), own(id_col).alias("id"),
                         leaf.alias("digest"), other.alias("altered"))
    rows = build_tree(numbered(leaves, "group", ["id", "digest"]).select(
        "group", "pos", "size", F.struct("digest", "id", "altered").alias("child")), fanout)
    tops = numbered(rows.top.select(F.lit("").alias("all"), "group", "digest"), "all", ["group"])
    return Manifest(rows, build_tree(tops.select(
        F.col("all").alias("group"), "pos", "size", F.struct("digest", "group").alias("child")), fanout))


def tampered(id_col: str = "doc_id") -> Column:
    """Fixed rule of the contract: a third of the documents by the checksum of their id; never a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 0, F.lit(False))


def lowered(text_col: str = "text") -> Column:
    """Fixed change of the contract: A-Z in lower case."""
    return F.translate(F.col(f"`{text_col}`").cast("string"), _UPPER, _LOWER)


def verify(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the original data), folded_root (of the altered leaf where there is
    one, with the original siblings) and verified, as hex text."""
    return manifest.proofs().select(
        F.col("id").alias("doc_id"), _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        _hex(fold(F.coalesce("altered", "leaf"), F.col("path"))).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
