"""Merkle manifest of a dataset: every few levels of the hash trees are stored, the others are made anew where a proof needs them.

Rows are the leaves of one tree for each value of a column, and the roots of these trees are the leaves of one more.
A node is the hash of up to ``FAN`` consecutive nodes below it. Only each ``KEPT``-th level is written; the levels
between two stored ones live within one aligned subtree of ``FAN ** KEPT`` stored nodes, which one row holds while its
parents or its proofs are made.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.columns import let
from tidewheel.session import materialize

#: Nodes below a node, and levels from one stored level to the next.
FAN, KEPT = 8, 3
SUBTREE = FAN ** KEPT
#: A step of a proof: the hashes left and right of a node in its run, as joined text.
STEP = "array<struct<left: string, right: string>>"


def joined_hash(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' bytes, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def row_hash(*cells: Column | str) -> Column:
    """Hash of a row's cells, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cells]
    return joined_hash(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _tree_name(value: Column) -> Column:
    """A name for each tree, never null, that sorts like the value's UTF-8 bytes with null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``idx`` (place within ``tree`` by ``order``) and ``n`` (rows of the tree), written to the shared folder.

    Rows are sorted over range partitions, so a tree with most of the rows is spread; only the counts by
    tree and partition are summed up.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    stored = materialize(dealt.withColumn("_row", F.monotonically_increasing_id()), label)
    part = F.shiftrightunsigned("_row", 33).alias("_part")
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("tree", part).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")).select(
        "tree", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("n"))
    return stored.withColumn("_part", part).join(starts, ["tree", "_part"]).withColumn("idx", F.col("_row") + F.col("_shift")).drop(
        "_row", "_part", "_shift")


def _depth() -> Column:
    """Levels from a stored node to the next stored one: fewer where the tree ends before."""
    out = F.lit(KEPT)
    for k in reversed(range(KEPT)):
        out = F.when(F.col("n") <= FAN ** k, k).otherwise(out)
    return out


def _subtrees(level: DataFrame, carry: Column) -> DataFrame:
    """tree, block, n, depth and the sorted nodes (idx, hash, carry) of each aligned subtree of trees with several nodes."""
    return level.filter("n > 1").groupBy("tree", F.expr(f"idx div {SUBTREE}").alias("block"), "n").agg(
        F.sort_array(F.collect_list(F.struct("idx", "hash", carry.alias("carry")))).alias("nodes")).withColumn("depth", _depth())


def _above(hashes: Column) -> Column:
    """The hashes one level up."""
    runs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: joined_hash(F.array_join(F.slice(hashes, i * FAN + 1, FAN), "")))


def _step(hashes: Column, place: Column) -> Column:
    """The hashes beside the node at ``place`` in its run."""
    at = place % FAN
    run = F.slice(hashes, place - at + 1, FAN)
    return F.struct(F.array_join(F.slice(run, F.lit(1), at), "").alias("left"), F.array_join(F.slice(run, at + 2, F.lit(FAN)), "").alias("right"))


def _next_level(level: DataFrame) -> DataFrame:
    """The stored level above: one node of each subtree."""
    def lift(hashes: Column, k: int) -> Column:
        return let(hashes, lambda h: F.when(F.col("depth") > k, _above(h)).otherwise(h))

    up = F.expr("transform(nodes, v -> v.hash)")
    for k in range(KEPT):
        up = lift(up, k)
    return _subtrees(level, F.lit(None)).select(
        "tree", F.col("block").alias("idx"), F.ceil(F.col("n") / SUBTREE).alias("n"), F.get(up, F.lit(0)).alias("hash"))


def _own_paths(level: DataFrame, carry: Column) -> DataFrame:
    """tree, block, idx, hash, carry and path within its subtree of every node of trees with several nodes."""
    def members(rows: list[Column]) -> Column:
        def one(node: Column, j: Column) -> Column:
            steps, place = [], j
            for k, hashes in enumerate(rows):
                steps.append(F.when(F.col("depth") > k, _step(hashes, place)))
                place = F.floor(place / FAN).cast("int")
            return F.struct(node["idx"].alias("idx"), node["hash"].alias("hash"), node["carry"].alias("carry"),
                            F.array_compact(F.array(*steps)).alias("path"))

        return F.transform("nodes", one)

    def lift(rows: list[Column]) -> Column:
        return members(rows) if len(rows) == KEPT else let(_above(rows[-1]), lambda h: lift([*rows, h]))

    own = let(F.expr("transform(nodes, v -> v.hash)"), lambda h: lift([h]))
    return _subtrees(level, carry).select("tree", "block", F.inline(own))


def stored_levels(nodes: DataFrame, label: str) -> list[DataFrame]:
    """``nodes`` (tree, idx, n, hash) and each ``KEPT``-th level above them, up to the last tree's root, as stored tables."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(materialize(_next_level(levels[-1].select("tree", "idx", "n", "hash")), label))
        most = -(-most // SUBTREE)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of the root of each tree."""
    out = levels[0].filter("n = 1").select("tree", "hash")
    for level in levels[1:]:
        out = out.union(level.filter("n = 1").select("tree", "hash"))
    return out


def paths(levels: list[DataFrame], above: DataFrame, carry: Column) -> DataFrame:
    """carry, hash, path and the columns of ``above`` (tree, path, more) for each node of the lowest level, from the stored levels down.

    ``above`` tells what lies over the root of each tree; the interior nodes of a subtree exist only within its row.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    found = None
    for k, level in reversed(list(enumerate(levels))):
        held = carry if k == 0 else F.lit(None)
        ends = level.filter("n = 1").select("tree", "idx", "hash", held.alias("carry")).join(above, "tree").select(
            "tree", "idx", "hash", "carry", "path", *more)
        if found is not None:
            over = found.select("tree", F.col("idx").alias("block"), F.col("path").alias("_over"), *more)
            inner = _own_paths(level, held).join(over, ["tree", "block"]).select(
                "tree", "idx", "hash", "carry", F.concat("path", "_over").alias("path"), *more)
            ends = ends.union(inner)
        found = ends
    return found


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the trees of the rows (leaves first), and those of the tree over their roots."""

    levels: list[DataFrame]
    top: list[DataFrame]

    def root(self) -> DataFrame:
        """One row with the ``root`` of the dataset; none for an empty one."""
        return roots(self.top).select(F.col("hash").alias("root"))

    def proofs(self) -> DataFrame:
        """The kept columns of every row, with leaf, subroot, root and ``path``: the steps from the leaf to the root."""
        nothing = self.root().select(F.lit("").alias("tree"), F.lit(None).cast(STEP).alias("path"), "root").withColumn(
            "path", F.coalesce("path", F.array().cast(STEP)))
        over = paths(self.top, nothing, F.col("name")).select(
            F.col("carry").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
        return paths(self.levels, over, F.col("kept")).select("carry.*", F.col("hash").alias("leaf"), "subroot", "root", "path")


def manifest(docs: DataFrame, cells: list[str], tree: str, order: str, keep: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``: leaves are row hashes over ``cells``, in one tree for each value of ``tree``, by ``order``.

    Rows without a value in ``tree`` are a tree of their own, the first one; those without one in ``order`` come first. Rows
    of one ``order`` go by their hash; equal rows are leaves of their own. ``keep`` names columns to hand on to the proofs (``order`` by default). Other
    columns are ignored, and an empty table has no leaf and no root.
    """
    kept = keep or {order: F.col(order)}
    rows = docs.select(_tree_name(F.col(tree)).alias("tree"), F.col(order).alias("by"), row_hash(*cells).alias("hash"),
                       F.struct(*[c.alias(name) for name, c in kept.items()]).alias("kept"))
    levels = stored_levels(materialize(numbered(rows, ["by", "hash"], "leaves"), "leaves"), "nodes")
    below = roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    return Manifest(levels, stored_levels(materialize(numbered(below, ["name"], "subroots"), "subroots"), "top"))


def proof_hash(path: Column) -> Column:
    """Hash of all siblings of a path, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: joined_hash(s["left"], h, s["right"]))


def verified_rows(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of documents, some of them tampered with.

    Rows whose doc_id has a CRC-32 that 3 divides are recomputed with A-Z of their text lower-cased; a row without doc_id is
    left as it is.
    """
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cells = ["doc_id", "source", "lang", "n_chars"]
    changed = row_hash(*cells, F.translate("text", capitals, capitals.lower()))
    keep = {"doc_id": F.col("doc_id"), "edited": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, changed)}
    rows = manifest(docs, [*cells, "text"], "lang", "doc_id", keep).proofs()
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"),
                      folded(F.col("path"), F.coalesce("edited", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
