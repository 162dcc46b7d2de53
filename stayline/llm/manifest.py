"""A Merkle manifest of a dataset, and versions of it by path copying.

Every row is a leaf; the leaves of a language, by doc_id, form a binary tree, and the roots of
the languages another one. A tree is cut into aligned blocks of 2**12 nodes of a level. A task
builds one block; the tops of the blocks are the lowest level of the next tier, which is built
in the same way, and so on until each tree is one block. On the way back a block gets the path
above its top and gives each of its nodes their whole path to the root.

A version of the tree in which one leaf is another shares all nodes with the tree but the
ancestors of that leaf. Inside its block these are copied from the block's levels; above it the
copy goes on along the path which the upper tiers sent down. A row is verified if the root of
its version is the root of the manifest.

Digests are lowercase hex SHA-256; inputs are concatenated, digests as hex text. A leaf hashes
the fields, each ``-`` if null, else byte count, ``:`` and value. Defined results: a language
has leaves in the order of doc_id (null first), rows of one doc_id in that of their digests; the
null language comes first, the others by their bytes; the path of a row without siblings is
empty; an empty table gives no rows. Columns other than the fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 12
_PART_BITS = 33  # of monotonically_increasing_id
_LEFT, _RIGHT, _ALONE = b"L", b"R", b"-"
_TREE_ROW = "tree string, block long, node binary"
_PATH_ROW = "tree string, block long, path binary, subroot binary, root binary"


def _join(*parts: bytes) -> bytes:
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def levels_of(leaves: Sequence[bytes], alone: bool, most: int) -> list[list[bytes]]:
    """Nodes level by level: up to a single one, or exactly ``most`` levels if the block is
    not ``alone`` in its tree."""
    levels = [list(leaves)]
    while len(levels) <= most and (len(levels[-1]) > 1 or not alone):
        below = levels[-1]
        levels.append([_join(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def path_of(levels: Sequence[Sequence[bytes]], i: int) -> bytes:
    """Records of a side and, but for a node without sibling, the sibling's 32 bytes."""
    records = []
    for level in levels[:-1]:
        sibling = i ^ 1
        if sibling >= len(level):
            records.append(_ALONE)
        else:
            records.append((_LEFT if sibling < i else _RIGHT) + level[sibling])
        i >>= 1
    return b"".join(records)


def siblings_of(path: bytes) -> list[tuple[bytes, bytes]]:
    """(side, sibling) of each record; the sibling of a lone node is empty."""
    found, at = [], 0
    while at < len(path):
        side = path[at : at + 1]
        end = at + (1 if side == _ALONE else 33)
        found.append((side, path[at + 1 : end]))
        at = end
    return found


def copied_path(node: bytes, siblings: Sequence[tuple[bytes, bytes]]) -> list[bytes]:
    """The nodes that a version with ``node`` in this place does not share: it and its ancestors."""
    nodes = [node]
    for side, sibling in siblings:
        if side == _LEFT:
            node = _join(sibling, node)
        elif side == _RIGHT:
            node = _join(node, sibling)
        else:
            node = _join(node)
        nodes.append(node)
    return nodes


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The digest, as bytes, of one row's fields."""
    parts = []
    for field in fields:
        value = field.cast("string")
        named = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(named, F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with their ``position`` in ``tree``, by ``order`` (nulls first).

    One range shuffle; what is joined to the rows is one row for each tree and range partition,
    by both, so that the join is no more skewed than the partitions.
    """
    by = [F.col("tree").asc(), *[F.col(c).asc_nulls_first() for c in order]]
    at = F.monotonically_increasing_id()
    placed = stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", at), "order")
    placed = placed.withColumn("part", F.shiftright("at", _PART_BITS))
    parts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("tree", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = (F.col("at") - F.col("first") + F.col("before")).alias("position")
    return placed.join(offsets, ["tree", "part"]).select(*rows.columns, place)


def _blocks(rows: DataFrame, block_levels: int) -> DataFrame:
    return rows.withColumn("block", F.shiftright("position", block_levels))


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("position")


def _tops(entries: DataFrame, block_levels: int) -> DataFrame:
    """The top node of each block of ``entries`` (tree, position, block, node)."""

    def top(key: tuple, table: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        leaves = _in_order(table)["node"].to_pylist()
        levels = levels_of(leaves, block == 0 and len(leaves) < 1 << block_levels, block_levels)
        return pa.table({"tree": [tree], "block": pa.array([block], pa.int64()), "node": pa.array(levels[-1], pa.binary())})

    grouped = entries.select("tree", "block", "position", "node").groupBy("tree", "block")
    return grouped.applyInArrow(top, _TREE_ROW)


def _grown(entries: DataFrame, block_levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The entries of each tier, lowest first, and (tree, node) of the roots of all trees."""
    tiers = [entries]
    while True:
        tops = stage(_tops(tiers[-1], block_levels), "tops")
        if tops.where("block > 0").isEmpty():
            return tiers, tops.select("tree", "node")
        tiers.append(_blocks(tops.select("tree", F.col("block").alias("position"), "node"), block_levels))


def _nodes_in(table: pa.Table, block: int, block_levels: int) -> list[list[bytes]]:
    leaves = table["node"].to_pylist()
    return levels_of(leaves, block == 0 and len(leaves) < 1 << block_levels, block_levels)


def _paths_below(entries: DataFrame, above: DataFrame, block_levels: int) -> DataFrame:
    """One tier down: the whole path of each entry, as (tree, block, path, subroot, root)."""

    def below(key: tuple, table: pa.Table, upper: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        table, given = _in_order(table), upper.to_pylist()[0]
        levels = _nodes_in(table, block, block_levels)
        n = len(table)
        return pa.table(
            {
                "tree": pa.array([tree] * n, pa.string()),
                "block": table["position"],
                "path": pa.array([path_of(levels, i) + given["path"] for i in range(n)], pa.binary()),
                "subroot": pa.array([given["subroot"]] * n, pa.binary()),
                "root": pa.array([given["root"]] * n, pa.binary()),
            }
        )

    left = entries.select("tree", "block", "position", "node").groupBy("tree", "block")
    return left.cogroup(above.groupBy("tree", "block")).applyInArrow(below, _PATH_ROW)


_ROW = (
    "doc_id {id}, leaf string, subroot string, root string, proof array<string>, sides string, "
    "tampered_leaf string, copied_nodes int, folded_root string, verified boolean"
)


def _versions(entries: DataFrame, above: DataFrame, block_levels: int, row: str) -> DataFrame:
    """Each leaf's path, and the root of the version in which it is tampered with, if it is."""

    def versions(key: tuple, table: pa.Table, upper: pa.Table) -> pa.Table:
        _, block = (k.as_py() for k in key)
        table, given = _in_order(table), upper.to_pylist()[0]
        levels = _nodes_in(table, block, block_levels)
        higher = siblings_of(given["path"])
        unchanged = copied_path(levels[-1][0], higher)[-1].hex()
        proofs, sides, copied, folded = [], [], [], []
        for i, other in enumerate(table["tampered"].to_pylist()):
            inside = siblings_of(path_of(levels, i))
            whole = inside + higher
            proofs.append([s.hex() for _, s in whole if s])
            sides.append(b"".join(side for side, _ in whole).decode())
            nodes = [] if other is None else copied_path(other, whole)
            copied.append(len(nodes))
            folded.append(nodes[-1].hex() if nodes else unchanged)
        n, root = len(table), given["root"].hex()
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "leaf": pa.array([x.hex() for x in levels[0]], pa.string()),
                "subroot": pa.array([given["subroot"].hex()] * n, pa.string()),
                "root": pa.array([root] * n, pa.string()),
                "proof": pa.array(proofs, pa.list_(pa.string())),
                "sides": pa.array(sides, pa.string()),
                "tampered_leaf": pa.array([None if x is None else x.hex() for x in table["tampered"].to_pylist()], pa.string()),
                "copied_nodes": pa.array(copied, pa.int32()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([x == root for x in folded], pa.bool_()),
            }
        )

    left = entries.groupBy("tree", "block")
    return left.cogroup(above.groupBy("tree", "block")).applyInArrow(versions, row)


def manifest(
    docs: DataFrame,
    tampered: Column | None = None,
    changes: Mapping[str, Column] | None = None,
    fields: Sequence[str] = FIELDS,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, sides, tampered_leaf, copied_nodes, folded_root, verified.

    Where ``tampered`` holds, a version of the tree is made in which the row's fields are as in
    ``changes``, all other rows untouched. ``proof`` has the siblings from the leaf up, ``sides``
    for each level L or R, where the sibling stands, or - if there is none.
    """
    changes = changes or {}
    other = leaf_digest([changes.get(c, F.col(c)) for c in fields])
    lang = F.col("lang").cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), lang), F.lit("-")).alias("tree"),
        "doc_id",
        leaf_digest([F.col(c) for c in fields]).alias("node"),
        F.when(F.coalesce(F.lit(False) if tampered is None else tampered, F.lit(False)), other).alias("tampered"),
    )
    rows = stage(rows, "leaves")
    leaves = stage(_blocks(_positions(rows, ["doc_id", "node", "tampered"]), block_levels), "placed")
    tiers, subroots = _grown(leaves, block_levels)
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    tops = stage(_blocks(_positions(tops, ["name"]), block_levels), "subroots")
    top_tiers, root = _grown(tops, block_levels)

    nothing = F.lit("").cast("binary")
    zero = F.lit(0).cast("long").alias("block")
    above = root.select("tree", zero, nothing.alias("path"), nothing.alias("subroot"), F.col("node").alias("root"))
    for entries in reversed(top_tiers):
        above = _paths_below(entries, above, block_levels)
    names = tops.select("position", F.col("name").alias("tree"), F.col("node").alias("own"))
    above = above.join(names, F.col("block") == F.col("position")).select(
        names["tree"], zero, "path", F.col("own").alias("subroot"), "root"
    )
    for entries in reversed(tiers[1:]):
        above = _paths_below(entries, above, block_levels)
    id_type = dict(rows.dtypes)["doc_id"]
    return _versions(leaves, above, block_levels, _ROW.format(id=id_type))
