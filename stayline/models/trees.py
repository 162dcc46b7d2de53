"""Regression trees over binned features, grown for the gain of sums of two statistics.

Every learner here gives a row two numbers, g and h, and splits a node where
G_left**2 / (H_left + ridge) + G_right**2 / (H_right + ridge) grows most over the node itself:

- a class forest: g = weight * label, h = weight (the Gini gain)
- an effect forest: g = treatment residual * outcome residual, h = treatment residual squared
  (the gain in heterogeneity of the effect G / H)
- boosting: g = gradient, h = curvature of the loss

A row goes left if its bin is at most the cut of the node. Bins are the places of a value
among at most 255 cut points of its feature, taken from quantile sketches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BINS = 256
_SKETCHES_AT_ONCE = 64
_ACCURACY = 20_000


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: feature -1 in a leaf; sums g, h and rows n of every node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    g: np.ndarray
    h: np.ndarray
    n: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        return descend(self.feature, self.cut, self.left, self.right, bins)

    def leaf_of_values(self, x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
        return descend(self.feature, self.thresholds(edges), self.left, self.right, x)

    def thresholds(self, edges: Sequence[np.ndarray]) -> np.ndarray:
        inner = self.feature >= 0
        cuts = np.zeros(len(self.feature))
        cuts[inner] = [edges[f][c] for f, c in zip(self.feature[inner], self.cut[inner])]
        return cuts


def descend(feature, cut, left, right, values: np.ndarray) -> np.ndarray:
    """The node in which each row of ``values`` ends."""
    node = np.zeros(len(values), np.int64)
    rows = np.arange(len(values))
    while len(rows):
        at = node[rows]
        inner = feature[at] >= 0
        rows, at = rows[inner], at[inner]
        node[rows] = np.where(values[rows, feature[at]] <= cut[at], left[at], right[at])
    return node


def packed_nodes(feature, cut, left) -> np.ndarray:
    """Nodes as one number each: left child, feature and cut. Right children follow left ones; a
    leaf is its own left child."""
    inner = feature >= 0
    to = np.where(inner, left, np.arange(len(feature))).astype(np.int64)
    return to << 24 | np.where(inner, feature, 0).astype(np.int64) << 8 | np.where(inner, cut, 255).astype(np.int64)


def leaves_of_bins(nodes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """``descend`` for ``packed_nodes`` and a matrix of bins."""
    n, width = bins.shape
    flat, begin = np.ascontiguousarray(bins).ravel(), np.arange(n) * width
    node, rows = np.zeros(n, np.int64), None
    at = node
    for level in range(len(nodes)):
        now = nodes.take(at)
        following = (now >> 24) + (flat.take(begin + ((now >> 8) & 0xFFFF)) > (now & 0xFF))
        moved = following != at
        at = following
        if level % 4 == 3 or n < 64:
            if rows is None:
                node = at
            else:
                node[rows] = at
            on = np.flatnonzero(moved)
            if not len(on):
                return node
            if 2 * len(on) < len(at):
                rows = on if rows is None else rows[on]
                at, begin = at[on], begin[on]
    if rows is None:
        return at
    node[rows] = at
    return node


def feature_edges(df: DataFrame, features: str = "features") -> list[np.ndarray]:
    """Cut points of each element of the vector: midpoints between neighbouring values of a
    sketch of 256 quantiles, of which repeated ones fall away."""
    values = df.select(vector_to_array(F.col(features)).alias("x"))
    width = values.select(F.max(F.size("x"))).first()[0] or 0
    shares = [i / (MOST_BINS - 1) for i in range(MOST_BINS)]
    edges = []
    for at in range(0, width, _SKETCHES_AT_ONCE):
        wanted = range(at, min(at + _SKETCHES_AT_ONCE, width))
        found = values.agg(*[F.percentile_approx(F.col("x")[i], shares, _ACCURACY).alias(f"e{i}") for i in wanted]).first()
        for i in wanted:
            distinct = np.unique(np.asarray(found[f"e{i}"], float))
            edges.append((distinct[1:] + distinct[:-1]) / 2)
    return edges


def bin_values(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    bins = np.empty(x.shape, np.uint8)
    for f, cuts in enumerate(edges):
        bins[:, f] = np.searchsorted(cuts, x[:, f], side="left")
    return bins


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` doubles as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def bytes_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of ``width`` bytes as rows of a matrix, without a copy."""
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return flat[begin : begin + len(column) * width].reshape(len(column), width)


def as_binary(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    offsets = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def binned(df: DataFrame, edges: Sequence[np.ndarray], carried: dict[str, Column], features: str = "features") -> DataFrame:
    """The columns ``carried`` and ``bins``, one byte for each element of the vector."""
    width = len(edges)
    rows = df.select(*[c.alias(name) for name, c in carried.items()], vector_to_array(F.col(features)).alias("x"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names = list(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = as_binary(bin_values(matrix_of(batch.column(len(names)), width), edges))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], bins], [*names, "bins"])

    return rows.mapInArrow(run, f"{kinds}, bins binary")


#: Nodes and, if there are several, rows that are looked at together: they fit a 16-bit key and a cache.
_PIECE_NODES, _PIECE_ROWS = 256, 65_536


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of nodes whose rows lie node by node: (first node, end, first row, end)."""
    ends = np.cumsum(sizes)
    node, row = 0, 0
    while node < len(sizes):
        most = int(np.searchsorted(ends, row + _PIECE_ROWS, side="right"))
        stop = max(node + 1, min(most, node + _PIECE_NODES))
        end = int(ends[stop - 1])
        if end > row:
            yield node, stop, row, end
        node, row = stop, end


@dataclass
class _Best:
    gain: np.ndarray
    feature: np.ndarray
    cut: np.ndarray


def _improve(best: _Best, nodes, chosen, bins, gh, sums, carried, least_rows, least_h, ridge) -> complex:
    """Tries one feature in each of some ``nodes`` (-1: none) and keeps what is better.

    Rows lie node by node; ``gh``: g and h as one complex number, which are moved
    and added at once; ``sums``: G, H and rows of each node. Rows are sorted by node and bin, so that
    the sums left of every cut are running sums. They go on from ``carried``, the sum of the pieces
    before; the sum with this one is returned.
    """
    sizes = sums[2]
    feature = np.repeat(chosen, sizes)
    at = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    places = np.arange(0, bins.size, bins.shape[1])
    if (chosen < 0).any():
        rows = np.flatnonzero(feature >= 0)
        at, feature, places, gh = at.take(rows), feature.take(rows), places.take(rows), gh.take(rows)
    places += feature
    keys = at << 8 | bins.ravel().take(places)
    order = np.argsort(keys, kind="stable")
    keys, running = keys.take(order), gh.take(order)
    running[0] += carried
    np.cumsum(running, out=running)
    change = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=change[:-1])
    ends = change.nonzero()[0]
    cut = keys.take(ends)
    node = (cut >> 8).astype(np.int64)
    change = np.ones(len(node), bool)
    np.not_equal(node[1:], node[:-1], out=change[1:])
    segment = change.nonzero()[0]
    place = change.cumsum() - 1
    start, before = np.zeros(len(segment), np.int64), np.full(len(segment), carried)
    start[1:] = ends.take(segment[1:] - 1) + 1
    before[1:] = running.take(start[1:] - 1)
    left = running.take(ends) - before.take(place)
    gl, hl = left.real.copy(), left.imag.copy()
    nl = ends - start.take(place) + 1
    total_g, total_h, total_n = (s.take(node) for s in sums)
    gr, hr, nr = total_g - gl, total_h - hl, total_n - nl
    fits = (nl >= least_rows) & (nr >= least_rows) & (hl > least_h) & (hr > least_h)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total_g**2 / (total_h + ridge)
    gain = np.where(fits, gain, -np.inf)
    top = np.maximum.reduceat(gain, segment)
    winners = (gain == top.take(place)).nonzero()[0][::-1]
    first = np.empty(len(segment), np.int64)
    first[place.take(winners)] = winners  # the first of a node is written last
    at = node.take(segment)
    better = (top > best.gain.take(nodes.take(at))).nonzero()[0]
    at = at.take(better)
    now = nodes.take(at)
    best.gain[now], best.feature[now], best.cut[now] = top[better], chosen[at], cut[first[better]] & 0xFF
    return running[-1]


def grow_tree(
    bins: np.ndarray,
    g: np.ndarray,
    h: np.ndarray,
    rng: np.random.Generator,
    *,
    least_rows: int,
    picks: int | None = None,
    most_depth: int | None = None,
    least_h: float = 0.0,
    ridge: float = 0.0,
) -> Tree:
    """A tree over the rows given, level by level.

    ``picks`` features are drawn for each node; the others are tried only where none of these
    gives a split. A node without a gain stays a leaf. Nodes stand level by level, so that the
    children of the k-th inner one are the nodes 2 k + 1 and 2 k + 2.
    """
    n, width = bins.shape
    picks = min(picks or width, width)
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("feature", "cut", "left", "right", "g", "h", "n")}
    apart_by_row = np.divide(g * g, h, out=np.zeros(n), where=h > 0)
    gh, bins = np.empty(n, complex), np.ascontiguousarray(bins)
    gh.real, gh.imag = g, h
    at, nodes, made, depth = np.zeros(n, np.int64), 1, 1, 0
    while nodes:
        # rows lie node by node, and within a node in the order given
        sizes = np.bincount(at, minlength=nodes)
        sums = (np.bincount(at, gh.real, nodes), np.bincount(at, gh.imag, nodes), sizes)
        # no split can gain more than what sets single rows apart; rounding is no gain
        apart = np.bincount(at, apart_by_row, nodes)
        bound = apart - sums[0] ** 2 / np.where(sums[1] + ridge > 0, sums[1] + ridge, 1.0)
        best = _Best(1e-9 * apart, np.full(nodes, -1), np.zeros(nodes, np.int64))
        if most_depth is None or depth < most_depth:
            drawn = rng.random((nodes, width)).argsort(axis=1)
            open_ = (sizes >= 2 * least_rows) & (bound > 1e-9 * apart)
            if not open_.all():
                rows = np.flatnonzero(open_[at])
                at, bins, gh, apart_by_row = at[rows], bins.take(rows, axis=0), gh[rows], apart_by_row[rows]
            opened, carried = np.flatnonzero(open_), [0j] * width
            for begin, end, first, last in _pieces(sizes[opened]):
                some = opened[begin:end]
                own, tries = [s[some] for s in sums], drawn[some]
                for k in range(width):
                    chosen = tries[:, k]
                    if k >= picks:
                        chosen = np.where(best.feature[some] >= 0, -1, chosen)
                        if (chosen < 0).all():
                            break
                    carried[k] = _improve(best, some, chosen, bins[first:last], gh[first:last], own, carried[k], least_rows, least_h, ridge)
        split = best.feature >= 0
        number = np.cumsum(split) - 1
        left = np.where(split, made + 2 * number, -1)
        for k, v in zip(parts, (best.feature, best.cut, left, np.where(split, left + 1, -1), *sums)):
            parts[k].append(v)
        if split.any():
            rows = np.flatnonzero(split[at])
            at = at[rows]
            right = bins.ravel().take(rows * width + best.feature[at]) > best.cut[at]
            at = 2 * number[at] + right
            order = np.concatenate([first + np.argsort(at[first:last].astype(np.uint16), kind="stable") for _, _, first, last in _pieces(np.bincount(at >> 1))])
            at, rows = at[order], rows[order]
            bins, gh, apart_by_row = bins.take(rows, axis=0), gh[rows], apart_by_row[rows]
        nodes = 2 * int(split.sum())
        made, depth = made + nodes, depth + 1
    whole = {k: np.concatenate(v) for k, v in parts.items()}
    return Tree(**{k: v.astype(np.int64) if k in ("feature", "cut", "left", "right") else v.astype(float) for k, v in whole.items()})


def levels_of(feature, left) -> list[np.ndarray]:
    """The inner nodes, level by level from the root."""
    found, nodes = [], np.zeros(1, np.int64)
    while len(nodes := nodes[feature[nodes] >= 0]):
        found.append(nodes)
        nodes = (left[nodes][:, None] + np.arange(2)).ravel()
    return found


def add_upwards(total: np.ndarray, feature, left) -> np.ndarray:
    """Sums of inner nodes from those of leaves, in place."""
    for nodes in reversed(levels_of(feature, left)):
        total[nodes] += total[left[nodes]] + total[left[nodes] + 1]
    return total


def node_sums(tree: Tree, leaf: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sums of ``values`` over the rows of every node, given each row's leaf. A right child
    follows its left one."""
    return [add_upwards(np.bincount(leaf, v, len(tree.feature)), tree.feature, tree.left) for v in values]
