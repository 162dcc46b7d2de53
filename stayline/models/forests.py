"""Forests whose trees draw their own rows: class forests and honest effect forests.

Which rows a tree draws is a function of seed, tree and the row's key that any task can
recompute: the 52-bit hash of the key, put through the tree's own affine map modulo a prime,
gives a uniform number. A bootstrap takes each row Poisson(1) times; class weights are those of
the tree's own draw or of all rows.

Growing has two steps. While a node holds more than ``NODE_ROWS`` drawn rows, its split is
found from histograms: each task sums g and h by tree, node, feature and bin over its rows, and
a shuffle by (tree, node) adds them up and picks the split. When no node is that large, the drawn
rows of each (tree, node) go to one task, which grows the rest of the branch there. The rows of
a group are thus bounded by ``NODE_ROWS`` at any size of the input; trees have no depth limit
unless one is given.

A fully grown forest has up to 2 / min_leaf nodes for each drawn row and tree, so it never passes
through the driver: the branches are a staged table, and the driver has the upper parts only. Rows
to be scored go in blocks to groups of whole trees, or, where trees have more than half of
``GROUP_NODES`` nodes, to the branch that each tree sends them to; the values of a block's rows are added up tree by
tree. A forest of at most ``BROADCAST_NODES`` nodes is broadcast instead.

Rows are dealt to trees in turns of about ``DEALT_BYTES``, packed without loss, and forests are scored
in turns too; what a turn has shuffled is deleted when it ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.hashing import hash_number
from stayline.models.trees import (
    Tree,
    add_upwards,
    bin_values,
    binned,
    bytes_matrix,
    descend,
    feature_edges,
    grow_tree,
    leaves_of_bins,
    matrix_of,
    node_sums,
    packed_nodes,
)
from stayline.session import freed_shuffles, stage, stage_for_training, stage_numbered

NODE_ROWS = 1_000_000
BROADCAST_NODES = 200_000
#: Nodes of the whole trees that one task scores, one tree at a time, and the rows that it scores at most.
GROUP_NODES, GROUP_ROWS = 4_000_000, 2_000_000
#: Bytes of packed rows that are shuffled in one turn, and bytes of blocks, branches and sums when scoring.
DEALT_BYTES = SCORED_BYTES = 800_000_000
#: Drawn rows for each task that grows branches, where there are many.
_TASK_ROWS = 20_000
#: Rows of a block that is scored, and rows to be scored for each chunk of a branch's blocks.
_BLOCK_ROWS, _CHUNK_ROWS = 4096, 1_000_000
#: Cells of histograms that a task holds at once: trees x nodes x features x bins.
_CELLS = 8_000_000
#: Cells of histograms that the driver adds up; more are added up in a shuffle.
_DRIVER_CELLS = 1_000_000
PRIME = 2**31 - 1
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 12)]))
_TREE_ARRAYS = ("feature", "cut", "g", "h", "n")


def draw_maps(seed: int, trees: int, purpose: int = 0) -> list[tuple[int, int]]:
    """Multiplier and shift of each tree's map."""
    rng = np.random.default_rng([seed, purpose])
    return [(int(rng.integers(PRIME // 4, PRIME)), int(rng.integers(PRIME))) for _ in range(trees)]


def uniform(hashes: np.ndarray, map_: tuple[int, int]) -> np.ndarray:
    """(a * (hash mod p) + b) mod p, as a number from 0 to 1."""
    a, b = map_
    return ((hashes % PRIME) * a + b) % PRIME / PRIME


def bootstrap_counts(hashes: np.ndarray, map_: tuple[int, int]) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean one."""
    return np.searchsorted(_POISSON, uniform(hashes, map_), side="right")


def bootstrap_count(hashed: Column, map_: tuple[int, int]) -> Column:
    """``bootstrap_counts`` as an expression."""
    a, b = map_
    drawn = (((hashed % PRIME) * a + b) % PRIME).cast("double") / float(PRIME)
    return sum(((drawn >= float(c)).cast("int") for c in _POISSON[1:]), (drawn >= float(_POISSON[0])).cast("int"))


@dataclass(frozen=True)
class Drawing:
    """How trees draw rows: a bootstrap, or a share without repeats of which half grows the
    tree and the other half gives its leaves their values (honest trees)."""

    seed: int
    trees: int
    share: float | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "maps", draw_maps(self.seed, self.trees))
        object.__setattr__(self, "halves", draw_maps(self.seed, self.trees, 1))

    def drawn(self, tree: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, their weights, whether they are kept back for the values)."""
        if self.share is None:
            counts = bootstrap_counts(hashes, self.maps[tree])
            rows = np.flatnonzero(counts)
            return rows, counts[rows].astype(float), np.zeros(len(rows), bool)
        rows = np.flatnonzero(uniform(hashes, self.maps[tree]) < self.share)
        return rows, np.ones(len(rows)), uniform(hashes[rows], self.halves[tree]) < 0.5


@dataclass(frozen=True)
class Growth:
    """Settings of ``grow_tree`` and what classes weigh: None, "all" rows or each tree's "drawn"."""

    least_rows: int
    picks: int | None = None
    most_depth: int | None = None
    class_weight: str | None = None
    least_h: float = 0.0
    ridge: float = 0.0


def _batches(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        if batch.num_rows:
            yield (
                batch.column(0).to_numpy(),
                *(batch.column(i).to_numpy() for i in (1, 2)),
                bytes_matrix(batch.column(3), width),
            )


#: What a task makes of its batches: (tree, a number for the order of blocks, g, h, kept back, bins).
Draw = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]


def forest_draw(drawing: Drawing, weights: np.ndarray | None, width: int, trees: Sequence[int]) -> Draw:
    def draw(batches):
        for hashes, g, h, bins in _batches(batches, width):
            for t in trees:
                at, times, kept_back = drawing.drawn(t, hashes)
                wg, wh = _weighted(g[at] * times, h[at] * times, None if weights is None else weights[t])
                yield t, int(hashes[0]), wg, wh, kept_back, bins[at]

    return draw


def class_sums(rows: DataFrame, drawing: Drawing, width: int) -> np.ndarray:
    """Drawn weight of (all rows, rows of class 1) for each tree; one number each per task and tree."""

    def run(batches):
        sums = np.zeros((drawing.trees, 2))
        for hashes, g, h, _ in _batches(batches, width):
            for tree in range(drawing.trees):
                at, weight, _ = drawing.drawn(tree, hashes)
                sums[tree] += (weight @ h[at], weight @ g[at])
        yield pa.RecordBatch.from_pydict(
            {"tree": pa.array(range(drawing.trees), pa.int32()), "h": sums[:, 0], "g": sums[:, 1]}
        )

    found = np.zeros((drawing.trees, 2))
    summed = rows.mapInArrow(run, "tree int, h double, g double").groupBy("tree").agg(F.sum("h"), F.sum("g"))
    for tree, h, g in summed.collect():
        found[tree] = h, g
    return found


def class_weights(sums: np.ndarray) -> np.ndarray:
    """Weight of class 0 and class 1: rows / (2 * rows of the class); 1 where a class is absent."""
    total, ones = sums[:, 0], sums[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.stack([total / (2 * (total - ones)), total / (2 * ones)], axis=1)
    return np.where(np.isfinite(weights), weights, 1.0)


def _weighted(g: np.ndarray, h: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return g, h
    return g * weights[1], (h - g) * weights[0] + g * weights[1]


_KINDS = {"i4": pa.int32(), "i8": pa.int64(), "f8": pa.float64(), "b": pa.binary()}


def _records(columns: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch; ``columns`` names each with its kind."""
    named = [c.split(":") for c in columns.split()]
    values = zip(*rows) if rows else [()] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[k]) for v, (_, k) in zip(values, named)], [n for n, _ in named])


class _Tops:
    """The upper parts of the trees while their large nodes are split."""

    def __init__(self, trees: int):
        self.parts = [{k: [v] for k, v in (("feature", -1), ("cut", 0), ("left", -1), ("right", -1))} for _ in range(trees)]

    def arrays(self, tree: int) -> tuple[np.ndarray, ...]:
        return tuple(np.array(self.parts[tree][k]) for k in ("feature", "cut", "left", "right"))

    def split(self, tree: int, node: int, feature: int, cut: int) -> tuple[int, int]:
        part = self.parts[tree]
        left = len(part["feature"])
        part["feature"][node], part["cut"][node] = feature, cut
        part["left"][node], part["right"][node] = left, left + 1
        for k, v in (("feature", -1), ("cut", 0), ("left", -1), ("right", -1)):
            part[k] += [v, v]
        return left, left + 1

    def depth(self, tree: int, node: int) -> int:
        depth, part = 0, self.parts[tree]
        while node:
            node = next(i for i, (a, b) in enumerate(zip(part["left"], part["right"])) if node in (a, b))
            depth += 1
        return depth


def split_large(rows: DataFrame, draw: Draw, growth: Growth, n_bins, shapes, wanted, seed: int) -> list:
    """One pass over the rows: the best split of each of the ``wanted`` (tree, node), with its
    gain and the sums and rows on both sides. ``shapes`` are the arrays of the trees so far."""
    width, offsets = len(n_bins), np.r_[0, np.cumsum(n_bins)]
    place: dict[int, dict[int, int]] = {}
    for t, node in wanted:
        place.setdefault(t, {})[node] = len(place.get(t, {}))
    shape = {t: shapes[t] for t in place}

    def run(batches):
        sums = {t: np.zeros((3, len(nodes), offsets[-1])) for t, nodes in place.items()}
        top = {t: packed_nodes(*shape[t][:3]) for t in place}
        for t, _, g, h, kept_back, bins in draw(batches):
            if t not in place:
                continue
            rank = np.full(len(shape[t][0]), -1)
            rank[list(place[t])] = list(place[t].values())
            own = rank[leaves_of_bins(top[t], bins)]
            own[kept_back] = -1
            at = np.flatnonzero(own >= 0)
            if len(at) < len(own):
                own, g, h, bins = own[at], g[at], h[at], bins[at]
            nodes = len(place[t])
            for f, some in enumerate(n_bins):
                cell = own * some + bins[:, f]
                for k, v in enumerate((g, h, None)):
                    sums[t][k, :, offsets[f] : offsets[f + 1]] += np.bincount(cell, v, nodes * some).reshape(nodes, some)
        out = [(t, node, sums[t][:, k].tobytes()) for t, nodes in place.items() for node, k in nodes.items()]
        yield _records("tree:i4 node:i4 sums:b", out)

    def best_split(tree, node, parts):
        g, h, n = sum(np.frombuffer(s).reshape(3, -1) for s in parts)
        order = np.random.default_rng([seed, tree, node]).permutation(width)
        best = (1e-9, -1, 0, *[0.0] * 6)
        for k, f in enumerate(order):
            if k >= (growth.picks or width) and best[1] >= 0:
                break
            gl, hl, nl = (np.cumsum(x[offsets[f] : offsets[f + 1]]) for x in (g, h, n))
            gr, hr, nr = gl[-1] - gl, hl[-1] - hl, nl[-1] - nl
            fits = (nl >= growth.least_rows) & (nr >= growth.least_rows) & (hl > growth.least_h) & (hr > growth.least_h)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gl**2 / (hl + growth.ridge) + gr**2 / (hr + growth.ridge) - gl[-1] ** 2 / (hl[-1] + growth.ridge)
            gain = np.where(fits, gain, -np.inf)
            top = int(np.argmax(gain))
            if gain[top] > best[0]:
                best = (float(gain[top]), int(f), top, *(float(x[top]) for x in (gl, hl, nl, gr, hr, nr)))
        return tree, node, *best

    def choose(key, table):
        return pa.Table.from_batches([_records(_SPLIT, [best_split(*(k.as_py() for k in key), table["sums"].to_pylist())])])

    found = rows.mapInArrow(run, "tree int, node int, sums binary")
    if rows.rdd.getNumPartitions() * len(wanted) * 3 * int(offsets[-1]) <= _DRIVER_CELLS:  # not worth a shuffle
        parts: dict[tuple[int, int], list[bytes]] = {}
        for t, node, sums in found.collect():
            parts.setdefault((t, node), []).append(sums)
        names = [c.split(":")[0] for c in _SPLIT.split()]
        return [dict(zip(names, best_split(*place, own))) for place, own in parts.items()]
    return found.groupBy("tree", "node").applyInArrow(choose, _sql(_SPLIT)).collect()


_SPLIT = "tree:i4 node:i4 gain:f8 feature:i4 cut:i4 gl:f8 hl:f8 nl:f8 gr:f8 hr:f8 nr:f8"
_SQL = {"i4": "int", "i8": "long", "f8": "double", "b": "binary"}


def dealt_rows(rows: DataFrame, draw: Draw, shapes, n_bins: Sequence[int]) -> DataFrame:
    """The drawn rows in blocks by tree and open node."""

    def deal(batches):
        top = {t: packed_nodes(*shape[:3]) for t, shape in shapes.items()}
        for t, first, g, h, kept_back, bins in draw(batches):
            node, out = leaves_of_bins(top[t], bins), []
            for leaf in np.unique(node):
                own = node == leaf if len(top[t]) > 1 else slice(None)
                numbers = [np.ascontiguousarray(x[own]).tobytes() for x in (g, h, kept_back)]
                out.append((t, int(leaf), first, *numbers, pack_bins(bins[own], n_bins)))
            yield _records("tree:i4 node:i4 first:i8 g:b h:b kept_back:b bins:b", out)

    return rows.mapInArrow(deal, "tree int, node int, first long, g binary, h binary, kept_back binary, bins binary")


def gathered(table: pa.Table, n_bins: Sequence[int]) -> tuple[np.ndarray, ...]:
    """g, h, kept back and bins of the rows of one (tree, node)."""
    table = table.sort_by("first")  # sums do not depend on which block came first
    g, h = (np.frombuffer(b"".join(table[c].to_pylist())) for c in ("g", "h"))
    kept_back = [np.frombuffer(b, bool) for b in table["kept_back"].to_pylist()]
    bins = [unpack_bins(b, len(k), n_bins) for b, k in zip(table["bins"].to_pylist(), kept_back)]
    return g, h, np.concatenate(kept_back), np.concatenate(bins)


def narrowed(x: np.ndarray, most_values: int = 0) -> bytes:
    """Numbers without loss: one if all are equal, a byte each if that holds them, numbers of their
    place among at most ``most_values`` distinct ones, or as they are."""
    if len(x) and (x == x[0]).all():
        return b"c" + float(x[0]).hex().encode()
    with np.errstate(invalid="ignore"):
        small = x.astype(np.uint8)
    if (small == x).all():
        return b"b" + small.tobytes()
    if most_values:
        values, place = np.unique(x, return_inverse=True)
        if len(values) <= min(most_values, len(x) // 8):
            kind = np.uint8 if len(values) <= 256 else np.uint16
            return b"t" + np.uint16(len(values) - 1).tobytes() + values.astype(float).tobytes() + place.astype(kind).tobytes()
    return b"d" + x.astype(float).tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that were ``narrowed``."""
    kind, rest = data[:1], memoryview(data)[1:]
    if kind == b"c":
        return np.full(n, float.fromhex(bytes(rest).decode()))
    if kind == b"b":
        return np.frombuffer(rest, np.uint8).astype(float)
    if kind == b"t":
        many = 1 + int(np.frombuffer(rest[:2], np.uint16)[0])
        values, place = rest[2 : 2 + 8 * many], rest[2 + 8 * many :]
        return np.frombuffer(values)[np.frombuffer(place, np.uint8 if many <= 256 else np.uint16)]
    return np.frombuffer(rest)


def pack_bins(bins: np.ndarray, n_bins: Sequence[int]) -> bytes:
    """Rows of bins: those of features with two bins as bits, the others as bytes."""
    two = np.asarray(n_bins) <= 2
    return np.ascontiguousarray(bins[:, ~two]).tobytes() + np.packbits(bins[:, two]).tobytes()


def unpack_bins(data: bytes, n: int, n_bins: Sequence[int]) -> np.ndarray:
    two = np.asarray(n_bins) <= 2
    flat, wide = np.frombuffer(data, np.uint8), n * int((~two).sum())
    bins = np.empty((n, len(two)), np.uint8)
    bins[:, ~two] = flat[:wide].reshape(n, -1) if wide else 0
    bins[:, two] = np.unpackbits(flat[wide:], count=n * int(two.sum())).reshape(n, int(two.sum()))
    return bins


def _packed_width(n_bins: Sequence[int]) -> float:
    return sum(1 if n > 2 else 1 / 8 for n in n_bins)


_DRAWN = "tree:i4 node:i4 first:i8 rows:i4 g:b h:b times:b kept_back:b bins:b"


def dealt_draws(rows: DataFrame, drawing: Drawing, shapes, trees: Sequence[int], n_bins: Sequence[int]) -> DataFrame:
    """The rows that ``trees`` draw, unweighted and packed, in blocks by tree and open node."""
    width = len(n_bins)

    def deal(batches):
        top = {t: packed_nodes(*shapes[t][:3]) for t in trees}
        out, held = [], 0
        for hashes, g, h, bins in _batches(batches, width):
            first = int(hashes[0])
            for t in trees:
                at, times, kept_back = drawing.drawn(t, hashes)
                own = bins.take(at, axis=0)
                node = leaves_of_bins(top[t], own) if len(top[t]) > 1 else np.zeros(len(at), np.int64)
                for leaf in np.unique(node):
                    some = slice(None) if len(top[t]) == 1 else np.flatnonzero(node == leaf)
                    of = at[some]
                    numbers = [narrowed(x) for x in (g[of], h[of], times[some], kept_back[some].astype(float))]
                    out.append((t, int(leaf), first, len(of), *numbers, pack_bins(own[some], n_bins)))
                    held += sum(map(len, out[-1][4:]))
                if held > 4_000_000:
                    yield _records(_DRAWN, out)
                    out, held = [], 0
        yield _records(_DRAWN, out)

    return rows.mapInArrow(deal, _sql(_DRAWN))


def gathered_draws(table: pa.Table, n_bins: Sequence[int]) -> tuple[np.ndarray, ...]:
    """g, h, times drawn, kept back and bins of the rows of one (tree, node)."""
    table = table.sort_by("first")  # sums do not depend on which block came first
    sizes = table["rows"].to_pylist()
    g, h, times, kept_back = (
        np.concatenate([widened(b, n) for b, n in zip(table[c].to_pylist(), sizes)]) for c in ("g", "h", "times", "kept_back")
    )
    bins = np.concatenate([unpack_bins(b, n, n_bins) for b, n in zip(table["bins"].to_pylist(), sizes)])
    return g, h, times, kept_back > 0, bins


@dataclass(frozen=True)
class Forest:
    """Grown trees: the arrays (feature, cut, left, right) of their upper parts, and a staged table
    of the branches that stand in the upper parts' open nodes: tree, node, nodes, rows of the root and the
    arrays of features and cuts and, of leaves, the sums, as bytes."""

    shapes: list[tuple[np.ndarray, ...]]
    branches: DataFrame

    def size(self) -> int:
        return self.branches.agg(F.sum("nodes")).first()[0] or 0

    def trees(self) -> list[Tree]:
        return _joined(self.shapes, self.branches.collect())


def branch_tree(row) -> Tree:
    """The branch in a row of ``Forest.branches``."""
    feature = np.frombuffer(row["feature"], np.int16).astype(np.int64)
    cut = np.frombuffer(row["cut"], np.uint8).astype(np.int64)
    inner = feature >= 0
    left = np.where(inner, 2 * np.cumsum(inner) - 1, -1)  # nodes stand level by level
    sums = []
    for k in "ghn":
        total = np.zeros(len(feature))
        total[~inner] = widened(row[k], int((~inner).sum()))
        sums.append(add_upwards(total, feature, left))
    return Tree(feature, cut, left, np.where(inner, left + 1, -1), *sums)


def _branch_record(tree: int, node: int, grown: Tree) -> pa.Table:
    leaf = grown.feature < 0
    arrays = [grown.feature.astype(np.int16).tobytes(), grown.cut.astype(np.uint8).tobytes()]
    arrays += [narrowed(x[leaf], 2**16) for x in (grown.g, grown.h, grown.n)]
    return pa.Table.from_batches([_records(_BRANCH, [(tree, node, len(leaf), float(grown.n[0]), *arrays)])])


_BRANCH = "tree:i4 node:i4 nodes:i8 rows:f8 " + " ".join(f"{k}:b" for k in _TREE_ARRAYS)


def grow_forest(
    rows: DataFrame, drawing: Drawing, growth: Growth, n_bins: Sequence[int], seed: int, node_rows: int = NODE_ROWS
) -> list[Tree]:
    """The trees of ``grown_forest`` on the driver."""
    return grown_forest(rows, drawing, growth, n_bins, seed, node_rows).trees()


def grown_forest(
    rows: DataFrame, drawing: Drawing, growth: Growth, n_bins: Sequence[int], seed: int, node_rows: int = NODE_ROWS
) -> Forest:
    """Trees over staged ``rows`` (hash long, g double, h double, bins binary)."""
    width = len(n_bins)
    weights = None
    if growth.class_weight == "drawn":
        weights = class_weights(class_sums(rows, drawing, width))
    elif growth.class_weight == "all":
        ones, total = rows.agg(F.sum("g"), F.sum("h")).first()
        weights = np.repeat(class_weights(np.array([[total, ones]])), drawing.trees, axis=0)
    tops, total = _Tops(drawing.trees), rows.count()
    large = [(t, 0) for t in range(drawing.trees)] if total > node_rows else []
    at_once = max(1, _CELLS // (3 * int(sum(n_bins))))
    while large:
        found, shapes = [], [tops.arrays(t) for t in range(drawing.trees)]
        for k in range(0, len(large), at_once):
            wanted = large[k : k + at_once]
            draw = forest_draw(drawing, weights, width, sorted({t for t, _ in wanted}))
            found += split_large(rows, draw, growth, n_bins, shapes, wanted, seed)
        large = []
        for r in found:
            if r["feature"] >= 0:
                children = tops.split(r["tree"], r["node"], r["feature"], r["cut"])
                for child, size in zip(children, (r["nl"], r["nr"])):
                    deep = growth.most_depth is not None and tops.depth(r["tree"], child) >= growth.most_depth
                    if size > node_rows and not deep:
                        large.append((r["tree"], child))
    shapes = [tops.arrays(t) for t in range(drawing.trees)]
    depths = [{n: tops.depth(t, n) for n in np.flatnonzero(s[0] < 0).tolist()} for t, s in enumerate(shapes)]

    def branch(key, table):
        tree, node = (k.as_py() for k in key)
        g, h, times, kept_back, bins = gathered_draws(table, n_bins)
        g, h = _weighted(g * times, h * times, None if weights is None else weights[tree])
        depth = None if growth.most_depth is None else growth.most_depth - depths[tree][node]
        own = ~kept_back
        grown = grow_tree(
            bins[own], g[own], h[own], np.random.default_rng([seed, tree, node]),
            least_rows=growth.least_rows, picks=growth.picks, most_depth=depth,
        )
        if drawing.share is not None:
            leaf = leaves_of_bins(packed_nodes(grown.feature, grown.cut, grown.left), bins[kept_back])
            sums = node_sums(grown, leaf, g[kept_back], h[kept_back], np.ones(kept_back.sum()))
            grown = Tree(grown.feature, grown.cut, grown.left, grown.right, *sums)
        return _branch_record(tree, node, grown)

    share = 1 - np.exp(-1.0) if drawing.share is None else drawing.share
    row_bytes = _packed_width(n_bins) + (2 if drawing.share is None else 17)
    at_once = max(1, int(DEALT_BYTES / max(1.0, total * share * row_bytes)))
    branches = None
    for k in range(0, drawing.trees, at_once):
        trees = range(k, min(k + at_once, drawing.trees))
        # a tree costs more than its few bytes say: as many tasks as cores, or as the drawn rows need
        cores = rows.sparkSession.sparkContext.defaultParallelism
        keys, drawn = sum(len(depths[t]) for t in trees), int(total * share * len(trees))
        tasks = max(4 * cores, min(2 * keys, drawn // _TASK_ROWS), -(-drawn // node_rows))
        dealt = dealt_draws(rows, drawing, shapes, trees, n_bins).repartition(tasks, "tree", "node")
        with freed_shuffles(rows.sparkSession):
            some = stage(dealt.groupBy("tree", "node").applyInArrow(branch, _sql(_BRANCH)), "forest", compression="zstd")
        branches = some if branches is None else branches.unionByName(some)
    return Forest(shapes, branches)


def _sql(columns: str) -> str:
    return ", ".join(f"{n} {_SQL[k]}" for n, k in (c.split(":") for c in columns.split()))


def _joined(shapes, branches) -> list[Tree]:
    """Whole trees: the branches put in the places of the open nodes of the upper parts."""
    by_tree: dict[int, list] = {}
    for r in branches:
        by_tree.setdefault(r["tree"], []).append(r)
    out = []
    for t, (feature, cut, left, right) in enumerate(shapes):
        arrays = {"feature": feature, "cut": cut, "left": left, "right": right}
        arrays = {k: v.astype(float) for k, v in arrays.items()} | {k: np.zeros(len(feature)) for k in "ghn"}
        for r in sorted(by_tree.get(t, []), key=lambda r: r["node"]):
            found = branch_tree(r)
            grown = {k: getattr(found, k).astype(float) for k in arrays}
            shift = len(arrays["feature"]) - 1  # its root takes the open node's place
            for side in ("left", "right"):
                grown[side] = np.where(grown[side] >= 0, grown[side] + shift, -1)
            for k in arrays:
                arrays[k][r["node"]] = grown[k][0]
                arrays[k] = np.concatenate([arrays[k], grown[k][1:]])
        for i in range(len(feature) - 1, -1, -1):  # the upper nodes' sums
            if feature[i] >= 0:
                for k in "ghn":
                    arrays[k][i] = arrays[k][left[i]] + arrays[k][right[i]]
        out.append(Tree(**{k: v.astype(np.int64) if k in ("feature", "cut", "left", "right") else v for k, v in arrays.items()}))
    return out


def row_blocks(rows: DataFrame, edges: Sequence[np.ndarray], shapes, chunks: int, *, every: bool = False) -> DataFrame:
    """Blocks of ``rows`` (row long, x array<double>) for the open node of each tree that they fall
    into, or for ``every`` open node: places in the block, whose number is that of its first row,
    and bins."""
    width = len(edges)
    opened = [np.flatnonzero(s[0] < 0) for s in shapes]

    def deal(batches):
        for first, own in _row_blocks(batches, width, edges):
            chunk = first // _BLOCK_ROWS % chunks
            for t, shape in enumerate(shapes):
                node = descend(*shape, own)
                out = []
                for leaf in opened[t] if every else np.unique(node):
                    place = np.arange(len(own)) if every else np.flatnonzero(node == leaf)
                    out.append((t, int(leaf), chunk, first, len(own), place.astype(np.uint16).tobytes(), own[place].tobytes()))
                yield _records("tree:i4 node:i4 chunk:i4 block:i8 rows:i4 place:b bins:b", out)

    return rows.mapInArrow(deal, "tree int, node int, chunk int, block long, rows int, place binary, bins binary")


def _row_blocks(batches: Iterator[pa.RecordBatch], width: int, edges: Sequence[np.ndarray]):
    """(first number, bins) of blocks of rows (row long, x array<double>) whose numbers follow each other."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        bins = bin_values(matrix_of(batch.column(1), width), edges)
        jumps = np.flatnonzero(np.diff(ids) != 1) + 1
        for begin, end in zip(np.r_[0, jumps], np.r_[jumps, len(ids)]):
            for at in range(begin, end, _BLOCK_ROWS):
                yield int(ids[at]), bins[at : min(at + _BLOCK_ROWS, end)]


def meet(
    blocks: DataFrame, branches: DataFrame, chunks: int, run, schema: str, *,
    by: Sequence[str] = ("tree", "node"), tasks: int | None = None,
) -> DataFrame:
    """``run(key, blocks, branches)`` for each key (tree and node, or ``by``) and chunk."""
    copies = branches.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    keys = [*by, "chunk"]
    tasks = max(4 * blocks.sparkSession.sparkContext.defaultParallelism, tasks or 32 * chunks)
    left, right = (side.repartition(tasks, *keys).groupBy(*keys) for side in (blocks, copies))
    return left.cogroup(right).applyInArrow(run, schema)


def chunks_of(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // _CHUNK_ROWS))


def leaf_values(tree: Tree) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(tree.h > 0, tree.g / tree.h, 0.0)


class ForestModel(Model):
    """Adds ``output``: the mean over trees of G / H of a row's leaf, or the ratio of the
    trees' mean sums; as a probability vector if ``vector``. ``trees`` brings the whole forest to
    the driver."""

    def __init__(
        self, forest: Forest, edges: list[np.ndarray], output: str, *, vector: bool, ratio_of_means: bool,
        features: str = "features", broadcast_nodes: int = BROADCAST_NODES,
    ):
        super().__init__()
        self.forest, self.edges, self.output = forest, edges, output
        self.vector, self.ratio_of_means, self.features = vector, ratio_of_means, features
        self.nodes = forest.size()
        self.small = self.nodes <= broadcast_nodes

    @property
    def trees(self) -> list[Tree]:
        if not hasattr(self, "_known_trees"):
            self._known_trees = self.forest.trees()
        return self._known_trees

    def scored(self, x: np.ndarray) -> np.ndarray:
        """One number for each row of ``x``."""
        top, bottom = np.zeros(len(x)), np.zeros(len(x))
        for tree, cuts in zip(self.trees, self._cuts()):
            leaf = descend(tree.feature, cuts, tree.left, tree.right, x)
            if self.ratio_of_means:
                rows = np.maximum(tree.n[leaf], 1.0)
                top += tree.g[leaf] / rows
                bottom += tree.h[leaf] / rows
            else:
                top += leaf_values(tree)[leaf]
                bottom += 1
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(bottom > 0, top / bottom, np.nan)

    def _cuts(self) -> list[np.ndarray]:
        if not hasattr(self, "_known_cuts"):
            self._known_cuts = [t.thresholds(self.edges) for t in self.trees]
        return self._known_cuts

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = self._broadcast_score(dataset) if self.small else self._branch_score(dataset)
        if not self.vector:
            return scored.withColumnRenamed("_p", self.output)
        return scored.withColumn(self.output, array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")

    def _broadcast_score(self, dataset: DataFrame) -> DataFrame:
        width, shared = len(self.edges), dataset.sparkSession.sparkContext.broadcast(_Scorer(self))

        @F.pandas_udf("double")
        def score(x):
            return shared.value.series(x, width)

        return dataset.withColumn("_p", score(vector_to_array(F.col(self.features))))

    def _branch_score(self, dataset: DataFrame) -> DataFrame:
        """Every row meets the leaves of all trees; the rows are staged, for their numbers must not change."""
        kept = stage_numbered(dataset, "scored", "_row")
        rows = kept.select("_row", vector_to_array(F.col(self.features)).alias("x"))
        whole, count = 2 * self.nodes <= GROUP_NODES * len(self.forest.shapes), kept.count()
        found = self._sums_of_groups(rows, count) if whole else self._sums_of_branches(rows, count)
        ratio_of_means, trees = self.ratio_of_means, len(self.forest.shapes)

        def added(key, table):
            table = table.sort_by("tree")
            places = [np.frombuffer(p, np.uint16) if p else slice(None) for p in table["place"].to_pylist()]
            size = max(table["rows"].to_pylist())
            top, bottom = np.zeros(size), np.zeros(size)
            for place, t, b in zip(places, table["top"].to_pylist(), table["bottom"].to_pylist()):
                top[place] += np.frombuffer(t)
                bottom[place] += np.frombuffer(b) if ratio_of_means else 0
            if not ratio_of_means:
                bottom += trees
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(bottom > 0, top / bottom, np.nan)
            return pa.table({"_row": key[0].as_py() + np.arange(len(value)), "_p": value})

        tasks = max(4 * kept.sparkSession.sparkContext.defaultParallelism, count // 50_000)
        with freed_shuffles(kept.sparkSession):
            scores = stage(found.repartition(tasks, "block").groupBy("block").applyInArrow(added, "_row long, _p double"), "scores")
        return kept.join(scores, "_row", "left").drop("_row")

    def _sums_of_groups(self, rows: DataFrame, count: int) -> DataFrame:
        """Sums of the values of groups of whole trees for blocks of rows."""
        shapes, edges, ratio_of_means = self.forest.shapes, self.edges, self.ratio_of_means
        trees, n_bins, cores = len(shapes), _bin_counts(edges), rows.sparkSession.sparkContext.defaultParallelism
        size = max(1, min(-(-trees // cores), GROUP_NODES * trees // max(1, self.nodes)))
        groups = -(-trees // size)
        chunks = max(1, -(-count // GROUP_ROWS), min(-(-4 * cores // groups), -(-count // _BLOCK_ROWS)))
        per_group = count * (_packed_width(n_bins) + (16 if ratio_of_means else 8)) + 8 * chunks * size * self.nodes / trees
        at_once = max(1, int(SCORED_BYTES / max(1.0, per_group)))
        width = len(edges)

        def deal(some):
            def run(batches):
                for block, bins in _row_blocks(batches, width, edges):
                    packed = pack_bins(bins, n_bins)
                    yield _records("group:i4 chunk:i4 block:i8 rows:i4 bins:b", [(k, block // _BLOCK_ROWS % chunks, block, len(bins), packed) for k in some])

            return run

        def values(key, blocks, branches):
            group, out = key[0].as_py(), []
            if blocks.num_rows:
                sizes = blocks["rows"].to_pylist()
                bins = np.concatenate([unpack_bins(b, n, n_bins) for b, n in zip(blocks["bins"].to_pylist(), sizes)])
                top, bottom = np.zeros(len(bins)), np.zeros(len(bins) if ratio_of_means else 0)
                for t in range(group * size, min((group + 1) * size, trees)):
                    own = branches.filter(pc.equal(branches["tree"], t)).to_pylist()
                    tree = _joined([shapes[t]], [r | {"tree": 0} for r in own])[0]
                    nodes, (over, under) = packed_nodes(tree.feature, tree.cut, tree.left), _leaf_values(tree, ratio_of_means)
                    for at in range(0, len(bins), 4 * _BLOCK_ROWS):
                        some = slice(at, at + 4 * _BLOCK_ROWS)
                        leaf = leaves_of_bins(nodes, bins[some])
                        top[some] += over[leaf]
                        if ratio_of_means:
                            bottom[some] += under[leaf]
                ends = np.cumsum(sizes)
                for block, begin, end in zip(blocks["block"].to_pylist(), ends - sizes, ends):
                    out.append((group, block, int(end - begin), b"", top[begin:end].tobytes(), bottom[begin:end].tobytes()))
            return pa.Table.from_batches([_records(_SUMS, out)])

        found = None
        for k in range(0, groups, at_once):
            some = range(k, min(k + at_once, groups))
            blocks = rows.mapInArrow(deal(some), "group int, chunk int, block long, rows int, bins binary")
            own = self.forest.branches.where(F.col("tree").between(k * size, some[-1] * size + size - 1))
            own = own.withColumn("group", F.floor(F.col("tree") / size).cast("int"))
            with freed_shuffles(rows.sparkSession):
                sums = stage(meet(blocks, own, chunks, values, _sql(_SUMS), by=["group"], tasks=2 * len(some) * chunks), "sums")
            found = sums if found is None else found.unionByName(sums)
        return found

    def _sums_of_branches(self, rows: DataFrame, count: int) -> DataFrame:
        """The values that each branch has for the rows that fall into it."""
        chunks, width, ratio_of_means = max(1, -(-count // _CHUNK_ROWS)), len(self.edges), self.ratio_of_means

        def values(key, blocks, branch):
            tree, node, _ = (k.as_py() for k in key)
            out = []
            if blocks.num_rows:
                nodes, (top, bottom) = _leaf_sums(branch, ratio_of_means)
                for block, size, place, bins in zip(*(blocks[c].to_pylist() for c in ("block", "rows", "place", "bins"))):
                    leaf = leaves_of_bins(nodes, np.frombuffer(bins, np.uint8).reshape(-1, width))
                    out.append((tree, block, size, place, top[leaf].tobytes(), b"" if bottom is None else bottom[leaf].tobytes()))
            return pa.Table.from_batches([_records(_SUMS, out)])

        blocks = row_blocks(rows, self.edges, self.forest.shapes, chunks)
        return meet(blocks, self.forest.branches, chunks, values, _sql(_SUMS))


_SUMS = "tree:i4 block:i8 rows:i4 place:b top:b bottom:b"


def _leaf_values(tree: Tree, ratio_of_means: bool):
    """The two numbers that a leaf adds to a row."""
    if not ratio_of_means:
        return leaf_values(tree), None
    rows = np.maximum(tree.n, 1.0)
    return tree.g / rows, tree.h / rows


def _leaf_sums(branch: pa.Table, ratio_of_means: bool):
    """Nodes of a branch and the two numbers that a leaf adds to a row; a tree without rows is one leaf."""
    if branch.num_rows:
        tree = branch_tree(branch.to_pylist()[0])
    else:
        tree = Tree(*(np.array([v]) for v in (-1, 0, -1, -1)), *np.zeros((3, 1)))
    return packed_nodes(tree.feature, tree.cut, tree.left), _leaf_values(tree, ratio_of_means)


class _Scorer:
    """What scoring tasks need of a model."""

    def __init__(self, model: ForestModel):
        self.trees, self.edges, self.ratio_of_means = model.trees, model.edges, model.ratio_of_means

    scored, _cuts = ForestModel.scored, ForestModel._cuts

    def series(self, x, width: int):
        import pandas as pd

        return pd.Series(self.scored(np.stack(x.to_numpy()).reshape(len(x), width)) if len(x) else np.empty(0))


def _bin_counts(edges: Sequence[np.ndarray]) -> list[int]:
    return [len(e) + 1 for e in edges]


def _hashed(dataset: DataFrame, key: str | None, seed: int) -> tuple[DataFrame, Column]:
    """Rows and the hash that their draws come from: of their key or, without one, of their
    place in the staged rows."""
    if key is None:
        dataset = stage_for_training(dataset.withColumn("_row", F.monotonically_increasing_id()), "forest-rows")
    return dataset, hash_number(f"{seed}:draw", F.col(key or "_row"))


class ForestClassifier(Estimator):
    """A forest of probability trees. ``picks``: features tried in each node, None for the root
    of their number; ``class_weight``: None, "all" or "drawn"."""

    def __init__(
        self, *, trees: int, min_leaf: int, max_depth: int | None = None, class_weight: str | None = None,
        seed: int = 42, label: str = "label", features: str = "features", key: str | None = None,
        output: str = "probability", node_rows: int = NODE_ROWS, broadcast_nodes: int = BROADCAST_NODES,
    ):
        super().__init__()
        self.trees, self.min_leaf, self.max_depth, self.class_weight = trees, min_leaf, max_depth, class_weight
        self.seed, self.label, self.features, self.key = seed, label, features, key
        self.output, self.node_rows, self.broadcast_nodes = output, node_rows, broadcast_nodes

    def _fit(self, dataset: DataFrame) -> ForestModel:
        wanted = [c for c in (self.key, self.label, self.features) if c]
        dataset, hashed = _hashed(dataset.select(*wanted), self.key, self.seed)
        edges = feature_edges(dataset, self.features)
        label = F.col(self.label).cast("double")
        carried = {"hash": hashed, "g": label, "h": F.lit(1.0)}
        rows = stage_for_training(binned(dataset.where(label.isNotNull()), edges, carried, self.features), "binned")
        growth = Growth(self.min_leaf, max(1, int(np.sqrt(len(edges)))), self.max_depth, self.class_weight)
        grown = grown_forest(rows, Drawing(self.seed, self.trees), growth, _bin_counts(edges), self.seed, self.node_rows)
        return ForestModel(
            grown, edges, self.output, vector=True, ratio_of_means=False, features=self.features, broadcast_nodes=self.broadcast_nodes
        )


class EffectForest(Estimator):
    """Honest trees for the effect of a treatment, from residuals of outcome and treatment.

    A tree draws ``share`` of the rows. One half of them decides the splits, by the gain in
    heterogeneity of the effect; the other half alone gives the leaves their sums. The effect
    of a row is the ratio of the trees' mean sums in its leaves.
    """

    def __init__(
        self, *, trees: int = 500, min_leaf: int = 10, max_depth: int | None = None, share: float = 0.45,
        seed: int = 42, outcome: str = "y_residual", treatment: str = "t_residual", features: str = "features",
        key: str | None = None, output: str = "effect", node_rows: int = NODE_ROWS, broadcast_nodes: int = BROADCAST_NODES,
    ):
        super().__init__()
        self.trees, self.min_leaf, self.max_depth, self.share, self.seed = trees, min_leaf, max_depth, share, seed
        self.outcome, self.treatment, self.features, self.key = outcome, treatment, features, key
        self.output, self.node_rows, self.broadcast_nodes = output, node_rows, broadcast_nodes

    def _fit(self, dataset: DataFrame) -> ForestModel:
        wanted = [c for c in (self.key, self.outcome, self.treatment, self.features) if c]
        dataset, hashed = _hashed(dataset.select(*wanted), self.key, self.seed)
        edges = feature_edges(dataset, self.features)
        t, y = F.col(self.treatment), F.col(self.outcome)
        carried = {"hash": hashed, "g": t * y, "h": t * t}
        rows = stage_for_training(binned(dataset, edges, carried, self.features), "binned")
        drawing = Drawing(self.seed, self.trees, self.share)
        grown = grown_forest(rows, drawing, Growth(self.min_leaf, None, self.max_depth), _bin_counts(edges), self.seed, self.node_rows)
        return ForestModel(
            grown, edges, self.output, vector=False, ratio_of_means=True, features=self.features, broadcast_nodes=self.broadcast_nodes
        )


def leaves_of(rows: DataFrame, model: ForestModel, drawing: Drawing) -> DataFrame:
    """tree, leaf, hash, g, h and kept_back of every drawn row: what each leaf's sums are made of.
    ``rows`` as for ``grow_forest``."""
    trees, width = model.trees, len(model.edges)

    def run(batches):
        for hashes, g, h, bins in _batches(batches, width):
            for t, tree in enumerate(trees):
                at, weight, kept_back = drawing.drawn(t, hashes)
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": pa.array([t] * len(at), pa.int32()),
                        "leaf": pa.array(tree.leaf_of(bins[at]), pa.int32()),
                        "hash": pa.array(hashes[at], pa.int64()),
                        "g": g[at] * weight,
                        "h": h[at] * weight,
                        "kept_back": pa.array(kept_back, pa.bool_()),
                    }
                )

    return rows.mapInArrow(run, "tree int, leaf int, hash long, g double, h double, kept_back boolean")

