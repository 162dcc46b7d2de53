"""Second-order boosted trees, grown best leaf first or to a depth.

Each round fits a tree to gradient and curvature of the log loss. A tree is cut where
G**2 / (H + ridge) grows most, the leaf with the largest gain first, until it has ``most_leaves``
leaves, or all leaves down to ``most_depth``; a leaf is worth step * G / (H + ridge). Rows and
columns may be drawn anew for each tree: rows by a hash of their key, columns once for the tree.

Several models are fitted at once (the folds of a cross-validation, say): rows carry the number of
their model, and one job serves a round of all of them. Nodes with more than ``BRANCH_ROWS`` rows
are split by summed histograms, one job for all of them; the rows of smaller nodes go to one task
for each (model, node), which grows the branch there. Branches are joined best leaf first on the
driver, which sees splits only. Rows lie in blocks of arrays, which every pass reads as they are,
and keep their margin from the trees of the last staging, at most ``STAGE_ROUNDS`` rounds ago.
What a round has shuffled, and blocks that were staged anew, are deleted.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.hashing import hash_number
from stayline.models.forests import Growth, dealt_rows, draw_maps, gathered, split_large, uniform
from stayline.models.trees import Tree, bin_values, binned, bytes_matrix, feature_edges, leaves_of_bins, packed_nodes
from stayline.session import drop_staged, freed_shuffles, stage, stage_for_training

BRANCH_ROWS = 2_000_000
STAGE_ROUNDS = 4
LEAST_GAIN = 1e-9
_LARGE_SAMPLE, _HELD_BACK, _PATIENCE, _TOLERANCE = 10_000, 0.1, 10, 1e-7


@dataclass(frozen=True)
class Boosting:
    """``early_stop``: models of more than 10,000 rows keep a tenth of them back and stop when
    their loss there has not improved for ten rounds."""

    iterations: int
    step: float
    most_leaves: int | None = None
    most_depth: int | None = None
    least_rows: int = 20
    least_h: float = 0.0
    ridge: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    early_stop: bool = False
    seed: int = 42


@dataclass
class Split:
    """A node that may be split: its best split, and its sums."""

    gain: float
    feature: int
    cut: int
    g: float
    h: float
    n: float
    left: "Split | None" = None
    right: "Split | None" = None


def _best_split(hist: np.ndarray, s: Boosting, usable: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, cut) over histograms (3, features, bins) of g, h and rows."""
    left = hist.cumsum(axis=2)
    total = left[:, :1, -1:]
    right = total - left
    fits = (left[2] >= s.least_rows) & (right[2] >= s.least_rows) & (left[1] > s.least_h) & (right[1] > s.least_h)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / (left[1] + s.ridge) + right[0] ** 2 / (right[1] + s.ridge) - total[0] ** 2 / (total[1] + s.ridge)
    gain = np.where(fits & usable[:, None], gain, -np.inf)
    top = int(np.argmax(gain))
    return (float(gain.flat[top]), *divmod(top, gain.shape[1]))


def grow_branch(bins: np.ndarray, g: np.ndarray, h: np.ndarray, s: Boosting, usable: np.ndarray, depth: int = 0) -> list[tuple]:
    """The nodes of a branch as (parent, side, depth, gain, feature, cut, g, h, n), the root first.

    Nodes are split best first, up to the leaves that the whole tree may have. The histogram of
    the larger child is that of its parent less that of the smaller.
    """
    n, width = bins.shape
    columns = np.ascontiguousarray(bins.T)
    most = 1 + int(columns.max(initial=0))

    def histogram(rows):
        found = np.empty((3, width, most))
        own_g, own_h = g.take(rows), h.take(rows)
        for f, column in enumerate(columns):
            cell = column.take(rows).astype(np.intp)
            for k, v in enumerate((own_g, own_h, None)):
                found[k, f] = np.bincount(cell, v, most)
        return found

    nodes, heap = [], []

    def add(parent, side, depth, rows, hist):
        deep = s.most_depth is not None and depth >= s.most_depth
        gain, feature, cut = (-np.inf, -1, 0) if deep or len(rows) < 2 * s.least_rows else _best_split(hist, s, usable)
        if not gain > LEAST_GAIN:
            gain, feature, cut = 0.0, -1, 0
        else:
            heapq.heappush(heap, (-gain, len(nodes), rows, hist))
        nodes.append((parent, side, depth, gain, feature, cut, float(g[rows].sum()), float(h[rows].sum()), len(rows)))

    add(-1, 0, depth, np.arange(n), histogram(np.arange(n)))
    leaves = 1
    while heap and (s.most_leaves is None or leaves < s.most_leaves):
        _, at, rows, hist = heapq.heappop(heap)
        goes_left = columns[nodes[at][4]].take(rows) <= nodes[at][5]
        parts = [rows[goes_left], rows[~goes_left]]
        small = int(len(parts[1]) < len(parts[0]))
        own = histogram(parts[small])
        both = [own, hist - own] if small == 0 else [hist - own, own]
        for side in (0, 1):
            add(at, side, nodes[at][2] + 1, parts[side], both[side])
        leaves += 1
    return nodes


def _linked(nodes: list[tuple]) -> Split:
    made = [Split(*node[3:]) for node in nodes]
    for node, split in zip(nodes, made):
        if node[0] >= 0:
            setattr(made[node[0]], ("left", "right")[node[1]], split)
    return made[0]


def best_first(root: Split, s: Boosting) -> Tree:
    """The tree of the best splits under ``root``: largest gain first, children after their
    parent. A leaf's sums are its value and 1."""
    arrays: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "g", "h", "n")}

    def add(node: Split) -> int:
        value = s.step * node.g / (node.h + s.ridge) if node.h + s.ridge > 0 else 0.0
        for k, v in zip(arrays, (-1, 0, -1, -1, value, 1.0, float(node.n))):
            arrays[k].append(v)
        return len(arrays["n"]) - 1

    heap, leaves = [(-root.gain, add(root), root)], 1
    while heap and (s.most_leaves is None or leaves < s.most_leaves):
        _, at, node = heapq.heappop(heap)
        if node.feature < 0 or node.left is None:
            continue
        arrays["feature"][at], arrays["cut"][at] = node.feature, node.cut
        for side, child in (("left", node.left), ("right", node.right)):
            arrays[side][at] = add(child)
            heapq.heappush(heap, (-child.gain, arrays[side][at], child))
        leaves += 1
    return Tree(**{k: np.array(v, np.int64 if k in ("feature", "cut", "left", "right") else float) for k, v in arrays.items()})


def _columns(s: Boosting, model: int, turn: int, width: int) -> np.ndarray:
    """The columns that a tree may use."""
    if s.column_share >= 1:
        return np.ones(width, bool)
    rng = np.random.default_rng([s.seed, model, turn])
    usable = np.zeros(width, bool)
    usable[rng.permutation(width)[: max(1, int(s.column_share * width))]] = True
    return usable


_BLOCK = "model int, hash binary, label binary, margin binary, bins binary"


def _block(m: int, hashes, label, margin, bins) -> pa.RecordBatch:
    """Rows of a model as arrays."""
    arrays = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (hashes, label, margin, bins)]
    return pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), *arrays], [c.split()[0] for c in _BLOCK.split(", ")])


def _in_blocks(rows: DataFrame, base: dict[int, float], width: int) -> DataFrame:
    """The rows (model, hash, label, bins) of each batch and model as a block, with the base margin."""

    def run(batches):
        for batch in batches:
            models = batch.column(0).to_numpy()
            hashes, label = (batch.column(i).to_numpy() for i in (1, 2))
            bins = bytes_matrix(batch.column(3), width)
            for m in np.unique(models).tolist():
                own = models == m
                yield _block(m, hashes[own], label[own], np.full(own.sum(), base[m]), bins[own])

    return rows.select("model", "hash", "label", "bins").mapInArrow(run, _BLOCK)


_NODES = "model int, node int, parent int, side int, depth int, gain double, feature int, cut int, g double, h double, n long"
_LOSS = -1  # the node under which a task hands in the loss of the rows kept back


def boost(rows: DataFrame, n_bins: list[int], s: Boosting, node_rows: int = BRANCH_ROWS) -> dict[int, tuple[float, list[Tree]]]:
    """(base margin, trees) of each model in ``rows`` (columns model, hash, label, bins)."""
    width = len(n_bins)
    found = rows.groupBy("model").agg(F.count("label"), F.avg("label")).collect()
    sizes = {m: n for m, n, _ in found}
    base = {m: float(np.log(p / (1 - p))) if 0 < p < 1 else float(np.sign(p - 0.5) * 20) for m, _, p in found}
    keeps_back = {m for m, n in sizes.items() if s.early_stop and n > _LARGE_SAMPLE}
    state = stage(_in_blocks(rows, base, width), "margins")
    trees: dict[int, list[Tree]] = {m: [] for m in sizes}
    losses: dict[int, list[float]] = {m: [] for m in sizes}
    done, staged = set(), 0
    held_map = draw_maps(s.seed, 1, 2)[0]
    row_maps = draw_maps(s.seed, s.iterations, 3)
    for turn in range(s.iterations + (1 if keeps_back else 0)):
        recent = {m: [(packed_nodes(t.feature, t.cut, t.left), t.g) for t in trees[m][staged:]] for m in sizes}
        settled = frozenset(done)

        def rows_of(batches: Iterator[pa.RecordBatch], recent=recent):
            """(model, hashes, label, margin, bins) with the margin brought up to date."""
            for batch in batches:
                for k in range(batch.num_rows):
                    m = batch.column(0)[k].as_py()
                    hashes, label, margin, bins = (
                        np.frombuffer(batch.column(i + 1)[k].as_buffer(), kind) for i, kind in enumerate((np.int64, float, float, np.uint8))
                    )
                    now, bins = margin.copy(), bins.reshape(-1, width)
                    for nodes, value in recent[m]:
                        now += value.take(leaves_of_bins(nodes, bins))
                    yield m, hashes, label, now, bins

        if turn - staged >= STAGE_ROUNDS:

            def updated(batches, rows_of=rows_of):
                for found in rows_of(batches):
                    yield _block(*found)

            before, state = state, stage(state.mapInArrow(updated, _BLOCK), "margins")
            drop_staged(before)
            staged = turn
            recent = {m: [] for m in sizes}

        row_map = row_maps[min(turn, s.iterations - 1)]

        def draw(batches, rows_of=rows_of, recent=recent, settled=settled, row_map=row_map):
            for m, hashes, label, margin, bins in rows_of(batches, recent):
                if m in settled:
                    continue
                p = 1 / (1 + np.exp(-margin))
                at = np.arange(len(label))
                if m in keeps_back:
                    out = uniform(hashes, held_map) < _HELD_BACK
                    at = at[~out]
                    loss = np.logaddexp(0, margin[out]) - label[out] * margin[out]
                    yield m, _LOSS, loss, np.ones(len(loss)), None, None
                if s.row_share < 1:
                    at = at[uniform(hashes[at], row_map) < s.row_share]
                if len(at):
                    yield m, int(hashes[0]), (label - p)[at], (p * (1 - p))[at], np.zeros(len(at), bool), bins.take(at, axis=0)

        grown = _round(state, draw, n_bins, s, turn, {m: n for m, n in sizes.items() if m not in done}, node_rows)
        for m, (tree, loss) in grown.items():
            if loss is not None:
                losses[m].append(loss)
                past = losses[m]
                if len(past) > _PATIENCE and not any(x < past[-_PATIENCE - 1] - _TOLERANCE for x in past[-_PATIENCE:]):
                    done.add(m)
                    continue
            if turn < s.iterations:
                trees[m].append(tree)
                if tree.feature[0] < 0 and s.row_share >= 1 and s.column_share >= 1:
                    done.add(m)
        if len(done) == len(sizes):
            break
    drop_staged(state)
    return {m: (base[m], trees[m]) for m in sizes}


def _round(state, draw, n_bins, s, turn, sizes, node_rows) -> dict[int, tuple[Tree, float | None]]:
    """One tree of each model, and the loss before it of the rows kept back."""
    width = len(n_bins)
    usable = {m: _columns(s, m, turn, width) for m in sizes}
    tops = {m: {k: np.array([v]) for k, v in (("feature", -1), ("cut", 0), ("left", -1), ("right", -1))} for m in sizes}
    known: dict[tuple[int, int], Split] = {}
    depth_of = {(m, 0): 0 for m in sizes}
    large = [(m, 0) for m, n in sizes.items() if n > node_rows]

    def plain(batches):  # without the loss, whose rows have no bins
        return (x for x in draw(batches) if x[5] is not None)

    growth = Growth(s.least_rows, None, None, None, s.least_h, s.ridge)
    while large:
        shapes = {m: tuple(a.values()) for m, a in tops.items()}
        narrowed = plain if s.column_share >= 1 else _only(plain, usable)
        pending, large = large, []
        for r in split_large(state, narrowed, growth, n_bins, shapes, pending, s.seed):
            m, node = r["tree"], r["node"]
            sums = [r["gl"] + r["gr"], r["hl"] + r["hr"], r["nl"] + r["nr"]]
            known[m, node] = Split(r["gain"], r["feature"], r["cut"], *sums)
            if r["feature"] < 0:
                continue
            arrays = tops[m]
            left = len(arrays["feature"])
            arrays["feature"][node], arrays["cut"][node] = r["feature"], r["cut"]
            arrays["left"][node], arrays["right"][node] = left, left + 1
            for k, v in (("feature", -1), ("cut", 0), ("left", -1), ("right", -1)):
                arrays[k] = np.append(arrays[k], [v, v])
            for child, size in ((left, r["nl"]), (left + 1, r["nr"])):
                depth_of[m, child] = depth_of[m, node] + 1
                if size > node_rows and (s.most_depth is None or depth_of[m, child] < s.most_depth):
                    large.append((m, child))
    shapes = {m: tuple(a.values()) for m, a in tops.items()}

    def with_loss(batches):
        losses: dict[int, np.ndarray] = {}
        for m, first, g, h, kept_back, bins in draw(batches):
            if bins is None:
                losses[m] = losses.get(m, 0) + np.array([g.sum(), h.sum()])
            else:
                yield m, first, g, h, kept_back, bins
        for m, (total, n) in losses.items():
            yield m, _LOSS, np.array([total]), np.array([n]), np.ones(1, bool), np.zeros((1, width), np.uint8)

    def branch(key, table):
        m, node = (k.as_py() for k in key)
        g, h, kept_back, bins = gathered(table, n_bins)
        nodes, loss = [], kept_back
        if (~loss).any():
            own = ~loss
            nodes = grow_branch(bins[own], g[own], h[own], s, usable[m], depth_of[m, node])
        if loss.any():
            nodes.append((_LOSS, 0, 0, 0.0, -1, 0, float(g[loss].sum()), float(h[loss].sum()), 0))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
        names = [c.split()[0] for c in _NODES.split(", ")]
        columns = [pa.array([m] * len(nodes), pa.int32()), pa.array([node] * len(nodes), pa.int32())]
        columns += [pa.array(v, k) for v, k in zip(zip(*nodes), kinds)] if nodes else [pa.array([], k) for k in kinds]
        return pa.Table.from_arrays(columns, names)

    dealt = dealt_rows(state, with_loss, shapes, n_bins)
    cores, keys = state.sparkSession.sparkContext.defaultParallelism, sum(int((a["feature"] < 0).sum()) for a in tops.values())
    tasks = max(min(4 * cores, 2 * keys), -(-sum(sizes.values()) // node_rows))
    loss: dict[int, list[float]] = {}
    branches: dict[tuple[int, int], list[tuple]] = {}
    with freed_shuffles(state.sparkSession):
        found = dealt.repartition(tasks, "tree", "node").groupBy("tree", "node").applyInArrow(branch, _NODES).collect()
    for m, node, *rest in found:
        if rest[0] == _LOSS and rest[4] == -1 and rest[8] == 0:
            total = loss.setdefault(m, [0.0, 0.0])
            total[0], total[1] = total[0] + rest[6], total[1] + rest[7]
        else:
            branches.setdefault((m, node), []).append(tuple(rest))
    out = {}
    for m in sizes:
        roots = {node: _linked(nodes) for (model, node), nodes in branches.items() if model == m}
        arrays = tops[m]
        for node in range(len(arrays["feature"]) - 1, -1, -1):
            if arrays["feature"][node] >= 0:
                whole = known[m, node]
                whole.left, whole.right = roots.get(int(arrays["left"][node])), roots.get(int(arrays["right"][node]))
                if whole.left is None or whole.right is None:
                    whole.left = whole.right = None
                roots[node] = whole
        root = roots.get(0) or Split(0.0, -1, 0, 0.0, 1.0, 0)
        out[m] = (best_first(root, s), loss[m][0] / loss[m][1] if loss.get(m, [0, 0])[1] else None)
    return out


def _only(draw, usable):
    """Columns that a tree may not use have one bin."""

    def narrowed(batches):
        for m, first, g, h, kept_back, bins in draw(batches):
            yield m, first, g, h, kept_back, np.where(usable[m], bins, 0).astype(np.uint8)

    return narrowed


class BoostedModel(Model):
    """Adds ``probability`` from base margin and trees (whose g is the value of a node)."""

    def __init__(self, base: float, trees: list[Tree], edges: list[np.ndarray], features: str = "features"):
        super().__init__()
        self.base, self.trees, self.edges, self.features = base, trees, edges, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        nodes = [(packed_nodes(t.feature, t.cut, t.left), t.g) for t in self.trees]
        shared, base, edges = dataset.sparkSession.sparkContext.broadcast(nodes), self.base, self.edges

        @F.pandas_udf("double")
        def probability(x):
            import pandas as pd

            rows = np.stack(x.to_numpy()).reshape(len(x), len(edges)) if len(x) else np.empty((0, len(edges)))
            bins, margin = bin_values(rows, edges), np.full(len(rows), base)
            for nodes, value in shared.value:
                margin += value.take(leaves_of_bins(nodes, bins))
            return pd.Series(1 / (1 + np.exp(-margin)))

        named = dataset.withColumn("_p", probability(vector_to_array(F.col(self.features))))
        return named.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")


class BoostedClassifier(Estimator):
    def __init__(self, settings: Boosting, *, label: str = "label", features: str = "features", key: str | None = None, node_rows: int = BRANCH_ROWS):
        super().__init__()
        self.settings, self.label, self.features, self.key, self.node_rows = settings, label, features, key, node_rows

    def _fit(self, dataset: DataFrame) -> BoostedModel:
        return self.fit_all([dataset])[0]

    def fit_all(self, datasets: list[DataFrame]) -> list[BoostedModel]:
        """A model of each frame; every round is one job for all of them."""
        edges, parts = [], []
        for m, dataset in enumerate(datasets):
            known = dataset.select(*[c for c in (self.key, self.label, self.features) if c]).where(F.col(self.label).isNotNull())
            if self.key is None:
                known = stage_for_training(known.withColumn("_row", F.monotonically_increasing_id()), "boosting-rows")
            edges.append(feature_edges(known, self.features))
            carried = {
                "model": F.lit(m),
                "hash": hash_number(f"{self.settings.seed}:draw", F.col(self.key or "_row")),
                "label": F.col(self.label).cast("double"),
            }
            parts.append(binned(known, edges[-1], carried, self.features))
        fitted = {}
        for width in {len(e) for e in edges}:  # frames may differ in their categories
            alike = [m for m, e in enumerate(edges) if len(e) == width]
            n_bins = [max(len(edges[m][f]) for m in alike) + 1 for f in range(width)]
            rows = parts[alike[0]]
            for m in alike[1:]:
                rows = rows.unionByName(parts[m])
            fitted |= boost(stage_for_training(rows, "boosting"), n_bins, self.settings, self.node_rows)
        return [BoostedModel(*fitted.get(m, (0.0, [])), edges[m], self.features) for m in range(len(datasets))]
