from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from stayline.models import boosted, forests, trees
from stayline.session import shared_folder, stage


def data(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    x[:, 3] = rng.integers(0, 2, n)
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] + x[:, 1] * x[:, 3] - 0.5)))
    return x, (rng.random(n) < p).astype(float)


def frame(spark, x, y):
    rows = spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, label double")
    return rows.withColumn("features", array_to_vector("x"))


def brute_tree(bins, g, h, s):
    """Leaf-wise growth by definition: of all leaves and cuts the one with the largest gain."""

    def score(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + s.ridge)

    def best(rows, depth):
        found = (boosted.LEAST_GAIN, None)
        if s.most_depth is not None and depth >= s.most_depth:
            return found
        for f in range(bins.shape[1]):
            for c in np.unique(bins[rows, f]):
                left, right = rows[bins[rows, f] <= c], rows[bins[rows, f] > c]
                if min(len(left), len(right)) < s.least_rows or min(h[left].sum(), h[right].sum()) <= s.least_h:
                    continue
                gain = score(left) + score(right) - score(rows)
                if gain > found[0] + 1e-9:
                    found = (gain, (left, right))
        return found

    leaves = [(np.arange(len(g)), 0)]
    while s.most_leaves is None or len(leaves) < s.most_leaves:
        options = [(*best(rows, depth), i) for i, (rows, depth) in enumerate(leaves)]
        gain, parts, i = max(options, key=lambda o: o[0])
        if parts is None:
            break
        depth = leaves.pop(i)[1]
        leaves += [(p, depth + 1) for p in parts]
    value = np.zeros(len(g))
    for rows, _ in leaves:
        value[rows] = s.step * g[rows].sum() / (h[rows].sum() + s.ridge)
    return value, len(leaves)


def brute_margins(bins, y, s, rounds):
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    counts = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        value, leaves = brute_tree(bins, y - p, p * (1 - p), s)
        margin = margin + value
        counts.append(leaves)
    return margin, counts


SETTINGS = {
    "leaf-wise": boosted.Boosting(3, 0.3, most_leaves=7, least_rows=10),
    "second order to a depth": boosted.Boosting(3, 0.3, most_depth=3, least_rows=1, least_h=1.0, ridge=1.0),
}


@pytest.mark.parametrize("name", SETTINGS)
@pytest.mark.parametrize("node_rows", [100_000, 90])
def test_margins_by_brute_force(spark, name, node_rows):
    s = SETTINGS[name]
    x, y = data(400)
    model = boosted.BoostedClassifier(s, key="id", node_rows=node_rows).fit(frame(spark, x, y))
    bins = trees.bin_values(x, model.edges)
    margin, leaves = brute_margins(bins, y, s, 3)
    found = model.transform(frame(spark, x, y)).orderBy("id").select("probability").collect()
    assert np.allclose([r["probability"][1] for r in found], 1 / (1 + np.exp(-margin)))
    assert [int((t.feature < 0).sum()) for t in model.trees] == leaves


def test_many_models_in_the_same_rounds(spark, monkeypatch):
    """Models fitted together are those fitted alone, also when margins are staged on the way."""
    monkeypatch.setattr(boosted, "STAGE_ROUNDS", 2)
    s = boosted.Boosting(5, 0.3, most_leaves=5, least_rows=10, row_share=0.8, column_share=0.8)
    frames = [frame(spark, *data(300, seed)) for seed in (1, 2)]
    together = boosted.BoostedClassifier(s, key="id").fit_all(frames)
    second = boosted.BoostedClassifier(s, key="id").fit_all([frames[1], frames[1]])[1]
    for a, b in zip(together[1].trees, second.trees):
        assert np.array_equal(a.feature, b.feature) and np.allclose(a.g, b.g)
    assert len(together[0].trees) == 5


def test_columns_and_rows_are_drawn(spark):
    s = boosted.Boosting(4, 0.3, most_depth=2, row_share=0.5, column_share=0.5, least_rows=1)
    rows = frame(spark, *data(400))
    model = boosted.BoostedClassifier(s, key="id").fit(rows)
    for turn, tree in enumerate(model.trees):
        usable = boosted._columns(s, 0, turn, 4)
        assert usable.sum() == 2 and all(usable[f] for f in tree.feature[tree.feature >= 0])
        assert 140 < tree.n[0] < 260


def test_stops_early_on_noise(spark, monkeypatch):
    monkeypatch.setattr(boosted, "_LARGE_SAMPLE", 100)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, 3)), (rng.random(400) < 0.5).astype(float)
    s = boosted.Boosting(60, 0.5, most_leaves=8, least_rows=5, early_stop=True)
    model = boosted.BoostedClassifier(s, key="id").fit(frame(spark, x, y))
    assert 10 <= len(model.trees) < 40
    assert 340 < model.trees[0].n[0] < 380


def test_one_class_and_no_split(spark):
    x, _ = data(60)
    model = boosted.BoostedClassifier(boosted.Boosting(5, 0.1, most_leaves=4)).fit(frame(spark, x, np.ones(60)))
    scored = model.transform(frame(spark, x, np.ones(60))).select("probability").collect()
    assert all(r["probability"][1] > 0.999 for r in scored)


def test_few_histograms_are_added_up_on_the_driver(spark, monkeypatch):
    """With and without the shuffle the splits of large nodes are the same."""
    x, y = data(400)
    rows, s = frame(spark, x, y), boosted.Boosting(3, 0.3, most_leaves=7, least_rows=10)
    assert forests._DRIVER_CELLS > 0
    few = boosted.BoostedClassifier(s, key="id", node_rows=90).fit(rows)
    monkeypatch.setattr(forests, "_DRIVER_CELLS", 0)
    many = boosted.BoostedClassifier(s, key="id", node_rows=90).fit(rows)
    for a, b in zip(few.trees, many.trees, strict=True):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.allclose(a.g, b.g)


def test_blocks_staged_anew_replace_the_old_ones(spark, monkeypatch):
    """Margins are staged every few rounds; no earlier table stays, and the scores are the margins."""
    monkeypatch.setattr(boosted, "STAGE_ROUNDS", 2)
    s = boosted.Boosting(7, 0.3, most_leaves=5, least_rows=10)
    x, y = data(400)
    before = set(Path(shared_folder(spark)).glob("stayline/margins-*"))
    model = boosted.BoostedClassifier(s, key="id").fit(frame(spark, x, y))
    assert set(Path(shared_folder(spark)).glob("stayline/margins-*")) == before
    margin, _ = brute_margins(trees.bin_values(x, model.edges), y, s, 7)
    found = model.transform(frame(spark, x, y)).orderBy("id").select("probability").collect()
    assert np.allclose([r["probability"][1] for r in found], 1 / (1 + np.exp(-margin)))
