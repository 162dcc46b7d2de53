import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from stayline.functions.hashing import hash_number
from stayline.models import forests, trees
from stayline.plans import explain
from stayline.session import stage


def brute_split(bins, g, h, least):
    """The best (gain, feature, cut) by trying every cut."""
    best = (0.0, -1, 0)
    for f in range(bins.shape[1]):
        for c in range(int(bins[:, f].max())):
            left = bins[:, f] <= c
            if min(left.sum(), (~left).sum()) < least or h[left].sum() <= 0 or h[~left].sum() <= 0:
                continue
            gain = g[left].sum() ** 2 / h[left].sum() + g[~left].sum() ** 2 / h[~left].sum() - g.sum() ** 2 / h.sum()
            if gain > best[0] + 1e-9:
                best = (gain, f, c)
    return best


def check_tree(tree, bins, g, h, least, node=0, rows=None):
    """Every split is a best one, every leaf has none, and the sums are those of the rows."""
    rows = np.arange(len(bins)) if rows is None else rows
    assert tree.n[node] == len(rows)
    assert tree.g[node] == pytest.approx(g[rows].sum()) and tree.h[node] == pytest.approx(h[rows].sum())
    gain, _, _ = brute_split(bins[rows], g[rows], h[rows], least)
    if tree.feature[node] < 0:
        assert gain <= 1e-6
        return
    left = bins[rows, tree.feature[node]] <= tree.cut[node]
    parts = [rows[left], rows[~left]]
    found = sum(g[p].sum() ** 2 / h[p].sum() for p in parts) - g[rows].sum() ** 2 / h[rows].sum()
    assert found == pytest.approx(gain)
    for child, part in zip((tree.left[node], tree.right[node]), parts):
        check_tree(tree, bins, g, h, least, child, part)


@pytest.mark.parametrize("seed", range(4))
def test_tree_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, [3, 20, 2, 1], (300, 4)).astype(np.uint8)
    h = rng.choice([0.5, 1.0, 2.0], 300)
    g = h * (rng.random(300) < 0.2 + 0.03 * bins[:, 1])
    tree = trees.grow_tree(bins, g, h, rng, least_rows=5)
    assert len(tree.feature) > 9
    check_tree(tree, bins, g, h, 5)
    leaf = tree.leaf_of(bins)
    assert np.array_equal(np.bincount(leaf, minlength=len(tree.n))[tree.feature < 0], tree.n[tree.feature < 0])


def frame(spark, n, seed=1):
    """Rows with a known effect: the treatment lowers the outcome by 0.4 where x1 is high."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    t = (rng.random(n) < 0.5).astype(float)
    y = (rng.random(n) < 0.55 + 0.1 * (x[:, 0] > 0) - 0.4 * t * (x[:, 1] > 0.3)).astype(float)
    data = [(int(i), [float(v) for v in x[i]], float(t[i]), float(y[i])) for i in range(n)]
    rows = spark.createDataFrame(data, "id long, x array<double>, t double, y double")
    return rows.withColumn("features", array_to_vector("x")).withColumn("label", F.col("y"))


def test_bootstrap_and_weights_equal_sql(spark):
    rows = frame(spark, 500).select(hash_number("7:draw", F.col("id")).alias("hash"), F.col("y").alias("g"), F.lit(1.0).alias("h"))
    rows = stage(rows.withColumn("bins", F.unhex(F.lit("00"))), "rows")
    drawing = forests.Drawing(7, 5)
    found = forests.class_sums(rows, drawing, 1)
    weights = forests.class_weights(found)
    con = duckdb.connect()
    con.execute("create table r (hash bigint, y double)")
    con.executemany("insert into r values (?, ?)", [(r["hash"], r["g"]) for r in rows.collect()])
    for tree, (a, b) in enumerate(drawing.maps):
        limits = ", ".join(repr(float(c)) for c in forests._POISSON)
        sql = f"""
          with drawn as (
            select y, list_sum(list_transform([{limits}], lambda c: (u >= c)::int)) as n
            from (select y, ((hash % 2147483647) * {a} + {b}) % 2147483647 / 2147483647::double as u from r))
          select sum(n), sum(n * y), sum(n) / (2 * sum(n * (1 - y))), sum(n) / (2 * sum(n * y)) from drawn"""
        total, ones, w0, w1 = con.execute(sql).fetchone()
        assert tuple(found[tree]) == (total, ones) and tuple(weights[tree]) == pytest.approx((w0, w1))
        native = rows.select(forests.bootstrap_count(F.col("hash"), (a, b)).alias("n")).agg(F.sum("n")).first()[0]
        assert native == total and 350 < total < 650


def grown(spark, rows, **options):
    return forests.ForestClassifier(trees=6, min_leaf=4, seed=3, key="id", **options).fit(rows)


def test_large_nodes_are_split_by_histograms(spark):
    """Trees do not depend on where the upper part ends, if every feature is tried."""
    rows = frame(spark, 800)
    edges = trees.feature_edges(rows)
    hashed = hash_number("3:draw", F.col("id"))
    carried = {"hash": hashed, "g": F.col("label") + hashed / 1e17, "h": F.lit(1.0)}  # no two gains are equal
    staged = stage(trees.binned(rows, edges, carried).repartition(3), "binned")
    n_bins = [len(e) + 1 for e in edges]
    drawing, growth = forests.Drawing(3, 4), forests.Growth(4)
    low = forests.grow_forest(staged, drawing, growth, n_bins, 3)
    high = forests.grow_forest(staged, drawing, growth, n_bins, 3, node_rows=60)
    capped = forests.grow_forest(staged, drawing, forests.Growth(4, None, 2), n_bins, 3, node_rows=60)
    found = staged.collect()
    hashes, every = np.array([r["hash"] for r in found]), np.array([list(r["bins"]) for r in found], np.uint8)
    for tree, (a, b, c) in enumerate(zip(low, high, capped)):
        bins = every[drawing.drawn(tree, hashes)[0]]
        assert len(a.feature) == len(b.feature) and len(c.feature) <= 7
        for name in ("g", "h", "n"):
            assert np.allclose(getattr(a, name)[a.leaf_of(bins)], getattr(b, name)[b.leaf_of(bins)])
            assert getattr(b, name)[0] == pytest.approx(getattr(a, name)[0])


def test_forest_scores_are_means_of_leaves(spark):
    rows = frame(spark, 600)
    model = grown(spark, rows, class_weight="all")
    scored = model.transform(rows).select("x", F.expr("probability").alias("p")).collect()
    x = np.array([r["x"] for r in scored])
    wanted = np.mean([(t.g / t.h)[t.leaf_of(trees.bin_values(x, model.edges))] for t in model.trees], axis=0)
    assert np.allclose([r["p"][1] for r in scored], wanted)
    assert all((t.n[t.feature < 0] >= 4).all() for t in model.trees)


def test_rows_without_a_key_and_one_class(spark):
    rows = frame(spark, 50).withColumn("label", F.lit(1.0))
    model = forests.ForestClassifier(trees=2, min_leaf=3, class_weight="drawn").fit(rows)
    assert {r["probability"][1] for r in model.transform(rows).select("probability").collect()} == {1.0}


def test_honest_leaves_hold_only_rows_kept_back(spark):
    rows = frame(spark, 900).withColumns({"y_residual": F.col("y") - 0.5, "t_residual": F.col("t") - 0.5})
    estimator = forests.EffectForest(trees=5, min_leaf=10, seed=3, key="id")
    model = estimator.fit(rows)
    t, y = F.col("t_residual"), F.col("y_residual")
    carried = {"hash": hash_number("3:draw", F.col("id")), "g": t * y, "h": t * t}
    binned = stage(trees.binned(rows, model.edges, carried), "binned")
    drawing = forests.Drawing(3, 5, 0.45)
    made_of = forests.leaves_of(binned, model, drawing).toPandas()
    con = duckdb.connect()
    con.register("made_of", made_of)
    sums = con.execute("select tree, leaf, sum(g), sum(h), count(*) from made_of where kept_back group by all").fetchall()
    seen = 0
    for tree, leaf, g, h, n in sums:
        found = model.trees[tree]
        assert (found.g[leaf], found.h[leaf], found.n[leaf]) == (pytest.approx(g), pytest.approx(h), n)
        seen += 1
    assert seen > 20
    own = made_of[~made_of.kept_back]
    assert (own.groupby(["tree", "leaf"]).size() >= 10).all()
    share = len(made_of) / (5 * 900)
    assert 0.40 < share < 0.50 and 0.4 < made_of.kept_back.mean() < 0.6


def test_known_effect_is_recovered(spark):
    rows = frame(spark, 6000).withColumns({"y_residual": F.col("y") - 0.5, "t_residual": F.col("t") - 0.5})
    model = forests.EffectForest(trees=60, min_leaf=10, seed=3, key="id").fit(rows)
    found = model.transform(rows).groupBy((F.col("x")[1] > 0.3).alias("high")).agg(F.avg("effect").alias("e")).collect()
    effect = {r["high"]: r["e"] for r in found}
    assert effect[True] == pytest.approx(-0.4, abs=0.06) and effect[False] == pytest.approx(0.0, abs=0.06)


@pytest.mark.parametrize("node_rows", [60, 250_000])
def test_large_forests_score_without_the_driver(spark, monkeypatch, node_rows):
    """A forest that is not broadcast stays a table, and gives the same scores."""
    rows = frame(spark, 700).withColumns({"y_residual": F.col("y") - 0.5, "t_residual": F.col("t") - 0.5})
    classes = forests.ForestClassifier(trees=5, min_leaf=4, seed=3, key="id", node_rows=node_rows)
    effects = forests.EffectForest(trees=5, min_leaf=10, seed=3, key="id", node_rows=node_rows)
    for estimator, value in ((classes, vector_to_array(F.col("probability"))[1]), (effects, F.col("effect"))):
        wanted = {r[0]: r[1] for r in estimator.fit(rows).transform(rows).select("id", value).collect()}
        estimator.broadcast_nodes = 0
        with monkeypatch.context() as patch:
            patch.setattr(forests.Forest, "trees", lambda self: pytest.fail("the forest came to the driver"))
            found = estimator.fit(rows).transform(rows.unionByName(rows.where("id < 9")))
            found = found.select("id", value).collect()
        assert len(found) == 709 and all(r[1] == pytest.approx(wanted[r[0]], abs=1e-12) for r in found)


@pytest.mark.parametrize("node_rows", [60, 250_000])
def test_large_forests_are_explained_without_the_driver(spark, monkeypatch, node_rows):
    rows = frame(spark, 300)
    estimator = forests.ForestClassifier(trees=3, min_leaf=8, seed=3, key="id", node_rows=node_rows)
    few = rows.where("id < 20")

    def explained(model):
        found = explain.tree_contributions(few, "id", ["a", "b", "c"], model).collect()
        return {(r["id"], r["feature"]): (r["value"], r["shap_value"], r["base_value"]) for r in found}

    wanted = explained(estimator.fit(rows))
    estimator.broadcast_nodes = 0
    monkeypatch.setattr(forests.Forest, "trees", lambda self: pytest.fail("the forest came to the driver"))
    found = explained(estimator.fit(rows))
    assert len(found) == 60 and all(found[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)


@pytest.mark.parametrize("rows", [40, 700])
def test_a_tree_does_not_depend_on_the_pieces_its_rows_are_looked_at_in(monkeypatch, rows):
    rng = np.random.default_rng(5)
    bins = rng.integers(0, [3, 200, 2, 1, 2], (3000, 5)).astype(np.uint8)
    h = rng.choice([0.5, 1.0, 2.0], 3000)
    g = h * (rng.random(3000) < 0.2 + 0.003 * bins[:, 1])
    whole = trees.grow_tree(bins, g, h, np.random.default_rng(1), least_rows=2, picks=2)
    monkeypatch.setattr(trees, "_PIECE_ROWS", rows)
    monkeypatch.setattr(trees, "_PIECE_NODES", 7)
    pieces = trees.grow_tree(bins, g, h, np.random.default_rng(1), least_rows=2, picks=2)
    assert len(whole.n) > 500 and all(np.array_equal(getattr(whole, k), getattr(pieces, k)) for k in vars(whole))
    packed = trees.packed_nodes(whole.feature, whole.cut, whole.left)
    assert np.array_equal(trees.leaves_of_bins(packed, bins), whole.leaf_of(bins))
    assert np.array_equal(trees.leaves_of_bins(packed, bins[:5]), whole.leaf_of(bins[:5]))
    leaf = whole.leaf_of(bins)
    assert np.array_equal(trees.node_sums(whole, leaf, np.ones(3000))[0], whole.n)


def test_packed_rows_come_back():
    rng = np.random.default_rng(2)
    n_bins = [2, 256, 1, 2, 9]
    for n in (0, 1, 13):
        bins = rng.integers(0, n_bins, (n, 5)).astype(np.uint8)
        assert np.array_equal(forests.unpack_bins(forests.pack_bins(bins, n_bins), n, n_bins), bins)
    few = rng.choice([0.1, -7.5, 1e300], 4000)
    for x in (few, np.full(9, 0.1), np.arange(300.0), np.arange(200.0), rng.normal(size=50), np.array([np.nan, 1.0]), np.array([])):
        for most in (0, 2**16):
            assert np.array_equal(forests.widened(forests.narrowed(x, most), len(x)), x, equal_nan=True)
    assert len(forests.narrowed(few, 2**16)) < 4100


def test_rows_are_dealt_in_turns_whose_shuffles_are_deleted(spark, monkeypatch):
    """Trees do not depend on the turns, and the rows that were dealt leave no files."""
    rows = stage(frame(spark, 700), "rows")
    wanted = forests.ForestClassifier(trees=40, min_leaf=4, seed=3, key="id", class_weight="drawn").fit(rows)
    monkeypatch.setattr(forests, "DEALT_BYTES", 30_000)
    folders = [Path(str(f)) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]

    def shuffled():
        return {f: f.stat().st_size for folder in folders for f in folder.rglob("shuffle_*.data")}

    before = shuffled()
    found = forests.ForestClassifier(trees=40, min_leaf=4, seed=3, key="id", class_weight="drawn").fit(rows)
    for _ in range(50):
        left = sum(size for f, size in shuffled().items() if f not in before)
        if left < 30_000:
            break
        time.sleep(0.2)
    assert left < 30_000  # drawn rows alone are about 100,000 bytes
    for a, b in zip(wanted.trees, found.trees, strict=True):
        assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in vars(a))


@pytest.mark.parametrize("nodes", [0, 300, 4_000_000])
def test_scores_do_not_depend_on_groups_and_turns(spark, monkeypatch, nodes):
    rows = frame(spark, 700).withColumns({"y_residual": F.col("y") - 0.5, "t_residual": F.col("t") - 0.5})
    classes = forests.ForestClassifier(trees=7, min_leaf=4, seed=3, key="id")
    effects = forests.EffectForest(trees=7, min_leaf=10, seed=3, key="id")
    for estimator, value in ((classes, vector_to_array(F.col("probability"))[1]), (effects, F.col("effect"))):
        wanted = {r[0]: r[1] for r in estimator.fit(rows).transform(rows).select("id", value).collect()}
        estimator.broadcast_nodes = 0
        with monkeypatch.context() as patch:
            for k, v in {"GROUP_NODES": nodes, "GROUP_ROWS": 200, "_BLOCK_ROWS": 64, "SCORED_BYTES": 1}.items():
                patch.setattr(forests, k, v)
            found = estimator.fit(rows).transform(rows).select("id", value).collect()
        assert len(found) == 700 and all(r[1] == pytest.approx(wanted[r[0]], abs=1e-12) for r in found)
