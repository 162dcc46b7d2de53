import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stayline.models import classifiers, prep
from stayline.plans import churn, explain
from stayline.workload import modeling
from stayline.workload.views import load_view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def customers(spark):
    return modeling.model_rows(spark, SF)


@pytest.fixture(scope="module")
def forest(customers):
    return classifiers.build_random_forest_model(
        customers, modeling.FEATURES, trees=5, max_depth=4
    ).fit(customers)


def test_features_tolerate_missing_columns(rows):
    out = churn.add_business_features(rows([(5, "x")], "tenure_in_months int, tech_support string"))
    r = out.first()
    assert r["tenure_band"] == "0-6 months" and r["customer_segment"] == "core_customers"
    assert r["monthly_revenue_at_risk"] is None


def test_fallback_support_column(rows):
    df = rows(
        [(20, 10.0, " MONTH-to-month\t", "YES"), (20, 10.0, "Month-to-Month", None), (20, 99.0, "One year", "no")],
        "tenure_in_months int, monthly_charge double, contract string, tech_support string",
    )
    found = [r["customer_segment"] for r in churn.add_business_features(df, 50.0).collect()]
    assert found == ["core_customers", "unsupported_flexible", "high_value_loyal"]


def test_no_leakage(rows):
    df = rows(
        [("a", 1, "Yes", "r", 9, 3.0, "s"), ("b", 0, "No", None, 1, 4.0, "s")],
        "customer_id string, churn_value int, churn_label string, churn_reason string, "
        "churn_score int, monthly_charge double, customer_segment string",
    )
    usable, features = churn.prepare_churn_xy(df)
    assert features == ["monthly_charge"] and usable.count() == 2
    with pytest.raises(ValueError, match="no column"):
        churn.prepare_churn_xy(df.drop("churn_value"))
    with pytest.raises(ValueError, match="nothing to predict from"):
        churn.prepare_churn_xy(df.drop("monthly_charge"))
    with pytest.raises(ValueError, match="needs rows of 0 and of 1"):
        churn.prepare_churn_xy(df.where("churn_value = 1"))
    with pytest.raises(ValueError, match="NULL in every row"):
        churn.prepare_churn_xy(df.where("churn_value > 1"))


def test_value_at_risk_by_column_existence(rows):
    df = rows([(0.5, "10", "x"), (0.5, "n/a", "x"), (0.5, None, "x")], "churn_probability double, cltv string, monthly_charge string")
    assert [r[0] for r in df.select(churn.value_at_risk(df)).collect()] == [5.0, 0.0, 0.0]
    charge = df.drop("cltv").withColumn("monthly_charge", F.lit(4.0))
    assert charge.select(churn.value_at_risk(charge)).first()[0] == 2.0
    alone = df.select("churn_probability")
    assert alone.select(churn.value_at_risk(alone)).first()[0] == 0.5


def test_pca_comparison(rows):
    board = rows(
        [("logistic_regression", 0.8, 0.5, 0.2), ("logistic_regression_pca", 0.7, 0.6, 0.1)],
        "model string, cv_roc_auc double, cv_pr_auc double, cv_brier_score double",
    )
    found = {r["metric"]: r for r in churn.compare_pca_validation(board).collect()}
    assert [found[m]["pca_improved"] for m in ("cv_roc_auc", "cv_pr_auc", "cv_brier_score")] == [False, True, True]
    assert found["cv_brier_score"]["pca_benefit"] == pytest.approx(0.1)
    with pytest.raises(ValueError, match="both logistic models"):
        churn.compare_pca_validation(board.limit(1))


def test_preparation_matches_numpy(rows):
    df = rows(
        [(1.0, 5.0, "b"), (2.0, 5.0, "a"), (3.0, 5.0, "a"), (10.0, None, "b"), (None, 5.0, None)],
        "x double, c double, k string",
    )
    fitted = prep.Preprocessor(["x", "c", "k"]).fit(df)
    vectors = fitted.transform(df)
    assert prep.feature_names(vectors) == ["x", "c", "k_a", "k_b"]
    matrix = np.array([r[0] for r in vectors.select(vector_to_array("features")).collect()])
    x = np.array([1, 2, 3, 10, 2.5])
    assert np.allclose(matrix[:, 0], (x - x.mean()) / x.std())
    assert np.allclose(matrix[:, 1], 0)
    assert matrix[4, 2:].tolist() == [1, 0]
    unseen = fitted.transform(rows([(1.0, 5.0, "zzz")], "x double, c double, k string"))
    assert unseen.select(vector_to_array("features")).first()[0][2:] == [0, 0]


def test_text_with_quotes_survives(rows):
    df = rows([("it's",), ("it's",), ("b\\s",), (None,)], "`odd name` string")
    fitted = prep.Preprocessor(["odd name"]).fit(df)
    sums = fitted.transform(df).select(vector_to_array("features")).collect()
    assert np.array([r[0] for r in sums]).sum(axis=0).tolist() == [1, 3]


def test_components_by_variance(spark, customers):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 1))
    data = np.hstack([base, base + 0.05 * rng.normal(size=(300, 1)), rng.normal(size=(300, 1))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")
    fitted = prep.build_preprocessor(df, ["a", "b", "c"], use_pca=True).fit(df)
    shares = np.linalg.eigvalsh(np.corrcoef(data.T))[::-1] / 3
    table = prep.variance_table(fitted, df).collect()
    assert np.allclose([r["variance_share"] for r in table], shares)
    assert [r["kept"] for r in table] == [True, True, False]
    assert len(fitted.transform(df).first()["features"]) == 2


def test_logistic_penalty_is_per_row(rows):
    """Optimum of C * weighted log loss + half the squared norm, intercept free."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-x - 1))).astype(int)
    df = rows([(float(a), float(b)) for a, b in zip(x, y)], "x double, label double")
    model = classifiers.build_logistic_model(df, ["x"]).fit(df).stages[-1]
    z = (x - x.mean()) / x.std()
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    b, a = model.coefficients[0], model.intercept
    residual = w * (1 / (1 + np.exp(-(b * z + a))) - y)
    assert abs((residual * z).sum() + b) < 1e-2 and abs(residual.sum()) < 1e-2


def test_models_score_every_row(customers):
    models = classifiers.build_models(
        customers,
        modeling.FEATURES,
        settings={
            "random_forest": {"trees": 3, "max_depth": 3},
            "gradient_boosting": {"iterations": 2, "most_leaves": 4},
            "xgboost": {"iterations": 2, "most_depth": 2},
        },
    )
    assert list(models) == [
        "logistic_regression", "logistic_regression_pca", "random_forest", "gradient_boosting", "xgboost",
    ]
    n = customers.count()
    for pipeline in models.values():
        scored = pipeline.fit(customers).transform(customers).select(churn.churn_probability().alias("p"))
        assert scored.where("p between 0 and 1").count() == n


def test_default_settings():
    forest = classifiers.forest("features", "label", 1, **classifiers.FOREST)
    assert (forest.trees, forest.min_leaf, forest.max_depth) == (350, 6, None)
    sampled = classifiers.boosting(1, **classifiers.SAMPLED_BOOSTING).settings
    assert (sampled.iterations, sampled.most_depth, sampled.row_share, sampled.ridge) == (250, 4, 0.8, 1.0)
    leafwise = classifiers.boosting(1, **classifiers.GRADIENT_BOOSTING).settings
    assert (leafwise.iterations, leafwise.most_leaves, leafwise.most_depth) == (250, 24, None)


def test_whole_churn_analysis(spark):
    frame = churn.add_business_features(load_view(spark, SF, "retention"))
    result = churn.run_churn_analysis(
        frame,
        folds=2,
        settings={
            "random_forest": {"trees": 3, "max_depth": 3},
            "gradient_boosting": {"iterations": 2, "most_leaves": 4},
            "xgboost": {"iterations": 2, "most_depth": 2},
        },
        importance_repeats=1,
    )
    board = result.leaderboard.collect()
    assert len(board) == 5 and board[0]["model"] == result.best_model
    assert board[0]["holdout_pr_auc"] is not None and board[1]["holdout_pr_auc"] is None
    assert result.pca_validation.count() == 3
    n = frame.count()
    assert result.predictions.count() == pytest.approx(n / 4, abs=2)
    values = [r["value_at_risk"] for r in result.predictions.collect()]
    assert values == sorted(values, reverse=True)
    assert {r["feature"] for r in result.importance.collect()} == set(result.features)
    assert "tenure_band" in result.features and "customer_segment" not in result.features


def brute_shapley(tree, x):
    """Path-dependent game by definition: unknown features split by training rows."""
    features = sorted({tree[n]["f"] for n in tree if tree[n]["left"] >= 0})

    def value(node, known):
        n = tree[node]
        if n["left"] < 0:
            return n["value"]
        if n["f"] in known:
            return value(n["left"] if x[n["f"]] <= n["cut"] else n["right"], known)
        parts = [(tree[c]["rows"], value(c, known)) for c in (n["left"], n["right"])]
        return sum(r * v for r, v in parts) / sum(r for r, _ in parts)

    phi = {}
    m = len(features)
    for f in features:
        rest = [g for g in features if g != f]
        phi[f] = sum(
            math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
            * (value(0, {*s, f}) - value(0, set(s)))
            for k in range(m)
            for s in itertools.combinations(rest, k)
        )
    return phi, value(0, set())


def test_tree_values_by_definition(customers, forest):
    model = forest.stages[-1]
    vectors = forest.stages[0].transform(customers).limit(6)
    x = np.array([r[0] for r in vectors.select(vector_to_array("features")).collect()])
    expected, base = np.zeros_like(x), 0.0
    for tree in model.trees:
        cuts = tree.thresholds(model.edges)
        nodes = {
            i: {
                "left": int(tree.left[i]), "right": int(tree.right[i]), "cut": cuts[i], "rows": tree.n[i],
                "f": int(tree.feature[i]), "value": tree.g[i] / tree.h[i],
            }
            for i in range(len(cuts))
        }
        for row in range(len(x)):
            phi, start = brute_shapley(nodes, x[row])
            for f, v in phi.items():
                expected[row, f] += v / len(model.trees)
        base += start / len(model.trees)
    paths = [p for t in model.trees for p in explain.tree_paths(t, model.edges, 1 / len(model.trees))]
    packed, found_base = explain.pack_paths(paths)
    found = explain.tree_shapley(x, packed)
    assert np.allclose(found, expected) and found_base == pytest.approx(base)


def test_boosted_values_add_up_to_the_log_odds(customers):
    model = classifiers.build_gradient_boosting_model(customers, modeling.FEATURES, iterations=4).fit(customers)
    explained = explain.compute_shap_explanation(model, customers, max_rows=40)
    sums = explained.groupBy("customer_id").agg((F.sum("shap_value") + F.first("base_value")).alias("total"))
    p = F.col("p")
    scored = model.transform(customers).select("customer_id", churn.churn_probability().alias("p"))
    joined = sums.join(scored, "customer_id").withColumn("off", F.abs(F.log(p / (1 - p)) - F.col("total")))
    assert joined.count() == 40 and joined.where("off > 1e-9").count() == 0


def test_values_add_up_to_the_score(customers, forest):
    explained = explain.compute_shap_explanation(forest, customers, max_rows=40)
    sums = explained.groupBy("customer_id").agg(
        (F.sum("shap_value") + F.first("base_value")).alias("total")
    )
    scored = forest.transform(customers).select("customer_id", churn.churn_probability().alias("p"))
    joined = sums.join(scored, "customer_id")
    assert joined.count() == 40 and joined.where("abs(total - p) > 1e-9").count() == 0


def test_linear_values_add_up_to_the_margin(customers):
    model = classifiers.build_logistic_model(customers, modeling.FEATURES).fit(customers)
    explained = explain.compute_shap_explanation(model, customers, max_rows=None)
    sums = explained.groupBy("customer_id").agg(
        (F.sum("shap_value") + F.first("base_value")).alias("total")
    )
    p = F.col("p")
    scored = model.transform(customers).select("customer_id", churn.churn_probability().alias("p"))
    off = sums.join(scored, "customer_id").where(F.abs(F.log(p / (1 - p)) - F.col("total")) > 1e-9)
    assert off.count() == 0
    top, profile = explain.explain_top_customer(
        model, customers, churn.score_customers(model, customers)
    )
    assert top.select("customer_id").distinct().collect() == profile.select("customer_id").collect()


def test_shuffling_an_unused_feature_changes_nothing(customers):
    rows = customers.withColumn("unused", F.lit(1.0))
    model = classifiers.build_logistic_model(rows, ["tenure_in_months", "contract", "unused"]).fit(rows)
    found = {
        r["feature"]: r["permutation_importance"]
        for r in explain.permutation_importance(
            model, rows, ["tenure_in_months", "contract", "unused"], repeats=2
        ).collect()
    }
    assert abs(found["unused"]) < 1e-12 and found["contract"] > 0


def test_permutation_importance_by_brute_force(spark, rows):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer, VectorAssembler

    data = [(i, (i * 7) % 13, (i * 5) % 11, int((i * 7) % 13 + (i * 3) % 5 > 8)) for i in range(30)]
    frame = rows(data, "customer_id long, a int, b int, label int")
    rule = PipelineModel(
        [
            SQLTransformer(statement="select *, (a + 0.0625 * b) / 20 as _p from __THIS__"),
            SQLTransformer(statement="select *, 1 - _p as _q from __THIS__"),
            VectorAssembler(inputCols=["_q", "_p"], outputCol="probability"),
        ]
    )

    def precision(scored):
        scored = list(scored)
        taken = tp = total = 0
        for p in sorted({p for p, _ in scored}, reverse=True):
            tied = [y for q, y in scored if q == p]
            taken, tp = taken + len(tied), tp + sum(tied)
            total += sum(tied) * tp / taken
        return total / tp

    def score(a, b):
        return (a + 0.0625 * b) / 20

    def order(repeat):
        return sorted(data, key=lambda r: (hashlib.md5(f"42:shuffle:{repeat}:{r[0]}".encode()).hexdigest()[:13], r[0]))

    drops = {"a": [], "b": []}
    for repeat in range(1, 4):
        giver = order(repeat)
        for name in drops:
            drops[name].append(
                precision(
                    (score(giver[i][1] if name == "a" else a, giver[i][2] if name == "b" else b), y)
                    for i, (_, a, b, y) in enumerate(order(0))
                )
            )
    before = precision((score(a, b), y) for _, a, b, y in data)
    found = explain.permutation_importance(rule, frame, ["a", "b"], label="label", repeats=3)
    got = {r["feature"]: r["permutation_importance"] for r in found.collect()}
    for name in drops:
        assert abs(got[name] - (before - sum(drops[name]) / 3)) < 1e-9


def test_permutation_importance_reads_its_rows_once(spark, customers):
    model = classifiers.build_logistic_model(customers, ["tenure_in_months", "contract"]).fit(customers)
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v

    known = customers.select("customer_id", "label", "tenure_in_months", "contract").localCheckpoint()
    rows = known.withColumn("contract", F.udf(counted, "string")("contract"))
    found = explain.permutation_importance(model, rows, ["tenure_in_months", "contract"], repeats=2)
    assert found.count() == 2 and seen.value == known.count()


def test_statistics_of_stored_columns_need_no_copy(rows, monkeypatch):
    """More columns than are aggregated together, with gaps and infinities."""
    from stayline.functions.numbers import GROUP_COLUMNS
    from stayline.models.prep import numeric_statistics
    from stayline.operators import quantiles

    def refused(df, label):
        raise AssertionError("a copy of stored columns")

    monkeypatch.setattr(quantiles, "stage", refused)
    names = [f"c{i}" for i in range(GROUP_COLUMNS + 2)]
    data = [[1.0 + i, 3.0 + i, 8.0 + i, None, float("inf")] for i in range(len(names))]
    df = rows(list(zip(*data)), ", ".join(f"{c} double" for c in names))
    found = numeric_statistics(df, names, staged=True)
    for i, c in enumerate(names):
        filled = np.array([1.0, 3.0, 8.0, 3.0, 3.0]) + i
        assert found[c] == pytest.approx((3.0 + i, filled.mean(), filled.std()))
