"""The churn classifiers and the campaign forest as Spark ML pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.models.boosted import BoostedClassifier, Boosting
from stayline.models.forests import ForestClassifier
from stayline.models.prep import Preprocessor, build_preprocessor

LABEL = "label"
WEIGHT = "_weight"

# The default settings of each model.
LOGISTIC = {"max_iter": 1500, "c": 1.0}
FOREST = {"trees": 350, "min_leaf": 6}
GRADIENT_BOOSTING = {
    "iterations": 250, "step": 0.06, "most_leaves": 24, "least_rows": 20, "early_stop": True,
}
SAMPLED_BOOSTING = {
    "iterations": 250, "step": 0.05, "most_depth": 4, "least_rows": 1, "least_h": 1.0, "ridge": 1.0,
    "row_share": 0.8, "column_share": 0.8,
}
SMALL_BOOSTING = {
    "iterations": 250, "step": 0.05, "most_leaves": 31, "least_rows": 20, "least_h": 0.001,
}
CAMPAIGN_FOREST = {"trees": 350, "min_leaf": 20}


class BalancedClassifier(Estimator):
    """Weights each class by rows / (2 * rows of the class), then fits ``inner``.

    ``per_row_ridge`` sets the ridge penalty of a logistic model to 1 / (C * rows):
    Spark averages the loss over the weights, which here sum to the rows.
    """

    def __init__(self, inner: Estimator, label: str = LABEL, per_row_ridge: float | None = None):
        super().__init__()
        self.inner, self.label, self.per_row_ridge = inner, label, per_row_ridge

    def _fit(self, dataset: DataFrame):
        y = F.col(self.label)
        rows, positives = dataset.agg(F.count(y), F.count_if(y == 1)).first()
        if positives in (0, rows):
            raise ValueError("Both outcome classes must be present")
        weight = F.when(y == 1, F.lit(rows / (2.0 * positives))).otherwise(
            F.lit(rows / (2.0 * (rows - positives)))
        )
        extra = {self.inner.weightCol: WEIGHT}
        if self.per_row_ridge is not None:
            extra[self.inner.regParam] = 1.0 / (self.per_row_ridge * rows)
        return self.inner.fit(dataset.withColumn(WEIGHT, weight), extra)


def logistic(*, max_iter: int = 1500, c: float = 1.0) -> Estimator:
    model = LogisticRegression(
        labelCol=LABEL, maxIter=max_iter, standardization=False, elasticNetParam=0.0
    )
    return BalancedClassifier(model, per_row_ridge=c)


def forest(
    features: str,
    label: str,
    seed: int,
    *,
    trees: int,
    min_leaf: int,
    max_depth: int | None = None,
    class_weight: str | None = None,
    key: str | None = None,
) -> ForestClassifier:
    return ForestClassifier(
        trees=trees, min_leaf=min_leaf, max_depth=max_depth, class_weight=class_weight,
        seed=seed, label=label, features=features, key=key,
    )


def boosting(seed: int, **settings) -> BoostedClassifier:
    return BoostedClassifier(Boosting(seed=seed, **settings), label=LABEL)


def _pipeline(prep: Preprocessor, model: Estimator) -> Pipeline:
    return Pipeline(stages=[prep, model])


def build_logistic_model(df: DataFrame, features: Sequence[str], seed: int = 42, **settings) -> Pipeline:
    return _pipeline(build_preprocessor(df, features), logistic(**{**LOGISTIC, **settings}))


def build_logistic_pca_model(
    df: DataFrame, features: Sequence[str], seed: int = 42, pca_variance: float = 0.95, **settings
) -> Pipeline:
    prep = build_preprocessor(df, features, use_pca=True, pca_variance=pca_variance)
    return _pipeline(prep, logistic(**{**LOGISTIC, **settings}))


def build_random_forest_model(
    df: DataFrame, features: Sequence[str], seed: int = 42, **settings
) -> Pipeline:
    model = forest("features", LABEL, seed, class_weight="all", **{**FOREST, **settings})
    return _pipeline(build_preprocessor(df, features), model)


def build_gradient_boosting_model(
    df: DataFrame, features: Sequence[str], seed: int = 42, **settings
) -> Pipeline:
    model = boosting(seed, **{**GRADIENT_BOOSTING, **settings})
    return _pipeline(build_preprocessor(df, features), model)


def build_xgboost_model(
    df: DataFrame, features: Sequence[str], seed: int = 42, **settings
) -> Pipeline:
    """Second-order boosted trees to a depth, with rows and columns drawn for each tree."""
    model = boosting(seed, **{**SAMPLED_BOOSTING, **settings})
    return _pipeline(build_preprocessor(df, features), model)


def build_lightgbm_model(
    df: DataFrame, features: Sequence[str], seed: int = 42, **settings
) -> Pipeline:
    """Boosted trees of 31 leaves, best leaf first; not part of ``build_models``."""
    model = boosting(seed, **{**SMALL_BOOSTING, **settings})
    return _pipeline(build_preprocessor(df, features), model)


def build_models(
    df: DataFrame,
    features: Sequence[str],
    seed: int = 42,
    pca_variance: float = 0.95,
    *,
    settings: dict[str, dict] | None = None,
) -> dict[str, Pipeline]:
    """The five compared models; ``settings[name]`` overrides a model's defaults."""
    s = settings or {}
    return {
        "logistic_regression": build_logistic_model(
            df, features, seed, **s.get("logistic_regression", {})
        ),
        "logistic_regression_pca": build_logistic_pca_model(
            df, features, seed, pca_variance, **s.get("logistic_regression_pca", {})
        ),
        "random_forest": build_random_forest_model(
            df, features, seed, **s.get("random_forest", {})
        ),
        "gradient_boosting": build_gradient_boosting_model(
            df, features, seed, **s.get("gradient_boosting", {})
        ),
        "xgboost": build_xgboost_model(df, features, seed, **s.get("xgboost", {})),
    }


def campaign_pipeline(
    df: DataFrame, features: Sequence[str], seed: int, *, label: str = LABEL, **settings
) -> Pipeline:
    """Median and mode fill, one-hot, and a forest whose trees balance the classes of their
    own bootstrap (no scaling)."""
    prep = Preprocessor(list(features), scale=False)
    model = forest("features", label, seed, class_weight="drawn", **{**CAMPAIGN_FOREST, **settings})
    return _pipeline(prep, model)
