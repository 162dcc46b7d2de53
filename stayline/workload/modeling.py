"""Queries on model preparation, training, evaluation and explanation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.models import classifiers, prep
from stayline.operators import metrics
from stayline.operators.sampling import assign_folds, is_test_row, stratified_split
from stayline.plans import churn, explain
from stayline.session import stage_for_training
from stayline.workload.registry import as_doubles, query, rounded
from stayline.workload.relational import retention, sparse_retention
from stayline.workload.views import load_view, oracle


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_view(spark, sf_dir, "churn_scored")


# Evaluation of scores

CURVE_SQL = """per_score as (
  select p, sum(y) as pos, count(*) - sum(y) as neg from churn_scored group by p),
curve as (
  select p, pos, neg, sum(pos) over (order by p desc) as tp, sum(neg) over (order by p desc) as fp
  from per_score),
totals as (select sum(pos) as pt, sum(neg) as nt from per_score)"""


@query(
    "roc_auc",
    oracle(
        "churn_scored",
        """select round(sum(neg * (tp - pos / cast(2 as double))) / any_value(pt) / any_value(nt), 9)
        as roc_auc from curve, totals""",
        CURVE_SQL,
    ),
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = metrics.ranking_metrics(scored(spark, sf_dir), "y", "p")
    return rounded(result.select("roc_auc"), {"roc_auc": 9})


@query(
    "average_precision",
    oracle(
        "churn_scored",
        """select round(sum(cast(pos as double) / pt * tp / (tp + fp)), 9) as average_precision
        from curve, totals""",
        CURVE_SQL,
    ),
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = metrics.ranking_metrics(scored(spark, sf_dir), "y", "p")
    return rounded(result.select("average_precision"), {"average_precision": 9})


@query(
    "pr_curve",
    oracle(
        "churn_scored",
        """select round(p, 9) as threshold, round(cast(tp as double) / (tp + fp), 9) as precision,
        round(cast(tp as double) / pt, 9) as recall from curve, totals
        union all select null, 1.0, 0.0""",
        CURVE_SQL,
    ),
)
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metrics.precision_recall_points(scored(spark, sf_dir), "y", "p")
    return rounded(points, {"threshold": 9, "precision": 9, "recall": 9})


@query(
    "threshold_metrics",
    oracle(
        "churn_scored",
        """select tp as true_positives, fp as false_positives, fn as false_negatives,
        tn as true_negatives, round(cast(tp as double) / (tp + fp), 9) as precision,
        round(cast(tp as double) / (tp + fn), 9) as recall,
        round(cast(2 * tp as double) / (2 * tp + fp + fn), 9) as f1,
        round(brier, 9) as brier_score from (
          select count(*) filter (where y = 1 and p >= 0.5) as tp,
            count(*) filter (where y = 0 and p >= 0.5) as fp,
            count(*) filter (where y = 1 and p < 0.5) as fn,
            count(*) filter (where y = 0 and p < 0.5) as tn, avg((p - y) * (p - y)) as brier
          from churn_scored)""",
    ),
)
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    hard = metrics.threshold_metrics(rows, "y", "p")
    brier = metrics.ranking_metrics(rows, "y", "p").first()["brier_score"]
    return rounded(
        hard.withColumn("brier_score", F.lit(brier)),
        {"precision": 9, "recall": 9, "f1": 9, "brier_score": 9},
    )


@query(
    "confusion_matrix",
    oracle(
        "churn_scored",
        """select y as actual, cast(p >= 0.5 as int) as predicted, count(*) as rows
        from churn_scored group by all""",
    ),
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(scored(spark, sf_dir), "y", "p")


@query(
    "calibration",
    oracle(
        "churn_scored",
        """select cast(greatest(0, ceil(p * 8) - 1) as int) as bin, count(*) as rows,
        round(avg(y), 6) as observed_rate, round(avg(p), 6) as predicted_rate
        from churn_scored group by 1""",
    ),
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = metrics.calibration_curve(scored(spark, sf_dir), "y", "p")
    return rounded(bins, {"observed_rate": 6, "predicted_rate": 6})


# Splits

SPLIT_SQL = """select customer_id, cast(row_number() over (partition by churn_value
    order by substr(md5('42:' || customer_id), 1, 13), customer_id)
    <= ceil(cast(0.25 as double) * count(*) over (partition by churn_value)) as int) as is_test
    from retention"""
FOLD_SQL = """folded as (
  select *, cast((row_number() over (partition by y
      order by substr(md5('42:fold:' || customer_id), 1, 13), customer_id) - 1) * 5
      // count(*) over (partition by y) as int) as fold from churn_scored)"""


@query("stratified_split", oracle("retention", SPLIT_SQL))
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = retention(spark, sf_dir)
    test = is_test_row(customers, "customer_id", F.col("churn_value"), 0.25, 42)
    return customers.select("customer_id", test.cast("int").alias("is_test"))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_folds(scored(spark, sf_dir), "customer_id", F.col("y"), 5, 42)


@query("fold_assignment", oracle("churn_scored", "select customer_id, fold from folded", FOLD_SQL))
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).select("customer_id", "fold")


# Leaderboard over three scoring rules that stand in for models

BOARD_SQL = (
    FOLD_SQL
    + """,
rules as (
  select 'logistic_regression' as model, fold, y, p from folded
  union all select 'logistic_regression_pca', fold, y,
    (p * 120 + customer_id % 7) / cast(127 as double) from folded
  union all select 'random_forest', fold, y,
    (p * 120 + customer_id % 31 * (1 - y)) / cast(151 as double) from folded),
per_score as (
  select model, fold, p, sum(y) as pos, count(*) - sum(y) as neg,
    sum((p - y) * (p - y)) as squares from rules group by model, fold, p),
curve as (
  select *, sum(pos) over w as tp, sum(neg) over w as fp from per_score
  window w as (partition by model, fold order by p desc)),
per_fold as (
  select model, fold,
    sum(cast(pos as double) * tp / (tp + fp)) / sum(pos) as ap,
    sum(neg * (tp - pos / cast(2 as double))) / sum(pos) / sum(neg) as auc,
    sum(squares) / (sum(pos) + sum(neg)) as brier from curve group by model, fold),
board as (
  select model, avg(auc) as cv_roc_auc, stddev_pop(auc) as cv_roc_auc_std, avg(ap) as cv_pr_auc,
    stddev_pop(ap) as cv_pr_auc_std, avg(brier) as cv_brier_score from per_fold group by model)"""
)
BOARD_COLUMNS = ["cv_roc_auc", "cv_roc_auc_std", "cv_pr_auc", "cv_pr_auc_std", "cv_brier_score"]


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, p, key = F.col("y"), F.col("p"), F.col("customer_id")
    rules = {
        "logistic_regression": p,
        "logistic_regression_pca": (p * 120 + key % 7) / F.lit(127.0),
        "random_forest": (p * 120 + key % 31 * (1 - y)) / F.lit(151.0),
    }
    scores = F.inline(
        F.array(*[F.struct(F.lit(m).alias("model"), s.alias("score")) for m, s in rules.items()])
    )
    long = folded(spark, sf_dir).select("fold", "y", scores)
    return churn.leaderboard_from_folds(
        metrics.ranking_metrics(long, "y", "score", by=["model", "fold"])
    )


@query(
    "leaderboard",
    oracle(
        "churn_scored",
        "select model, " + ", ".join(f"round({c}, 7) as {c}" for c in BOARD_COLUMNS) + " from board",
        BOARD_SQL,
    ),
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(board(spark, sf_dir), {c: 7 for c in BOARD_COLUMNS})


@query(
    "pca_validation",
    oracle(
        "churn_scored",
        """select metric, round(without_pca, 7) as without_pca, round(with_pca, 7) as with_pca,
        round(with_pca - without_pca, 7) as pca_delta,
        round(sign * (with_pca - without_pca), 7) as pca_benefit,
        sign * (with_pca - without_pca) > 0 as pca_improved from pairs""",
        BOARD_SQL
        + """,
pairs as ("""
        + " union all ".join(
            f"""select '{m}' as metric, {sign} as sign,
            max({m}) filter (where model = 'logistic_regression') as without_pca,
            max({m}) filter (where model = 'logistic_regression_pca') as with_pca from board"""
            for m, sign in (("cv_roc_auc", 1), ("cv_pr_auc", 1), ("cv_brier_score", -1))
        )
        + ")",
    ),
)
def pca_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        churn.compare_pca_validation(board(spark, sf_dir)),
        {"without_pca": 7, "with_pca": 7, "pca_delta": 7, "pca_benefit": 7},
    )


@query(
    "unpivot_metrics",
    oracle(
        "churn_scored",
        """select model, 'cv_pr_auc' as metric, round(cv_pr_auc, 7) as score from board
        union all select model, 'cv_roc_auc', round(cv_roc_auc, 7) from board""",
        BOARD_SQL,
    ),
)
def unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(churn.metric_frame(board(spark, sf_dir)), {"score": 7})


# Preparation

NUMERIC = ["tenure_in_months", "monthly_charge", "cltv"]
CATEGORICAL = ["contract", "premium_tech_support", "payment_method", "internet_type"]
FEATURES = NUMERIC + CATEGORICAL


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sparse_retention(spark, sf_dir)
    return rows.withColumn("label", F.col("churn_value").cast("double"))


SPARSE_SQL = "case when customer_id % 11 = 4 then null else tenure_in_months end"


@query(
    "impute_median",
    oracle(
        "retention",
        f"""select customer_id, coalesce(tenure, (select quantile_cont(tenure, 0.5) from sparse))
        as tenure_in_months from sparse""",
        f"sparse as (select customer_id, cast({SPARSE_SQL} as double) as tenure from retention)",
    ),
)
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sparse_retention(spark, sf_dir)
    statistics = prep.numeric_statistics(rows, ["tenure_in_months"])
    filled = prep.fill_and_scale(statistics, {}, scale=False).transform(rows)
    return filled.select("customer_id", F.col("_num_tenure_in_months").alias("tenure_in_months"))


@query(
    "standardize",
    oracle(
        "retention",
        """select customer_id, round((tenure - avg(tenure) over ()) / stddev_pop(tenure) over (), 6)
          as tenure_z, round((charge - avg(charge) over ()) / stddev_pop(charge) over (), 6) as charge_z
        from (select customer_id, cast(tenure_in_months as double) as tenure,
                cast(monthly_charge as double) as charge from retention)""",
    ),
)
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retention(spark, sf_dir)
    statistics = prep.numeric_statistics(rows, ["tenure_in_months", "monthly_charge"])
    scaled = prep.fill_and_scale(statistics, {}, scale=True).transform(rows)
    return scaled.select(
        "customer_id",
        F.round("_num_tenure_in_months", 6).alias("tenure_z"),
        F.round("_num_monthly_charge", 6).alias("charge_z"),
    )


@query(
    "impute_mode",
    oracle(
        "retention",
        """select customer_id, coalesce(internet_type, (select internet_type from retention
          where internet_type is not null group by internet_type
          order by count(*) desc, internet_type limit 1)) as internet_type from retention""",
    ),
)
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retention(spark, sf_dir)
    filled = prep.fill_and_scale({}, prep.modes(rows, ["internet_type"]), scale=False).transform(rows)
    return filled.select("customer_id", F.col("_cat_internet_type").alias("internet_type"))


@query(
    "onehot_counts",
    oracle(
        "retention",
        " union all ".join(
            f"""select '{c}_' || coalesce({c}, mode_value) as feature, cast(count(*) as double) as rows
            from retention, (select {c} as mode_value from retention where {c} is not null
              group by {c} order by count(*) desc, {c} limit 1)
            group by 1"""
            for c in ("contract", "payment_method", "internet_type")
        ),
    ),
)
def onehot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retention(spark, sf_dir)
    features = ["contract", "payment_method", "internet_type"]
    fitted = prep.Preprocessor(features).fit(rows)
    vectors = fitted.transform(rows)
    names = prep.feature_names(vectors)
    totals = vectors.agg(Summarizer.sum(F.col("features")).alias("sums"))
    return totals.select(F.posexplode(churn.vector_to_array("sums")).alias("i", "rows")).select(
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("feature"), "rows"
    )


FILLED_SQL = f"""sparse as (
  select customer_id, cast({SPARSE_SQL} as double) as tenure,
    cast(monthly_charge as double) as charge, cast(cltv as double) as value,
    contract, premium_tech_support, payment_method, internet_type from retention),
filled as (
  select * replace (coalesce(tenure, (select quantile_cont(tenure, 0.5) from sparse)) as tenure,
    coalesce(premium_tech_support, (select premium_tech_support from sparse
      where premium_tech_support is not null group by all
      order by count(*) desc, 1 limit 1)) as premium_tech_support,
    coalesce(internet_type, (select internet_type from sparse where internet_type is not null
      group by all order by count(*) desc, 1 limit 1)) as internet_type) from sparse)"""


@query(
    "prep_pipeline",
    oracle(
        "retention",
        " union all ".join(
            [
                f"""select customer_id, '{name}' as feature, round(({c} - avg({c}) over ())
                  / stddev_pop({c}) over (), 6) as value from filled"""
                for name, c in zip(NUMERIC, ("tenure", "charge", "value"))
            ]
            + [
                f"""select customer_id, '{c}_' || known as feature,
                  cast({c} = known as int)::double as value
                  from filled, (select distinct {c} as known from filled)"""
                for c in CATEGORICAL
            ]
        ),
        FILLED_SQL,
    ),
)
def prep_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of every prepared vector."""
    rows = model_rows(spark, sf_dir)
    vectors = prep.build_preprocessor(rows, FEATURES).fit(rows).transform(rows)
    names = F.array(*[F.lit(n) for n in prep.feature_names(vectors)])
    elements = F.posexplode(churn.vector_to_array("features")).alias("i", "value")
    return vectors.select("customer_id", elements).select(
        "customer_id",
        F.element_at(names, F.col("i") + 1).alias("feature"),
        F.round("value", 6).alias("value"),
    )


# Eigenvalues of a 3 x 3 correlation matrix in closed form.
EIGEN_SQL = (
    FILLED_SQL
    + """,
correlations as (
  select corr(tenure, charge) as a, corr(tenure, value) as b, corr(charge, value) as c from filled),
scaled as (select *, sqrt((a * a + b * b + c * c) / 3) as p from correlations),
angles as (select p, acos(a * b * c / (p * p * p)) / 3 as phi from scaled),
roots as (
  select (1 + 2 * p * cos(phi)) / 3 as first, (1 + 2 * p * cos(phi + 2 * pi() / 3)) / 3 as third
  from angles),
shares as (
  select 1 as component, first as share, first as upto from roots
  union all select 2, 1 - first - third, 1 - third from roots
  union all select 3, third, 1.0 from roots)"""
)


@query(
    "pca_variance",
    oracle(
        "retention",
        """select component, round(share, 7) as variance_share, round(upto, 7) as cumulative_share,
        upto - share <= 0.95 as kept from shares""",
        EIGEN_SQL,
    ),
)
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    fitted = prep.build_preprocessor(rows, FEATURES, use_pca=True).fit(rows)
    return rounded(
        prep.variance_table(fitted, rows), {"variance_share": 7, "cumulative_share": 7}
    )


# Models


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    train, test = stratified_split(rows, "customer_id", F.col("label"), 0.25, 42)
    return stage_for_training(train, "train"), test


def _holdout_scores(spark: SparkSession, sf_dir: str, build, **settings) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    train, test = split(rows)
    model = build(rows, FEATURES, 42, **settings).fit(train)
    return as_doubles(churn.score_customers(model, test), "monthly_charge", "cltv")


def _register_model(name: str, build, **settings) -> None:
    @query(name)
    def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _holdout_scores(spark, sf_dir, build, **settings)


_register_model("model_logistic", classifiers.build_logistic_model)
_register_model("model_logistic_pca", classifiers.build_logistic_pca_model)
_register_model("model_random_forest", classifiers.build_random_forest_model)
_register_model("model_gbt", classifiers.build_gradient_boosting_model)
_register_model("model_gbt_sampled", classifiers.build_xgboost_model)
_register_model("model_gbt_small", classifiers.build_lightgbm_model)


@query(
    "logistic_optimality",
    oracle(
        "retention",
        """select model, sum(1 - is_test) as training_rows, cast(sum(churn_value * (1 - is_test)) as bigint) as churned_rows,
          0.0::double as largest_gradient
        from split join retention using (customer_id),
          (select unnest(['logistic_regression', 'logistic_regression_pca']) as model) group by model""",
        f"split as ({SPLIT_SQL})",
    ),
)
def logistic_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both logistic models are where the penalised loss has no slope."""
    rows = model_rows(spark, sf_dir)
    train, _ = split(rows)
    builders = {
        "logistic_regression": classifiers.build_logistic_model,
        "logistic_regression_pca": classifiers.build_logistic_pca_model,
    }
    found = None
    for name, build in builders.items():
        slopes = churn.penalised_gradient(build(rows, FEATURES, 42).fit(train), train)
        largest = slopes.agg(F.round(F.max(F.abs("gradient")), 4).alias("largest_gradient"))
        counted = train.agg(F.count("label").alias("training_rows"), F.sum("churn_value").cast("long").alias("churned_rows"))
        row = counted.crossJoin(largest).select(F.lit(name).alias("model"), "*")  # one row each
        found = row if found is None else found.unionByName(row)
    return found


@query("churn_scores")
def churn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison of five models at their defaults."""
    analysis = churn.run_churn_analysis(churn.add_business_features(sparse_retention(spark, sf_dir)))
    return as_doubles(analysis.predictions, "monthly_charge", "cltv")


# Explanation


def _logistic(spark: SparkSession, sf_dir: str):
    rows = model_rows(spark, sf_dir)
    train, test = split(rows)
    return classifiers.build_logistic_model(rows, FEATURES).fit(train), test


RULE_SQL = """cast(300 + case when contract = 'Month-to-Month' then 220 else 0 end
    + case when tenure_in_months <= 12 then 250 else 0 end
    - case when premium_tech_support = 'Yes' then 50 else 0 end - 3 * tenure_in_months as double)
    / cast(1200 as double)"""
RULE_FEATURES = ["tenure_in_months", "contract", "premium_tech_support"]
SHUFFLE_SQL = f"""rounds as (
  select i as repeat, r.*, row_number() over (partition by i
    order by substr(md5('42:shuffle:' || i || ':' || customer_id), 1, 13), customer_id) as place
  from retention r, range(9) g(i)),
pairs as (
  select o.repeat, own.churn_value as y,
    {", ".join(f"own.{c} as {c}, o.{c} as other_{c}" for c in RULE_FEATURES)}
  from rounds own join rounds o on own.place = o.place and own.repeat = 0 and o.repeat > 0),
swapped as ("""
SHUFFLE_SQL += " union all ".join(
    f"""select '{f}' as feature, repeat, y, """
    + ", ".join(f"other_{c} as {c}" if c == f else c for c in RULE_FEATURES)
    + " from pairs"
    for f in RULE_FEATURES
)
SHUFFLE_SQL += f"""
  union all select 'none', 0, churn_value, {", ".join(RULE_FEATURES)} from retention),
per_score as (
  select feature, repeat, {RULE_SQL} as p, sum(y) as pos, count(*) as n from swapped group by all),
curve as (
  select *, sum(pos) over w as tp, sum(n) over w as taken from per_score
  window w as (partition by feature, repeat order by p desc)),
precisions as (
  select feature, repeat, sum(cast(pos as double) * tp / taken) / sum(pos) as ap
  from curve group by feature, repeat)"""


@query(
    "permutation_importance",
    oracle(
        "retention",
        """select feature, round((select ap from precisions where feature = 'none') - avg(ap), 7)
          as permutation_importance from precisions where feature <> 'none' group by feature""",
        SHUFFLE_SQL,
    ),
)
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written-down scoring rule in the place of the fitted model."""
    rule = PipelineModel(
        [
            SQLTransformer(statement=f"select *, {RULE_SQL} as _p from __THIS__"),
            SQLTransformer(statement="select *, 1 - _p as _q from __THIS__"),
            VectorAssembler(inputCols=["_q", "_p"], outputCol="probability"),
        ]
    )
    found = explain.permutation_importance(
        rule, retention(spark, sf_dir), RULE_FEATURES, label="churn_value"
    )
    return rounded(found, {"permutation_importance": 7})


@query("permutation_importance_logistic")
def permutation_importance_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _logistic(spark, sf_dir)
    return explain.permutation_importance(model, test, FEATURES)


@query("shap_local")
def shap_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _logistic(spark, sf_dir)
    return explain.compute_shap_explanation(model, test, max_rows=None)


@query("shap_trees")
def shap_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    train, test = split(rows)
    model = classifiers.build_random_forest_model(rows, FEATURES, 42).fit(train)
    return explain.shap_importance(model, test, max_rows=None)


WEIGHTS = {"tenure_in_months": -0.04, "monthly_charge": 0.015, "cltv": -0.0002}


@query(
    "linear_shap_global",
    oracle(
        "retention",
        " union all ".join(
            f"""select '{c}' as feature, round(avg(abs(cast({w} as double) * (x - m))), 6)
              as mean_abs_shap
            from (select cast({c} as double) as x, avg(cast({c} as double)) over () as m
                  from retention)"""
            for c, w in WEIGHTS.items()
        ),
    ),
)
def linear_shap_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_doubles(retention(spark, sf_dir), *WEIGHTS)
    vectors = VectorAssembler(inputCols=list(WEIGHTS), outputCol="features").transform(rows)
    means = explain.feature_means(vectors)
    values = explain.linear_contributions(
        vectors, "customer_id", list(WEIGHTS), list(WEIGHTS.values()), means, 0.0
    )
    return rounded(explain.global_importance(values), {"mean_abs_shap": 6})


@query("top_customer_explanation")
def top_customer_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _logistic(spark, sf_dir)
    predictions = churn.score_customers(model, test)
    return explain.explain_top_customer(model, test, predictions)[0]
