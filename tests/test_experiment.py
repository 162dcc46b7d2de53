import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.plans import experiment, policy, uplift
from stayline.workload.views import load_view

SF = "/root/testdata/sf0.001"


def arms(rows, control, treated):
    """Rows for (churned, customers) per arm."""
    data = [(0, int(i < control[0])) for i in range(control[1])]
    data += [(1, int(i < treated[0])) for i in range(treated[1])]
    return rows(data, "t int, y int")


def test_validation(rows):
    with pytest.raises(ValueError, match="lacks the columns"):
        experiment.validate_experiment(rows([(1,)], "t int"))
    with pytest.raises(ValueError, match="t needs rows"):
        experiment.estimate_ab_effect(rows([(1, 0), (1, 1)], "t int, y int"))
    with pytest.raises(ValueError, match="y needs rows"):
        experiment.validate_experiment(rows([(1, 0), (0, 2)], "t int, y int"))


def test_effect_arithmetic(rows):
    r = experiment.estimate_ab_effect(arms(rows, (320, 1000), (260, 1000))).first()
    error = math.sqrt(0.32 * 0.68 / 1000 + 0.26 * 0.74 / 1000)
    null_error = math.sqrt(0.29 * 0.71 * 2 / 1000)
    assert r["absolute_churn_reduction"] == pytest.approx(0.06)
    assert r["relative_churn_reduction"] == pytest.approx(0.06 / 0.32)
    assert r["ci_95_low"] == pytest.approx(0.06 - 1.96 * error)
    assert r["ci_95_high"] == pytest.approx(0.06 + 1.96 * error)
    assert r["z_statistic"] == pytest.approx(0.06 / null_error)
    assert r["p_value_two_sided"] == pytest.approx(math.erfc(0.06 / null_error / math.sqrt(2)))
    assert r["number_needed_to_treat"] == pytest.approx(1 / 0.06)


def test_no_effect(rows):
    r = experiment.estimate_ab_effect(arms(rows, (5, 10), (10, 20))).first()
    assert (r["absolute_churn_reduction"], r["z_statistic"], r["p_value_two_sided"]) == (0, 0, 1)
    assert r["number_needed_to_treat"] is None


def test_segment_without_an_arm_is_undefined(rows):
    df = rows([("a", 0, 1), ("a", 1, 0), ("b", 0, 1), ("b", 0, 0)], "s string, t int, y int")
    found = {r["s"]: r for r in experiment.estimate_ab_effect(df, by=["s"]).collect()}
    assert found["b"]["treated_churn_rate"] is None and found["b"]["z_statistic"] is None


def test_beta_posterior(rows):
    assert experiment.beta_posterior(3, 7) == (4.0, 8.0)
    with pytest.raises(ValueError, match="below zero"):
        experiment.beta_posterior(-1, 2)
    df = rows([(3, 7)], "s int, f int")
    a, b = experiment.beta_posterior(F.col("s"), F.col("f"))
    assert tuple(df.select(a, b).first()) == (4.0, 8.0)
    with pytest.raises(Exception, match="below zero"):
        df.select(*experiment.beta_posterior(F.col("s") - 9, F.col("f"))).collect()


def test_posterior_from_summary_counts(spark):
    result = experiment.bayesian_from_counts(spark, (320, 1000), (260, 1000), draws=30_000, seed=1)
    r = result.summary.first()
    assert r["probability_treatment_better"] > 0.9
    assert r["expected_churn_reduction"] == pytest.approx(321 / 1002 - 261 / 1002, abs=1e-3)
    assert r["credible_interval_95_low"] < 0.06 < r["credible_interval_95_high"]
    assert result.churn_reduction_samples.count() == 30_000


def test_draws_do_not_depend_on_layout(spark):
    first = experiment.posterior_draws(spark, (3, 5), (2, 6), draws=25_000, seed=9)
    many = sorted(r["reduction"] for r in first.repartition(7).collect())
    assert many == sorted(r["reduction"] for r in first.collect())
    blocks = [np.random.default_rng([9, b]).beta(3, 5, 10_000) for b in (0, 1)]
    rates = {r["control_rate"] for r in first.collect()}
    assert set(np.concatenate(blocks)) <= rates


def test_histogram_is_a_density(rows):
    df = rows([(float(i),) for i in range(100)], "x double")
    bars = experiment.density_histogram(df, "x", bins=8).collect()
    assert sum(r["draws"] for r in bars) == 100
    assert sum(r["density"] for r in bars) * 99 / 8 == pytest.approx(1)
    same = experiment.density_histogram(rows([(2.0,), (2.0,)], "x double"), "x").collect()
    assert {r["bin"]: r["draws"] for r in same} == {b: 2 * (b == 0) for b in range(80)}
    gap = experiment.density_histogram(rows([(0.0,), (8.0,), (float("nan"),)], "x double"), "x", bins=8)
    assert sorted((r["bin"], r["draws"]) for r in gap.collect()) == [(0, 1), *((b, 0) for b in range(1, 7)), (7, 1)]
    assert experiment.density_histogram(rows([], "x double"), "x").count() == 0


@pytest.mark.parametrize("n, sizes", [(12, [2, 1, 1, 1, 1, 1, 1, 1, 1, 2]), (3, [1, 1, 1]), (1, [1])])
def test_rank_cut_sizes(rows, n, sizes):
    df = rows([(i, i % 2, 0, -float(i)) for i in range(n)], "campaign_row_id int, t int, y int, predicted_uplift double")
    found = uplift.uplift_by_decile(df).collect()
    assert [r["customers"] for r in found] == sizes
    assert [r["uplift_decile"] for r in found] == list(range(1, len(sizes) + 1))


def test_deciles_with_equal_scores(rows):
    df = rows([(i, i % 2, 0, 0.5) for i in range(40)], "campaign_row_id int, t int, y int, predicted_uplift double")
    assert [r["customers"] for r in uplift.uplift_by_decile(df).collect()] == [4] * 10


def test_qini_needs_both_arms(rows):
    df = rows([(1, 1, 0, 0.1)], "campaign_row_id int, t int, y int, predicted_uplift double")
    with pytest.raises(ValueError, match="both arms"):
        uplift.qini_like_curve(df)


def test_qini_curve_and_area(spark):
    scored = load_view(spark, SF, "campaign_scored")
    data = scored.toPandas().sort_values(
        ["predicted_uplift", "campaign_row_id"], ascending=[False, True]
    )
    share = data.t.mean()
    gain = (data.y * (1 - data.t) / (1 - share) - data.y * data.t / share).cumsum().to_numpy()
    fraction = np.arange(1, len(data) + 1) / len(data)
    qini = gain - gain[-1] * fraction
    curve = uplift.qini_like_curve(scored)
    found = curve.orderBy("target_fraction").toPandas()
    assert np.allclose(found.cumulative_incremental_gain, gain)
    assert np.allclose(found.qini_gain, qini)
    assert uplift.qini_auc(curve) == pytest.approx(np.trapezoid(qini, fraction))
    thin = uplift.qini_like_curve(scored, points=50).collect()
    assert len(thin) == 50 and max(r["target_fraction"] for r in thin) == 1.0


def test_expected_value():
    assert policy.expected_customer_value(0.1, 40.0, 12.0, 30.0) == pytest.approx(18.0)


def test_per_customer_margin_and_cost(rows):
    df = rows([(1, 0.1, 40.0, 30.0), (2, 0.01, 40.0, 30.0)], "id int, predicted_uplift double, m double, c double")
    found = policy.target_profitable_customers(
        df, monthly_margin=F.col("m"), expected_remaining_months=12, campaign_cost=F.col("c")
    ).collect()
    assert [(r["id"], r["target"]) for r in found] == [(1, True), (2, False)]
    assert found[0]["expected_net_value"] == pytest.approx(18.0)


def test_threshold_search(rows):
    df = rows([(0.01,), (0.05,), (0.20,)], "predicted_uplift double")
    best = policy.optimize_threshold(df, 500.0, 30.0).first()
    assert best["customers_targeted"] >= 1 and best["expected_total_profit"] == pytest.approx(70.0)
    given = policy.optimize_threshold(df, 500.0, 30.0, thresholds=[0.05, 0.5, 0.0]).collect()
    assert {r["uplift_threshold"]: r["customers_targeted"] for r in given} == {0.0: 3, 0.05: 2, 0.5: 0}


def test_policy_with_one_arm_has_no_gain(rows):
    df = rows(
        [(i, int(i >= 2), 1, -float(i), 0.1) for i in range(20)],
        "campaign_row_id int, t int, y int, predicted_uplift double, p_churn_control double",
    )
    found = {
        (r["policy"], r["target_fraction"]): r for r in policy.compare_policies(df).collect()
    }
    assert len(found) == 15
    assert found["uplift", 0.1]["estimated_churns_prevented"] is None
    assert found["uplift", 0.1]["customers_targeted"] == 2
    assert found["random", 1.0]["estimated_churns_prevented"] == pytest.approx(
        found["uplift", 1.0]["estimated_churns_prevented"]
    )


def test_profit_from_draws(rows):
    df = rows([(0.1,), (0.2,), (-0.1,), (0.0,)], "reduction double")
    r = policy.posterior_campaign_profit(df, 100, 40.0, 12.0, 10.0).first()
    profits = np.array([0.1, 0.2, -0.1, 0.0]) * 48000 - 1000
    assert r["expected_profit"] == pytest.approx(profits.mean())
    assert r["profit_ci_95_low"] == pytest.approx(np.quantile(profits, 0.025))
    assert r["probability_profitable"] == 0.5


def test_learner_finds_the_persuadable(spark):
    campaign = load_view(spark, "/root/testdata/sf0.01", "campaign")
    scored = uplift.fit_t_learner(campaign, ordered=False, trees=20, max_depth=5)
    difference = F.col("p_churn_control") - F.col("p_churn_treated") - F.col("predicted_uplift")
    assert scored.where(F.abs(difference) > 1e-12).count() == 0
    assert scored.where("p_churn_control not between 0 and 1").count() == 0
    kinds = scored.join(campaign.select("campaign_row_id", "factor1"), "campaign_row_id")
    means = {r["factor1"]: r["u"] for r in kinds.groupBy("factor1").agg(F.avg("predicted_uplift").alias("u")).collect()}
    assert max(means, key=means.get) == "error"
    assert scored.count() == pytest.approx(3000, abs=4)


def test_effect_forest_finds_the_persuadable(spark):
    campaign = load_view(spark, "/root/testdata/sf0.01", "campaign")
    scored, _ = uplift.causal_effect_forest(campaign, ["pc1", "factor1"], trees=10, max_depth=4)
    means = {r["factor1"]: r["e"] for r in scored.groupBy("factor1").agg(F.avg("effect").alias("e")).collect()}
    assert max(means, key=means.get) == "error" and means["error"] > 0


def test_t_learner_needs_arms_and_outcomes(rows):
    df = rows([(1.0, 0, 0), (2.0, 0, 1), (3.0, 0, 1)], "x double, t int, y int")
    with pytest.raises(ValueError, match="both arms"):
        uplift.t_learner_uplift(df, ["x"])
    df = rows([(1.0, 0, 0), (2.0, 0, 1), (3.0, 1, 0)], "x double, t int, y int")
    with pytest.raises(ValueError, match="churned customer"):
        uplift.t_learner_uplift(df, ["x"])


def test_named_outputs_reach_the_folder(spark):
    from stayline import campaign_outputs, customer_outputs, write_results
    from stayline.session import new_path

    campaign = load_view(spark, SF, "campaign")
    analysis = experiment.run_experiment_analysis(campaign, trees=3, max_depth=3)
    names = campaign_outputs(campaign, analysis)
    names |= customer_outputs(load_view(spark, SF, "retention"))
    folder = new_path(spark, "outputs")
    write_results(names, folder)
    read = {n: spark.read.option("header", True).csv(f"{folder}/{n}") for n in names}
    assert read["campaign_policy_results"].count() == 15
    assert read["uplift_deciles"].count() == 10
    assert read["customer_segment_summary"].count() == 5
    assert read["qini_curve"].count() == read["uplift_customer_scores"].count()


def test_posterior_integral_against_closed_forms(rows):
    from stayline.plans.experiment import beta_difference, beta_weights

    x, w = beta_weights(3.0, 5.0, 4001)
    assert (x * w).sum() == pytest.approx(3 / 8, abs=1e-7)
    assert (x * x * w).sum() - (x * w).sum() ** 2 == pytest.approx(15 / 576, abs=1e-6)
    # P(X > Y) of Beta(1, 1) and Beta(2, 1) is 1/3; of two equal ones 1/2
    assert beta_difference((1.0, 1.0), (2.0, 1.0)).probability_above_zero == pytest.approx(1 / 3, abs=1e-6)
    same = beta_difference((40.0, 60.0), (40.0, 60.0))
    assert same.probability_above_zero == pytest.approx(0.5, abs=1e-9) and same.mean == 0
    assert same.below(-1) == 0 and same.below(1) == pytest.approx(1)


def test_experiment_page_without_cost_or_targets(rows):
    from stayline.plans.marts import experiment_page

    data = [(i, i % 2, int(i % 5 < 2 - i % 2)) for i in range(200)]
    arms = rows(data, "campaign_row_id long, t int, y int")
    targets = rows([(0.1,), (0.3,)], "predicted_uplift double")
    free = experiment_page(arms, targets, retained_value=100.0, campaign_cost=0.0).first()
    assert free["roi"] is None and free["expected_campaign_profit"] == pytest.approx(40) and free["targeted_customers"] == 2
    paid = experiment_page(arms, targets, retained_value=100.0, campaign_cost=5.0).first()
    assert paid["roi"] == pytest.approx(3.0) and paid["control_churn_rate"] == pytest.approx(0.4)
    nobody = experiment_page(arms, targets.where("false"), retained_value=100.0, campaign_cost=5.0).first()
    assert nobody["roi"] is None and nobody["expected_campaign_profit"] == 0


def test_wide_rows_are_dealt_to_all_cores(spark):
    """The source is one file of one row group."""
    from stayline.workload.campaigns import wide_campaign
    from stayline.workload.views import load_view

    wide = wide_campaign(spark, "/root/testdata/sf0.001")
    files = wide.groupBy(F.input_file_name()).count().count()
    assert files >= spark.sparkContext.defaultParallelism
    some = ["campaign_row_id", "t", "y", "pc1", "pc77", "factor18"]
    expected = load_view(spark, "/root/testdata/sf0.001", "campaign_wide")
    assert sorted(map(str, wide.select(some).collect())) == sorted(map(str, expected.select(some).collect()))


def test_balance_of_more_columns_than_one_group(rows):
    from stayline.functions.numbers import GROUP_COLUMNS
    from stayline.plans.reports import covariate_balance

    n = GROUP_COLUMNS + 3
    names = [f"pc{i}" for i in range(n)]
    df = rows(
        [(0, 0, *map(float, range(n))), (1, 1, *[2.0 * i for i in range(n)]), (1, 0, *[None] * n)],
        "t int, y int, " + ", ".join(f"{c} double" for c in names),
    )
    found = covariate_balance(df, top=None).collect()
    assert [(r["covariate"], r["absolute_mean_difference"]) for r in found] == [(f"pc{i}", float(i)) for i in reversed(range(n))]
