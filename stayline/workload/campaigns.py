"""Queries on the campaign population: inference, uplift evaluation, policies."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions.hashing import hash_number
from stayline.functions.numbers import column_groups
from stayline.models import forests, prep
from stayline.operators import cleaning
from stayline.operators.quantiles import exact_quantiles
from stayline.plans import experiment, marts, policy, reports, uplift
from stayline.session import stage
from stayline.sources.schemas import CAMPAIGN_NUMERIC, CATEGORICAL_COVARIATES
from stayline.workload.registry import query, rounded
from stayline.workload.views import load_view, oracle, view_over


def campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_view(spark, sf_dir, "campaign")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_view(spark, sf_dir, "campaign_scored")


# Cleaning and reports

VALID_SQL = """valid as (
  select campaign_row_id, cast(pc1 as double) as pc1, factor1, cast(y as smallint) as y,
    cast(t as smallint) as t
  from (select campaign_row_id, nullif(trim(pc1, ' '), '') as pc1, factor1,
          nullif(trim(y, ' '), '') as y, nullif(trim(t, ' '), '') as t from dirty_campaign)
  where y in ('0', '1') and t in ('0', '1'))"""


@query("valid_binary", oracle("dirty_campaign", "select * from valid", VALID_SQL))
def valid_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = cleaning.clean_text(load_view(spark, sf_dir, "dirty_campaign"))
    types = {"pc1": "double", "y": "smallint", "t": "smallint"}
    return cleaning.strict_cast(cleaning.valid_binary(raw), types)


@query(
    "load_summary_campaign",
    oracle(
        "dirty_campaign",
        """select count(*) as imported_rows, count(distinct campaign_row_id) as unique_rows,
        count(*) filter (where t = 0) as control_customers,
        count(*) filter (where t = 1) as treated_customers,
        count(*) filter (where y = 1) as churned_customers,
        round(100.0 * avg(y), 2) as churn_rate_pct from valid""",
        VALID_SQL,
    ),
)
def load_summary_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.campaign_load_summary(valid_binary(spark, sf_dir))


@query(
    "inf_to_null",
    oracle(
        "campaign",
        """select campaign_row_id, case when campaign_row_id % 10 in (0, 1, 2, 3) then null else pc1 end
          as pc1, factor1 from campaign""",
    ),
)
def inf_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.expr(
        """case campaign_row_id % 10 when 0 then double('Infinity') when 1 then double('-Infinity')
        when 2 then double('NaN') when 3 then null else pc1 end"""
    )
    rows = campaign(spark, sf_dir).select("campaign_row_id", broken.alias("pc1"), "factor1")
    return cleaning.infinite_to_null(rows)


@query(
    "arm_summary",
    oracle(
        "campaign",
        """select t as treatment, count(*) as customers, cast(sum(y) as bigint) as churned_customers,
        round(100.0 * avg(y), 3) as churn_rate_pct from campaign group by t order by t""",
    ),
)
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.arm_summary(campaign(spark, sf_dir))


@query(
    "treatment_effect",
    oracle(
        "campaign",
        """select round(avg(y) filter (where t = 0), 9) as control_churn_rate,
        round(avg(y) filter (where t = 1), 9) as treated_churn_rate,
        round(avg(y) filter (where t = 0) - avg(y) filter (where t = 1), 9)
          as absolute_churn_reduction from campaign""",
    ),
)
def treatment_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    effect = reports.treatment_effect(campaign(spark, sf_dir))
    return rounded(effect, {c: 9 for c in effect.columns})


@query(
    "arm_outcome_counts",
    oracle("campaign", "select t, y, count(*) as rows from campaign group by t, y"),
)
def arm_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.arm_outcome_counts(campaign(spark, sf_dir))


@query(
    "treatment_balance",
    oracle(
        "campaign",
        """select case t when 0 then 'control' else 'treated' end as arm, count(*) as customers,
        round(avg(y), 9) as outcome_rate from campaign group by t""",
    ),
)
def treatment_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.treatment_balance(campaign(spark, sf_dir)), {"outcome_rate": 9})


@query(
    "covariate_balance",
    oracle(
        "campaign",
        " union all ".join(
            f"""select '{c}' as covariate, round(avg({c}) filter (where t = 0), 6) as control_mean,
            round(avg({c}) filter (where t = 1), 6) as treated_mean,
            round(abs(avg({c}) filter (where t = 1) - avg({c}) filter (where t = 0)), 6)
              as absolute_mean_difference from campaign"""
            for c in ("pc1", "pc2", "pc3")
        ),
    ),
)
def covariate_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = reports.covariate_balance(campaign(spark, sf_dir))
    return rounded(
        balance, {"control_mean": 6, "treated_mean": 6, "absolute_mean_difference": 6}
    )


# The campaign at its full width


def wide_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as a stored table: its 178 derived columns are computed once.

    The narrow rows are dealt out before, since a file of few large row groups would leave the
    wide ones to as few tasks.
    """
    rows = campaign(spark, sf_dir)
    rows = rows.repartition(max(3 * spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))
    return stage(view_over(spark, "campaign_wide", campaign=rows), "wide")


def listed(texts) -> str:
    return f"unnest([{', '.join(texts)}])"


NUMBER_NAMES = listed(f"'{c}'" for c in CAMPAIGN_NUMERIC)
WIDE_FACTORS = [f"factor{i}" for i in range(1, CATEGORICAL_COVARIATES + 1)]


@query(
    "covariate_balance_wide",
    oracle(
        "campaign_wide",
        f"""select covariate, round(control, 6) as control_mean, round(treated, 6) as treated_mean,
        round(abs(treated - control), 6) as absolute_mean_difference
        from (select {NUMBER_NAMES} as covariate,
            {listed(f"avg({c}) filter (where t = 0)" for c in CAMPAIGN_NUMERIC)} as control,
            {listed(f"avg({c}) filter (where t = 1)" for c in CAMPAIGN_NUMERIC)} as treated
          from campaign_wide)
        order by abs(treated - control) desc, covariate limit 15""",
    ),
)
def covariate_balance_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 least balanced of 160 numeric covariates."""
    balance = reports.covariate_balance(wide_campaign(spark, sf_dir))
    return rounded(
        balance, {"control_mean": 6, "treated_mean": 6, "absolute_mean_difference": 6}
    )


@query(
    "covariate_medians_wide",
    oracle(
        "campaign_wide",
        f"""select {NUMBER_NAMES} as covariate, round({listed(f"quantile_cont({c}, 0.5)" for c in CAMPAIGN_NUMERIC)}, 9)
          as median, {listed(f"count({c})" for c in CAMPAIGN_NUMERIC)} as usable from campaign_wide""",
    ),
)
def covariate_medians_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of 160 columns, narrowed together."""
    wide = wide_campaign(spark, sf_dir).select(*CAMPAIGN_NUMERIC)
    medians = exact_quantiles(wide, {c: [0.5] for c in CAMPAIGN_NUMERIC}, staged=True)
    counts = [
        wide.agg(*[F.count(c).alias(c) for c in some]).unpivot([], some, "covariate", "usable")
        for some in column_groups(CAMPAIGN_NUMERIC)
    ]
    return reduce(DataFrame.unionByName, counts).select(
        "covariate",
        F.round(F.element_at(F.create_map(*[F.lit(x) for c in CAMPAIGN_NUMERIC for x in (c, medians[c][0])]), F.col("covariate")), 9)
        .alias("median"),
        "usable",
    )


WIDE_PREP_SQL = " union all ".join(
    [
        f"""select feature, round((treated - n * middle) / spread, 4) as treated_total from (
        select {NUMBER_NAMES} as feature, count(*) filter (where t = 1) as n,
          {listed(f"sum({c}) filter (where t = 1)" for c in CAMPAIGN_NUMERIC)} as treated,
          {listed(f"avg({c})" for c in CAMPAIGN_NUMERIC)} as middle,
          {listed(f"stddev_pop({c})" for c in CAMPAIGN_NUMERIC)} as spread from filled)"""
    ]
    + [
        f"""select '{c}_' || coalesce({c}, usual) as feature, cast(count(*) filter (where t = 1) as double) as treated_total
        from campaign_wide, (select {c} as usual from campaign_wide where {c} is not null
          group by {c} order by count(*) desc, {c} limit 1) group by 1"""
        for c in WIDE_FACTORS
    ]
)
WIDE_FILLED_SQL = f"""middles as (
  select {", ".join(f"quantile_cont({c}, 0.5) as m_{c}" for c in CAMPAIGN_NUMERIC)} from campaign_wide),
filled as (
  select t, {", ".join(f"coalesce({c}, m_{c}) as {c}" for c in CAMPAIGN_NUMERIC)} from campaign_wide, middles)"""


@query("prep_wide", oracle("campaign_wide", WIDE_PREP_SQL, WIDE_FILLED_SQL))
def prep_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled, scaled and encoded vectors of all 178 covariates, summed over the treated rows."""
    features = [*CAMPAIGN_NUMERIC, *WIDE_FACTORS]
    wide = wide_campaign(spark, sf_dir)
    vectors = prep.build_preprocessor(wide, features, staged=True).fit(wide).transform(wide)
    names = F.array(*[F.lit(n) for n in prep.feature_names(vectors)])
    totals = vectors.where("t = 1").agg(Summarizer.sum(F.col("features")).alias("sums"))
    return totals.select(F.posexplode(vector_to_array("sums")).alias("i", "total")).select(
        F.element_at(names, F.col("i") + 1).alias("feature"), F.round("total", 4).alias("treated_total")
    )


# Inference

AB_SQL = """arms as (
  select {by} count(*) filter (where t = 0) as control_customers,
    count(*) filter (where t = 1) as treated_customers,
    cast(coalesce(sum(y) filter (where t = 0), 0) as double) as y_c,
    cast(coalesce(sum(y) filter (where t = 1), 0) as double) as y_t from campaign {group}),
rates as (
  select *, y_c / control_customers as p_c, y_t / treated_customers as p_t,
    (y_c + y_t) / (control_customers + treated_customers) as pooled from arms),
effects as (
  select *, p_c - p_t as effect,
    sqrt(p_c * (1 - p_c) / control_customers + p_t * (1 - p_t) / treated_customers) as error,
    sqrt(pooled * (1 - pooled) * (1.0 / control_customers + 1.0 / treated_customers)) as null_error
  from rates)"""
AB_REPORT_SQL = """select {by} control_customers, treated_customers,
    round(p_c, 9) as control_churn_rate, round(p_t, 9) as treated_churn_rate,
    round(effect, 9) as absolute_churn_reduction, round(effect / nullif(p_c, 0), 9)
      as relative_churn_reduction,
    round(effect - 1.96 * error, 9) as ci_95_low, round(effect + 1.96 * error, 9) as ci_95_high,
    round(effect / nullif(null_error, 0), 6) as z_statistic,
    case when effect > 0 then round(1 / effect, 6) end as number_needed_to_treat from effects"""
AB_DIGITS = {
    "control_churn_rate": 9,
    "treated_churn_rate": 9,
    "absolute_churn_reduction": 9,
    "relative_churn_reduction": 9,
    "ci_95_low": 9,
    "ci_95_high": 9,
    "z_statistic": 6,
    "number_needed_to_treat": 6,
}


@query(
    "ab_effect",
    oracle("campaign", AB_REPORT_SQL.format(by=""), AB_SQL.format(by="", group="")),
)
def ab_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    effect = experiment.estimate_ab_effect(campaign(spark, sf_dir))
    return rounded(effect.drop("p_value_two_sided"), AB_DIGITS)


@query(
    "ab_effect_by_segment",
    oracle(
        "campaign",
        AB_REPORT_SQL.format(by="factor1,"),
        AB_SQL.format(by="factor1,", group="group by factor1"),
    ),
)
def ab_effect_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    effect = experiment.estimate_ab_effect(campaign(spark, sf_dir), by=["factor1"])
    return rounded(effect.drop("p_value_two_sided"), AB_DIGITS)


# The normal tail by Simpson's rule over twelve deviations.
TAIL_SQL = AB_SQL.format(by="", group="") + """,
tests as (select effect / nullif(null_error, 0) as z from effects),
tails as (
  select z, 2 * sum((case when i in (0, 24000) then 1 when i % 2 = 1 then 4 else 2 end)
      * exp(-(abs(z) + i * 0.0005) * (abs(z) + i * 0.0005) / 2)) * 0.0005 / 3 / sqrt(2 * pi()) as p
  from tests, range(24001) r(i) group by z)"""


@query(
    "ab_effect_p",
    oracle("campaign", "select round(z, 6) as z_statistic, round(p, 9) as p_value_two_sided from tails", TAIL_SQL),
)
def ab_effect_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    effect = experiment.estimate_ab_effect(campaign(spark, sf_dir))
    return rounded(effect.select("z_statistic", "p_value_two_sided"), {"z_statistic": 6, "p_value_two_sided": 9})


@query(
    "beta_posterior",
    oracle(
        "campaign",
        """select factor1, t, cast(1 + sum(y) as double) as alpha,
        cast(1 + count(*) - sum(y) as double) as beta,
        round(cast(1 + sum(y) as double) / (2 + count(*)), 9) as posterior_mean
        from campaign group by factor1, t""",
    ),
)
def beta_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = campaign(spark, sf_dir).groupBy("factor1", "t").agg(
        F.sum("y").alias("churned"), F.count(F.lit(1)).alias("rows")
    )
    alpha, beta = experiment.beta_posterior(F.col("churned"), F.col("rows") - F.col("churned"))
    return counts.select("factor1", "t", alpha.alias("alpha"), beta.alias("beta")).withColumn(
        "posterior_mean", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 9)
    )


@query("bayesian_ab")
def bayesian_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.bayesian_ab_churn(campaign(spark, sf_dir)).summary


# Both posteriors in 4001 cells; the control's distribution function at every cell of the other.
POSTERIOR_SQL = """params as (
  select t as arm, cast(1 + sum(y) as double) as a, cast(1 + count(*) - sum(y) as double) as b
  from campaign group by t),
reaches as (
  select *, a / (a + b) as m, 12 * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) as r from params),
cells as (
  select arm, a, b, i, greatest(0, m - r) as low, (least(1, m + r) - greatest(0, m - r)) / 4001 as step
  from reaches, range(4001) g(i)),
heights as (select *, low + (i + 0.5) * step as x,
  (a - 1) * ln(low + (i + 0.5) * step) + (b - 1) * ln(1 - low - (i + 0.5) * step) as height from cells),
raised as (select *, exp(height - max(height) over (partition by arm)) as e from heights),
weights as (select *, e / sum(e) over (partition by arm) as w from raised),
upto as (select *, sum(w) over (partition by arm order by i) - w as before from weights),
placed as (
  select t.w as v, (t.x - c.low) / c.step as place
  from upto t, (select any_value(low) as low, any_value(step) as step from upto where arm = 0) c where t.arm = 1),
below as (
  select sum(v * case when place <= 0 then 0 when place >= 4001 then 1 else before + (place - floor(place)) * w end) as p
  from placed left join upto on arm = 0 and i = floor(place)),
better as (
  select 1 - p as probability, c.a / (c.a + c.b) - t.a / (t.a + t.b) as reduction
  from below, params c, params t where c.arm = 0 and t.arm = 1)"""


@query(
    "bayesian_ab_reference",
    oracle(
        "campaign",
        """select round(reduction, 9) as expected_churn_reduction, round(probability, 6) as probability_treatment_better,
        true as mean_agrees, true as probability_agrees, true as low_agrees, true as high_agrees from better""",
        POSTERIOR_SQL,
    ),
)
def bayesian_ab_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws' figures next to the integral's: within five standard errors."""
    rows = campaign(spark, sf_dir)
    arms = {t: (y, n) for t, y, n in rows.groupBy("t").agg(F.sum("y"), F.count("y")).collect()}
    control, treated = (experiment.beta_posterior(arms[t][0], arms[t][1] - arms[t][0]) for t in (0, 1))
    found = experiment.draws_against_reference(experiment.bayesian_ab_churn(rows).summary, control, treated)
    return rounded(found, {"expected_churn_reduction": 9, "probability_treatment_better": 6})


@query(
    "experiment_page",
    oracle(
        "campaign_scored",
        """select round(p_c, 9) as control_churn_rate, round(p_t, 9) as treated_churn_rate,
        round(effect, 9) as absolute_churn_reduction, round(probability, 6) as probability_treatment_better,
        round(480 * gain - 10 * n, 4) as expected_campaign_profit, round((480 * gain - 10 * n) / nullif(10 * n, 0), 6) as roi,
        n as targeted_customers
        from effects, better, (select coalesce(sum(predicted_uplift), 0) as gain, count(*) as n
          from campaign_scored where predicted_uplift * 480 > 10)""",
        AB_SQL.format(by="", group="") + "," + POSTERIOR_SQL,
    ),
)
def experiment_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's experiment page, targeting whom treatment is expected to pay for."""
    targets = scored(spark, sf_dir).where(F.col("predicted_uplift") * 480 > 10)
    page = marts.experiment_page(campaign(spark, sf_dir), targets, retained_value=480.0, campaign_cost=10.0)
    digits = {"control_churn_rate": 9, "treated_churn_rate": 9, "absolute_churn_reduction": 9}
    digits |= {"probability_treatment_better": 6, "expected_campaign_profit": 4, "roi": 6}
    return rounded(page, digits)


@query("posterior_histogram")
def posterior_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = experiment.bayesian_ab_churn(campaign(spark, sf_dir)).churn_reduction_samples
    return experiment.density_histogram(samples, "reduction")


@query(
    "uplift_histogram",
    oracle(
        "campaign_scored",
        """select g.bin, round(low + g.bin * width, 9) as bin_start, count(b.bin) as draws,
        round(count(b.bin) / (n * width), 6) as density
        from (select cast(range as int) as bin from range(80)) g,
          (select min(predicted_uplift) as low,
            (max(predicted_uplift) - min(predicted_uplift)) / 80 as width, count(*) as n
            from campaign_scored) s
        left join (
          select least(cast(floor((predicted_uplift - low) / width) as int), 79) as bin
          from campaign_scored, (select min(predicted_uplift) as low,
            (max(predicted_uplift) - min(predicted_uplift)) / 80 as width from campaign_scored)) b
          on b.bin = g.bin
        group by g.bin, low, width, n""",
    ),
)
def uplift_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = experiment.density_histogram(scored(spark, sf_dir), "predicted_uplift")
    return rounded(bars, {"bin_start": 9, "density": 6})


@query(
    "posterior_profit",
    oracle(
        "campaign_scored",
        """select round(avg(profit), 4) as expected_profit,
        round(quantile_cont(profit, 0.025), 4) as profit_ci_95_low,
        round(quantile_cont(profit, 0.975), 4) as profit_ci_95_high,
        round(avg(cast(profit > 0 as double)), 9) as probability_profitable
        from (select predicted_uplift * cast(3000 as double) * 40 * 12 - 3000 * cast(10 as double)
          as profit from campaign_scored)""",
    ),
)
def posterior_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    profit = policy.posterior_campaign_profit(
        scored(spark, sf_dir), 3000, 40.0, 12.0, 10.0, reduction="predicted_uplift"
    )
    return rounded(
        profit,
        {
            "expected_profit": 4,
            "profit_ci_95_low": 4,
            "profit_ci_95_high": 4,
            "probability_profitable": 9,
        },
    )


# Uplift evaluation

RANKED_SQL = """ranked as (
  select *, row_number() over (order by predicted_uplift desc, campaign_row_id) - 1 as r,
    count(*) over () as n, avg(cast(t as double)) over () as share from campaign_scored)"""


@query(
    "uplift_deciles",
    oracle(
        "campaign_scored",
        """select uplift_decile, count(*) as customers,
        round(avg(predicted_uplift), 9) as mean_predicted_uplift,
        round(avg(y) filter (where t = 0), 6) as control_churn_rate,
        round(avg(y) filter (where t = 1), 6) as treated_churn_rate,
        round(avg(y) filter (where t = 0) - avg(y) filter (where t = 1), 6)
          as observed_churn_reduction
        from (select *, cast(greatest(1, (r * 10 + n - 2) // (n - 1)) as int) as uplift_decile
              from ranked) group by uplift_decile""",
        RANKED_SQL,
    ),
)
def uplift_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    deciles = uplift.uplift_by_decile(scored(spark, sf_dir))
    return rounded(
        deciles,
        {
            "mean_predicted_uplift": 9,
            "control_churn_rate": 6,
            "treated_churn_rate": 6,
            "observed_churn_reduction": 6,
        },
    )


QINI_SQL = (
    RANKED_SQL
    + """,
gains as (
  select r, n, cast(r + 1 as double) / n as target_fraction,
    sum(y * (1 - t)) over (order by r) / (1 - share) - sum(y * t) over (order by r) / share as gain
  from ranked),
curve as (
  select r, n, target_fraction, gain, max_by(gain, r) over () * target_fraction as random_gain
  from gains)"""
)


@query(
    "qini_curve",
    oracle(
        "campaign_scored",
        """select round(target_fraction, 9) as target_fraction,
        round(gain, 6) as cumulative_incremental_gain, round(random_gain, 6) as random_gain,
        round(gain - random_gain, 6) as qini_gain from curve""",
        QINI_SQL,
    ),
)
def qini_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        uplift.qini_like_curve(scored(spark, sf_dir)),
        {"target_fraction": 9, "cumulative_incremental_gain": 6, "random_gain": 6, "qini_gain": 6},
    )


@query(
    "qini_auc",
    oracle(
        "campaign_scored",
        """select round(sum((q + before) / 2 * (target_fraction - f_before)), 6) as qini_area from (
          select gain - random_gain as q, target_fraction,
            lag(gain - random_gain) over (order by r) as before,
            lag(target_fraction) over (order by r) as f_before from curve)""",
        QINI_SQL,
    ),
)
def qini_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(uplift.qini_area(uplift.qini_like_curve(scored(spark, sf_dir))), {"qini_area": 6})


# Decisions


@query(
    "expected_value",
    oracle(
        "campaign",
        """select campaign_row_id, round((0.05 + pc3 / cast(1000 as double)) * (30 + pc2) * 12
          - (10 + campaign_row_id % 3), 6) as expected_net_value from campaign""",
    ),
)
def expected_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = policy.expected_customer_value(
        F.lit(0.05) + F.col("pc3") / F.lit(1000.0),
        30 + F.col("pc2"),
        12,
        10 + F.col("campaign_row_id") % 3,
    )
    return campaign(spark, sf_dir).select(
        "campaign_row_id", F.round(value, 6).alias("expected_net_value")
    )


@query(
    "profitable_targets",
    oracle(
        "campaign_scored",
        """select campaign_row_id, round(predicted_uplift * 40 * 12 - 10, 6) as expected_net_value,
        predicted_uplift * 40 * 12 - 10 > 0 as target from campaign_scored""",
    ),
)
def profitable_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = policy.target_profitable_customers(
        scored(spark, sf_dir), monthly_margin=40.0, expected_remaining_months=12.0, campaign_cost=10.0
    )
    return rounded(targets, {"expected_net_value": 6}).select(
        "campaign_row_id", "expected_net_value", "target"
    )


@query(
    "threshold_profit",
    oracle(
        "campaign_scored",
        """select round(uplift_threshold, 9) as uplift_threshold, count(*) as customers_targeted,
        round(sum(predicted_uplift) * 480 - count(*) * 10, 4) as expected_total_profit
        from campaign_scored join thresholds on predicted_uplift >= uplift_threshold
        group by uplift_threshold""",
        """places as (
          select predicted_uplift as u, row_number() over (order by predicted_uplift) - 1 as r
          from campaign_scored),
        wanted as (
          select (select count(*) - 1 from campaign_scored) * (cast(i as double) / 100) as place
          from range(101) g(i)),
        thresholds as (
          select distinct case when place - floor(place) < 0.5
            then a.u + (b.u - a.u) * (place - floor(place))
            else b.u - (b.u - a.u) * (1 - (place - floor(place))) end as uplift_threshold
          from wanted join places a on a.r = floor(place) join places b on b.r = ceil(place))""",
    ),
)
def threshold_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    profit = policy.optimize_threshold(scored(spark, sf_dir), 480.0, 10.0)
    return rounded(profit, {"uplift_threshold": 9, "expected_total_profit": 4})


@query(
    "policy_comparison",
    oracle(
        "campaign_scored",
        """select policy, target_fraction, any_value(size) as customers_targeted,
        round(sum(y * (1 - t)) / (1 - avg(t)) - sum(y * t) / avg(t), 6)
          as estimated_churns_prevented,
        round((sum(y * (1 - t)) / (1 - avg(t)) - sum(y * t) / avg(t)) * 480 - any_value(size) * 10, 4)
          as estimated_incremental_profit
        from places join sizes on place <= size group by policy, target_fraction""",
        """sizes as (
          select f as target_fraction, greatest(1, cast(floor(n * f) as bigint)) as size
          from (select unnest([0.1, 0.2, 0.3, 0.5, 1.0]::double[]) as f, count(*) as n
                from campaign_scored)),
        places as (
          select t, y, 'uplift' as policy,
            row_number() over (order by predicted_uplift desc, campaign_row_id) as place
          from campaign_scored
          union all select t, y, 'churn_risk',
            row_number() over (order by p_churn_control desc, campaign_row_id) from campaign_scored
          union all select t, y, 'random',
            row_number() over (order by substr(md5('42:' || campaign_row_id), 1, 13) desc,
              campaign_row_id) from campaign_scored)""",
    ),
)
def policy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        policy.compare_policies(scored(spark, sf_dir)),
        {"estimated_churns_prevented": 6, "estimated_incremental_profit": 4},
    )


# Values and costs that differ from customer to customer.
OWN_VALUE = "300 + campaign_row_id % 7 * 50"
OWN_COST = "5 + campaign_row_id % 3"


@query(
    "threshold_profit_per_customer",
    oracle(
        "campaign_scored",
        """select round(uplift_threshold, 9) as uplift_threshold, count(*) as customers_targeted,
        round(sum(predicted_uplift * (300 + campaign_row_id % 7 * 50)) - sum(5 + campaign_row_id % 3), 4)
          as expected_total_profit
        from campaign_scored join thresholds on predicted_uplift >= uplift_threshold
        group by uplift_threshold""",
        """places as (
          select predicted_uplift as u, row_number() over (order by predicted_uplift) - 1 as r
          from campaign_scored),
        wanted as (
          select (select count(*) - 1 from campaign_scored) * (cast(i as double) / 100) as place
          from range(101) g(i)),
        thresholds as (
          select distinct case when place - floor(place) < 0.5
            then a.u + (b.u - a.u) * (place - floor(place))
            else b.u - (b.u - a.u) * (1 - (place - floor(place))) end as uplift_threshold
          from wanted join places a on a.r = floor(place) join places b on b.r = ceil(place))""",
    ),
)
def threshold_profit_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    profit = policy.optimize_threshold(scored(spark, sf_dir), F.expr(OWN_VALUE), F.expr(OWN_COST))
    return rounded(profit, {"uplift_threshold": 9, "expected_total_profit": 4})


@query(
    "policy_comparison_per_customer",
    oracle(
        "campaign_scored",
        """select policy, target_fraction, any_value(size) as customers_targeted,
        round(sum(y * (1 - t)) / (1 - avg(t)) - sum(y * t) / avg(t), 6)
          as estimated_churns_prevented,
        round(sum(y * (1 - t) * v) / (1 - avg(t)) - sum(y * t * v) / avg(t) - sum(c), 4)
          as estimated_incremental_profit
        from places join sizes on place <= size group by policy, target_fraction""",
        """sizes as (
          select f as target_fraction, greatest(1, cast(floor(n * f) as bigint)) as size
          from (select unnest([0.1, 0.2, 0.3, 0.5, 1.0]::double[]) as f, count(*) as n
                from campaign_scored)),
        places as (
          select t, y, 300 + campaign_row_id % 7 * 50 as v, 5 + campaign_row_id % 3 as c, 'uplift' as policy,
            row_number() over (order by predicted_uplift desc, campaign_row_id) as place
          from campaign_scored
          union all select t, y, 300 + campaign_row_id % 7 * 50 as v, 5 + campaign_row_id % 3 as c, 'churn_risk',
            row_number() over (order by p_churn_control desc, campaign_row_id) from campaign_scored
          union all select t, y, 300 + campaign_row_id % 7 * 50 as v, 5 + campaign_row_id % 3 as c, 'random',
            row_number() over (order by substr(md5('42:' || campaign_row_id), 1, 13) desc,
              campaign_row_id) from campaign_scored)""",
    ),
)
def policy_comparison_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        policy.compare_policies(
            scored(spark, sf_dir), retained_customer_value=F.expr(OWN_VALUE), campaign_cost=F.expr(OWN_COST)
        ),
        {"estimated_churns_prevented": 6, "estimated_incremental_profit": 4},
    )


# Learners

_MAPS = ", ".join(f"({t}, {a}, {b})" for t, (a, b) in enumerate(forests.draw_maps(42, 350)))
_LIMITS = ", ".join(f"cast('{float(c)!r}' as double)" for c in forests._POISSON)


@query(
    "forest_draws",
    oracle(
        "campaign",
        """select tree, cast(sum(n) as double) as drawn, round(sum(n) / (2 * sum(n * (1 - y))), 9) as weight_0,
        round(sum(n) / (2 * sum(n * y)), 9) as weight_1 from drawn group by tree""",
        f"""maps(tree, a, b) as (values {_MAPS}),
hashed as (
  select y, cast('0x' || substr(md5('42:draw:' || campaign_row_id), 1, 13) as bigint) % 2147483647 as h
  from campaign where t = 1),
drawn as (
  select tree, y, cast(list_sum(list_transform([{_LIMITS}],
      lambda c: cast((h * a + b) % 2147483647 / cast(2147483647 as double) >= c as int))) as bigint) as n
  from hashed, maps)""",
    ),
)
def forest_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the 350 trees of the treated arm draws, and what its classes weigh."""
    treated = campaign(spark, sf_dir).where("t = 1")
    rows = treated.select(
        hash_number("42:draw", F.col("campaign_row_id")).alias("hash"),
        F.col("y").cast("double").alias("g"),
        F.lit(1.0).alias("h"),
        F.lit(b"").alias("bins"),
    )
    sums = forests.class_sums(rows, forests.Drawing(42, 350), 0)
    weights = forests.class_weights(sums)
    found = [(t, float(sums[t][0]), *map(float, weights[t])) for t in range(len(sums))]
    out = spark.createDataFrame(found, "tree int, drawn double, weight_0 double, weight_1 double")
    return rounded(out, {"weight_0": 9, "weight_1": 9})


@query("t_learner_scores")
def t_learner_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uplift.fit_t_learner(campaign(spark, sf_dir), ordered=False)


@query("t_learner_in_sample")
def t_learner_in_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = campaign(spark, sf_dir)
    features = ["pc1", "pc2", "pc3", "factor1", "factor2"]
    model = uplift.campaign_pipeline(rows, features, 42)
    return uplift.t_learner_uplift(rows, features, model)[0]


@query("r_learner_scores")
def r_learner_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = ["pc1", "pc2", "pc3", "factor1", "factor2"]
    return uplift.causal_effect_forest(campaign(spark, sf_dir), features)[0]


@query("experiment_run")
def experiment_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis; returns its policy table."""
    return experiment.run_experiment_analysis(campaign(spark, sf_dir)).policy_comparison
