"""Tables behind the dashboard: the customer export, headline cards, breakdowns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.bands import export_tenure_group, risk_score, risk_segment
from stayline.functions.numbers import edge_index, ratio
from stayline.operators.quantiles import exact_quantiles
from stayline.plans.experiment import beta_difference, beta_posterior, estimate_ab_effect


def with_risk(customers: DataFrame) -> DataFrame:
    """Add ``risk_score`` and ``risk_segment`` to the export's customer columns."""
    score = risk_score(
        F.col("contract_type"),
        F.col("tenure"),
        F.col("tech_support"),
        F.col("monthly_charges"),
        F.col("payment_method"),
    )
    return customers.withColumn("risk_score", score).withColumn(
        "risk_segment", risk_segment(F.col("risk_score"))
    )


def export_mart(customers: DataFrame, experiment: DataFrame) -> DataFrame:
    """Customers with tenure group and risk, left-joined to their experiment rows."""
    outcome = experiment.select(
        "customer_id", "treatment", "churn_after_campaign", "campaign_cost"
    )
    return (
        with_risk(customers.withColumn("tenure_group", export_tenure_group(F.col("tenure"))))
        .join(outcome, "customer_id", "left")
    )


def charge_band(charge: Column, quartiles: Sequence[float]) -> Column:
    """Q1..Q4 by the quartile a charge lies in (a quartile value opens its band)."""
    return F.concat(F.lit("Q"), (edge_index(charge.cast("double"), quartiles) + 1).cast("string"))


def charge_quartiles(customers: DataFrame, charge: str = "monthly_charge") -> list[float]:
    return exact_quantiles(customers, {charge: [0.25, 0.5, 0.75]})[charge]


def dashboard_cards(
    customers: DataFrame, *, retained_value: float, campaign_cost: float, reduction: float
) -> DataFrame:
    """Headline figures; expects ``risk_segment``. The expected profit is that of
    treating every high-risk customer at the given churn reduction."""
    high = F.count_if(F.col("risk_segment") == "High")
    charge = F.col("monthly_charge").cast("double")
    return customers.agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(F.col("churn_value").cast("double")).alias("churn_rate"),
        F.sum(charge).alias("monthly_revenue"),
        F.sum(F.when(F.col("churn_value") == 1, charge)).alias("revenue_at_risk"),
        high.alias("high_risk_customers"),
        (high * F.lit(reduction * retained_value - campaign_cost)).alias(
            "expected_campaign_profit"
        ),
    )


def dashboard_breakdowns(
    customers: DataFrame, dimensions: Mapping[str, str], slicers: Sequence[str] = ()
) -> DataFrame:
    """Customers, churn and exposed revenue per level of every dimension.

    ``dimensions`` maps the shown name to a column. One scan: each row is counted
    once per dimension in the map-side aggregate. ``slicers`` stay as columns.
    """
    levels = F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("dimension"), F.col(c).cast("string").alias("level"))
                for name, c in dimensions.items()
            ]
        )
    )
    return (
        customers.select(*slicers, "churn_value", "monthly_charge", levels)
        .groupBy("dimension", "level", *slicers)
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum(F.col("churn_value").cast("long")).alias("churned_customers"),
            F.avg(F.col("churn_value").cast("double")).alias("churn_rate"),
            F.sum(F.when(F.col("churn_value") == 1, F.col("monthly_charge")))
            .cast("double")
            .alias("revenue_at_risk"),
        )
    )


def dashboard_slices(customers: DataFrame, slicers: Sequence[str]) -> DataFrame:
    """Figures for every combination of slicer settings, open slicers included, in one scan.

    ``grouping`` has a bit for each slicer, the first the highest: 1 where it is left open
    (and its column NULL), 0 where the column holds the chosen level.
    """
    return customers.cube(*slicers).agg(
        F.grouping_id().alias("grouping"),
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.col("churn_value").cast("long")).alias("churned_customers"),
        F.avg(F.col("churn_value").cast("double")).alias("churn_rate"),
        F.sum(F.when(F.col("churn_value") == 1, F.col("monthly_charge"))).cast("double").alias("revenue_at_risk"),
    )


def experiment_page(
    experiment: DataFrame, targets: DataFrame, *, retained_value: float, campaign_cost: float
) -> DataFrame:
    """One row: both churn rates, their difference, the posterior probability that treatment is
    better, and what targeting ``targets`` (with ``predicted_uplift``) is expected to earn.

    ``roi`` is expected profit per unit of cost; NULL if nothing is spent.
    """
    summary = estimate_ab_effect(experiment).first()
    arms = {t: (churned, n) for t, churned, n in experiment.groupBy("t").agg(F.sum("y"), F.count("y")).collect()}
    control, treated = (beta_posterior(arms[t][0], arms[t][1] - arms[t][0]) for t in (0, 1))
    better = beta_difference(control, treated).probability_above_zero
    gain = F.coalesce(F.sum("predicted_uplift"), F.lit(0.0)) * retained_value
    cost = F.count(F.lit(1)) * F.lit(float(campaign_cost))
    return targets.agg(
        F.lit(summary["control_churn_rate"]).alias("control_churn_rate"),
        F.lit(summary["treated_churn_rate"]).alias("treated_churn_rate"),
        F.lit(summary["absolute_churn_reduction"]).alias("absolute_churn_reduction"),
        F.lit(better).alias("probability_treatment_better"),
        (gain - cost).alias("expected_campaign_profit"),
        ratio(gain - cost, cost).alias("roi"),
        F.count(F.lit(1)).alias("targeted_customers"),
    )


# Signal, interpretation, possible action.
RETENTION_ACTIONS = [
    ("Short tenure", "Early-life churn risk", "Improve onboarding and first-90-day support"),
    ("Month-to-month contract", "Low switching barrier", "Offer an appropriate contract incentive"),
    ("No technical support", "Unresolved service friction", "Offer proactive technical assistance"),
    ("High monthly charge", "Possible price sensitivity", "Review plan fit before offering a discount"),
]


def retention_actions(customers: DataFrame, signals: Mapping[str, Column]) -> DataFrame:
    """One row per customer and raised signal, with what it means and what to do.

    ``signals`` maps the four signal names to conditions.
    """
    table = customers.sparkSession.createDataFrame(
        RETENTION_ACTIONS, "signal string, interpretation string, possible_action string"
    )
    raised = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in signals.items()]))
    return customers.select("customer_id", F.explode(raised).alias("signal")).join(
        F.broadcast(table), "signal"  # four rows
    )
