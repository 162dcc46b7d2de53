"""From predicted uplift to targeting decisions and profit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.hashing import hash_uniform
from stayline.functions.numbers import ratio, with_step
from stayline.operators.quantiles import exact_quantiles, position_among, sortable_score, top_cuts

TARGET_FRACTIONS = (0.10, 0.20, 0.30, 0.50, 1.00)  # fixed values


def expected_customer_value(
    churn_reduction, monthly_margin, expected_remaining_months, campaign_cost
):
    """Expected profit of targeting one customer. Every argument may be a number or a
    column (per-customer margins and costs)."""
    return churn_reduction * monthly_margin * expected_remaining_months - campaign_cost


def target_profitable_customers(
    scored: DataFrame,
    *,
    monthly_margin: float | Column,
    expected_remaining_months: float | Column,
    campaign_cost: float | Column,
    ordered: bool = True,
    key: str | None = None,
) -> DataFrame:
    """Add ``expected_net_value`` and ``target``; ``ordered=False`` saves the sort. ``key``
    breaks ties of the order, ascending."""
    value = expected_customer_value(
        F.col("predicted_uplift"), monthly_margin, expected_remaining_months, campaign_cost
    )
    result = scored.withColumn("expected_net_value", value).withColumn(
        "target", F.col("expected_net_value") > 0
    )
    ties = [F.asc(key)] if key else []
    return result.orderBy(F.desc_nulls_last("expected_net_value"), *ties) if ordered else result


def _amount(value: float | Column) -> Column:
    return value.cast("double") if isinstance(value, Column) else F.lit(float(value))


def optimize_threshold(
    scored: DataFrame,
    retained_customer_value: float | Column,
    campaign_cost: float | Column,
    thresholds: Sequence[float] | None = None,
    *,
    uplift: str = "predicted_uplift",
) -> DataFrame:
    """Customers and total profit at each uplift threshold, best first.

    Value and cost are numbers or columns of ``scored`` (each customer's own).
    Each row falls into one interval between thresholds; the totals above a threshold
    are sums over at most 102 intervals, not a rescan per threshold.
    """
    if thresholds is None:
        thresholds = exact_quantiles(scored, {uplift: [i / 100 for i in range(101)]})[uplift]
    grid = sorted({float(v) for v in thresholds if v is not None})
    if not grid:
        raise ValueError("There is no uplift value or threshold to compare")
    spark = scored.sparkSession
    per_interval = (
        with_step(
            scored.select(
                F.col(uplift).cast("double").alias("_uplift"),
                (F.col(uplift).cast("double") * _amount(retained_customer_value)).alias("_gain"),
                _amount(campaign_cost).alias("_cost"),
            ),
            "_uplift",
            grid,
            "step",
        )
        .groupBy("step")
        .agg(F.count(F.lit(1)).alias("rows"), (F.sum("_gain") - F.sum("_cost")).alias("profit"))
        .where("step > 0")
    )
    at_least = Window.orderBy(F.desc("step"))  # one row per threshold
    steps = spark.createDataFrame(
        [(i + 1, v) for i, v in enumerate(grid)], "step int, uplift_threshold double"
    )
    rows = F.sum(F.coalesce("rows", F.lit(0))).over(at_least)
    profit = F.sum(F.coalesce("profit", F.lit(0.0))).over(at_least)
    return (
        steps.join(per_interval, "step", "left")
        .select(
            "uplift_threshold",
            rows.alias("customers_targeted"),
            profit.alias("expected_total_profit"),
        )
        .orderBy(F.desc("expected_total_profit"), "uplift_threshold")
    )


def posterior_campaign_profit(
    samples: DataFrame,
    n_targeted: int,
    monthly_margin: float,
    retained_months: float,
    cost_per_customer: float,
    *,
    reduction: str = "reduction",
) -> DataFrame:
    """Expected profit, 95 % interval and probability of a profit."""
    # Profit rises with the reduction, so its quantiles are those of the reduction.
    gain = float(n_targeted) * monthly_margin * retained_months
    cost = float(n_targeted) * cost_per_customer
    low, high = exact_quantiles(samples, {reduction: [0.025, 0.975]})[reduction]
    if low is None:
        raise ValueError("There is no posterior sample")
    if gain < 0:
        low, high = high, low
    profit = F.col(reduction) * F.lit(gain) - F.lit(cost)
    return samples.agg(
        F.avg(profit).alias("expected_profit"),
        F.lit(low * gain - cost).alias("profit_ci_95_low"),
        F.lit(high * gain - cost).alias("profit_ci_95_high"),
        F.avg((profit > 0).cast("double")).alias("probability_profitable"),
    )


def prevented_churn(rows: Column, treated: Column, y_control: Column, y_treated: Column) -> Column:
    """Inverse-propensity estimate from group totals; NULL when an arm is empty."""
    share = ratio(treated, rows)
    estimate = ratio(y_control, 1 - share) - ratio(y_treated, share)
    return F.when((share > 0) & (share < 1), estimate)


def compare_policies(
    scored: DataFrame,
    random_state: int = 42,
    *,
    retained_customer_value: float | Column = 480.0,
    campaign_cost: float | Column = 10.0,
    key: str = "campaign_row_id",
    fractions: Sequence[float] = TARGET_FRACTIONS,
) -> DataFrame:
    """Estimated gain and profit of targeting by uplift, churn risk or at random.

    The best n rows of each policy are found as cut predicates (no sort); one
    aggregate then serves all policies and fractions. Value and cost are numbers or
    columns of ``scored``; with columns the profit weighs each prevented churn by its
    customer's value and takes off the costs of those targeted.
    """
    policies = {
        "uplift": F.col("predicted_uplift"),
        "churn_risk": F.col("p_churn_control"),
        "random": hash_uniform(random_state, F.col(key)),
    }
    shares = sorted(fractions)

    def sizes(n: int) -> list[int]:
        return [max(1, int(n * f)) for f in shares]

    counts, cuts = top_cuts(scored, policies, key, {p: sizes for p in policies})
    total = counts["uplift"]
    spark = scored.sparkSession
    targeted = spark.createDataFrame(
        [(p, i, float(f), n) for p in policies for i, (f, n) in enumerate(zip(shares, sizes(total)))],
        "policy string, tier int, target_fraction double, customers_targeted long",
    )

    ranked = scored.select(
        key,
        "t",
        "y",
        _amount(retained_customer_value).alias("_value"),
        _amount(campaign_cost).alias("_cost"),
        *[sortable_score(score).alias(f"_{p}") for p, score in policies.items()]
    )
    memberships = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(p).alias("policy"),
                    position_among(cuts[p], F.col(f"_{p}"), F.col(key)).alias("tier"),
                )
                for p in policies
            ]
        )
    )
    t, y = F.col("t").cast("long"), F.col("y").cast("long")
    per_tier = (
        ranked.select("t", "y", "_value", "_cost", memberships)
        .where(F.col("tier") < len(shares))
        .groupBy("policy", "tier")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(t).alias("n_t"),
            F.sum(y * (1 - t)).alias("y_c"),
            F.sum(y * t).alias("y_t"),
            F.sum(y * (1 - t) * F.col("_value")).alias("v_c"),
            F.sum(y * t * F.col("_value")).alias("v_t"),
            F.sum("_cost").alias("cost"),
        )
    )
    nested = Window.partitionBy("policy").orderBy("tier")  # one row per fraction
    n, n_t, y_c, y_t, v_c, v_t, cost = (
        F.sum(F.coalesce(c, F.lit(0))).over(nested) for c in ("n", "n_t", "y_c", "y_t", "v_c", "v_t", "cost")
    )
    gain = F.col("estimated_churns_prevented")
    return (
        targeted.join(per_tier, ["policy", "tier"], "left")
        .withColumn("estimated_churns_prevented", prevented_churn(n, n_t, y_c, y_t))
        .withColumn("_profit", prevented_churn(n, n_t, v_c, v_t) - cost)
        .select(
            "policy",
            "target_fraction",
            "customers_targeted",
            gain,
            F.col("_profit").alias("estimated_incremental_profit"),
        )
        .orderBy("target_fraction", "policy")
    )
