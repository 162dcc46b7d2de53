"""Descriptive churn and campaign reports.

Every report is one pass of partial and final hash aggregation; the result has a
handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.bands import customer_segment, tenure_band, tenure_band_order
from stayline.functions.numbers import column_groups
from stayline.operators.quantiles import exact_median, exact_quantiles


def _rows() -> Column:
    return F.count(F.lit(1))


def _churned() -> Column:
    return F.sum(F.col("churn_value").cast("long"))


def _rate_pct(column: str = "churn_value", digits: int = 2) -> Column:
    return F.round(100.0 * F.avg(F.col(column).cast("double")), digits)


def _average_charge() -> Column:
    return F.round(F.avg(F.col("monthly_charge").cast("double")), 2)


def _lost_revenue() -> Column:
    """Monthly charges of churned customers; NULL when there is none."""
    return F.round(
        F.sum(F.when(F.col("churn_value") == 1, F.col("monthly_charge"))).cast("double"), 2
    )


def overall_kpis(customers: DataFrame) -> DataFrame:
    return customers.agg(
        _rows().alias("customers"),
        _churned().alias("churned_customers"),
        _rate_pct().alias("churn_rate_pct"),
        _lost_revenue().alias("monthly_revenue_at_risk"),
    )


def kpi_list(customers: DataFrame) -> DataFrame:
    """Unrounded figures in long form: ``metric``, ``value``."""
    exposure = F.col("monthly_charge").cast("double") * F.col("churn_value")
    figures = {
        "customers": _rows(),
        "churned_customers": _churned(),
        "churn_rate_pct": 100.0 * F.avg(F.col("churn_value").cast("double")),
        "average_monthly_charge": F.avg(F.col("monthly_charge").cast("double")),
        "monthly_revenue_at_risk": F.sum(exposure),
    }
    wide = customers.agg(*[c.cast("double").alias(k) for k, c in figures.items()])
    return wide.unpivot([], list(figures), "metric", "value")


def churn_by_contract(customers: DataFrame, *, least: int = 30) -> DataFrame:
    """Contracts with at least ``least`` customers, highest churn first."""
    return (
        customers.groupBy("contract")
        .agg(
            _rows().alias("customers"),
            _churned().alias("churned_customers"),
            _rate_pct().alias("churn_rate_pct"),
            _average_charge().alias("avg_monthly_charge"),
        )
        .where(F.col("customers") >= least)
        .orderBy(F.desc_nulls_first("churn_rate_pct"), "contract")
    )


def churn_by_tenure(customers: DataFrame) -> DataFrame:
    """Tenure bands in tenure order; a missing tenure counts as the last band."""
    return (
        customers.groupBy(tenure_band(F.col("tenure_in_months"), null_band=True).alias("tenure_band"))
        .agg(
            _rows().alias("customers"),
            _rate_pct().alias("churn_rate_pct"),
            _lost_revenue().alias("monthly_revenue_at_risk"),
            F.min("tenure_in_months").alias("_from"),
        )
        .orderBy(F.asc_nulls_last("_from"))
        .drop("_from")
    )


def churn_reasons(customers: DataFrame) -> DataFrame:
    return (
        customers.where((F.col("churn_value") == 1) & F.col("churn_reason").isNotNull())
        .groupBy("churn_reason")
        .agg(_rows().alias("churned_customers"))
        .orderBy(F.desc("churned_customers"), "churn_reason")
    )


def with_segment(customers: DataFrame, median_charge: float | None = None) -> DataFrame:
    """Add ``customer_segment``; the median charge is found first, then a literal."""
    if median_charge is None:
        median_charge = exact_median(customers, "monthly_charge")
    return customers.withColumn(
        "customer_segment",
        customer_segment(
            F.col("tenure_in_months"),
            F.col("monthly_charge"),
            F.col("contract"),
            F.col("premium_tech_support"),
            median_charge,
        ),
    )


def segment_summary(customers: DataFrame) -> DataFrame:
    return (
        with_segment(customers)
        .groupBy("customer_segment")
        .agg(
            _rows().alias("customers"),
            _churned().alias("churned_customers"),
            _rate_pct().alias("churn_rate_pct"),
            _average_charge().alias("avg_monthly_charge"),
            _lost_revenue().alias("monthly_revenue_at_risk"),
        )
        .orderBy(F.desc_nulls_last("monthly_revenue_at_risk"), "customer_segment")
    )


def segment_summary_distinct(
    featured: DataFrame, *, approximate: bool = False, relative_error: float = 0.01
) -> DataFrame:
    """Segments with distinct customers; ``featured`` carries the business features.

    ``approximate`` replaces the exact distinct count, whose shuffle grows with the
    number of customers, by a mergeable sketch.
    """
    distinct = (
        F.approx_count_distinct("customer_id", relative_error)
        if approximate
        else F.count_distinct("customer_id")
    )
    return (
        featured.groupBy("customer_segment")
        .agg(
            distinct.alias("customers"),
            F.avg(F.col("churn_value").cast("double")).alias("churn_rate"),
            F.avg(F.col("monthly_charge").cast("double")).alias("average_monthly_charge"),
            F.coalesce(F.sum("monthly_revenue_at_risk").cast("double"), F.lit(0.0)).alias(
                "monthly_revenue_at_risk"
            ),
        )
        .orderBy(F.desc("monthly_revenue_at_risk"), "customer_segment")
    )


def rate_by_attributes(customers: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Size and churn rate per value of each attribute, the NULL value included.

    All attributes share one scan (one grouping set each).
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("level"))
                for a in attributes
            ]
        )
    )
    return (
        customers.select("churn_value", pairs.alias("p"))
        .groupBy("p.attribute", "p.level")
        .agg(
            _rows().alias("customers"),
            F.avg(F.col("churn_value").cast("double")).alias("churn_rate"),
        )
        .orderBy("attribute", F.desc_nulls_last("churn_rate"), "level")
    )


def rate_by_band(customers: DataFrame) -> DataFrame:
    """Observed tenure bands in order; customers without a tenure are left out."""
    return (
        customers.withColumn("tenure_band", tenure_band(F.col("tenure_in_months")))
        .where(F.col("tenure_band").isNotNull())
        .groupBy("tenure_band")
        .agg(
            _rows().alias("customers"),
            F.avg(F.col("churn_value").cast("double")).alias("churn_rate"),
        )
        .withColumn("band_order", tenure_band_order(F.col("tenure_band")))
        .orderBy("band_order")
    )


def box_statistics(
    df: DataFrame, value: str, group: str, groups: Sequence[object]
) -> DataFrame:
    """Quartiles and whiskers (furthest value within 1.5 interquartile ranges)."""
    names = {f"g{i}": g for i, g in enumerate(groups)}
    split = df.select(
        *[
            F.when(F.col(group) == F.lit(g), F.col(value).cast("double")).alias(n)
            for n, g in names.items()
        ]
    )
    quartiles = exact_quantiles(split, {n: [0.25, 0.5, 0.75] for n in names})
    known = {n: q for n, q in quartiles.items() if q[0] is not None}
    near = []
    for n, (q1, _, q3) in known.items():
        reach = 1.5 * (q3 - q1)
        near += [
            F.min(F.when(F.col(n) >= F.lit(q1 - reach), F.col(n))).alias(f"{n}_low"),
            F.max(F.when(F.col(n) <= F.lit(q3 + reach), F.col(n))).alias(f"{n}_high"),
            F.count(n).alias(f"{n}_rows"),
        ]
    boxes = [
        F.struct(
            F.lit(names[n]).alias(group),
            F.col(f"{n}_rows").alias("customers"),
            F.lit(q1).alias("first_quartile"),
            F.lit(q2).alias("median"),
            F.lit(q3).alias("third_quartile"),
            F.col(f"{n}_low").alias("lower_whisker"),
            F.col(f"{n}_high").alias("upper_whisker"),
        )
        for n, (q1, q2, q3) in known.items()
    ]
    return split.agg(*near).select(F.inline(F.array(*boxes)))


def arm_summary(campaign: DataFrame) -> DataFrame:
    return (
        campaign.groupBy(F.col("t").alias("treatment"))
        .agg(
            _rows().alias("customers"),
            F.sum(F.col("y").cast("long")).alias("churned_customers"),
            _rate_pct("y", 3).alias("churn_rate_pct"),
        )
        .orderBy("treatment")
    )


def treatment_effect(campaign: DataFrame) -> DataFrame:
    y = F.col("y").cast("double")
    control = F.avg(F.when(F.col("t") == 0, y))
    treated = F.avg(F.when(F.col("t") == 1, y))
    return campaign.agg(
        control.alias("control_churn_rate"),
        treated.alias("treated_churn_rate"),
        (control - treated).alias("absolute_churn_reduction"),
    )


def arm_outcome_counts(campaign: DataFrame) -> DataFrame:
    return campaign.groupBy("t", "y").agg(_rows().alias("rows")).orderBy("t", "y")


def treatment_balance(campaign: DataFrame) -> DataFrame:
    arm = F.when(F.col("t") == 0, "control").when(F.col("t") == 1, "treated")
    return (
        campaign.groupBy("t")
        .agg(_rows().alias("customers"), F.avg(F.col("y").cast("double")).alias("outcome_rate"))
        .orderBy("t")
        .select(arm.alias("arm"), "customers", "outcome_rate")
    )


def numeric_covariates(campaign: DataFrame) -> list[str]:
    return [
        f.name
        for f in campaign.schema.fields
        if f.dataType.typeName() in {"byte", "short", "integer", "long", "float", "double", "decimal"}
        and f.name not in {"campaign_row_id", "t", "y"}
    ]


def covariate_balance(campaign: DataFrame, *, top: int | None = 15) -> DataFrame:
    """Arm means per numeric covariate, largest absolute difference first.

    Some columns at a time, each of which is read once; covariates become rows afterwards.
    """

    def arm_means(names: list[str]) -> DataFrame:
        means = campaign.agg(
            *[
                F.avg(F.when(F.col("t") == arm, F.col(c).cast("double"))).alias(f"{c}_{arm}")
                for c in names
                for arm in (0, 1)
            ]
        )
        return means.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("covariate"),
                            F.col(f"{c}_0").alias("control_mean"),
                            F.col(f"{c}_1").alias("treated_mean"),
                        )
                        for c in names
                    ]
                )
            )
        )

    long = reduce(DataFrame.unionByName, map(arm_means, column_groups(numeric_covariates(campaign))))
    gap = F.abs(F.col("treated_mean") - F.col("control_mean"))
    ranked = long.withColumn("absolute_mean_difference", gap).orderBy(
        F.desc_nulls_last("absolute_mean_difference"), "covariate"
    )
    return ranked if top is None else ranked.limit(top)
