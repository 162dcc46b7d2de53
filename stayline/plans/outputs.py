"""The named result tables a dashboard reads, gathered from finished analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.plans.churn import ChurnAnalysis, add_business_features
from stayline.plans.experiment import ExperimentAnalysis
from stayline.plans.explain import shap_importance
from stayline.plans.policy import optimize_threshold
from stayline.plans.reports import segment_summary_distinct


def customer_outputs(customers: DataFrame) -> dict[str, DataFrame]:
    return {
        "customer_retention_sql": customers,
        "customer_segment_summary": segment_summary_distinct(add_business_features(customers)),
    }


def churn_outputs(analysis: ChurnAnalysis, *, key: str = "customer_id") -> dict[str, DataFrame]:
    out = {
        "model_leaderboard": analysis.leaderboard,
        "pca_validation": analysis.pca_validation,
        "customer_churn_scores": analysis.predictions,
        "shap_global_importance": shap_importance(analysis.model, analysis.holdout, key=key),
    }
    if analysis.importance is not None:
        out["permutation_importance"] = analysis.importance
    return out


def campaign_outputs(
    campaign: DataFrame,
    analysis: ExperimentAnalysis,
    *,
    retained_customer_value: float = 480.0,
    campaign_cost: float = 10.0,
    key: str = "campaign_row_id",
) -> dict[str, DataFrame]:
    """Every campaign result by the name of its folder; only sinks are sorted."""
    return {
        "campaign_sql": campaign,
        "ab_test_summary": analysis.ab_summary,
        "bayesian_ab_summary": analysis.bayesian_summary,
        "uplift_customer_scores": analysis.scored_customers.orderBy(F.desc("predicted_uplift"), key),
        "uplift_deciles": analysis.uplift_deciles,
        "qini_curve": analysis.qini_curve,
        "campaign_policy_results": analysis.policy_comparison,
        "uplift_threshold_optimization": optimize_threshold(
            analysis.scored_customers, retained_customer_value, campaign_cost
        ),
    }
