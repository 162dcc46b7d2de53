"""Retention and campaign-experiment analytics as Spark DataFrame jobs.

Sub-packages
------------
``sources``    readers, loaders with schema checks, result sinks
``functions``  column expressions (text, bands, hashing, decision arithmetic)
``operators``  distributed building blocks (order statistics, ranks, splits, metrics)
``models``     Spark ML preprocessing and classifiers
``plans``      the analyses: reports, marts, churn, experiment, uplift, policy
``workload``   the registered queries over the supplied tables and their SQL
"""

from stayline.operators.cleaning import (
    add_churn_value,
    cast_or_quarantine,
    clean_campaign,
    clean_customers,
    clean_text,
    constraint_report,
    enforce_constraints,
    infinite_to_null,
    keep_last,
    strict_cast,
    valid_binary,
)
from stayline.models.classifiers import build_models
from stayline.operators.sampling import assign_folds, hash_sample, stratified_split
from stayline.plans.churn import (
    ChurnAnalysis,
    add_business_features,
    compare_pca_validation,
    prepare_churn_xy,
    run_churn_analysis,
)
from stayline.plans.experiment import (
    BayesianABResult,
    ExperimentAnalysis,
    bayesian_ab_churn,
    bayesian_from_counts,
    beta_posterior,
    density_histogram,
    effect_from_counts,
    estimate_ab_effect,
    run_experiment_analysis,
    validate_experiment,
)
from stayline.plans.explain import (
    compute_shap_explanation,
    explain_top_customer,
    permutation_importance,
    shap_importance,
)
from stayline.plans.outputs import campaign_outputs, churn_outputs, customer_outputs
from stayline.plans.policy import (
    compare_policies,
    expected_customer_value,
    optimize_threshold,
    posterior_campaign_profit,
    target_profitable_customers,
)
from stayline.plans.uplift import (
    causal_effect_forest,
    fit_t_learner,
    qini_area,
    qini_auc,
    qini_like_curve,
    t_learner_uplift,
    uplift_by_decile,
)
from stayline.session import remove_staged
from stayline.sources.files import (
    publish_table,
    read_campaign_csv,
    read_csv,
    read_customers_csv,
    write_results,
)
from stayline.sources.tables import (
    JdbcSource,
    AnalysisData,
    load_analysis_data,
    load_campaign,
    load_customers,
    load_table,
    require_columns,
)
