"""Declared layouts of the two raw tables and their typed forms."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of the raw customer file.
CUSTOMER_COLUMNS = """
    customer_id gender age under_30 senior_citizen married dependents number_of_dependents
    country state city zip_code latitude longitude population quarter referred_a_friend
    number_of_referrals tenure_in_months offer phone_service avg_monthly_long_distance_charges
    multiple_lines internet_service internet_type avg_monthly_gb_download online_security
    online_backup device_protection_plan premium_tech_support streaming_tv streaming_movies
    streaming_music unlimited_data contract paperless_billing payment_method monthly_charge
    total_charges total_refunds total_extra_data_charges total_long_distance_charges
    total_revenue satisfaction_score customer_status churn_label churn_score cltv
    churn_category churn_reason
""".split()

# Types of the cleaned customer columns; the others stay text.
CUSTOMER_TYPES = {
    **dict.fromkeys(
        "age number_of_dependents population number_of_referrals tenure_in_months "
        "avg_monthly_gb_download satisfaction_score churn_score".split(),
        "int",
    ),
    **dict.fromkeys(["latitude", "longitude"], "double"),
    **dict.fromkeys(
        "avg_monthly_long_distance_charges monthly_charge total_refunds "
        "total_extra_data_charges".split(),
        "decimal(12,2)",
    ),
    **dict.fromkeys(
        "total_charges total_long_distance_charges total_revenue cltv".split(),
        "decimal(14,2)",
    ),
}

NUMERIC_COVARIATES = 160
CATEGORICAL_COVARIATES = 18
CAMPAIGN_NUMERIC = [f"pc{i}" for i in range(1, NUMERIC_COVARIATES + 1)]
CAMPAIGN_COLUMNS = [
    *CAMPAIGN_NUMERIC,
    *[f"factor{i}" for i in range(1, CATEGORICAL_COVARIATES + 1)],
    "y",
    "t",
]
CAMPAIGN_TYPES = {**dict.fromkeys(CAMPAIGN_NUMERIC, "double"), "y": "smallint", "t": "smallint"}

CUSTOMER_REQUIRED = {"customer_id", "churn_value"}
CAMPAIGN_REQUIRED = {"campaign_row_id", "t", "y"}


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
