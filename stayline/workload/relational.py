"""Queries on the customer population: sources, cleaning, reports, marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions.bands import tenure_band
from stayline.operators import cleaning
from stayline.operators.sampling import hash_sample
from stayline.plans import marts, reports
from stayline.plans.churn import add_business_features, prepare_churn_xy, value_at_risk
from stayline.session import new_path
from stayline.sources.files import read_customers_csv, write_result
from stayline.sources.schemas import CUSTOMER_COLUMNS
from stayline.sources.tables import load_table
from stayline.workload.registry import as_doubles, query, rounded
from stayline.workload.views import load_view, oracle

MEDIAN_SQL = "(select quantile_cont(cast(monthly_charge as double), 0.5) from retention)"
SEGMENT_SQL = f"""case
    when tenure_in_months <= 6 and lower(contract) = 'month-to-month' then 'new_and_fragile'
    when cast(monthly_charge as double) >= {MEDIAN_SQL} and lower(contract) = 'month-to-month'
      then 'high_value_at_risk'
    when lower(contract) = 'month-to-month' and coalesce(lower(premium_tech_support), 'no') <> 'yes'
      then 'unsupported_flexible'
    when cast(monthly_charge as double) >= {MEDIAN_SQL} then 'high_value_loyal'
    else 'core_customers' end"""


def _band_sql(tenure: str, when_null: str) -> str:
    return f"""case when {tenure} is null then {when_null} when {tenure} <= 6 then '0-6 months'
    when {tenure} <= 12 then '7-12 months' when {tenure} <= 24 then '13-24 months'
    when {tenure} <= 48 then '25-48 months' else '49+ months' end"""


SPARSE_TENURE = "case when customer_id % 11 = 4 then null else tenure_in_months end"
RATE_SQL = "round(100.0 * avg(churn_value), 2) as churn_rate_pct"
CHURNED_SQL = "cast(sum(churn_value) as bigint) as churned_customers"
LOST_SQL = (
    "round(cast(sum(monthly_charge) filter (where churn_value = 1) as double), 2) "
    "as monthly_revenue_at_risk"
)
AVG_CHARGE_SQL = "round(avg(cast(monthly_charge as double)), 2) as avg_monthly_charge"


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_view(spark, sf_dir, "retention")


def sparse_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some customers without a tenure."""
    return retention(spark, sf_dir).withColumn(
        "tenure_in_months", F.when(F.col("customer_id") % 11 != 4, F.col("tenure_in_months"))
    )


# Sources


@query(
    "csv_roundtrip",
    oracle(
        "retention",
        """select cast(customer_id as string) as customer_id, contract, premium_tech_support,
        cast(monthly_charge as double) as monthly_charge, tenure_in_months,
        case when customer_id % 5 = 0 then 'said "too dear", left'
             when customer_id % 5 = 1 then null else 'moved, abroad' end as churn_reason,
        cast(churn_value as smallint) as churn_value
        from retention""",
    ),
)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("customer_id") % 5 == 0, 'said "too dear", left').when(
        F.col("customer_id") % 5 != 1, "moved, abroad"
    )
    known = (
        retention(spark, sf_dir)
        .withColumn("churn_reason", reason)
        .withColumn("churn_label", F.when(F.col("churn_value") == 1, " Yes").otherwise("no "))
    )
    text = known.select(
        *[
            (F.col(c).cast("string") if c in known.columns else F.lit("")).alias(c)
            for c in CUSTOMER_COLUMNS
        ]
    )
    path = new_path(spark, "customers-csv")
    write_result(text, path, format="csv")
    return as_doubles(cleaning.clean_customers(read_customers_csv(spark, path)), "monthly_charge").select(
        "customer_id",
        "contract",
        "premium_tech_support",
        "monthly_charge",
        "tenure_in_months",
        "churn_reason",
        "churn_value",
    )


@query(
    "file_order",
    oracle(
        "retention",
        """select cast(customer_id as string) as customer_id,
        row_number() over (order by customer_id) as load_order from retention""",
    ),
)
def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers of a CSV of several files, written in the order of its key."""
    known = retention(spark, sf_dir).orderBy("customer_id")
    text = known.select(
        *[
            (F.col(c).cast("string") if c in known.columns else F.lit("")).alias(c)
            for c in CUSTOMER_COLUMNS
        ]
    )
    path = new_path(spark, "ordered-csv")
    write_result(text, path, format="csv")
    return read_customers_csv(spark, path).select("customer_id", F.col("load_order").cast("long"))


@query("scan_prune", "select o_orderkey, o_totalprice from orders where o_orderpriority = '1-URGENT'")
def scan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["o_orderkey", "o_totalprice", "o_orderpriority"]
    orders = load_table(spark, f"{sf_dir}/orders.parquet", columns=columns)
    return orders.where("o_orderpriority = '1-URGENT'").drop("o_orderpriority")


# Cleaning

TRIM_SQL = ", ".join(
    f"nullif(trim({c}, ' '), '') as {c}"
    for c in "customer_id contract monthly_charge tenure_in_months total_charges churn_label".split()
)
LAST_SQL = f"""trimmed as (select {TRIM_SQL}, load_order from dirty_retention),
last_rows as (
  select * exclude (place) from (
    select *, row_number() over (partition by customer_id order by load_order desc) as place
    from trimmed where customer_id is not null) where place = 1),
labelled as (
  select *, cast(case lower(churn_label) when 'yes' then 1 when 'no' then 0 end as smallint)
    as churn_value from last_rows)"""
DIRTY_TYPES = {
    "monthly_charge": "decimal(12,2)",
    "total_charges": "decimal(14,2)",
    "tenure_in_months": "int",
}


def trimmed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_text(load_view(spark, sf_dir, "dirty_retention"))


def last_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.keep_last(trimmed_customers(spark, sf_dir), "customer_id", "load_order")


def typed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.add_churn_value(
        cleaning.strict_cast(last_customers(spark, sf_dir), DIRTY_TYPES)
    )


query("clean_text", oracle("dirty_retention", "select * from trimmed", LAST_SQL))(trimmed_customers)
query("dedup_last", oracle("dirty_retention", "select * from last_rows", LAST_SQL))(last_customers)


@query(
    "strict_cast",
    oracle(
        "dirty_retention",
        """select customer_id, cast(cast(monthly_charge as decimal(12,2)) as double) as monthly_charge,
        cast(cast(total_charges as decimal(14,2)) as double) as total_charges,
        cast(tenure_in_months as int) as tenure_in_months from last_rows""",
        LAST_SQL,
    ),
)
def strict_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = cleaning.strict_cast(last_customers(spark, sf_dir), DIRTY_TYPES)
    return as_doubles(
        typed.select("customer_id", *DIRTY_TYPES), "monthly_charge", "total_charges"
    )


@query(
    "cast_quarantine",
    oracle(
        "dirty_retention",
        """select customer_id, churn_label, 'churn_label' as malformed_columns from last_rows
        where churn_label is not null and try_cast(churn_label as int) is null""",
        LAST_SQL,
    ),
)
def cast_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = cleaning.cast_or_quarantine(
        last_customers(spark, sf_dir), {**DIRTY_TYPES, "churn_label": "int"}
    )
    return bad.select(
        "customer_id", "churn_label", F.concat_ws(",", "malformed_columns").alias("malformed_columns")
    )


@query(
    "derive_label",
    oracle("dirty_retention", "select customer_id, churn_label, churn_value from labelled", LAST_SQL),
)
def derive_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = cleaning.add_churn_value(last_customers(spark, sf_dir))
    return labelled.select("customer_id", "churn_label", "churn_value")


@query(
    "constraint_report",
    oracle(
        "dirty_retention",
        """select 'customer_id not null' as rule, count(*) as violations from trimmed
           where customer_id is null
        union all select 'churn_label not null', count(*) from trimmed where churn_label is null
        union all select 'flag in (0, 1)', count(*) from trimmed where load_order % 4 not in (0, 1)
           and load_order % 4 <> 3
        union all select 'customer_id unique', count(*) from (
          select customer_id from trimmed where customer_id is not null
          group by customer_id having count(*) > 1)""",
        LAST_SQL,
    ),
)
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("load_order") % 4 != 3, F.col("load_order") % 4)
    return cleaning.constraint_report(
        trimmed_customers(spark, sf_dir).withColumn("flag", flag),
        "customer_id",
        binary=["flag"],
        not_null=["churn_label"],
    )


@query(
    "load_summary_customers",
    oracle(
        "dirty_retention",
        f"""select count(*) as customers,
        count(*) filter (where total_charges is null) as missing_total_charges,
        count(*) filter (where churn_value = 1) as churned_customers, {RATE_SQL} from labelled""",
        LAST_SQL,
    ),
)
def load_summary_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.customer_load_summary(typed_customers(spark, sf_dir))


# Derived features


@query(
    "tenure_band",
    oracle("retention", f"select customer_id, {_band_sql(f'({SPARSE_TENURE})', 'null')} as tenure_band from retention"),
)
def tenure_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = sparse_retention(spark, sf_dir)
    return customers.select("customer_id", tenure_band(F.col("tenure_in_months")).alias("tenure_band"))


@query(
    "business_features",
    oracle(
        "retention",
        f"""select customer_id, {_band_sql('tenure_in_months', 'null')} as tenure_band,
        {SEGMENT_SQL} as customer_segment,
        cast(monthly_charge * churn_value as double) as monthly_revenue_at_risk from retention""",
    ),
)
def business_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = add_business_features(retention(spark, sf_dir))
    return as_doubles(featured, "monthly_revenue_at_risk").select(
        "customer_id", "tenure_band", "customer_segment", "monthly_revenue_at_risk"
    )


@query(
    "model_matrix",
    oracle(
        "retention",
        f"""select customer_id, tenure_in_months, cast(monthly_charge as double) as monthly_charge,
        contract, premium_tech_support, payment_method, internet_type, cast(cltv as double) as cltv,
        {_band_sql('tenure_in_months', 'null')} as tenure_band, cast(churn_value as double) as label
        from retention""",
    ),
)
def model_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable, features = prepare_churn_xy(add_business_features(retention(spark, sf_dir)))
    return as_doubles(usable.select("customer_id", *features, "label"), "monthly_charge", "cltv")


RISK_SQL = """(3 * cast(coalesce(contract_type = 'Month-to-month', false) as int)
    + 2 * cast(coalesce(tenure < 12, false) as int)
    + cast(coalesce(tech_support = 'No', false) as int)
    + cast(coalesce(monthly_charges >= 85, false) as int)
    + cast(coalesce(payment_method = 'Electronic check', false) as int))"""
RISK_SEGMENT_SQL = f"case when {RISK_SQL} <= 2 then 'Low' when {RISK_SQL} <= 5 then 'Medium' else 'High' end"
GROUP_SQL = """case when tenure <= -1 then null when tenure <= 12 then '0-12' when tenure <= 24 then '13-24'
    when tenure <= 48 then '25-48' when tenure <= 999 then '49+' end"""


@query(
    "risk_segment",
    oracle(
        "export_customers",
        f"""select customer_id, {RISK_SQL} as risk_score, {RISK_SEGMENT_SQL} as risk_segment
        from export_customers""",
    ),
)
def risk_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.with_risk(load_view(spark, sf_dir, "export_customers")).select(
        "customer_id", "risk_score", "risk_segment"
    )


@query(
    "export_mart",
    oracle(
        "export_customers export_experiment",
        f"""select c.*, {GROUP_SQL} as tenure_group, {RISK_SQL} as risk_score,
        {RISK_SEGMENT_SQL} as risk_segment, treatment, churn_after_campaign, campaign_cost
        from export_customers c left join export_experiment e on c.customer_id = e.customer_id""",
    ),
)
def export_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.export_mart(
        load_view(spark, sf_dir, "export_customers"), load_view(spark, sf_dir, "export_experiment")
    )


VALUE_SQL = """select customer_id, p as churn_probability,
    p * coalesce(try_cast(case when customer_id % 9 = 0 then 'n/a' when customer_id % 9 = 1 then null
      else cast(cltv as string) end as double), 0) as value_at_risk from churn_scored"""


def scored_with_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    worth = F.when(F.col("customer_id") % 9 == 0, "n/a").when(
        F.col("customer_id") % 9 != 1, F.col("cltv").cast("string")
    )
    scored = (
        load_view(spark, sf_dir, "churn_scored")
        .withColumnRenamed("p", "churn_probability")
        .withColumn("cltv", worth)
    )
    return scored.withColumn("value_at_risk", value_at_risk(scored))


@query("value_at_risk", oracle("churn_scored", VALUE_SQL))
def value_at_risk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_with_value(spark, sf_dir).select(
        "customer_id", "churn_probability", "value_at_risk"
    )


@query(
    "top_value_at_risk",
    oracle("churn_scored", f"{VALUE_SQL} order by value_at_risk desc, customer_id limit 10"),
)
def top_value_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = value_at_risk_all(spark, sf_dir)
    return ranked.orderBy(F.desc("value_at_risk"), "customer_id").limit(10)


@query(
    "top_customer_profile",
    oracle(
        "churn_scored",
        f"""select customer_id, tenure_in_months, contract, internet_type,
        cast(monthly_charge as double) as monthly_charge, premium_tech_support
        from retention where customer_id in (select customer_id from ({VALUE_SQL})
          order by value_at_risk desc, customer_id limit 1)""",
    ),
)
def top_customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = value_at_risk_all(spark, sf_dir).orderBy(F.desc("value_at_risk"), "customer_id").limit(1)
    profile = retention(spark, sf_dir).join(first, "customer_id", "left_semi")
    return as_doubles(profile, "monthly_charge").drop("churn_value", "payment_method", "cltv")


@query(
    "hash_sample",
    oracle(
        "retention",
        """select customer_id, contract from retention
        order by substr(md5('42:' || customer_id), 1, 13), customer_id limit 500""",
    ),
)
def sample_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_sample(retention(spark, sf_dir), "customer_id", 500).select("customer_id", "contract")


# Reports


@query("overall_kpis", oracle("retention", f"select count(*) as customers, {CHURNED_SQL}, {RATE_SQL}, {LOST_SQL} from retention"))
def overall_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.overall_kpis(retention(spark, sf_dir))


@query(
    "kpi_long",
    oracle(
        "retention",
        """select metric, round(value, 6) as value from (
        unpivot (select cast(count(*) as double) as customers,
            cast(sum(churn_value) as double) as churned_customers,
            100.0 * avg(cast(churn_value as double)) as churn_rate_pct,
            avg(cast(monthly_charge as double)) as average_monthly_charge,
            sum(cast(monthly_charge as double) * churn_value) as monthly_revenue_at_risk
          from retention) on columns(*) into name metric value value)""",
    ),
)
def kpi_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.kpi_list(retention(spark, sf_dir)), {"value": 6})


@query(
    "churn_by_contract",
    oracle(
        "retention",
        f"""select contract, count(*) as customers, {CHURNED_SQL}, {RATE_SQL}, {AVG_CHARGE_SQL}
        from retention group by contract having count(*) >= 30
        order by churn_rate_pct desc nulls first, contract""",
    ),
)
def churn_by_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.churn_by_contract(retention(spark, sf_dir))


@query(
    "churn_by_tenure",
    oracle(
        "retention",
        f"""select tenure_band, count(*) as customers, {RATE_SQL}, {LOST_SQL} from (
          select *, {_band_sql('tenure', "'49+ months'")} as tenure_band
          from (select *, {SPARSE_TENURE} as tenure from retention))
        group by tenure_band order by min(tenure) nulls last""",
    ),
)
def churn_by_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.churn_by_tenure(sparse_retention(spark, sf_dir))


REASON_SQL = """case when churn_value = 1 then case customer_id % 5 when 0 then 'Competitor offer'
    when 1 then 'Attitude of support' when 2 then 'Price too high' when 3 then 'Moved' end end"""


@query(
    "churn_reasons",
    oracle(
        "retention",
        f"""select churn_reason, count(*) as churned_customers
        from (select *, {REASON_SQL} as churn_reason from retention)
        where churn_value = 1 and churn_reason is not null group by churn_reason""",
    ),
)
def churn_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.churn_reasons(
        retention(spark, sf_dir).withColumn("churn_reason", F.expr(REASON_SQL))
    )


@query(
    "segment_summary",
    oracle(
        "retention",
        f"""select customer_segment, count(*) as customers, {CHURNED_SQL}, {RATE_SQL},
        {AVG_CHARGE_SQL}, {LOST_SQL}
        from (select *, {SEGMENT_SQL} as customer_segment from retention)
        group by customer_segment""",
    ),
)
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.segment_summary(retention(spark, sf_dir))


@query(
    "segment_summary_distinct",
    oracle(
        "retention",
        f"""select customer_segment, count(distinct customer_id) as customers,
        round(avg(cast(churn_value as double)), 6) as churn_rate,
        round(avg(cast(monthly_charge as double)), 6) as average_monthly_charge,
        cast(sum(monthly_charge * churn_value) as double) as monthly_revenue_at_risk
        from (select *, {SEGMENT_SQL} as customer_segment from retention)
        group by customer_segment""",
    ),
)
def segment_summary_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = reports.segment_summary_distinct(add_business_features(retention(spark, sf_dir)))
    return rounded(summary, {"churn_rate": 6, "average_monthly_charge": 6})


ATTRIBUTE_SQL = """select '{0}' as attribute, {0} as level, count(*) as customers,
    round(avg(cast(churn_value as double)), 6) as churn_rate from retention group by {0}"""


@query(
    "rate_by_attribute",
    oracle(
        "retention",
        " union all ".join(ATTRIBUTE_SQL.format(c) for c in ("contract", "internet_type")),
    ),
)
def rate_by_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = reports.rate_by_attributes(retention(spark, sf_dir), ["contract", "internet_type"])
    return rounded(rates, {"churn_rate": 6})


@query(
    "rate_by_band",
    oracle(
        "retention",
        f"""select tenure_band, count(*) as customers,
        round(avg(cast(churn_value as double)), 6) as churn_rate,
        case tenure_band when '0-6 months' then 1 when '7-12 months' then 2
          when '13-24 months' then 3 when '25-48 months' then 4 else 5 end as band_order
        from (select *, {_band_sql(f'({SPARSE_TENURE})', 'null')} as tenure_band from retention)
        where tenure_band is not null group by tenure_band""",
    ),
)
def rate_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.rate_by_band(sparse_retention(spark, sf_dir)), {"churn_rate": 6})


@query(
    "charge_box_stats",
    oracle(
        "retention",
        """select q.churn_value, count(*) as customers, round(any_value(q1), 6) as first_quartile,
        round(any_value(q2), 6) as median, round(any_value(q3), 6) as third_quartile,
        min(charge) filter (where charge >= q1 - 1.5 * (q3 - q1)) as lower_whisker,
        max(charge) filter (where charge <= q3 + 1.5 * (q3 - q1)) as upper_whisker
        from charges c join q on c.churn_value = q.churn_value group by q.churn_value""",
        """charges as (select churn_value, cast(monthly_charge as double) as charge from retention),
        q as (select churn_value, quantile_cont(charge, 0.25) as q1, quantile_cont(charge, 0.5) as q2,
          quantile_cont(charge, 0.75) as q3 from charges group by churn_value)""",
    ),
)
def charge_box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = reports.box_statistics(
        retention(spark, sf_dir), "monthly_charge", "churn_value", [0, 1]
    )
    return rounded(boxes, {"first_quartile": 6, "median": 6, "third_quartile": 6})


# Marts

DASHBOARD_SQL = f"""mart as (
  select r.*, {SEGMENT_SQL} as customer_segment, {GROUP_SQL} as tenure_group,
    {RISK_SEGMENT_SQL.replace("payment_method", "e.payment_method")} as risk_segment,
    'Q' || (1 + cast(cast(monthly_charge as double) >= b.q1 as int)
              + cast(cast(monthly_charge as double) >= b.q2 as int)
              + cast(cast(monthly_charge as double) >= b.q3 as int)) as charge_band
  from retention r join export_customers e on r.customer_id = e.customer_id,
    (select quantile_cont(cast(monthly_charge as double), 0.25) as q1,
       quantile_cont(cast(monthly_charge as double), 0.5) as q2,
       quantile_cont(cast(monthly_charge as double), 0.75) as q3 from retention) b)"""
DIMENSIONS = {
    "contract": "contract",
    "tenure group": "tenure_group",
    "segment": "customer_segment",
    "charge band": "charge_band",
    "payment method": "payment_method",
    "tech support": "premium_tech_support",
    "risk segment": "risk_segment",
}
BREAKDOWN_SQL = """select '{0}' as dimension, {1} as level, count(*) as customers,
    cast(sum(churn_value) as bigint) as churned_customers,
    round(avg(cast(churn_value as double)), 6) as churn_rate,
    cast(sum(monthly_charge) filter (where churn_value = 1) as double) as revenue_at_risk
    from mart group by {1}"""


def dashboard_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention rows with every band and segment the dashboard shows."""
    customers = retention(spark, sf_dir)
    quartiles = marts.charge_quartiles(customers)
    featured = add_business_features(customers, median_charge=quartiles[1]).withColumn(
        "charge_band", marts.charge_band(F.col("monthly_charge"), quartiles)
    )
    payment = F.when(F.col("payment_method") == "AUTOMOBILE", "Electronic check").otherwise(
        F.col("payment_method")
    )
    contract = F.when(F.col("contract") == "Month-to-Month", "Month-to-month").otherwise(
        F.col("contract")
    )
    rules = marts.with_risk(
        featured.select(
            "*",
            contract.alias("contract_type"),
            F.col("tenure_in_months").alias("tenure"),
            F.col("premium_tech_support").alias("tech_support"),
            F.col("monthly_charge").alias("monthly_charges"),
            F.col("payment_method").alias("_payment"),
        ).withColumn("payment_method", payment)
    )
    return rules.withColumn("payment_method", F.col("_payment")).withColumn(
        "tenure_group", marts.export_tenure_group(F.col("tenure"))
    )


@query(
    "dashboard_breakdowns",
    oracle(
        "export_customers",
        " union all ".join(BREAKDOWN_SQL.format(n, c) for n, c in DIMENSIONS.items()),
        DASHBOARD_SQL,
    ),
)
def dashboard_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = dashboard_customers(spark, sf_dir)
    return rounded(marts.dashboard_breakdowns(mart, DIMENSIONS), {"churn_rate": 6})


@query(
    "dashboard_sliced",
    oracle(
        "export_customers",
        """select contract, internet_type, 'segment' as dimension, customer_segment as level,
        count(*) as customers, cast(sum(churn_value) as bigint) as churned_customers,
        round(avg(cast(churn_value as double)), 6) as churn_rate,
        cast(sum(monthly_charge) filter (where churn_value = 1) as double) as revenue_at_risk
        from mart group by contract, internet_type, customer_segment""",
        DASHBOARD_SQL,
    ),
)
def dashboard_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = marts.dashboard_breakdowns(
        dashboard_customers(spark, sf_dir),
        {"segment": "customer_segment"},
        slicers=["contract", "internet_type"],
    )
    return rounded(sliced, {"churn_rate": 6})


@query(
    "dashboard_cards",
    oracle(
        "export_customers",
        """select count(*) as customers, round(avg(cast(churn_value as double)), 6) as churn_rate,
        round(cast(sum(monthly_charge) as double), 2) as monthly_revenue,
        round(cast(sum(monthly_charge) filter (where churn_value = 1) as double), 2) as revenue_at_risk,
        count(*) filter (where risk_segment = 'High') as high_risk_customers,
        round(count(*) filter (where risk_segment = 'High') * (cast(0.05 as double) * 480 - 10), 2)
          as expected_campaign_profit from mart""",
        DASHBOARD_SQL,
    ),
)
def dashboard_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = marts.dashboard_cards(
        dashboard_customers(spark, sf_dir), retained_value=480.0, campaign_cost=10.0, reduction=0.05
    )
    return rounded(
        cards,
        {"churn_rate": 6, "monthly_revenue": 2, "revenue_at_risk": 2, "expected_campaign_profit": 2},
    )


SLICERS = ["contract", "internet_type", "tenure_group", "payment_method"]


@query(
    "dashboard_slices",
    oracle(
        "export_customers",
        f"""select {", ".join(SLICERS)}, cast(grouping({", ".join(SLICERS)}) as bigint) as grouping, count(*) as customers,
        cast(sum(churn_value) as bigint) as churned_customers, round(avg(cast(churn_value as double)), 6) as churn_rate,
        cast(sum(monthly_charge) filter (where churn_value = 1) as double) as revenue_at_risk
        from mart group by cube ({", ".join(SLICERS)})""",
        DASHBOARD_SQL,
    ),
)
def dashboard_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of the four slicers."""
    return rounded(marts.dashboard_slices(dashboard_customers(spark, sf_dir), SLICERS), {"churn_rate": 6})


ACTION_SQL = {
    "Short tenure": "tenure_in_months <= 6",
    "Month-to-month contract": "contract = 'Month-to-Month'",
    "No technical support": "coalesce(premium_tech_support, 'No') <> 'Yes'",
    "High monthly charge": f"cast(monthly_charge as double) >= {MEDIAN_SQL}",
}


@query(
    "retention_actions",
    oracle(
        "retention",
        " union all ".join(
            f"""select customer_id, '{s}' as signal, '{meaning}' as interpretation,
            '{action}' as possible_action from retention where {ACTION_SQL[s]}"""
            for s, meaning, action in marts.RETENTION_ACTIONS
        ),
    ),
)
def retention_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = retention(spark, sf_dir)
    median = reports.exact_median(customers, "monthly_charge")
    signals = {s: F.expr(sql) for s, sql in ACTION_SQL.items() if "select" not in sql}
    signals["High monthly charge"] = F.col("monthly_charge").cast("double") >= F.lit(median)
    return marts.retention_actions(customers, signals)
