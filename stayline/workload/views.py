"""The two populations, derived from the supplied tables.

One SQL text per view serves Spark and the SQL the results are checked with; only
file access and the day difference are spelled differently. Orders play the
customers, events play the campaign rows. ``label_draw`` and ``outcome_draw`` decide
the synthetic labels and never leave the views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayline.sources.schemas import CATEGORICAL_COVARIATES, NUMERIC_COVARIATES


def spark_dialect(sf_dir: str) -> dict[str, str]:
    return {
        "orders": f"parquet.`{sf_dir}/orders.parquet`",
        "customer": f"parquet.`{sf_dir}/customer.parquet`",
        "events": f"parquet.`{sf_dir}/events.parquet`",
        "months": "datediff(newest, o_orderdate) div 30",
    }


DUCKDB_DIALECT = {
    "orders": "orders",
    "customer": "customer",
    "events": "events",
    "months": "date_diff('day', o_orderdate, newest) // 30",
}

_RETENTION = """
retention_base as (
  select o_orderkey as customer_id, cast({months} as int) as tenure_in_months,
    cast(o_totalprice / 4000 as decimal(12,2)) as monthly_charge,
    case when o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') then 'Month-to-Month'
         when o_orderpriority = '4-NOT SPECIFIED' then 'One Year' else 'Two Year' end as contract,
    case c_mktsegment when 'BUILDING' then 'Yes' when 'MACHINERY' then null else 'No' end
      as premium_tech_support,
    c_mktsegment as payment_method,
    case c_nationkey % 4 when 0 then 'Fiber Optic' when 1 then 'DSL' when 2 then 'Cable'
         else null end as internet_type,
    cast(c_acctbal as decimal(14,2)) as cltv,
    ((o_orderkey % 10007) * (o_orderkey % 10007) * 31 + (o_orderkey % 10007) * 17 + 11)
      % 10007 % 100 as label_draw
  from (select *, (select max(o_orderdate) from {orders}) as newest from {orders}) o
       join {customer} c on o_custkey = c_custkey),
retention as (
  select customer_id, tenure_in_months, monthly_charge, contract, premium_tech_support,
    payment_method, internet_type, cltv,
    case when label_draw < 8 + case when contract = 'Month-to-Month' then 22 else 0 end
                             + case when tenure_in_months <= 12 then 25 else 0 end
                             + case when premium_tech_support = 'Yes' then -5 else 0 end
         then 1 else 0 end as churn_value
  from retention_base)"""

_CAMPAIGN = """
campaign_base as (
  select event_id as campaign_row_id, value as pc1, hour(ts) as pc2,
    cast(regexp_extract(props, '([0-9]+)', 1) as int) as pc3,
    event_type as factor1, cast(user_id % 5 as string) as factor2,
    case when ((event_id % 10007) * (event_id % 10007) * 31 + (event_id % 10007) * 17 + 11)
      % 10007 % 100 < 30 then 1 else 0 end as t,
    ((event_id % 10009) * (event_id % 10009) * 57 + (event_id % 10009) * 101 + 7)
      % 10009 % 1000 as outcome_draw
  from {events}),
campaign as (
  select campaign_row_id, pc1, pc2, pc3, factor1, factor2, t,
    case when outcome_draw < 150 + case when factor1 = 'error' then 150 else 0 end
                                 + case when pc1 > 60 then 60 else 0 end
           - t * case when factor1 = 'error' then 120 when factor1 = 'signup' then -30 else 20 end
         then 1 else 0 end as y
  from campaign_base)"""

# The campaign at the full width of its layout: 160 numbers and 18 factors, some missing.
_WIDE_NUMBERS = ", ".join(
    f"""case when (campaign_row_id + {i}) % {37 + i} = 0 then null
      else cast((campaign_row_id * {2 * i + 1} + pc2 * {i}) % {89 + i}
        + case when campaign_row_id % {2 + i % 5} = 0 then t * {i % 11} else 0 end as double) end as pc{i}"""
    for i in range(4, NUMERIC_COVARIATES + 1)
)
_WIDE_FACTORS = ", ".join(
    f"""case when (campaign_row_id + {i}) % {23 + i} = 0 then null
      else cast((campaign_row_id * {i} + pc2) % {2 + i % 5} as string) end as factor{i}"""
    for i in range(3, CATEGORICAL_COVARIATES + 1)
)
_CAMPAIGN_WIDE = f"""
campaign_wide as (
  select campaign_row_id, t, y, cast(pc1 as double) as pc1, cast(pc2 as double) as pc2,
    cast(pc3 as double) as pc3, {_WIDE_NUMBERS}, factor1, factor2, {_WIDE_FACTORS}
  from campaign)"""

_CAMPAIGN_SCORED = """
campaign_points as (
  select campaign_row_id, t, y,
    cast(150 + case when factor1 = 'error' then 150 else 0 end
         + case when pc1 > 60 then 60 else 0 end + campaign_row_id % 97 as double)
      / cast(1000 as double) as p_churn_control,
    cast(150 + case when factor1 in ('error', 'signup') then 30 else -20 end
         + case when pc1 > 60 then 60 else 0 end + campaign_row_id % 89 as double)
      / cast(1000 as double) as p_churn_treated
  from campaign),
campaign_scored as (
  select *, p_churn_control - p_churn_treated as predicted_uplift from campaign_points)"""

_CHURN_SCORED = """
churn_scored as (
  select customer_id, churn_value as y, monthly_charge, cltv,
    cast(8 + case when contract = 'Month-to-Month' then 22 else 0 end
           + case when tenure_in_months <= 12 then 25 else 0 end
           - case when premium_tech_support = 'Yes' then 5 else 0 end
           + customer_id % 53 as double) / cast(120 as double) as p
  from retention)"""

# Raw text with blanks, padding, repeated keys and unusable values.
_DIRTY_RETENTION = """
dirty_first as (
  select case when customer_id % 11 = 0 then '  ' || cast(customer_id as string) || ' '
              when customer_id % 101 = 7 then '   ' else cast(customer_id as string) end as customer_id,
    case when customer_id % 11 = 1 then '' when customer_id % 11 = 2 then '    '
         else ' ' || contract || '  ' end as contract,
    case when customer_id % 11 = 3 then ' ' else cast(monthly_charge as string) || ' ' end
      as monthly_charge,
    case when customer_id % 11 = 4 then null else cast(tenure_in_months as string) end
      as tenure_in_months,
    case when customer_id % 11 = 5 then '   '
         else cast(cast(monthly_charge * tenure_in_months as decimal(14,2)) as string) end
      as total_charges,
    case when customer_id % 11 = 6 then 'maybe' when customer_id % 11 = 7 then ' '
         when churn_value = 1 then case when customer_id % 2 = 0 then 'Yes' else ' yes ' end
         else case when customer_id % 2 = 0 then 'No' else 'no' end end as churn_label,
    customer_id as load_order
  from retention),
dirty_retention as (
  select * from dirty_first
  union all
  select customer_id, 'Two Year', monthly_charge, '99', total_charges, 'No',
    load_order + 1000000000000 as load_order
  from dirty_first where load_order % 7 = 0)"""

_DIRTY_CAMPAIGN = """
dirty_campaign as (
  select campaign_row_id, cast(pc1 as string) as pc1, factor1,
    case when campaign_row_id % 13 = 0 then null when campaign_row_id % 13 = 1 then '2'
         when campaign_row_id % 13 = 2 then ' ' when campaign_row_id % 13 = 3 then '1.0'
         else cast(y as string) end as y,
    case when campaign_row_id % 17 = 0 then 'x' when campaign_row_id % 17 = 1 then null
         else cast(t as string) end as t
  from campaign)"""

# The older export layout; some customers have two experiment rows, many have none.
_EXPORT_CUSTOMERS = """
export_customers as (
  select customer_id, tenure_in_months as tenure,
    case when contract = 'Month-to-Month' then 'Month-to-month' else contract end as contract_type,
    premium_tech_support as tech_support, cast(monthly_charge as double) as monthly_charges,
    case when payment_method = 'AUTOMOBILE' then 'Electronic check' else payment_method end
      as payment_method
  from retention)"""

_EXPORT_EXPERIMENT = """
experiment_first as (
  select campaign_row_id as customer_id, t as treatment, y as churn_after_campaign,
    cast(10 + campaign_row_id % 3 as double) as campaign_cost
  from campaign),
export_experiment as (
  select * from experiment_first
  union all
  select customer_id, 1 - treatment, churn_after_campaign, campaign_cost + 1
  from experiment_first where customer_id % 5 = 0)"""

_TEXTS = {
    "export_customers": _EXPORT_CUSTOMERS,
    "export_experiment": _EXPORT_EXPERIMENT,
    "retention": _RETENTION,
    "campaign": _CAMPAIGN,
    "campaign_wide": _CAMPAIGN_WIDE,
    "campaign_scored": _CAMPAIGN_SCORED,
    "churn_scored": _CHURN_SCORED,
    "dirty_retention": _DIRTY_RETENTION,
    "dirty_campaign": _DIRTY_CAMPAIGN,
}
_NEEDS = {
    "export_customers": ["retention"],
    "export_experiment": ["campaign"],
    "retention": [],
    "campaign": [],
    "campaign_wide": ["campaign"],
    "campaign_scored": ["campaign"],
    "churn_scored": ["retention"],
    "dirty_retention": ["retention"],
    "dirty_campaign": ["campaign"],
}


def with_views(views: str, dialect: dict[str, str]) -> str:
    """``with ...`` text that defines the space-separated ``views`` and their sources."""
    wanted = list(dict.fromkeys(n for v in views.split() for n in [*_NEEDS[v], v]))
    return "with " + ",".join(_TEXTS[v].format(**dialect) for v in wanted)


def load_view(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return spark.sql(f"{with_views(view, spark_dialect(sf_dir))}\nselect * from {view}")


def view_over(spark: SparkSession, view: str, **sources: DataFrame) -> DataFrame:
    """``view`` with the views it needs given as frames."""
    given = ", ".join(f"{name} as (select * from {{{name}}})" for name in sources)
    return spark.sql(f"with {given},{_TEXTS[view]}\nselect * from {view}", **sources)


def oracle(views: str, query: str, more: str = "") -> str:
    """DuckDB text of ``query`` over ``views`` (and further ``more`` CTEs)."""
    extra = f",\n{more}" if more else ""
    return f"{with_views(views, DUCKDB_DIALECT)}{extra}\n{query}"
