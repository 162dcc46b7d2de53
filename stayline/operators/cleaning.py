"""Cleaning, typing and integrity rules for the two raw tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.functions.numbers import finite_or_null
from stayline.functions.text import blank_to_null
from stayline.session import stage
from stayline.sources.schemas import CAMPAIGN_TYPES, CUSTOMER_TYPES


def clean_text(df: DataFrame) -> DataFrame:
    """Trim every text column and turn blanks into NULL, in one projection."""
    return df.select(
        *[
            blank_to_null(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per non-null ``key``: the one with the greatest ``order``.

    Catalyst limits each key to one row per task before the shuffle
    (WindowGroupLimit), so a key that holds a third of all rows stays cheap.
    """
    newest_first = Window.partitionBy(key).orderBy(F.col(order).desc())
    return (
        df.where(F.col(key).isNotNull())
        .withColumn("_place", F.row_number().over(newest_first))
        .where("_place = 1")
        .drop("_place")
    )


def _malformed(c: Column, data_type: str) -> Column:
    return c.isNotNull() & c.try_cast(data_type).isNull()


def strict_cast(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast text columns; the job fails on the first malformed value.

    Independent of the session's ANSI setting.
    """

    def typed(name: str) -> Column:
        c = F.col(name)
        message = F.concat(F.lit(f"malformed {types[name]} in {name}: "), c.cast("string"))
        return (
            F.when(_malformed(c, types[name]), F.raise_error(message).cast(types[name]))
            .otherwise(c.try_cast(types[name]))
            .alias(name)
        )

    return df.select(*[typed(c) if c in types else F.col(c) for c in df.columns])


def cast_or_quarantine(
    df: DataFrame, types: Mapping[str, str]
) -> tuple[DataFrame, DataFrame]:
    """(typed good rows, raw bad rows with the list of ``malformed_columns``)."""
    bad = F.array_compact(
        F.array(*[F.when(_malformed(F.col(c), t), F.lit(c)) for c, t in types.items()])
    )
    marked = df.withColumn("malformed_columns", bad)
    good = marked.where(F.size("malformed_columns") == 0)
    return (
        good.select(
            *[
                F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c)
                for c in df.columns
            ]
        ),
        marked.where(F.size("malformed_columns") > 0),
    )


def add_churn_value(df: DataFrame, label: str = "churn_label") -> DataFrame:
    """yes/no in any case to 1/0 as smallint; anything else NULL."""
    answer = F.lower(F.col(label))
    value = F.when(answer == "yes", 1).when(answer == "no", 0)
    return df.withColumn("churn_value", value.cast("short"))


def valid_binary(df: DataFrame, columns: Sequence[str] = ("y", "t")) -> DataFrame:
    """Keep rows whose text in every column is exactly '0' or '1'."""
    for c in columns:
        df = df.where(F.col(c).isin("0", "1"))
    return df


def infinite_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating-point column."""
    return df.select(
        *[
            finite_or_null(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def constraint_report(
    df: DataFrame, key: str, *, binary: Sequence[str] = (), not_null: Sequence[str] = ()
) -> DataFrame:
    """``rule``, ``violations``: key present and unique, columns in {0,1} (NULL
    passes the check), columns present."""
    required = [key, *[c for c in not_null if c != key]]
    checks = {f"{c} not null": F.count_if(F.col(c).isNull()) for c in required}
    checks |= {
        f"{c} in (0, 1)": F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(0, 1)) for c in binary
    }
    row_rules = df.agg(*[c.alias(rule) for rule, c in checks.items()])
    rules = row_rules.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("violations"))
                    for rule in checks
                ]
            )
        ).alias("r")
    ).select("r.rule", "r.violations")
    repeated = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .agg(F.coalesce(F.count_if(F.col("rows") > 1), F.lit(0)).alias("violations"))
        .select(F.lit(f"{key} unique").alias("rule"), "violations")
    )
    return rules.unionByName(repeated)


def enforce_constraints(
    df: DataFrame, key: str, *, binary: Sequence[str] = (), not_null: Sequence[str] = ()
) -> DataFrame:
    """Write ``df`` once, check what was written, and return a reader of it; ValueError
    names the broken rules. So what is published later is what was checked."""
    df = stage(df, "checked")
    report = constraint_report(df, key, binary=binary, not_null=not_null)
    broken = {r["rule"]: r["violations"] for r in report.where("violations > 0").collect()}
    if broken:
        raise ValueError(f"Constraint violations: {broken}")
    return df


def clean_customers(raw: DataFrame, order: str = "load_order") -> DataFrame:
    """Raw customer text to the typed customer table with ``churn_value``."""
    typed = strict_cast(keep_last(clean_text(raw), "customer_id", order), CUSTOMER_TYPES)
    return add_churn_value(typed).drop(order)


def clean_campaign(raw: DataFrame) -> DataFrame:
    """Raw campaign text (with ``campaign_row_id``) to the typed campaign table."""
    return strict_cast(valid_binary(clean_text(raw)), CAMPAIGN_TYPES)


def customer_load_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("total_charges").isNull()).alias("missing_total_charges"),
        F.count_if(F.col("churn_value") == 1).alias("churned_customers"),
        F.round(100.0 * F.avg("churn_value"), 2).alias("churn_rate_pct"),
    )


def campaign_load_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("imported_rows"),
        F.count_distinct("campaign_row_id").alias("unique_rows"),
        F.count_if(F.col("t") == 0).alias("control_customers"),
        F.count_if(F.col("t") == 1).alias("treated_customers"),
        F.count_if(F.col("y") == 1).alias("churned_customers"),
        F.round(100.0 * F.avg("y"), 2).alias("churn_rate_pct"),
    )
