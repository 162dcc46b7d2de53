"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Strip spaces (spaces only, tabs stay) and turn an empty rest into NULL."""
    return F.nullif(F.btrim(c), F.lit(""))


def normalised(c: Column) -> Column:
    """NULL to empty, strip every kind of white space, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", ""))


def column_or_default(df: DataFrame, name: str, default: Column) -> Column:
    """``df[name]`` if the frame has it, else ``default``."""
    return F.col(name) if name in df.columns else default
