"""Numeric column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    value = c.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(math.inf)), F.lit(None)).otherwise(value)


GROUP_COLUMNS = 32  # columns aggregated together: the generated code of more is not compiled


def column_groups(columns: Sequence[str]) -> list[list[str]]:
    return [list(columns[i : i + GROUP_COLUMNS]) for i in range(0, len(columns), GROUP_COLUMNS)]


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in double; NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def edge_index(c: Column, edges: Sequence[float]) -> Column:
    """How many of a few ``edges`` are <= ``c`` (NULL stays NULL)."""
    return sum(((c >= F.lit(float(e))).cast("int") for e in edges), F.lit(0))


def with_step(df: DataFrame, column: str, edges: Sequence[float], name: str) -> DataFrame:
    """Add how many of the ascending ``edges`` are <= ``column``, by binary search."""
    search = Bucketizer(
        splits=[-math.inf, *edges, math.inf], inputCol=column, outputCol=name, handleInvalid="skip"
    )
    return search.transform(df).withColumn(name, F.col(name).cast("int"))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail probability; applied to aggregated rows only."""
    tail = np.frompyfunc(math.erfc, 1, 1)(np.abs(z.to_numpy(float)) / math.sqrt(2.0))
    return pd.Series(tail.astype(float))
