"""Stratified splits, folds and samples as predicates on a key hash.

The exact number of rows per stratum is taken in hash order, but nothing is sorted
or shuffled: the hash value at the cut is found by ``top_cuts`` and the split is a
row-local condition. Wide rows never move and any re-evaluation agrees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.hashing import hash_number
from stayline.operators.quantiles import TopCut, position_among, top_cuts


def require_keys(df: DataFrame, key: str) -> None:
    """Refuse rows without a key: no hash can place them, and a predicate would lose them."""
    if df.where(F.col(key).isNull()).limit(1).count():
        raise ValueError(f"{key} must not be NULL: rows without it cannot be placed")


def strata_sizes(df: DataFrame, stratum: Column) -> dict[object, int]:
    """Rows per stratum; strata are a handful by design (classes, arms)."""
    sizes = df.groupBy(stratum.alias("s")).agg(F.count(F.lit(1)).alias("rows"))
    found = {row["s"]: row["rows"] for row in sizes.where("s is not null").collect()}
    return dict(sorted(found.items()))


def _hash_cuts(
    df: DataFrame,
    key: str,
    stratum: Column,
    seed: int | str,
    sizes: Callable[[int], Sequence[int]],
) -> tuple[Column, dict[object, list[TopCut]]]:
    """Cuts of the smallest hashes per stratum (the score is the negated hash)."""
    require_keys(df, key)
    score = -hash_number(seed, F.col(key)).cast("double")
    rows = strata_sizes(df, stratum)
    names = {f"s{i}": v for i, v in enumerate(rows)}
    _, cuts = top_cuts(
        df,
        {n: score for n in names},
        key,
        {n: sizes for n in names},
        where={n: stratum == F.lit(v) for n, v in names.items()},
        counts={n: rows[v] for n, v in names.items()},
    )
    return score, {v: cuts[n] for n, v in names.items()}


def is_test_row(
    df: DataFrame, key: str, stratum: Column, fraction: float, seed: int | str
) -> Column:
    """True for ceil(fraction * n) rows of every stratum."""
    score, cuts = _hash_cuts(df, key, stratum, seed, lambda n: [math.ceil(fraction * n)])
    out = F.lit(False)
    for value, (cut,) in cuts.items():
        out = F.when(stratum == F.lit(value), cut.contains(score, F.col(key))).otherwise(out)
    return out


def stratified_split(
    df: DataFrame, key: str, stratum: Column, fraction: float, seed: int | str = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test); rows without a stratum belong to neither."""
    test = is_test_row(df, key, stratum, fraction, seed)
    known = df.where(stratum.isNotNull())
    return known.where(~test), known.where(test)


def assign_folds(
    df: DataFrame,
    key: str,
    stratum: Column,
    folds: int = 5,
    seed: int | str = 42,
    name: str = "fold",
) -> DataFrame:
    """Add fold 0..folds-1: row r of n in hash order gets floor(r * folds / n)."""

    def sizes(n: int) -> list[int]:
        return [-(-i * n // folds) for i in range(1, folds)]

    score, cuts = _hash_cuts(df, key, stratum, f"{seed}:fold", sizes)
    hashed = df.withColumn("_hash", score)
    fold = F.lit(None).cast("int")
    for value, edges in cuts.items():
        inner = position_among(edges, F.col("_hash"), F.col(key))
        fold = F.when(stratum == F.lit(value), inner).otherwise(fold)
    return hashed.withColumn(name, fold).drop("_hash")


def hash_sample(df: DataFrame, key: str, rows: int, seed: int | str = 42) -> DataFrame:
    """At most ``rows`` rows, the same ones under any layout.

    The sample is a predicate, so it never meets in one task, whatever its size.
    """
    require_keys(df, key)
    score = -hash_number(seed, F.col(key)).cast("double")
    _, cuts = top_cuts(df, {"h": score}, key, {"h": lambda n: [rows]})
    return df.where(cuts["h"][0].contains(score, F.col(key)))
