"""Exact global positions and running sums over any number of rows.

Never an un-partitioned window over data rows. The rows are range-partitioned and
sorted by the full (unique) order once; the position inside its partition is then
known without another shuffle. Only one row per part (partition or block) and group
goes through the un-partitioned step, so its size does not grow with a group or tie.

The order must be unique (end it with a key). That also keeps the partitions even
when one score holds a large share of the rows: the key splits the tie.
"""

from __future__ import annotations

import math

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import stage

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row number below
_BLOCK_BITS = 20  # rows of a running-sum block: about a million
_MOST_BLOCKS = 500_000  # larger tables get larger blocks


def _positioned(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Staged rows with ``_pos``: range partition and place in it, in one number."""
    full_order = [F.col(name).asc() for name in by] + list(order)
    placed = (
        df.repartitionByRange(*full_order)
        .sortWithinPartitions(*full_order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    return stage(placed, "order")


def _preceding(parts: DataFrame, by: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Per group, sums of ``values`` over the earlier partitions (one row per part)."""
    earlier = (
        Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0)
    return parts.select(
        *by,
        "_part",
        *[c for c in parts.columns if c not in {*by, "_part", *values}],
        *[F.coalesce(F.sum(v).over(earlier), zero).alias(out) for v, out in values.items()],
    )


def _attach(rows: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join the offsets of the parts to the rows.

    Broadcast is bounded by construction: because groups lead the sort order there are
    at most (range partitions + groups) parts, plus ``_MOST_BLOCKS`` for running sums.
    """
    right = parts.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_part").alias("_right_part"),
        *[c for c in parts.columns if c not in {*by, "_part"}],
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by],
        F.col("_part") == F.col("_right_part"),
    )
    return rows.join(F.broadcast(right), same).drop("_right_part", *[f"_by_{c}" for c in by])


def global_rank(
    df: DataFrame, order: Sequence[Column], *, by: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Add the 0-based rank in ``order`` inside each ``by`` group. One range shuffle."""
    rows = _positioned(df, by, order).withColumn("_part", F.shiftright("_pos", _ROW_BITS))
    parts = rows.groupBy(*by, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_first")
    )
    offsets = _preceding(parts, by, {"_rows": "_before"}).drop("_rows")
    return (
        _attach(rows, offsets, by)
        .withColumn(name, F.col("_pos") - F.col("_first") + F.col("_before"))
        .select(*df.columns, name)
    )


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    *,
    by: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """Add the 0-based rank and inclusive running sums in ``order`` per ``by`` group.

    The running sum is local to a block of consecutive rows (about a million, whatever
    the group sizes) and shifted by the total of the earlier blocks.
    """
    rows = _positioned(df.withColumns({f"_in_{k}": v for k, v in sums.items()}), by, order)
    bits = max(_BLOCK_BITS, math.ceil(math.log2(rows.count() / _MOST_BLOCKS + 1)))
    rows = rows.withColumn("_part", F.shiftright("_pos", min(bits, _ROW_BITS)))
    parts = rows.groupBy(*by, "_part").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("_pos").alias("_first"),
        *[F.sum(f"_in_{k}").alias(f"_sum_{k}") for k in sums],
    )
    offsets = _preceding(
        parts, by, {"_rows": "_before", **{f"_sum_{k}": f"_before_{k}" for k in sums}}
    )
    offsets = offsets.drop("_rows", *[f"_sum_{k}" for k in sums])
    so_far = (
        Window.partitionBy(*by, "_part")
        .orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.withColumns({f"_local_{k}": F.sum(f"_in_{k}").over(so_far) for k in sums})
    return (
        _attach(local, offsets, by)
        .withColumn(name, F.col("_pos") - F.col("_first") + F.col("_before"))
        .withColumns({k: F.col(f"_local_{k}") + F.col(f"_before_{k}") for k in sums})
        .select(*df.columns, name, *sums)
    )
