"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.session import stage

_MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for the long columns u and v.

    Each round hangs the larger neighbours of every node, then the smaller ones, on the
    smallest it knows; it is over when every component is a star. Nodes without an edge to
    another node do not come up. A node with many neighbours is one row of the small side of
    each join, and its edges can be split over tasks.
    """
    edges = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = _state(edges)
    for _ in range(_MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("w", F.least("u", "w"))
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        larger = stage(larger, "larger")
        least = larger.groupBy("u").agg(F.min("v").alias("w"))
        moved = larger.join(least, "u")
        edges = stage(
            moved.select("u", F.col("w").alias("v"))
            .unionByName(moved.where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")))
            .distinct(),
            "edges",
        )
        after = _state(edges)
        if after == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
    raise RuntimeError(f"components not found in {_MOST_ROUNDS} rounds")
