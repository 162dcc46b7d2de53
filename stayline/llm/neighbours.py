"""Nearest neighbours by vantage-point trees, one tree for each shard of the vectors.

A node holds a vantage point and splits the others into halves by their distance to it;
every half keeps its smallest and largest distance. By the triangle inequality a half whose
distances leave a gap to the query's own cannot hold anything nearer than the gap. A half
is skipped if ``factor`` times its gap is beyond the k-th best found so far: with factor 1
the search is exact, larger factors skip more and may miss neighbours.

Shards are written once as packed trees; blocks of queries are dealt to the shards by
equi-joins, and the partial lists are merged by query.

Defined results: vectors that are null, zero, or hold null or non-finite components take no
part, neither as queries nor as candidates; nor do rows without a vec_id. Vectors of different
lengths have no distance and are kept in shards apart. Rows that repeat a vec_id count once for
each different vector as candidates and share one list as queries; a query never finds its own
vec_id. Equal distances go to the smaller vec_id. An empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import stage

SHARD_ROWS = 4_096
QUERY_ROWS = 512
_LEAF = 48


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles) and its length, for vectors that take part."""
    vector = F.col(vector_column).cast("array<double>")
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
        .where("vec_id is not null and vector is not null")
        .where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .where(~F.forall("vector", lambda x: x == 0))
        .withColumn("length", F.size("vector"))
        .dropDuplicates()
    )


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    difference = points - query
    return np.sqrt(np.einsum("ij,ij->i", difference, difference))


class Tree:
    """Rows in tree order and, for each node, its range of rows and the ranges of distances.

    Node i covers rows first[i] .. last[i]. In an inner node the first row is the vantage
    point, the next ones up to ``middle`` are the nearer half. ``near`` and ``far`` hold the
    smallest and largest distance to the vantage point in either half.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        children: list[list[int]] = []
        ranges = []
        while todo:
            first, last, parent, side = todo.pop()
            node = len(ranges)
            ranges.append([first, last, -1, 0.0, 0.0, 0.0, 0.0])
            children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = node
            if last - first <= _LEAF:
                continue
            pick = first + rng.integers(last - first)
            order[[first, pick]] = order[[pick, first]]
            rest = order[first + 1 : last]
            away = distances(points[rest], points[order[first]])
            half = len(rest) // 2
            split = np.argpartition(away, half)
            order[first + 1 : last] = rest[split]
            away = away[split]
            ranges[node][2:] = [
                first + 1 + half,
                away[:half].min(),
                away[:half].max(),
                away[half:].min(),
                away[half:].max(),
            ]
            todo += [(first + 1, first + 1 + half, node, 0), (first + 1 + half, last, node, 1)]
        self.ids, self.points = ids[order], points[order]
        self.ranges, self.children = ranges, children

    def search(self, own: int, query: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest to ``query`` other than id ``own``: distances and ids, nearest first."""
        best_d, best_i = np.empty(0), np.empty(0, np.int64)
        worst = np.inf

        def offer(d: np.ndarray, ids: np.ndarray) -> None:
            nonlocal best_d, best_i, worst
            good = (d <= worst) & (ids != own)
            if good.any():
                d, ids = np.concatenate([best_d, d[good]]), np.concatenate([best_i, ids[good]])
                first = np.lexsort((ids, d))[:k]
                best_d, best_i = d[first], ids[first]
                if len(best_d) == k:
                    worst = best_d[-1]

        todo = [(0.0, 0)]
        while todo:
            gap, node = todo.pop()
            if gap * factor * (1 - 1e-12) > worst:
                continue
            first, last, middle, near0, near1, far0, far1 = self.ranges[node]
            if middle < 0:
                offer(distances(self.points[first:last], query), self.ids[first:last])
                continue
            to = distances(self.points[first : first + 1], query)
            offer(to, self.ids[first : first + 1])
            d = float(to[0])
            gaps = [max(near0 - d, d - near1, 0.0), max(far0 - d, d - far1, 0.0)]
            sides = [0, 1] if gaps[0] > gaps[1] or (gaps[0] == gaps[1] and d > near1) else [1, 0]
            todo += [(gaps[s], self.children[node][s]) for s in sides]  # the nearer side is popped first
        return best_d, best_i


def pack(points: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard: length, shard, ids and points as bytes."""
    counts = points.groupBy("length").count().withColumn("shards", F.ceil(F.col("count") / shard_rows).cast("int"))
    salted = points.join(counts.select("length", "shards"), "length").withColumn(
        "shard", F.pmod(F.xxhash64("vec_id", "vector"), F.col("shards")).cast("int")
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        return pd.DataFrame(
            {
                "length": group["length"].iloc[:1].to_numpy(),
                "shard": group["shard"].iloc[:1].to_numpy(),
                "ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
                "points": [np.array(group["vector"].tolist(), np.float64).tobytes()],
            }
        )

    return salted.groupBy("length", "shard").applyInPandas(
        run, "length int, shard int, ids binary, points binary"
    )


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    factor: float = 1.0,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score (the distance) for every row that fulfils ``queries``."""
    known = stage(usable(vectors), "vectors")
    shards = stage(pack(known, shard_rows), "shards")
    asked = known.where(queries)
    blocks = asked.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("blocks"))
    per_length = shards.groupBy("length").agg(F.max("shard").alias("last_shard"))
    dealt_queries = (
        asked.join(blocks, "length")
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        .join(per_length, "length")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last_shard"))))
        .select("length", "shard", "block", "vec_id", "vector")
    )
    dealt_shards = shards.join(blocks, "length").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )

    def run(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(shard) and len(asked):
            ids = np.frombuffer(shard["ids"].iloc[0], np.int64)
            points = np.frombuffer(shard["points"].iloc[0], np.float64).reshape(len(ids), -1)
            tree = Tree(ids, points)
            for own, query in zip(asked["vec_id"], asked["vector"], strict=True):
                d, i = tree.search(own, np.asarray(query, np.float64), k, factor)
                found.append(pd.DataFrame({"query_id": own, "vec_id": i, "score": d}))
        if not found:
            return pd.DataFrame(columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return pd.concat(found)

    keys = ["length", "shard", "block"]
    partial = (
        dealt_shards.groupBy(*keys)
        .cogroup(dealt_queries.groupBy(*keys))
        .applyInPandas(run, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
