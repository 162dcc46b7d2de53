"""Exact order statistics, quantiles and top-n cuts by narrowing.

``percentile`` keeps every distinct value of a column in one aggregation buffer and
a global sort moves every row. Here a quantile sketch (one summary of bounded size for
each task and column) brackets each wanted rank, counts confirm the bracket, and only the
few values inside it are grouped and ranked. No row of the table is shuffled.

The passes read the compared columns alone, written once as doubles: whatever lies behind
the input (joins, scores, expressions) runs once and not again for every pass. Tasks look at
batches of a column as arrays, so that hundreds of columns are narrowed in the same passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.numbers import finite_or_null
from stayline.operators.ordering import global_rank
from stayline.session import stage

SKETCH_POINTS = 2048  # a sketch's points, each standing for as many values; the ends are kept
CHUNK = 1 << 15  # values, or points, of a sketch that are thinned together
FEW_VALUES = 500  # values left in a bracket that are ranked at last; tables of any size narrow to it
FEW_EDGES = 8  # edges that are compared with every value; more are looked up in sorted batches
AT_ONCE = 320  # brackets narrowed in one pass: bounds the sketches a task holds


@dataclass(frozen=True)
class RankedValue:
    """A value with the number of rows under it and equal to it."""

    value: float
    under: int
    tied: int


@dataclass(frozen=True)
class _Bracket:
    """The wanted value lies strictly between ``low`` and ``high`` (None: open end);
    ``below`` usable values are not above ``low``, ``inside`` lie between."""

    column: str
    rank: int
    below: int
    inside: int
    low: float | None = None
    high: float | None = None
    slack: int = 2
    found: RankedValue | None = None

    def within(self, values: np.ndarray) -> np.ndarray:
        if self.low is not None:
            values = values[values > self.low]
        return values if self.high is None else values[values < self.high]

    def settled(self, few: int) -> bool:
        return self.found is not None or self.inside <= few


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The finite values of every column; adding zero makes one value of both signed zeros."""
    for batch in batches:
        found = {c: batch.column(c).drop_null().to_numpy(zero_copy_only=False) for c in batch.schema.names}
        yield {c: v[np.isfinite(v)] + 0.0 for c, v in found.items()}


def _thinned(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """At most SKETCH_POINTS values in order, and for how many values each stands."""
    if weights is None:
        values = np.sort(values)
        upto = np.arange(1, len(values) + 1)
    else:
        order = np.argsort(values)
        values, upto = values[order], np.cumsum(weights[order])
    if len(values) <= SKETCH_POINTS:
        return values, np.diff(upto, prepend=0)
    edges = np.linspace(0, upto[-1], SKETCH_POINTS + 1).astype(np.int64)
    at = np.searchsorted(upto, (edges[:-1] + edges[1:]) // 2, side="right")
    at[0], at[-1] = 0, len(values) - 1
    return values[at], np.diff(edges)


class _Sketch:
    """What a task has seen of one bracket: values not yet thinned, and points."""

    def __init__(self) -> None:
        self.raw: list[np.ndarray] = []
        self.points: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.raw.append(values)
        self.size += len(values)
        if self.size >= CHUNK:
            self._thin()
            if sum(len(p) for p, _ in self.points) >= CHUNK:
                self.points = [_thinned(*map(np.concatenate, zip(*self.points, strict=True)))]

    def _thin(self) -> None:
        if self.raw:
            self.points.append(_thinned(np.concatenate(self.raw)))
            self.raw, self.size = [], 0

    def whole(self) -> tuple[np.ndarray, np.ndarray] | None:
        self._thin()
        return _thinned(*map(np.concatenate, zip(*self.points, strict=True))) if self.points else None


def _sketched(values: DataFrame, cells: Sequence[_Bracket], shares: Sequence[Sequence[float]]) -> list[list[float]]:
    """For each cell, values near the ``shares`` of the ranks inside it; 0 and 1 give the ends."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [_Sketch() for _ in cells]
        for found in _usable(batches):
            for cell, seen in zip(cells, sketches, strict=True):
                seen.add(cell.within(found[cell.column]))
        for j, seen in enumerate(sketches):
            if (whole := seen.whole()) is not None:
                yield pa.RecordBatch.from_pydict(
                    {"cell": pa.array([j], pa.int32()), "points": [whole[0]], "weights": [whole[1]]}
                )

    def merge(sketches: pa.Table) -> pa.Table:
        j = sketches["cell"][0].as_py()
        points, weights = (sketches[c].combine_chunks().flatten().to_numpy() for c in ("points", "weights"))
        order = np.argsort(points)
        upto = np.cumsum(weights[order])
        at = np.searchsorted(upto, np.array(shares[j]) * (upto[-1] - 1), side="right")
        return pa.table({"cell": pa.array([j], pa.int32()), "ends": [points[order][at]]})

    sketches = values.select(*dict.fromkeys(c.column for c in cells)).mapInArrow(
        sketch, "cell int, points array<double>, weights array<long>"
    )
    rows = sketches.groupBy("cell").applyInArrow(merge, "cell int, ends array<double>").collect()  # one for each cell
    ends = {r["cell"]: r["ends"] for r in rows}
    return [ends[j] for j in range(len(cells))]


def _narrow(df: DataFrame, brackets: Sequence[_Bracket]) -> list[_Bracket]:
    """One sketch pass and one counting pass.

    A wanted rank that falls on a new end is found, however many rows share that
    value; otherwise the ends are excluded, so a bracket always shrinks. A bracket
    that misses its rank is retried wider.
    """
    cells: dict[tuple, list[int]] = {}
    for i, b in enumerate(brackets):
        cells.setdefault((b.column, b.low, b.high), []).append(i)
    shares = []
    for members in cells.values():
        shares.append([])
        for i in members:
            b = brackets[i]
            share = (b.rank - b.below) / max(b.inside - 1, 1)
            pad = b.slack / SKETCH_POINTS + b.slack / b.inside
            shares[-1] += [max(0.0, share - pad), min(1.0, share + pad)]
    found = _sketched(df, [brackets[members[0]] for members in cells.values()], shares)
    ends = {
        i: found[j][2 * place : 2 * place + 2]
        for j, members in enumerate(cells.values())
        for place, i in enumerate(members)
    }
    under = _rows_below(df, {(b.column, end) for i, b in enumerate(brackets) for end in ends[i]})
    out = []
    for i, b in enumerate(brackets):
        low, high = ends[i]
        below_low, above_low = under[b.column, low]
        at_high, past = under[b.column, high]
        if not below_low <= b.rank < past:
            out.append(replace(b, slack=b.slack * 4))
        elif b.rank < above_low:
            out.append(replace(b, found=RankedValue(low, below_low, above_low - below_low)))
        elif b.rank >= at_high:
            out.append(replace(b, found=RankedValue(high, at_high, past - at_high)))
        else:
            out.append(
                replace(b, below=above_low, inside=at_high - above_low, low=low, high=high, slack=2)
            )
    return out


def _rows_below(
    df: DataFrame, edges: set[tuple[str, float]]
) -> dict[tuple[str, float], tuple[int, int]]:
    """For each (column, edge): how many values lie under the edge, and not above it."""
    by_column: dict[str, list[float]] = {}
    for c, edge in sorted(edges):
        by_column.setdefault(c, []).append(edge)
    asked = [(c, edge) for c, points in by_column.items() for edge in points]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = {c: np.zeros((2, len(points)), np.int64) for c, points in by_column.items()}
        for found in _usable(batches):
            for c, points in by_column.items():
                v = found[c]
                if len(points) <= FEW_EDGES:
                    below[c] += [[np.count_nonzero(v < e) for e in points], [np.count_nonzero(v <= e) for e in points]]
                else:
                    v = np.sort(v)
                    below[c] += [np.searchsorted(v, points, side) for side in ("left", "right")]
        under, upto = np.concatenate([below[c] for c in by_column], axis=1)
        yield pa.RecordBatch.from_pydict({"edge": np.arange(len(asked), dtype=np.int32), "under": under, "upto": upto})

    counted = (
        df.select(*by_column)
        .mapInArrow(count, "edge int, under long, upto long")
        .groupBy("edge")
        .agg(F.sum("under").alias("under"), F.sum("upto").alias("upto"))
        .collect()
    )
    # a table without partitions counts nothing
    return dict.fromkeys(asked, (0, 0)) | {asked[r["edge"]]: (r["under"], r["upto"]) for r in counted}


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Callable[[int], Sequence[int]]],
    *,
    counts: Mapping[str, int] | None = None,
    few: int = FEW_VALUES,
    staged: bool = False,
) -> tuple[dict[str, int], dict[str, dict[int, RankedValue]]]:
    """The values at 0-based ascending ``ranks[column](n)`` among ``n`` usable values.

    NULL, NaN and infinities are not values. Columns are compared as doubles.
    ``counts`` saves a pass when the numbers of usable values are known, ``staged`` the copy
    of columns that are plain staged ones already. Returns the counts and, per column, ``{rank: RankedValue}``.
    """
    names = list(ranks)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    if not staged:
        values = stage(values, "values")
    if counts is None:
        below = _rows_below(values, {(c, math.inf) for c in names})
        counts = {c: below[c, math.inf][0] for c in names}
    brackets = [
        _Bracket(c, r, 0, counts[c])
        for c in names
        if counts[c]
        for r in sorted(set(ranks[c](counts[c])))
    ]
    while wide := [b for b in brackets if not b.settled(few)]:
        brackets = [b for b in brackets if b.settled(few)]
        for start in range(0, len(wide), AT_ONCE):
            brackets += _narrow(values, wide[start : start + AT_ONCE])
    result: dict[str, dict[int, RankedValue]] = {c: {} for c in names}
    open_brackets: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        if b.found is not None:
            result[b.column][b.rank] = b.found
        else:
            open_brackets.setdefault((b.column, b.low, b.high), []).append(b)
    cells = list(open_brackets.values())
    if not cells:
        return counts, result
    wanted = F.array(
        *[F.array(*[F.lit(b.rank - b.below).cast("long") for b in cell]) for cell in cells]
    )
    so_far = Window.partitionBy("cell").orderBy("value")  # at most `few` values a cell
    picked = (
        _candidates(values, [cell[0] for cell in cells])
        .groupBy("cell", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("upto", F.sum("rows").over(so_far))
        .withColumn("rank", F.explode(F.element_at(wanted, F.col("cell") + 1)))
        .where((F.col("upto") - F.col("rows") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
    )
    for row in picked.collect():  # one row per wanted rank
        b = cells[row["cell"]][0]
        result[b.column][row["rank"] + b.below] = RankedValue(
            row["value"], b.below + row["upto"] - row["rows"], row["rows"]
        )
    return counts, result


def _candidates(values: DataFrame, brackets: Sequence[_Bracket]) -> DataFrame:
    """``cell``, ``value`` of the rows inside each bracket (brackets may overlap)."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _usable(batches):
            hits = [b.within(found[b.column]) for b in brackets]
            cells = np.repeat(np.arange(len(brackets), dtype=np.int32), [len(v) for v in hits])
            yield pa.RecordBatch.from_pydict({"cell": cells, "value": np.concatenate(hits)})

    return values.select(*dict.fromkeys(b.column for b in brackets)).mapInArrow(inside, "cell int, value double")


def exact_quantiles(
    df: DataFrame,
    probabilities: Mapping[str, Sequence[float]],
    *,
    counts: Mapping[str, int] | None = None,
    few: int = FEW_VALUES,
    staged: bool = False,
) -> dict[str, list[float | None]]:
    """Continuous quantiles (linear interpolation) per column; NULL for an empty one."""

    def neighbours(probs: Sequence[float]) -> Callable[[int], list[int]]:
        return lambda n: [
            r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))
        ]

    counts, found = order_statistics(
        df, {c: neighbours(probs) for c, probs in probabilities.items()}, counts=counts, few=few, staged=staged
    )
    out: dict[str, list[float | None]] = {}
    for c, probs in probabilities.items():
        out[c] = []
        for p in probs:
            if not counts[c]:
                out[c].append(None)
                continue
            place = (counts[c] - 1) * p
            share = place - math.floor(place)
            low, high = found[c][math.floor(place)].value, found[c][math.ceil(place)].value
            out[c].append(
                low + (high - low) * share if share < 0.5 else high - (high - low) * (1 - share)
            )
    return out


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_quantiles(df, {column: [0.5]})[column][0]


@dataclass(frozen=True)
class TopCut:
    """The first ``size`` rows by (score descending, key ascending) as a predicate."""

    size: int
    score: float
    last_key: object | None  # None: every row with this score is inside

    def contains(self, score: Column, key: Column) -> Column:
        """``score`` must have gone through ``sortable_score``."""
        tied = score == F.lit(self.score)
        if self.last_key is not None:
            tied = tied & (key <= F.lit(self.last_key))
        return (score > F.lit(self.score)) | tied


_LOWEST = -1.7976931348623157e308


def sortable_score(score: Column) -> Column:
    """A double; undefined scores sort last."""
    return F.coalesce(finite_or_null(score), F.lit(_LOWEST))


def position_among(cuts: Sequence[TopCut], score: Column, key: Column) -> Column:
    """How many of the nested ``cuts`` a row lies outside of: 0 for the best rows."""
    return sum(((~cut.contains(score, key)).cast("int") for cut in cuts), F.lit(0))


def top_cuts(
    df: DataFrame,
    scores: Mapping[str, Column],
    key: str,
    sizes: Mapping[str, Callable[[int], Sequence[int]]],
    *,
    where: Mapping[str, Column] | None = None,
    counts: Mapping[str, int] | None = None,
    few: int = FEW_VALUES,
) -> tuple[dict[str, int], dict[str, list[TopCut]]]:
    """Cuts for the ``sizes[name](n)`` best rows of each score, all scores together.

    ``where[name]`` restricts a score to some rows (a stratum). Only rows tied with a
    cut score are ever ordered by key.
    """
    where = where or {}
    work = df.select(
        key,
        *[
            (F.when(where[s], sortable_score(c)) if s in where else sortable_score(c)).alias(s)
            for s, c in scores.items()
        ],
    )
    work = stage(work, "scores")
    wanted: dict[str, list[int]] = {}

    def ranks_for(name: str) -> Callable[[int], list[int]]:
        def ranks(n: int) -> list[int]:
            wanted[name] = [min(max(m, 0), n) for m in sizes[name](n)]
            return [n - m for m in wanted[name] if m > 0]

        return ranks

    counts, found = order_statistics(work, {s: ranks_for(s) for s in scores}, counts=counts, few=few, staged=True)
    cuts: dict[str, list[TopCut]] = {s: [] for s in scores}
    split_ties: dict[tuple[str, float, int], RankedValue] = {}
    for s in scores:
        for m in wanted.get(s, []):
            if m == 0:
                cuts[s].append(TopCut(0, math.inf, None))
                continue
            at = found[s][counts[s] - m]
            need = m - (counts[s] - at.under - at.tied)
            cuts[s].append(TopCut(m, at.value, need))
            if need < at.tied:
                split_ties[(s, at.value, need)] = at
    last_keys = _keys_at(work, key, split_ties, few) if split_ties else {}
    return counts, {
        s: [replace(c, last_key=last_keys.get((s, c.score, c.last_key))) for c in cuts[s]]
        for s in scores
    }


def _keys_at(
    work: DataFrame, key: str, wanted: Mapping[tuple[str, float, int], RankedValue], few: int
) -> dict[tuple[str, float, int], object]:
    """The ``need``-th smallest key among the rows tied at each (column, value)."""
    edges = sorted({(s, v) for s, v, _ in wanted})
    on_edge = [F.col(s) == F.lit(v) for s, v in edges]
    met = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(on_edge)]))
    ties = work.where(reduce(or_, on_edge)).select(key, F.explode(met).alias("edge"))
    if max(at.tied for at in wanted.values()) <= few:
        in_key_order = Window.partitionBy("edge").orderBy(key)  # at most `few` rows a group
        ranked = ties.withColumn("rank", F.row_number().over(in_key_order) - 1)
    else:
        ranked = global_rank(ties, [F.col(key).asc()], by=["edge"])
    asked = F.array(
        *[
            F.array(*[F.lit(need - 1).cast("long") for s, v, need in wanted if (s, v) == edge])
            for edge in edges
        ]
    )
    hits = ranked.where(
        F.array_contains(F.element_at(asked, F.col("edge") + 1), F.col("rank").cast("long"))
    )
    return {
        (*edges[row["edge"]], row["rank"] + 1): row[key] for row in hits.collect()
    }  # one row per cut that splits a tie
