"""Feature preparation fitted with exact statistics.

The fitted result consists of JVM stages only: the statistics are literals of one
SQL projection, so transforming is a single pass without joins or Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import (
    PCA,
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.functions.numbers import column_groups, finite_or_null
from stayline.operators.quantiles import exact_quantiles


def feature_roles(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) features by data type."""
    if not features:
        raise ValueError("There must be at least one model feature column")
    numeric = [c for c in features if isinstance(df.schema[c].dataType, T.NumericType)]
    return numeric, [c for c in features if c not in numeric]


def numeric_statistics(
    df: DataFrame, columns: Sequence[str], *, staged: bool = False
) -> dict[str, tuple[float, float, float]]:
    """Per column (median, mean and population deviation after the median fill).

    The moments of the known values and the number of gaps give those of the filled
    column, so the fill itself needs no pass. ``staged``: ``df`` is a stored table.
    """
    row: dict[str, float] = {}
    moments = {"n": F.count, "mean": F.avg, "var": F.var_pop}
    for some in column_groups(columns):
        doubles = df.select(*[finite_or_null(F.col(c)).alias(c) for c in some])
        found = doubles.agg(
            F.count(F.lit(1)).alias("rows"),
            *[f(c).alias(f"{c}:{m}") for c in some for m, f in moments.items()],
        )
        row |= found.first().asDict()
    medians = exact_quantiles(
        df, {c: [0.5] for c in columns}, counts={c: row[f"{c}:n"] for c in columns}, staged=staged
    )
    out = {}
    for c in columns:
        known, rows = row[f"{c}:n"], row["rows"]
        if not known:
            out[c] = (0.0, 0.0, 0.0)
            continue
        median, gaps = medians[c][0], rows - known
        mean = (known * row[f"{c}:mean"] + gaps * median) / rows
        spread = known * (row[f"{c}:var"] + (row[f"{c}:mean"] - mean) ** 2)
        out[c] = (median, mean, math.sqrt((spread + gaps * (median - mean) ** 2) / rows))
    return out


MOST_CATEGORIES = 100_000  # per column on average; bounds what comes to the driver


def category_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    """Rows per known value of each text column, values in ascending order.

    One pass. The driver receives one row per category, as any one-hot encoding must; a
    column with more than MOST_CATEGORIES is refused.
    """
    pairs = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]
    counted = (
        df.select(F.inline(F.array(*pairs)))
        .where("v is not null")
        .groupBy("c", "v")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    out: dict[str, dict[str, int]] = {c: {} for c in columns}
    found = counted.limit(MOST_CATEGORIES * max(1, len(columns)) + 1).collect()
    if len(found) > MOST_CATEGORIES * max(1, len(columns)):
        raise ValueError(f"More than {MOST_CATEGORIES} categories per column in {list(columns)}: band or drop them")
    for row in sorted(found, key=lambda r: r["v"]):
        out[row["c"]][row["v"]] = row["rows"]
    return out


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per text column; the smallest one among ties."""
    pairs = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]
    best = (
        df.select(F.inline(F.array(*pairs)))
        .where("v is not null")
        .groupBy("c", "v")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("c")
        .agg(F.min(F.struct((-F.col("rows")).alias("less"), "v")).alias("first"))
    )
    found = {row["c"]: row["first"]["v"] for row in best.collect()}
    return {c: found.get(c) for c in columns}


def _most_frequent(counts: dict[str, int]) -> str | None:
    return min(counts, key=lambda v: (-counts[v], v), default=None)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(value: float) -> str:
    return f"double('{value!r}')"


def fill_and_scale(
    numeric: dict[str, tuple[float, float, float]], categorical: dict[str, str | None], *, scale: bool
) -> SQLTransformer:
    """One projection that adds ``_num_<c>`` and ``_cat_<c>`` columns."""
    added = []
    for c, (median, mean, deviation) in numeric.items():
        clean = f"double({_quoted(c)})"
        bounded = f"if(isnan({clean}) or abs({clean}) = double('Infinity'), null, {clean})"
        value = f"coalesce({bounded}, {_number(median)})"
        if scale:
            # A constant column is centred and left at zero.
            value = f"({value} - {_number(mean)}) / {_number(deviation if deviation > 0 else 1.0)}"
        added.append(f"{value} AS {_quoted('_num_' + c)}")
    for c, mode in categorical.items():
        fallback = _text(mode if mode is not None else "")
        added.append(f"coalesce(string({_quoted(c)}), {fallback}) AS {_quoted('_cat_' + c)}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(added)} FROM __THIS__")


def components_for(shares: Sequence[float], wanted: float) -> int:
    """Fewest leading components whose summed variance share exceeds ``wanted``."""
    total = 0.0
    for i, share in enumerate(shares):
        total += share
        if total > wanted:
            return i + 1
    return len(shares)


@dataclass(eq=False)
class Preprocessor(Estimator):
    """Median fill, standardise and optionally PCA for numbers; mode fill and one-hot
    (an unseen category is all zeros) for text. ``fit`` gives a ``PipelineModel`` with
    output column ``features``.

    ``encode=False`` leaves category indices instead of one-hot vectors. ``staged``: the rows
    that are fitted are a stored table, whose columns need no copy for the medians.
    """

    features: list[str]
    scale: bool = True
    encode: bool = True
    pca_variance: float | None = None
    output: str = "features"
    staged: bool = False

    def __post_init__(self) -> None:
        super().__init__()

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        numeric, categorical = feature_roles(dataset, self.features)
        statistics = numeric_statistics(dataset, numeric, staged=self.staged) if numeric else {}
        categories = category_counts(dataset, categorical) if categorical else {}
        fills = {c: _most_frequent(counts) for c, counts in categories.items()}
        stages: list[Transformer] = [fill_and_scale(statistics, fills, scale=self.scale)]
        blocks: list[str] = []
        inputs = [f"_num_{c}" for c in numeric]
        narrow = dataset.select(*self.features)
        if numeric and self.pca_variance is not None:
            stages.append(VectorAssembler(inputCols=inputs, outputCol="_numeric"))
            vectors = PipelineModel(stages).transform(narrow).select("_numeric")
            pca = PCA(k=len(numeric), inputCol="_numeric", outputCol="_all_pc").fit(vectors)
            kept = components_for(list(pca.explainedVariance), self.pca_variance)
            # Components are nested: the wanted ones are the first of the full fit.
            stages += [
                pca,
                VectorSlicer(inputCol="_all_pc", outputCol="_pc", indices=list(range(kept))),
            ]
            blocks.append("_pc")
        else:
            blocks += inputs
        if categorical:
            texts = [f"_cat_{c}" for c in categorical]
            indices = [f"_idx_{c}" for c in categorical]
            indexers = [
                StringIndexerModel.from_labels(
                    list(categories[c]) or [""], text, index, handleInvalid="keep"
                )
                for c, text, index in zip(categorical, texts, indices)
            ]
            stages += indexers
            if self.encode:
                hot = [f"_hot_{c}" for c in categorical]
                # Unseen gets the last index, which the encoder drops: all zeros.
                encoder = OneHotEncoder(inputCols=indices, outputCols=hot, dropLast=True)
                indexed = PipelineModel([stages[0], *indexers]).transform(narrow)
                stages.append(encoder.fit(indexed))  # reads column metadata, no rows
                blocks += hot
            else:
                blocks += indices
        stages.append(VectorAssembler(inputCols=blocks, outputCol=self.output))
        return PipelineModel(stages)


def build_preprocessor(
    df: DataFrame,
    features: Sequence[str],
    *,
    use_pca: bool = False,
    pca_variance: float = 0.95,
    staged: bool = False,
) -> Preprocessor:
    feature_roles(df, features)
    return Preprocessor(list(features), pca_variance=pca_variance if use_pca else None, staged=staged)


def feature_names(transformed: DataFrame, output: str = "features") -> list[str]:
    """Names of the vector's elements: column, column=category, or component."""
    attributes = transformed.schema[output].metadata.get("ml_attr", {}).get("attrs", {})
    named = {a["idx"]: a.get("name", "") for group in attributes.values() for a in group}
    names = []
    for i in range(len(named)):
        raw = named[i]
        if raw.startswith("_num_"):
            names.append(raw[len("_num_"):])
        elif raw.startswith("_hot_"):
            names.append(raw[len("_hot_"):])
        elif raw.startswith("_pc"):
            names.append(f"pca{i}")
        else:
            names.append(raw)
    return names


def variance_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Per component: variance share, running share, and whether it was kept."""
    pca = next(s for s in model.stages if hasattr(s, "explainedVariance"))
    slicer = next(s for s in model.stages if isinstance(s, VectorSlicer))
    shares = [float(v) for v in pca.explainedVariance]
    kept = len(slicer.getIndices())
    rows, total = [], 0.0
    for i, share in enumerate(shares):
        total += share
        rows.append((i + 1, share, min(total, 1.0) if math.isfinite(total) else None, i < kept))
    return df.sparkSession.createDataFrame(
        rows, "component int, variance_share double, cumulative_share double, kept boolean"
    )
