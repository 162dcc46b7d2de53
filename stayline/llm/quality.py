"""Quality rules: document statistics, base rules, and monotone boosted trees over them.

Defined results: a null text counts as empty; rows may repeat and keep their own result;
other columns of the input are neither read nor needed. An empty table gives no rows.
Without a labelled row of either class there is no model and the base rules decide alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.boosting import Trees, fit_trees
from stayline.llm.words import SPACES, hash_ngrams, hash_words

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: Statistic and the direction in which it may move the chance of being good (0: free).
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "duplicate_line_share": -1,
    "repeated_word_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": -1,
    "distinct_word_share": 0,
    "words_per_line": 0,
    "mark_end_share": -1,
    "most_common_share": 0,
    "single_letter_share": 0,
}
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!#$%&*+/<=>?@[]^_`{|}~"


def _repeated(hashes: np.ndarray) -> int:
    """Words inside windows of WINDOW words that the text holds twice or more."""
    windows = hash_ngrams(hashes, WINDOW)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.flatnonzero(np.isin(windows, twice))
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[found] += 1
    edge[found + WINDOW] -= 1
    return int((edge.cumsum() > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The five base counts and the feature values of one text."""
    words = text.split()
    n = len(words)
    inside = text.translate(None, SPACES)
    chars = len(inside.decode("utf-8", "replace"))
    symbols = len(inside) - len(inside.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    duplicate = len(lines) - len(set(lines))
    hashes = hash_words(words)
    repeated = _repeated(hashes)
    m, size = max(n, 1), max(len(inside), 1)
    counts = np.unique(hashes, return_counts=True)[1]

    def share(of: bytes) -> float:
        return (len(inside) - len(inside.translate(None, of))) / size

    features = [
        float(np.log1p(n)),
        chars / m,
        symbols / m,
        duplicate / max(len(lines), 1),
        repeated / m,
        share(_UPPER),
        share(_DIGITS),
        share(_MARKS),
        len(counts) / m,
        n / max(len(lines), 1),
        sum(w[-1] in _MARKS for w in words) / m,
        float(counts.max()) / m if n else 0.0,
        sum(len(w) == 1 for w in words) / m,
    ]
    return [n, chars, symbols, duplicate, repeated], features


def _failed(base: list[int]) -> bool:
    return base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED_PERCENT * base[0]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, ``base_failed`` and ``features`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x or b"") for x in batch.column(1).to_pylist()]
            columns = [pa.array([f[0][k] for f in found], pa.int64()) for k in range(len(_BASE))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *columns,
                    pa.array([_failed(f[0]) for f in found], pa.bool_()),
                    pa.array([f[1] for f in found], pa.list_(pa.float64())),
                ],
                ["doc_id", *_BASE, "base_failed", "features"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    counts = ", ".join(f"{c} long" for c in _BASE)
    return narrow.mapInArrow(run, f"doc_id long, {counts}, base_failed boolean, features array<double>")


def fit_quality(stats: DataFrame, labels: DataFrame, sample_rows: int = 20_000, seed: int = 7) -> Trees | None:
    """Trees that tell quality 1 from 0, from at most ``sample_rows`` labelled documents.

    The sample is the labelled rows of smallest hash of (seed, doc_id); it is the only part
    of the data that reaches the driver. Two labels for one document count as the better one.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    labelled = stats.select("doc_id", "features").join(known, "doc_id")
    # a share slightly above what is wanted, so that hardly more than the sample is moved
    share = min(1.0, 1.2 * sample_rows / max(1, labelled.count()))
    place = F.xxhash64(F.lit(seed), "doc_id")
    sample = (
        labelled.where(F.pmod(place, F.lit(2**32)) < int(share * 2**32))
        .orderBy(F.pmod(place, F.lit(2**32)), "doc_id", "features")
        .limit(sample_rows)
        .select("features", "quality")
        .collect()
    )
    y = np.array([r.quality for r in sample], float)
    if len(y) == 0 or y.min() == y.max():
        return None
    x = np.array([r.features for r in sample])
    return fit_trees(x, y, np.array(list(FEATURES.values())))


def score_quality(stats: DataFrame, model: Trees | None, threshold: float = 0.5) -> DataFrame:
    """``stats`` without features, with the model's ``score`` and ``kept``."""
    score = F.lit(None).cast("double")
    verdict = F.lit(True)
    if model is not None:

        @F.pandas_udf("double")
        def probability(features: pd.Series) -> pd.Series:
            return pd.Series(model.probability(np.array(features.tolist()).reshape(-1, len(FEATURES))))

        score = probability("features")
        verdict = F.col("score") >= threshold
    scored = stats.withColumn("score", score).withColumn("kept", ~F.col("base_failed") & verdict)
    return scored.drop("features")


def keep_good(docs: DataFrame, model: Trees | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that pass base rules and model."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics((x or "").encode()) for x in batch.column(at).to_pylist()]
            good = np.array([not _failed(f[0]) for f in found], bool)
            if model is not None and len(found):
                good &= model.probability(np.array([f[1] for f in found])) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
