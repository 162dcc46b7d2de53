"""N-gram Jaccard join: near duplicates by MinHash banding and verification on full sets.

Words are runs of anything but white space, A-Z in lower case; the set of a text holds its
word n-grams, a text with fewer words is its own single n-gram. Texts of equal words are
collapsed first. Bands and rows are chosen for the target recall at the threshold; texts
that share a band hash are candidates, and the candidates that hang together are compared
on their full sets, in blocks of bounded size: a group that is too large for one block is
split into chunks, and each pair of chunks is a block. What a block returns grows with its
texts, not with its pairs.

Defined results: texts that are null or without a word equal nothing and are classes of their
own; a text shorter than n words equals only texts of the same words; rows without doc_id take
no part and get a null class; rows that repeat a doc_id count as copies if their words are
equal, else they are compared like others and share its name. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.components import components
from stayline.llm.words import hash_ngrams, hash_words
from stayline.session import stage

N = 5
THRESHOLD = 0.8
RECALL = 0.9995
MOST_HASHES = 160
BLOCK_NGRAMS = 400_000
BLOCK_TEXTS = 512
_COLUMNS = 4_096


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, whose bands find a pair
    at the threshold with the target recall by at most ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError(f"{most} hashes cannot reach recall {recall} at {threshold}")
    return best


def ngram_set(text: bytes, n: int) -> np.ndarray:
    words = text.lower().split()
    return np.unique(hash_ngrams(hash_words(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def _key(words: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int = 5) -> DataFrame:
    """doc_id, key (equal for equal words), n_ngrams and the band hashes of every row."""
    rng = np.random.default_rng(seed)
    factor = (rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    offset = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)[:, None]
    numbers = np.arange(1, bands + 1, dtype=np.uint64)

    def band_hashes(words: list[bytes]) -> np.ndarray:
        grams = hash_ngrams(hash_words(words), n)
        short = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(bands * rows, 2**32 - 1, np.uint32)
        for at in range(0, len(short), _COLUMNS):
            least = np.minimum(least, (short[at : at + _COLUMNS] * factor + offset).min(1))
        table = least.reshape(bands, rows).astype(np.uint64)
        table = np.concatenate([numbers[:, None], table], axis=1)
        return np.array([hash_ngrams(row, rows + 1)[0] for row in table]).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or b"").lower().split()
                keys.append(_key(words))
                sizes.append(max(1, len(words) - n + 1) if words else 0)
                hashes.append(band_hashes(words) if len(words) >= n else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(keys, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(hashes, pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "n_ngrams", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, "doc_id long, key binary, n_ngrams long, bands array<long>"
    )


def candidate_groups(texts: DataFrame) -> DataFrame:
    """node and root for the texts that share a band hash with another text."""
    spread = texts.select("rep", F.explode("bands").alias("hash"))
    buckets = spread.groupBy("hash").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most")
    links = spread.join(buckets.select("hash", "least"), "hash").where("rep <> least")
    return components(links.select(F.col("rep").alias("u"), F.col("least").alias("v")))


def linked(
    left: list[np.ndarray], right: list[np.ndarray], threshold: float, same: bool
) -> np.ndarray:
    """Which texts of ``left`` and ``right`` reach the threshold, by their n-gram sets.

    N-grams that only one text holds cannot be shared and drop out; the rest is counted in
    blocks of columns.
    """
    sets = left if same else left + right
    sizes = np.array([len(s) for s in sets])
    grams = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(grams, return_inverse=True, return_counts=True)
    shared = counts > 1
    keep = shared[column]
    column, owners = (np.cumsum(shared) - 1)[column[keep]], owners[keep]
    order = np.argsort(column, kind="stable")
    column, owners = column[order], owners[order]
    first = len(left)
    both = np.zeros((first, len(sets) if same else len(right)), np.float32)
    for at in range(0, int(shared.sum()), _COLUMNS):
        part = slice(*np.searchsorted(column, (at, at + _COLUMNS)))
        block = np.zeros((len(sets), _COLUMNS), np.float32)
        block[owners[part], column[part] - at] = 1
        both += block[:first] @ (block if same else block[first:]).T
    both = np.rint(both).astype(np.int64)
    union = sizes[:first, None] + (sizes if same else sizes[first:])[None, :] - both
    result = both * 1_000_000 >= round(threshold * 1_000_000) * union
    if same:
        np.fill_diagonal(result, False)
    return result


def _roots(ids: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The smallest id that each text reaches by links."""
    roots = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        reached = np.minimum(roots, np.where(links, roots[None, :], top).min(1))
        if (reached == roots).all():
            return roots
        roots = reached


def verified(docs: DataFrame, candidates: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """What comparing full sets within groups gives: (rep, root) edges and (rep, links).

    ``candidates`` holds rep, key, copies, n_ngrams and the group's root. Small groups are
    dealt to bins of about BLOCK_NGRAMS; a large one is split into chunks.
    """
    sums = candidates.groupBy("root").agg(F.sum("n_ngrams").alias("ngrams"), F.count(F.lit(1)).alias("texts"))
    split = F.greatest(F.ceil(F.col("ngrams") / BLOCK_NGRAMS), F.ceil(F.col("texts") / BLOCK_TEXTS)).cast("int")
    sums = sums.select("root", "ngrams", split.alias("chunks"))
    total = sums.where("chunks = 1").agg(F.sum("ngrams")).first()[0] or 0
    bins = max(1, math.ceil(total / BLOCK_NGRAMS))
    chunk = F.pmod(F.xxhash64("rep", "key"), F.col("chunks")).cast("int")
    placed = (
        candidates.join(sums.drop("ngrams"), "root")
        .withColumn("chunk", chunk)
        .withColumn("bin", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")))
        .select("rep", "key", "copies", "root", "chunks", "chunk", "bin")
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            texts, keys = at["text"].to_pylist(), at["key"].to_pylist()
            own = [i for i, (t, k) in enumerate(zip(texts, keys, strict=True)) if _key((t or b"").lower().split()) == k]
            grams = pa.array([ngram_set(texts[i], n).tobytes() for i in own], pa.binary())
            names = ["rep", "key", "copies", "root", "chunks", "chunk", "bin"]
            kept = [at[name].take(pa.array(own, pa.int64())) for name in names]
            yield pa.RecordBatch.from_arrays([*kept, grams], [*names, "grams"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text"))
    with_sets = (
        placed.hint("merge")  # candidates grow with the texts; no size of theirs is small for good
        .join(texts, "rep")
        .mapInArrow(sets, "rep long, key binary, copies long, root long, chunks int, chunk int, bin long, grams binary")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("a", F.least("chunk", "other"))
        .withColumn("b", F.greatest("chunk", "other"))
        .withColumn("large", F.col("chunks") > 1)
        .drop("other", "chunks")
    )

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        found = []
        a, b = block["a"].iloc[0], block["b"].iloc[0]
        # rows that repeat a doc_id and its words come up more than once
        block = block.drop_duplicates(["rep", "key", "chunk"])
        for _, group in block.groupby("root"):
            parts = [group] if a == b else [group[group["chunk"] == a], group[group["chunk"] == b]]
            if any(part.empty for part in parts) or len(group) < 2:
                continue
            left, right = parts[0], parts[-1]
            grams = [[np.frombuffer(x, np.uint64) for x in part["grams"]] for part in parts]
            links = linked(grams[0], grams[-1], threshold, a == b)
            weights = [part["copies"].to_numpy(np.int64) for part in parts]
            ids = group["rep"].to_numpy(np.int64) if a == b else np.concatenate([left["rep"], right["rep"]])
            if a == b:
                counts, square = links @ weights[0], links
            else:
                counts = np.concatenate([links @ weights[1], links.T @ weights[0]])
                square = np.zeros((len(ids), len(ids)), bool)
                square[: len(left), len(left) :] = links
                square[len(left) :, : len(left)] = links.T
            frame = pd.DataFrame({"rep": ids, "root": _roots(ids, square), "links": counts})
            found.append(frame[frame["links"] > 0])
        if not found:
            return pd.DataFrame({"rep": [], "root": [], "links": [], "large": []})
        return pd.concat(found).assign(large=bool(block["large"].iloc[0]))

    result = stage(
        with_sets.groupBy("large", "bin", "a", "b").applyInPandas(
            compare, "rep long, root long, links long, large boolean"
        ),
        "verified",
    )
    return result.select("rep", "root", "large"), result.groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(
    docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES
) -> DataFrame:
    """doc_id, class_id and n_links for every row of ``docs``.

    Two rows are linked if their n-gram sets reach the threshold; a class hangs together by
    links and is named after its smallest doc_id; n_links counts the other rows linked to a
    row, copies included.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)
    signed = stage(signatures(docs, n, bands, rows), "signatures")
    texts = stage(
        signed.where("key is not null and doc_id is not null")
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("rep"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n_ngrams").alias("n_ngrams"),
            F.first("bands").alias("bands"),
        ),
        "texts",
    )
    groups = candidate_groups(texts)
    candidates = texts.drop("bands").join(groups, F.col("rep") == F.col("node")).drop("node")
    edges, links = verified(docs, stage(candidates, "candidates"), n, threshold)
    small = edges.where("not large").select(F.col("rep").alias("node"), "root")
    large = components(edges.where("large").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    roots = small.unionByName(large).groupBy("node").agg(F.min("root").alias("root"))
    by_text = (
        texts.select("key", "rep", "copies")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .join(links, "rep", "left")
        .select(
            "key",
            F.coalesce("root", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    known = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    return known.join(by_text, "key", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` that give their class its name, a repeated row once; rows without
    doc_id stay. ``classes`` is what ``near_duplicates`` found."""
    first = classes.where("doc_id = class_id").select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
