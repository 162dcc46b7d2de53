"""LM scoring with an Elias-Fano n-gram trie.

Texts are lower-cased (A-Z) and cut at white space; every text ends with one end token. The
model interpolates orders 1 .. ``order``: order 1 is the add-one estimate over the training
tokens, order k discounts each count by DISCOUNT and gives what it took to order k-1.
Discounted probabilities and interpolation weights are quantised to steps of 1/20 of a
power of ten and kept in tries.

Work goes in blocks of documents and shards of n-grams. A block sends the distinct n-grams it
holds, with their training counts, to the shards of their contexts; a shard sums the counts
up, writes its trie to a memory-mapped file, and answers each block by searching it. Words
behind a frequent context (more than a quarter of a shard's share of all tokens, so at most
four for each shard) are spread over all shards; the counts of these contexts are few enough to pass through
the driver. No task ever holds the model, only its shard.

Defined results: a null text is empty and has the end token only; a null doc_id counts as the
text '' in the split; repeated rows are texts of their own; without training texts every
probability is that of order 1. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.elias_fano import Trie, write_trie
from stayline.llm.packing import pack, pack_ranks, unpack, unpack_ranks
from stayline.llm.words import hash_words
from stayline.session import stage

ORDER = 3
DISCOUNT = 0.75
BLOCK_BYTES = 8_000_000
SHARD_TOKENS = 1_500_000
_STEPS = 20
_END = hash_words([b"\n"])[0]  # no word holds white space
_START = hash_words([b" "])[0]
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values (the usual three-step finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shard(x: np.ndarray, shards: int) -> np.ndarray:
    return ((x >> _HALF) * np.uint64(shards)) >> _HALF


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes 1 .. 255 of probabilities in (0, 1]; code 0 is left for what is unknown."""
    return np.clip(np.rint(-np.log10(p) * _STEPS) + 1, 1, 255).astype(np.uint8)


def restored(codes: np.ndarray, unknown: float) -> np.ndarray:
    table = np.power(10.0, -(np.arange(256) - 1.0) / _STEPS)
    table[0] = unknown
    return table[codes]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document stays out of training: crc32 of its id as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def make_blocks(docs: DataFrame, held: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents in blocks: their ids, lengths and split, the block's distinct words, most
    frequent first, and each token as a number among them."""
    names = ["block", "doc_ids", "held", "lengths", "words", "counts", "tokens", "n_tokens", "n_train", "train_docs"]

    def block(number: int, rows: list[tuple]) -> pa.RecordBatch:
        hashes = [np.append(hash_words((text or b"").lower().split()), _END) for _, text, _ in rows]
        lengths = np.array([len(h) for h in hashes], np.int32)
        words, tokens, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        by_rank = np.argsort(-often, kind="stable")  # small numbers for frequent words pack better
        rank = np.empty(len(words), np.uint32)
        rank[by_rank] = np.arange(len(words), dtype=np.uint32)
        train = np.array([not h for _, _, h in rows])
        counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(words))
        values = [
            number,
            [r[0] for r in rows],
            [r[2] for r in rows],
            pack(lengths),
            words[by_rank].tobytes(),
            pack(counts[by_rank].astype(np.uint32)),
            pack_ranks(rank[tokens]),
            len(tokens),
            int(counts.sum()),
            int(train.sum()),
        ]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4, *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[1] or b"")
                if size >= block_bytes:
                    yield block(number, rows)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield block(number, rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), held.alias("held")).mapInArrow(
        run,
        "block long, doc_ids array<long>, held array<boolean>, lengths binary, words binary, counts binary, "
        "tokens binary, n_tokens long, n_train long, train_docs long",
    )


class Grams:
    """The n-grams of one order in a block, by (hot, shard, key) in that order.

    ``index`` gives each token the number of the n-gram that ends with it.
    """

    def __init__(self, context: np.ndarray, follower: np.ndarray, shards: int, hot: np.ndarray):
        place = np.searchsorted(hot, context)
        self.is_hot = np.zeros(len(context), bool)
        if len(hot):
            self.is_hot = hot[np.minimum(place, len(hot) - 1)] == context
        mixed = _mixed(context)
        spread = np.where(self.is_hot, follower, mixed)
        key = ((spread & _LOW) << _HALF) | np.where(self.is_hot, place.astype(np.uint64), follower & _LOW)
        part = _shard(spread, shards) + self.is_hot * np.uint64(shards)
        order = np.argsort(key)
        order = order[np.argsort(part[order], kind="stable")]
        key, part = key[order], part[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        self.index = np.empty(len(order), np.int64)
        self.index[order] = np.cumsum(new) - 1
        self.keys, self.parts = key[new], part[new].astype(np.int64)
        self.hot_place = place

    def ids(self) -> np.ndarray:
        """One 64-bit name for the n-gram that ends with each token."""
        return _mixed(self.keys ^ _mixed(self.parts.astype(np.uint64)))[self.index]


def _orders(row, order: int, shards: int, hot: list[np.ndarray]) -> Iterator[Grams]:
    """The n-grams of orders 2, 3 .. of a block, each token's history cut at its text's start."""
    words = np.frombuffer(row["words"], np.uint64)
    tokens = unpack_ranks(row["tokens"])
    lengths = unpack(row["lengths"], np.int32)
    hashes = words[tokens]
    follower = _mixed(hashes ^ np.uint64(0xD6E8FEB86659FD93))
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    ids = hashes
    for k in range(2, order + 1):
        context = np.r_[ids[:1], ids[:-1]]
        context[starts] = _START + np.uint64(k)
        grams = Grams(context, follower, shards, hot[k - 2])
        yield grams
        ids = grams.ids()


def _lists(block: int, parts: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    edges = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(parts[a]), block, keys[a:b].tobytes(), pack(counts[a:b].astype(np.uint32))


_LIST = "part int, block long, keys binary, counts binary"
_ANSWER = "block long, level int, part int, first binary, second binary, distinct long, total long, frequent array<struct<id:long,n:long>>"


def _list_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "block", "keys", "counts"])


def word_lists(blocks: DataFrame, shards: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                words = np.frombuffer(row["words"], np.uint64)
                order = np.argsort(words)
                words, counts = words[order], unpack(row["counts"], np.uint32)[order]
                parts = _shard(words, shards).astype(np.int64)
                yield _list_frame(list(_lists(row["block"], parts, words, counts)))

    return blocks.select("block", "words", "counts").mapInPandas(run, _LIST)


def gram_lists(blocks: DataFrame, level: int, shards: int, hot: list[np.ndarray]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                *_, grams = _orders(row, level, shards, hot)
                train = np.repeat(~np.array(row["held"], bool), unpack(row["lengths"], np.int32))
                counts = np.bincount(grams.index[train], minlength=len(grams.keys))
                yield _list_frame(list(_lists(row["block"], grams.parts, grams.keys, counts)))

    return blocks.select("block", "words", "tokens", "lengths", "held").mapInPandas(run, _LIST)


def _summed(lists: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of a shard, their counts, and where each block's keys are among them."""
    keys = [np.frombuffer(k, np.uint64) for k in lists["keys"]]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([unpack(c, np.uint32) for c in lists["counts"]])
    return distinct, np.bincount(place, counts, len(distinct)).astype(np.int64), place, np.cumsum([0, *map(len, keys)]).tolist()


def _answers(lists: pd.DataFrame, level: int, place, edges, *values) -> list[tuple]:
    part = int(lists["part"].iloc[0])
    return [
        (block, level, part, *(pack(v[place[a:b]]) for v in values), 0, 0, [])
        for block, a, b in zip(lists["block"], edges[:-1], edges[1:], strict=True)
    ]


def _answer_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "level", "part", "first", "second", "distinct", "total", "frequent"])


def _frequent(ids: np.ndarray, counts: np.ndarray, shards: int) -> list[dict]:
    """Those above a quarter of this shard's share; the share of the mean shard decides later."""
    often = counts * 4 * shards > counts.sum()
    return [{"id": int(i), "n": int(n)} for i, n in zip(ids[often].view(np.int64), counts[often], strict=True)]


def count_words(lists: DataFrame, shards: int) -> DataFrame:
    """Each block's words answered with their training counts; one more row for each shard with
    its distinct training words and the frequent ones."""

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        keys, counts, place, edges = _summed(lists)
        rows = _answers(lists, 1, place, edges, counts, np.empty(len(keys), np.uint8))
        part = int(lists["part"].iloc[0])
        rows.append((-1, 1, part, b"", b"", int((counts > 0).sum()), int(counts.sum()), _frequent(keys, counts, shards)))
        return _answer_frame(rows)

    return lists.groupBy("part").applyInPandas(run, _ANSWER)


def search_grams(lists: DataFrame, level: int, shards: int, hot_counts: np.ndarray, discount: float) -> DataFrame:
    """Each block's n-grams answered from the shard's trie: the code of the discounted
    probability, and the code of the context's interpolation weight. Frequent contexts have
    their known count, and one more row tells how many followers this shard holds for each."""

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        keys, counts, place, edges = _summed(lists)
        part = int(lists["part"].iloc[0])
        hot = part >= shards
        known = counts > 0
        trained, n = keys[known], counts[known]
        context = trained >> _HALF
        new = np.r_[True, context[1:] != context[:-1]][: len(trained)]
        number = np.cumsum(new) - 1
        contexts = int(new.sum())
        if hot:
            total = hot_counts[(trained & _LOW).astype(np.int64)]
            weights = np.zeros(contexts, np.uint8)
        else:
            totals = np.bincount(number, n, contexts)
            total = totals[number]
            weights = quantised(discount * np.bincount(number, minlength=contexts) / totals)
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "trie")
            write_trie(path, trained, quantised((n - discount) / total), weights)
            codes, context_codes = Trie(path).find(keys)
        rows = _answers(lists, level, place, edges, codes, context_codes)
        ids = _mixed(trained ^ _mixed(np.array([part], np.uint64)))
        followers = []
        if hot:
            found = np.bincount((trained & _LOW).astype(np.int64), minlength=len(hot_counts))
            followers = [{"id": int(i), "n": int(found[i])} for i in np.flatnonzero(found)]
        rows.append((-1, level, part, b"", b"", 0, int(n.sum()), _frequent(ids, n, shards)))
        rows.append((-2, level, part, b"", b"", 0, 0, followers))
        return _answer_frame(rows)

    return lists.groupBy("part").applyInPandas(run, _ANSWER)


def score_texts(
    docs: DataFrame,
    held: Column | None = None,
    order: int = ORDER,
    discount: float = DISCOUNT,
    block_bytes: int = BLOCK_BYTES,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from the rows where ``held`` is not true. base_score is that of order 1,
    score that of the whole model, both as log10 of the text's probability.
    """
    held = F.coalesce(held_out() if held is None else held, F.lit(False))
    blocks = stage(make_blocks(docs, held, block_bytes), "blocks")
    sums = blocks.agg(F.sum("n_tokens"), F.sum("n_train"), F.sum("train_docs")).first()
    tokens, train, train_docs = (int(x or 0) for x in sums)
    shards = max(8, -(-tokens // shard_tokens))
    bar = train // (4 * shards)

    def frequent(answers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = answers.where("block = -1").select(F.explode("frequent").alias("f")).where(F.col("f.n") > bar).collect()
        return np.array([r.f.id for r in rows], np.int64).view(np.uint64), np.array([r.f.n for r in rows], np.int64)

    words = stage(count_words(word_lists(blocks, shards), shards), "words")
    distinct = int(words.where("block = -1").agg(F.sum("distinct")).first()[0] or 0)
    answers = [words]
    hot: list[np.ndarray] = []
    hot_weights: list[np.ndarray] = []
    ids, counts = frequent(words)
    for level in range(2, order + 1):
        ids, counts = np.append(ids, _START + np.uint64(level)), np.append(counts, train_docs)
        by_id = np.argsort(ids)
        hot.append(ids[by_id])
        counts = counts[by_id]
        found = stage(search_grams(gram_lists(blocks, level, shards, hot), level, shards, counts, discount), "grams")
        answers.append(found)
        followers = np.zeros(len(counts))
        rows = found.where("block = -2").select(F.explode("frequent").alias("f")).groupBy("f.id").agg(F.sum("f.n").alias("n"))
        for r in rows.collect():
            followers[r.id] = r.n
        hot_weights.append(np.where(counts > 0, discount * followers / np.maximum(counts, 1), 1.0))
        if level < order:
            ids, counts = frequent(found)

    columns = ["block", "level", "part", "first", "second"]
    every = answers[0].select(*columns)
    for more in answers[1:]:
        every = every.unionByName(more.select(*columns))

    def assemble(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty:
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]).astype(object)
        row = blocks.to_dict("records")[0]
        answers = answers.sort_values(["level", "part"])
        levels = {k: g for k, g in answers.groupby("level")}
        tokens = unpack_ranks(row["tokens"])
        lengths = unpack(row["lengths"], np.int32)
        words = np.frombuffer(row["words"], np.uint64)
        counts = np.empty(len(words), np.int64)
        counts[np.argsort(words)] = np.concatenate([unpack(x, np.int64) for x in levels[1]["first"]])
        seen = counts[tokens]
        p = (seen + 1) / (train + distinct + 1)
        text = np.repeat(np.arange(len(lengths)), lengths)
        base = np.bincount(text, np.log10(p), len(lengths))
        for level, grams in enumerate(_orders(row, order, shards, hot), 2):
            codes = np.concatenate([unpack(x, np.uint8) for x in levels[level]["first"]])[grams.index]
            weights = np.concatenate([unpack(x, np.uint8) for x in levels[level]["second"]])[grams.index]
            weight = restored(weights, 1.0)
            weight[grams.is_hot] = hot_weights[level - 2][grams.hot_place[grams.is_hot]]
            p = restored(codes, 0.0) + weight * p
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if x is None or x != x else int(x) for x in row["doc_ids"]], "Int64"),
                "held_out": np.array(row["held"], bool),
                "n_tokens": lengths.astype(np.int64),
                "n_known": np.bincount(text[seen > 0], minlength=len(lengths)),
                "base_score": base,
                "score": np.bincount(text, np.log10(np.minimum(p, 1.0)), len(lengths)),
            }
        )

    narrow = blocks.select("block", "doc_ids", "held", "lengths", "words", "tokens")
    scored = (
        narrow.groupBy("block")
        .cogroup(every.where("block >= 0").groupBy("block"))
        .applyInPandas(
            assemble, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
        )
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score"
    )
