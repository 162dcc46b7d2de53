"""SentencePiece encoding and decoding over a given piece table.

Encoding is relational. Texts are cut into words: a run of letters or of other characters,
with all spaces before it; line breaks, and spaces before one, stand alone. No piece crosses
such a cut, so the words' best paths make up the text's; with a piece table where one does,
the whole text is one word. Of the distinct words
of all documents every substring up to the longest piece is exploded and equi-joined to the
piece table; the matches are the edges of each word's lattice. They are grouped by word, and
a higher-order aggregate folds them into the best path (Viterbi): the largest sum of piece
scores, then the fewest pieces, then the longest last piece, and so on backwards. A character without
a piece becomes its UTF-8 bytes, at a cost below any piece's. Words of more than 63 characters
are never cut: their paths are found, by the same order, where their shard answers, in steps
that grow with their length only. The words' paths go back to
the documents through blocks of documents, each of which asks for its distinct words once.
Blocks are written bucketed, so that answers are shuffled to them and they stay in place.

The text is taken with one space in front, which decoding takes away again; a piece's
space mark is a space here, so that a mark in the text itself is kept by its bytes, and
``decode`` gives back exactly what ``encode`` read.

Defined results: null and empty texts have no pieces; repeated rows each give their result; a
null doc_id stays null; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm.packing import pack, pack_ranks, unpack, unpack_ranks
from stayline.session import new_path

MODEL = "piece_bpe_32k.model"
BLOCK_CHARS = 8_000_000
SHARD_WORDS = 100_000
TASK_WORDS = 100_000
#: Longer words are no rows of the lattice.
SHORT_CHARS = 63
#: A square sign goes with the other characters: a piece joins it to a full stop.
_WORD = re.compile(r" *+[^\W\d_²]+| *+(?:[\d_²]|[^\w \n])+| +|\n")
_WHOLE = re.compile(r"(?s).+")
#: The letters of _WORD, and the kinds of characters it tells apart.
_LETTERS = re.compile(r"[^\W\d_²]+")
_SPACE, _BREAK, _LETTER, _OTHER = range(4)
#: Characters or ids looked at together (whole words, whole texts), and an odd factor of hashes.
_WINDOW, _FACTOR = 1 << 19, np.uint64(0x9E3779B97F4A7C15)
#: Rows that are Python objects at a time.
_ROWS = 256
#: Characters that a word's start may share with the word before.
_SHARED = 24
_MARK = "▁"
#: Edges as one number: a word has fewer than _SIDE characters, an edge fewer than _BYTES ids, a
#: vocabulary fewer than _IDS pieces.
_SIDE, _BYTES, _IDS = 128, 8, 2**32


def model_path(name: str = MODEL) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Vocabulary:
    """Pieces, with spaces for space marks, their scores, and the ids of the 256 bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pieces = {
            model.id_to_piece(i).replace(_MARK, " "): (i, model.get_score(i))
            for i in ids
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        self.longest = max(map(len, self.pieces))
        self.word = _WHOLE if any(len(_WORD.findall(p)) > 1 for p in self.pieces) else _WORD
        self.byte_cost = min(score for _, score in self.pieces.values()) - 10.0
        self.bytes_of = {i: p.encode() for p, (i, _) in self.pieces.items()} | {
            i: bytes([b]) for b, i in enumerate(self.byte_ids)
        }

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, i) for p, (i, _) in self.pieces.items()], "piece string, id long")

    def scores(self) -> Column:
        """An array of the scores by id + 1, a constant of the plan; the cost of a character
        without a piece is the first."""
        by_id = dict(self.pieces.values())
        known = [by_id.get(i, self.byte_cost) for i in range(-1, max(by_id) + 1)]
        return F.from_json(F.lit(json.dumps(known)), "array<double>")


def split_words(text: str | None, word: re.Pattern = _WORD) -> list[str]:
    return word.findall(f" {text}") if text else []


def long_path(word: str, pieces: dict, byte_ids: list[int], byte_cost: float, longest: int) -> list[int]:
    """The best path of a word of any length.

    Of two paths with the same score and number of pieces the one with the longer last piece is
    better, and paths to one place with equal last pieces have the same beginning.
    """
    best, last = [(0.0, 0)], [(0, ())]
    for end in range(1, len(word) + 1):
        top, step = None, None
        for begin in range(max(0, end - longest), end):  # the longest piece first
            known = pieces.get(word[begin:end])
            if known:
                ids, cost = (known[0],), known[1]
            elif end - begin == 1:
                ids, cost = tuple(byte_ids[b] for b in word[begin].encode()), byte_cost
            else:
                continue
            score, fewer = best[begin]
            into = (score + cost, fewer - len(ids))
            if top is None or into > top:
                top, step = into, (begin, ids)
        best.append(top)
        last.append(step)
    steps, end = [], len(word)
    while end:
        end, ids = last[end]
        steps.append(ids)
    return list(chain.from_iterable(reversed(steps)))


def lattice_paths(words: DataFrame, vocabulary: Vocabulary, tasks: int) -> DataFrame:
    """``words`` (columns part, number and word; part and number name a word) with ``ids``, the
    best path of each word, without ``word``.

    Words are dealt out once; substrings, edges and paths stay where their word is. The piece
    table is as large as the vocabulary, which does not grow with the data. An edge travels
    as one number, (end, begin, number of ids, id + 1), the last 0 where the character has no piece.
    The fold goes over the edges by their ends once: ``ends`` holds the best last step to each place
    that is done, ``best`` the best so far to the place behind them. The order of steps is that of
    preference: paths to one place whose last pieces are as long have the same beginning.
    """
    size = F.length("word")
    # a small input grows a hundredfold here: as many partitions as its words need, not its bytes
    named = words.withColumn("name", F.shiftleft(F.col("part").cast("long"), 32) + F.col("number"))
    dealt = named.select("name", "word").repartition(tasks, "name")
    starts = dealt.select("name", "word", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    most = F.least(F.lit(vocabulary.longest), size - F.col("start") + 1)
    spans = starts.select("name", "word", "start", F.explode(F.sequence(F.lit(1), most)).alias("length"))
    spans = spans.select(
        "name",
        "start",
        "length",
        F.expr("substring(word, start, length)").alias("piece"),
        F.when((F.col("start") == 1) & (F.col("length") == 1), F.col("word")).alias("word"),
    )
    joined = spans.join(F.broadcast(vocabulary.table(words.sparkSession)), "piece", "left").where(
        "id is not null or length = 1"
    )
    known = F.coalesce(F.col("id") + 1, F.lit(0).cast("long"))
    n_ids = F.when(F.col("id").isNull(), F.octet_length("piece")).otherwise(F.lit(1))
    place = (F.col("start") + F.col("length") - 1) * _SIDE + F.col("start") - 1
    edge = F.shiftleft((place * _BYTES + n_ids).cast("long"), 32) + known
    grouped = (
        joined.select("name", edge.alias("edge"), "word")
        .groupBy("name")
        .agg(F.collect_list("edge").alias("edges"), F.max("word").alias("word"))
    )
    scores, byte_ids = vocabulary.scores(), F.from_json(F.lit(json.dumps(vocabulary.byte_ids)), "array<int>")

    def followed(state: Column, edge: Column) -> Column:
        ends, best = state["ends"], state["best"]
        begin = F.shiftright(edge, 35).bitwiseAND(_SIDE - 1).cast("int")
        before = F.when(begin == F.size(ends), best).otherwise(F.get(ends, begin))
        score = before["score"] + F.get(scores, edge.bitwiseAND(_IDS - 1).cast("int"))
        step = F.struct(
            score.alias("score"),
            (before["fewer"] - F.shiftright(edge, 32).bitwiseAND(_BYTES - 1)).alias("fewer"),
            (-edge).alias("edge"),
        )
        same = F.shiftright(edge, 42) == F.size(ends)
        return (
            F.when(~same, F.struct(F.array_append(ends, best).alias("ends"), step.alias("best")))
            .when(score < best["score"], state)
            .otherwise(F.struct(ends.alias("ends"), F.greatest(best, step).alias("best")))
        )

    def bytes_at(begin: Column) -> Column:
        spelled = F.hex(F.encode(F.substr(F.col("word"), begin + 1, F.lit(1)), "UTF-8"))
        return F.transform(
            F.sequence(F.lit(0), (F.length(spelled) / 2).cast("int") - 1),
            lambda i: F.get(byte_ids, F.conv(F.substr(spelled, i * 2 + 1, F.lit(2)), 16, 10).cast("int")),
        )

    def back(done: Column, step: Column) -> Column:
        edge = -step["edge"]
        begin = F.shiftright(edge, 35).bitwiseAND(_SIDE - 1).cast("int")
        piece = edge.bitwiseAND(_IDS - 1).cast("int") - 1
        ids = F.when(piece >= 0, F.array_prepend(done["ids"], piece)).otherwise(F.concat(bytes_at(begin), done["ids"]))
        here = done["at"] == F.shiftright(edge, 42)
        return F.when(here, F.struct(begin.alias("at"), ids.alias("ids"))).otherwise(done)

    def traced(state: Column) -> Column:
        start = F.struct(F.length("word").alias("at"), F.array().cast("array<int>").alias("ids"))
        steps = F.reverse(F.array_append(state["ends"], state["best"]))
        return F.aggregate(steps, start, back, lambda done: done["ids"])

    one = "struct<score:double,fewer:bigint,edge:bigint>"
    # the way to place 0; its edge ends nowhere
    root = F.struct(F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("fewer"), F.lit(1).cast("long").alias("edge"))
    nothing = F.struct(F.array().cast(f"array<{one}>").alias("ends"), root.alias("best"))
    return grouped.select(
        F.shiftright("name", 32).cast("int").alias("part"),
        F.col("name").bitwiseAND(F.lit(0xFFFFFFFF)).alias("number"),
        F.aggregate(F.sort_array("edges"), nothing, followed, traced).alias("ids"),
    )


@cache
def _kinds(word: re.Pattern) -> np.ndarray:
    """The kind of every character, as ``word`` tells them apart."""
    kinds = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    if word is not _WHOLE:
        signs = np.arange(len(kinds), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
        for run in _LETTERS.finditer(signs):
            kinds[run.start() : run.end()] = _LETTER
        kinds[ord(" ")], kinds[ord("\n")] = _SPACE, _BREAK
    return kinds


def _numbered(texts: list[str | None], word: re.Pattern) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words in each text, the number of every word, and the distinct words by number, in the
    order of their first places: what ``split_words`` gives, for many texts at once.

    Words are told apart by 64-bit hashes; every word is then compared with the first of its
    number, and should two words share a hash, all are looked up as strings.
    """
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    flat = "".join(f" {t}" for t in texts if t)
    if not flat:
        return np.zeros(len(texts), np.int32), np.empty(0, np.int64), []
    points = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    kinds = _kinds(word)[points]
    first = np.ones(len(points), bool)
    first[1:] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != _SPACE) | (kinds[1:] == _BREAK)
    ends = np.cumsum(sizes)
    first[(ends - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(np.searchsorted(starts, np.r_[0, ends])).astype(np.int32)
    chars = np.diff(starts, append=len(points))
    powers = np.cumprod(np.full(int(chars.max()), _FACTOR, np.uint64))
    # whole words, as many as start in a window of the text
    edges = np.searchsorted(starts, np.arange(0, len(points) + _WINDOW, _WINDOW))
    windows = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]
    hashes = np.empty(len(starts), np.uint64)
    for w in windows:
        begin, inside = starts[w.start], _inside(chars[w])
        mixed = points[begin : begin + len(inside)] * _FACTOR
        mixed ^= mixed >> np.uint64(29)
        mixed *= powers[inside]
        hashes[w] = np.add.reduceat(mixed, starts[w] - begin)
    tokens, distinct = pd.factorize(hashes)
    at = np.empty(len(distinct), np.int64)
    at[tokens[::-1]] = np.arange(len(tokens))[::-1]
    same = bool((chars[at][tokens] == chars).all())
    for w in windows if same else []:
        begin, away = starts[w.start], np.repeat(starts[at[tokens[w]]] - starts[w], chars[w])
        away += np.arange(begin, begin + len(away))
        same = same and bool((points[begin : begin + len(away)] == points[away]).all())
    if same:
        words = [flat[a:b] for a, b in zip(starts[at].tolist(), (starts + chars)[at].tolist(), strict=True)]
        return lengths, tokens, words
    number: dict[str, int] = {}
    every = (flat[a:b] for a, b in zip(starts.tolist(), (starts + chars).tolist(), strict=True))
    tokens = np.fromiter((number.setdefault(w, len(number)) for w in every), np.int64, len(starts))
    return lengths, tokens, list(number)


def make_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS, word: re.Pattern = _WORD) -> DataFrame:
    """Documents in blocks: ids, words in each, the block's distinct words in alphabetical
    order, their ranks by frequency, and every word of the texts by its rank; a column of
    ``docs`` named digest goes along."""
    names = ["block", "doc_ids", "digests", "lengths", "words", "ranks", "tokens", "n_words"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), *[pa.binary()] * 4, pa.int64()]
    digest = F.col("digest") if "digest" in docs.columns else F.lit(None).cast("binary")

    def block(number: int, ids: list, digests: list, texts: list[str | None]) -> pa.RecordBatch:
        lengths, tokens, known = _numbered(texts, word)
        often = np.argsort(-np.bincount(tokens, minlength=len(known)), kind="stable")
        rank = np.empty(len(known), np.uint32)
        rank[often] = np.arange(len(known))
        order = sorted(range(len(known)), key=known.__getitem__)
        packed = [pack(lengths), _joined([known[i] for i in order]), pack_ranks(rank[order]), pack_ranks(rank[tokens])]
        values = [number, ids, digests, *packed, len(known)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, digests, texts, size = [], [], [], 0
        for batch in (b.slice(a, _ROWS) for b in batches for a in range(0, b.num_rows, _ROWS)):
            for doc_id, text, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                digests.append(known)
                texts.append(text)
                size += len(text or "")
                if size >= block_chars:
                    yield block(number, ids, digests, texts)
                    number, ids, digests, texts, size = number + 1, [], [], [], 0
        if ids:
            yield block(number, ids, digests, texts)

    return docs.select(F.col("doc_id").cast("long"), "text", digest.alias("digest")).mapInArrow(
        run,
        "block long, doc_ids array<long>, digests array<binary>, lengths binary, words binary, ranks binary, tokens binary, n_words long",
    )


def _bucketed(blocks: DataFrame) -> DataFrame:
    """``blocks`` written once in the shared folder, bucketed by block: a later grouping by
    block shuffles only what is joined to it."""
    spark = blocks.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(buckets, "block").option("path", new_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def _parts(words: list[str], shards: int) -> np.ndarray:
    hashes = pd.util.hash_array(np.array(words, object), categorize=False)
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _joined(words: list[str]) -> bytes:
    """Words in order, each after the length of the start it shares with the one before (as far
    as _SHARED characters)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.array(words, f"<U{_SHARED}").reshape(len(words), 1).view(np.uint32).reshape(len(words), _SHARED)
    shared = np.zeros(len(words), np.int64)
    if len(words) > 1:
        differ = np.ones((len(words) - 1, _SHARED + 1), bool)
        differ[:, :-1] = starts[1:] != starts[:-1]
        shared[1:] = np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    rest = [w[n:] for w, n in zip(words, shared.tolist(), strict=True)]
    lengths = np.array([shared, sizes - shared], "<u4")
    planes = lengths.view(np.uint8).reshape(-1, 4).T  # all low bytes first: the others are nearly all 0
    letters = "".join(rest).encode()
    return pack(np.r_[np.array([len(words)], "<u4").view(np.uint8), planes.ravel(), np.frombuffer(letters, np.uint8)])


def _cut(data: bytes) -> list[str]:
    flat = unpack(data, np.uint8)
    n = int(flat[:4].view("<u4")[0])
    lengths = np.ascontiguousarray(flat[4 : 4 + 8 * n].reshape(4, 2 * n).T).view("<u4").ravel()
    shared, sizes = lengths[:n].tolist(), lengths[n:].tolist()
    letters = flat[4 + 8 * n :].tobytes().decode()
    words, last, at = [], "", 0
    for keep, size in zip(shared, sizes, strict=True):
        last = last[:keep] + letters[at : at + size]
        at += size
        words.append(last)
    return words


def word_lists(blocks: DataFrame, shards: int) -> DataFrame:
    """Each block's distinct words by shard, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _cut(packed)
                parts = _parts(words, shards)
                order = np.argsort(parts, kind="stable")
                edges = np.flatnonzero(np.diff(parts[order], prepend=-1, append=shards))
                rows = [
                    {"part": int(parts[order[a]]), "block": block, "words": _joined([words[i] for i in order[a:b]])}
                    for a, b in zip(edges[:-1], edges[1:], strict=True)
                ]
                schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary())])
                yield pa.RecordBatch.from_pylist(rows, schema)

    return blocks.select("block", "words").mapInArrow(run, "part int, block long, words binary")


def encode(
    docs: DataFrame, path: str | None = None, block_chars: int = BLOCK_CHARS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """doc_id, n_words, n_pieces and ids for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    return _encoded(docs, Vocabulary(path or model_path()), block_chars, shard_words).drop("digest", "decoded")


def _encoded(
    docs: DataFrame, vocabulary: Vocabulary, block_chars: int, shard_words: int, decode: bool = False
) -> DataFrame:
    """``encode`` with the column digest of ``docs``, null where it has none, and decoded, null
    or the SHA-256 of the text that the ids give where they are put together."""
    spelled = _speller(vocabulary) if decode else None
    known = (vocabulary.pieces, vocabulary.byte_ids, vocabulary.byte_cost, vocabulary.longest)
    blocks = _bucketed(make_blocks(docs, block_chars, vocabulary.word))
    distinct_most = int(blocks.agg(F.sum("n_words")).first()[0] or 0)  # words of two blocks count twice
    shards = max(8, -(-distinct_most // shard_words))
    lists = word_lists(blocks, shards)

    def distinct(lists: pd.DataFrame) -> pd.DataFrame:
        words = sorted(w for w in set(chain.from_iterable(map(_cut, lists["words"]))) if len(w) <= SHORT_CHARS)
        return pd.DataFrame({"part": lists["part"].iloc[0], "number": range(len(words)), "word": words})

    words = lists.groupBy("part").applyInPandas(distinct, "part int, number long, word string")
    tasks = max(8, -(-distinct_most // TASK_WORDS))
    # no copy in between: the lists are shuffled once, for the distinct words and for their answers
    paths = lattice_paths(words, vocabulary, tasks)

    def answer(lists: pa.Table, paths: pa.Table) -> pa.Table:
        paths = paths.sort_by("number")  # the numbers of the short words in alphabetical order
        offsets, values = np.zeros(1, np.int64), np.empty(0, np.int32)
        if paths.num_rows:
            ids = paths["ids"].combine_chunks()
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy()
        cut = [_cut(x) for x in lists["words"].to_pylist()]
        words = sorted(set(chain.from_iterable(cut)), key=lambda w: (len(w) > SHORT_CHARS, w))
        number = {w: i for i, w in enumerate(words)}
        longs = [np.array(long_path(w, *known), np.int32) for w in words[paths.num_rows :]]
        offsets = np.r_[offsets, offsets[-1] + np.cumsum([len(x) for x in longs], dtype=np.int64)]
        values = np.concatenate([values, *longs])
        rows = []
        for part, block, words in zip(lists["part"].to_pylist(), lists["block"].to_pylist(), cut, strict=True):
            at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            sizes = offsets[at + 1] - offsets[at]
            found = np.repeat(offsets[at], sizes) + _inside(sizes)
            rows.append(
                {"block": block, "part": part, "sizes": pack_ranks(sizes), "ids": pack_ranks(values[found])}
            )
        schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])
        return pa.Table.from_pylist(rows, schema)

    answers = (
        lists.groupBy("part")
        .cogroup(paths.groupBy("part"))
        .applyInArrow(answer, "block long, part int, sizes binary, ids binary")
    )

    def assemble(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_pieces", "ids", "digest", "decoded"]
        if not blocks.num_rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.table([pa.array([], k) for k in kinds], names)
        row = blocks.to_pylist()[0]
        tokens, lengths = unpack_ranks(row["tokens"]), unpack(row["lengths"], np.int32)
        sizes, ids = np.empty(0, np.int64), np.empty(0, np.uint32)
        found = sorted(answers.to_pylist(), key=lambda r: r["part"])
        if found:
            sizes = np.concatenate([unpack_ranks(r["sizes"]) for r in found]).astype(np.int64)
            ids = np.concatenate([unpack_ranks(r["ids"]) for r in found])
        # answers come by shard; `place` is where the word of each rank is among them
        order = np.argsort(_parts(_cut(row["words"]), shards), kind="stable")
        place = np.empty(len(order), np.int64)
        place[unpack_ranks(row["ranks"])[order]] = np.arange(len(order))
        begins = np.r_[0, np.cumsum(sizes)][:-1]
        at = place[tokens]
        each = sizes[at]
        values = ids[np.repeat(begins[at], each) + _inside(each)].astype(np.int32)
        ends = np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(lengths)]]
        decoded = [None] * len(lengths)
        if spelled:
            decoded = [
                sha256(found[a + 1 : b]).digest()  # without the leading space
                for found, offsets in spelled(values, ends)
                for a, b in pairwise(offsets.tolist())
            ]
        return pa.table(
            [
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(lengths.astype(np.int64)),
                pa.array(np.diff(ends).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)),
                pa.array(row["digests"], pa.binary()),
                pa.array(decoded, pa.binary()),
            ],
            names,
        )

    return (
        blocks.select("block", "doc_ids", "digests", "lengths", "words", "ranks", "tokens")
        .groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(assemble, "doc_id long, n_words long, n_pieces long, ids array<int>, digest binary, decoded binary")
    )


def _inside(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. inside each run of the given sizes."""
    inside = np.arange(int(sizes.sum()))
    inside -= np.repeat(np.cumsum(sizes) - sizes, sizes)
    return inside


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``text``: the bytes of its ids, without the leading space. Null ids give
    an empty text."""
    return _decoded(encoded, Vocabulary(path or model_path()))


def _speller(vocabulary: Vocabulary) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]:
    known = [vocabulary.bytes_of.get(i) for i in range(max(vocabulary.bytes_of) + 1)]
    sizes_of = np.array([-1 if x is None else len(x) for x in known], np.int64)
    starts_of = np.r_[0, np.cumsum(np.maximum(sizes_of, 0))[:-1]]
    letters = np.frombuffer(b"".join(x or b"" for x in known), np.uint8)

    def spelled(ids: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The bytes of the texts whose ids lie between ``edges``, and where each begins and the
        last ends; so many texts at a time as begin in a window of the ids."""
        cuts = np.searchsorted(edges[:-1], np.arange(0, edges[-1] + _WINDOW, _WINDOW))
        cuts = np.unique(np.r_[0, cuts, len(edges) - 1])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            some = ids[edges[a] : edges[b]]
            sizes = sizes_of[some]
            if (sizes < 0).any():
                raise KeyError("an id without a piece")
            found = letters[np.repeat(starts_of[some], sizes) + _inside(sizes)]
            yield found, np.r_[0, np.cumsum(sizes)][edges[a : b + 1] - edges[a]]

    return spelled


def _decoded(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    spelled = _speller(vocabulary)

    def texts(found: np.ndarray, offsets: np.ndarray) -> pa.Array:
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(found)]
        whole = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers)
        whole.validate(full=True)
        return pc.utf8_slice_codeunits(whole, 1).cast(pa.string())

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        edges = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]
        parts = [texts(*x) for x in spelled(ids.flatten().to_numpy(), edges)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return encoded.withColumn("text", text("ids"))


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def round_trip(
    docs: DataFrame, path: str | None = None, block_chars: int = BLOCK_CHARS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``encode`` with text_sha256, the digest of the text decoded from the ids, and round_trip,
    whether it is the digest of the text that was read. A null text counts as empty."""
    read = docs.select("doc_id", "text", F.unhex(_digest(F.col("text"))).alias("digest"))
    found = _encoded(read, Vocabulary(path or model_path()), block_chars, shard_words, decode=True)
    text_sha256, equal = F.lower(F.hex("decoded")), F.col("decoded") == F.col("digest")
    return found.select(
        "doc_id", "n_words", "n_pieces", "ids", text_sha256.alias("text_sha256"), equal.alias("round_trip")
    )
