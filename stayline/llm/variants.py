"""Groups of spelling variants: words one edit apart, found over a reduced alphabet.

Words are the distinct results of taking runs of letters from all texts, with a share of the
runs losing one letter (chosen by a hash of document and run, so that there are variants to
find). Letters are hashed to a few symbols, more of them the larger the vocabulary, so that a
reduced word stands for few words. The full neighbourhood of each reduced word (itself, and
every deletion, replacement and insertion of one symbol) is generated as hashes, from running
sums over the word, without writing out a string. Neighbourhoods meet the reduced vocabulary
by equal hash: both are dealt by it to buckets of bounded size, as packed arrays. Whatever
meets is verified on the original words. If two words are one edit apart, so are their reduced
words, or these are equal; so no pair is lost.

Defined results: a null text has no words; a null doc_id hashes as ``null``; repeated rows count
each; words are compared and ordered by code points. An empty table gives no rows. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.packing import pack, unpack
from stayline.session import stage

#: Fixed values of the contract.
LEAST_LETTERS, LEAST_COUNT, FORM_RATIO, DAMAGE_MODULUS = 7, 2, 10, 31
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands them on.
_WORDS_AT_ONCE = 400_000
#: Words of a block of neighbourhoods (a place in it takes 16 bits), and hashes held at once.
_BLOCK_WORDS, _HASHES_AT_ONCE, _CELLS_AT_ONCE = 1 << 16, 1 << 22, 1 << 18
#: Words that a bucket of hashes has on average.
WORDS_PER_BUCKET = 8192
_HASH_BITS = 48
_LETTER_MIX = 0x9E3779B1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def damaged(doc_id, run: str, modulus: int = DAMAGE_MODULUS) -> str:
    """The run, without one letter if its hash says so."""
    return _damaged(zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode()), run, modulus)


def _damaged(prefix: int, run: str, modulus: int) -> str:
    h = zlib.crc32(run.encode(), prefix)
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, modulus: int = DAMAGE_MODULUS) -> DataFrame:
    """word, n: words of enough letters that occur often enough in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())}
            )

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                small = text.as_buffer().to_pybytes().lower().decode()
                prefix = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(_RUN.findall(small)).items():
                    if len(run) >= LEAST_LETTERS:
                        word = _damaged(prefix, run, modulus)
                        if len(word) >= LEAST_LETTERS:
                            seen[word] += n
                if len(seen) >= _WORDS_AT_ONCE:
                    yield rows()
                    seen.clear()
        yield rows()

    texts = docs.where("text is not null").select("doc_id", "text")
    counts = texts.mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def symbols_for(n_words: int) -> int:
    """So many symbols that those of eight letters could tell four times the words apart."""
    return max(4, int(np.ceil((4.0 * max(n_words, 1)) ** 0.125)))


def reduce_letters(codes: np.ndarray, symbols: int) -> np.ndarray:
    """1 to ``symbols`` for each code point."""
    mixed = (codes.astype(np.uint64) * np.uint64(_LETTER_MIX)) & np.uint64(0xFFFFFFFF)
    return ((mixed * np.uint64(symbols)) >> np.uint64(32)) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(64 - _HASH_BITS)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE), dtype=np.uint64)])


def _running(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, .. symbols of each row: sums of symbol times power of place."""
    sums = np.zeros((len(values), values.shape[1] + 1), np.uint64)
    np.cumsum(values * powers[: values.shape[1]], axis=1, dtype=np.uint64, out=sums[:, 1:])
    return sums


def neighbourhoods(values: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every different string within one edit of each row of ``values`` (words
    of one length, as symbols), in pieces of bounded size."""
    n, length = values.shape
    powers = _powers(length + 1)
    sums = _running(values, powers)
    total = sums[:, -1]
    yield np.arange(n), _mixed(total)
    step = max(1, _CELLS_AT_ONCE // max(n, 1))
    for a in range(0, length + 1, step):
        b = min(a + step, length)
        before = sums[:, a : min(a + step, length + 1)]
        row = np.broadcast_to(np.arange(n)[:, None], before.shape)
        # the symbol on the left; 0 at the start. Edits are made at the left end of a run of
        # equal symbols only, so that no string comes twice
        left = np.zeros(before.shape, np.uint64)
        first = max(a, 1)
        left[:, first - a :] = values[:, first - 1 : first - 1 + before.shape[1] - (first - a)]
        place = powers[a : a + before.shape[1]]
        for s in range(1, symbols + 1):
            new = left != s
            yield row[new], _mixed((before + np.uint64(s) * place + (total[:, None] - before) * _BASE)[new])
        if b > a:
            own, before, row, left = values[:, a:b], before[:, : b - a], row[:, : b - a], left[:, : b - a]
            gone = left != own
            yield row[gone], _mixed((before + (total[:, None] - sums[:, a + 1 : b + 1]) * _UNBASE)[gone])
            for s in range(1, symbols + 1):
                new = own != s
                changed = total[:, None] + (np.uint64(s) - own) * powers[a:b]
                yield row[new], _mixed(changed[new])


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, their symbols) of words of one length, few enough at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            length = int(lengths[places[0]])
            rows = max(1, _CELLS_AT_ONCE // length)
            for k in range(0, len(places), rows):
                some = places[k : k + rows]
                letters = "".join(words[i] for i in some).encode("utf-32-le")
                yield some, reduce_letters(np.frombuffer(letters, "<u4").reshape(len(some), length), symbols)


def _dealt(hashes: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By bucket: hashes in order (their low 32 bits) and 16-bit places."""
    both = np.sort((hashes << np.uint64(16)) | places.astype(np.uint64))
    hashes = both >> np.uint64(16)
    edges = np.array([-(-(k << _HASH_BITS) // buckets) for k in range(buckets + 1)], np.uint64)
    cuts = np.searchsorted(hashes, edges)
    low = (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")
    place = (both & np.uint64(0xFFFF)).astype("<u2")
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), low[cuts[k] : cuts[k + 1]], place[cuts[k] : cuts[k + 1]]


def _planes(x: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T)


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(unpack(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _runs_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of consecutive ids, short enough for 16-bit places."""
    for batch in batches:
        ids = batch["id"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids) != 1) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            for k in range(a, b, _BLOCK_WORDS):
                part = batch.slice(k, min(b - k, _BLOCK_WORDS))
                if part.num_rows:
                    yield int(ids[k]), part


def _neighbour_blocks(words: DataFrame, symbols: int, buckets: int) -> DataFrame:
    """bucket, first id, hashes and places of the neighbourhoods of all words."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, part in _runs_of_ids(batches):
            held, size = [], 0

            def rows() -> pa.RecordBatch:
                hashes, places = (np.concatenate(x) for x in zip(*held))
                dealt = [(k, first, _planes(h), _planes(p)) for k, h, p in _dealt(hashes, places, buckets)]
                return pa.RecordBatch.from_pydict(dict(zip(("bucket", "first", "hashes", "places"), map(list, zip(*dealt)))))

            for places, values in _by_length(part["word"].to_pylist(), symbols):
                for row, hashes in neighbourhoods(values, symbols):
                    held.append((hashes, places[row]))
                    size += len(hashes)
                    if size >= _HASHES_AT_ONCE:
                        yield rows()
                        held, size = [], 0
            if size:
                yield rows()

    return words.select("id", "word").mapInArrow(deal, "bucket long, first long, hashes binary, places binary")


def _reduced_words(words: DataFrame, symbols: int, buckets: int) -> DataFrame:
    """bucket, and the hashes, ids, words and counts of the reduced vocabulary in it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, part in _runs_of_ids(batches):
            held = [
                (_mixed(_running(values, _powers(values.shape[1]))[:, -1]), places)
                for places, values in _by_length(part["word"].to_pylist(), symbols)
            ]
            hashes, places = (np.concatenate(x) for x in zip(*held))
            for bucket, low, place in _dealt(hashes, places, buckets):
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([bucket] * len(low), pa.int64()),
                        "hash": pa.array(low.astype(np.int64), pa.int64()),
                        "id": pa.array(first + place.astype(np.int64), pa.int64()),
                        "word": part["word"].take(pa.array(place.astype(np.int64))),
                        "n": part["n"].take(pa.array(place.astype(np.int64))),
                    }
                )

    return words.mapInArrow(deal, "bucket long, hash long, id long, word string, n long")


_MET = "id long, near string, near_n long"


def _meet(blocks: pa.Table, keys: pa.Table) -> pa.Table:
    """All (id, other word) whose hashes are equal, of one bucket."""
    keys = keys.combine_chunks().sort_by("hash")
    known, ids = keys["hash"].to_numpy().astype(np.uint32), keys["id"].to_numpy()
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(known):
        for first, hashes, places in zip(blocks["first"].to_pylist(), blocks["hashes"].to_pylist(), blocks["places"].to_pylist()):
            hashes = _from_planes(hashes, "<u4")
            lo = np.searchsorted(known, hashes, "left")
            hit = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == hashes)
            lo = lo[hit]
            times = np.searchsorted(known, hashes[hit], "right") - lo
            mine = np.repeat(first + _from_planes(places, "<u2")[hit].astype(np.int64), times)
            at = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
            other = mine != ids[at]
            left.append(mine[other])
            right.append(at[other])
    at = pa.array(np.concatenate(right))
    return pa.table({"id": np.concatenate(left), "near": keys["word"].take(at), "near_n": keys["n"].take(at)})


def near_words(words: DataFrame, symbols: int | None = None, words_per_bucket: int = WORDS_PER_BUCKET) -> DataFrame:
    """id, word, n, near, near_n: each staged word (id, word, n; ids consecutive where they
    were written) with every other word one edit away; near is null if there is none."""
    total = words.count()
    symbols = symbols or symbols_for(total)
    buckets = max(1, -(-total // words_per_bucket))
    blocks = _neighbour_blocks(words, symbols, buckets).groupBy("bucket")
    met = blocks.cogroup(_reduced_words(words, symbols, buckets).groupBy("bucket")).applyInArrow(_meet, _MET)
    pairs = words.join(met, "id", "left")
    near = F.levenshtein("word", "near", 1) == 1
    return pairs.withColumns({"near": F.when(near, F.col("near")), "near_n": F.when(near, F.col("near_n"))})


def _with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form. A form has at least ten times the count of
    its word, so that a chain has no more links than the largest count has digits."""
    links = stage(forms.where("form is not null").select("word", "form"), "forms")
    steps = links.select(F.col("word").alias("follower"), F.col("form").alias("at"))
    done = None
    while True:
        met = steps.join(links, steps["at"] == links["word"], "left").select("follower", "at", "form")
        met = stage(met, "roots")
        ended = met.where("form is null").select(F.col("follower").alias("word"), F.col("at").alias("root"))
        done = ended if done is None else done.unionByName(ended)
        steps = met.where("form is not null").select("follower", F.col("form").alias("at"))
        if steps.isEmpty():
            return done


def spelling_variants(docs: DataFrame, modulus: int = DAMAGE_MODULUS, symbols: int | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs``."""
    counted = vocabulary(docs, modulus)
    words = stage(counted.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))))
    near = near_words(words, symbols).groupBy("id", "word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= FORM_RATIO * F.col("n")
    forms = stage(
        near.select(
            "word",
            F.when(is_form, F.col("best.word")).alias("form"),
            "n",
            "n_near",
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        ),
        "variants",
    )
    with_root = forms.join(_with_roots(forms), "word", "left")
    return with_root.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
