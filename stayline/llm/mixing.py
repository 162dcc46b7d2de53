"""Mixing sources to target weights.

The words of each source, documents in a pseudorandom order, are packed into blocks of
fixed length. Every output shard draws how many of its slots each source fills; the slots
of a source are numbered through all shards and mapped to its blocks by a pseudorandom
permutation, a new one for each pass over the source. Documents meet their slots in a join
on (source, block). Only sums by source and the draws pass through the driver.

Defined results: a null text has no words, a null source is a source of its own (the last);
documents without words take part with nothing; repeated rows are documents of their own.
With an empty table, or without any word, nothing is taken. Other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import stage

WORD = r"[^\x20\x09-\x0D]+"
MOST_PASSES = 3
MOST_SOURCES = 100_000
_ROUNDS = 24
_TASK_SLOTS = 100_000


@dataclass(frozen=True)
class Plan:
    """By source, in order: its words, target words, blocks and slots."""

    sources: list[str | None]
    size: np.ndarray
    target: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray


def targets(size: np.ndarray, weight: np.ndarray, most: float = MOST_PASSES) -> np.ndarray:
    """Shares of the sum of sizes by weight; none above ``most`` times its size, what is over
    goes to the others by weight until none is above."""
    target = np.zeros(len(size))
    free = np.ones(len(size), bool)
    rest = float(size.sum())
    while free.any():
        target[free] = rest * weight[free] / weight[free].sum()
        above = free & (target > most * size)
        if not above.any():
            break
        target[above] = most * size[above]
        rest -= target[above].sum()
        free &= ~above
    return target


def draw_shards(slots: np.ndarray, shard_slots: int, seed: int) -> np.ndarray:
    """Slots of each source in each output shard, (shards, sources).

    Every shard draws its counts from the multinomial distribution over the slots that are
    left; what a source cannot fill is drawn again from the others. So the sums by source are
    exact.
    """
    rng = np.random.default_rng(seed)
    left = slots.astype(np.int64).copy()
    shards = max(1, -(-int(left.sum()) // shard_slots))
    drawn = np.zeros((shards, len(left)), np.int64)
    for j in range(shards):
        want = -(-int(left.sum()) // (shards - j))
        while want > 0:
            counts = np.minimum(rng.multinomial(want, left / left.sum()), left)
            drawn[j] += counts
            left -= counts
            want -= int(counts.sum())
    return drawn


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. size-1 by ``key``: swap-or-not rounds, each of
    which pairs x with k - x and swaps the pair or not by a hash of its larger member."""

    def swapped(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, *key), size) - x, size)
        swap = F.pmod(F.xxhash64(r, F.greatest(x, partner), *key), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), index, swapped)


def _key(seed: int) -> Column:
    """Order of the documents in their source; rows of equal doc_id and text share it."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _key(seed).alias("shuffled"),
    )


def make_plan(sized: DataFrame, block_words: int) -> Plan:
    """Targets and slots by source; refuses more than MOST_SOURCES sources."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    sums.sort(key=lambda r: (r.source is None, r.source or ""))
    size = np.array([r["size"] for r in sums], np.int64)
    target = targets(size, 1.0 + np.arange(len(size)) % 3)
    blocks = -(-size // block_words)
    slots = np.minimum(np.rint(target * blocks / np.maximum(size, 1)).astype(np.int64), MOST_PASSES * blocks)
    return Plan([r.source for r in sums], size, target, blocks, slots)


def place(sized: DataFrame, plan: Plan, bucket_rows: int = 2_000) -> DataFrame:
    """Adds ``at`` (the source's number), source_size, target, and the document's place in its
    source's words: ``start``, ``end`` and the unique ``row`` of its ``bucket``.

    Running sums work on buckets of about ``bucket_rows`` documents; the sums of the buckets
    are summed up once more.
    """
    spark = sized.sparkSession
    known = spark.createDataFrame(
        [(i, s, int(n), float(t)) for i, (s, n, t) in enumerate(zip(plan.sources, plan.size, plan.target, strict=True))],
        "at int, source_name string, source_size long, target double",
    )
    buckets = max(1, -(-sized.count() // bucket_rows))
    rows = (
        sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("source_name")))
        .drop("source_name")
        .withColumn("bucket", F.pmod("shuffled", F.lit(buckets)))
    )
    before = Window.partitionBy("at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("at", "bucket")
        .agg(F.sum("size").alias("words"))
        .select("at", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("at", "bucket").orderBy("shuffled", "doc_id", "size")
    return (
        rows.withColumn("row", F.row_number().over(inside))
        .withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, ["at", "bucket"])
        .withColumn("end", F.col("end") + F.col("offset"))
        .withColumn("start", F.col("end") - F.col("size"))
        .drop("offset")
    )


def slot_blocks(spark, plan: Plan, shard_slots: int, seed: int) -> DataFrame:
    """Every slot of the mix: shard, at, slot, turn (pass over the source) and block."""
    drawn = draw_shards(plan.slots, shard_slots, seed)
    first = np.cumsum(drawn, axis=0) - drawn
    cells = spark.createDataFrame(
        [
            (int(j), int(i), int(first[j, i]), int(drawn[j, i]), int(plan.blocks[i]))
            for j, i in zip(*np.nonzero(drawn), strict=True)
        ],
        "shard int, at int, first long, n long, blocks long",
    )
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(plan.slots.sum()) // _TASK_SLOTS))
    slots = cells.repartition(tasks, "shard", "at").select(
        "shard", "at", "blocks", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot")
    )
    turn = F.expr("slot div blocks").alias("turn")
    return slots.select("shard", "at", "slot", "blocks", turn).select(
        "shard",
        "at",
        "slot",
        "turn",
        permuted(F.expr("slot % blocks"), F.col("blocks"), F.lit(seed), F.col("at"), F.col("turn")).alias("block"),
    )


def pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """One row for each document and block it reaches into; documents without words keep one
    row with a null block."""
    last = f"(end - 1) div {block_words}"
    spread = placed.withColumn(
        "block", F.explode_outer(F.expr(f"if(size > 0, sequence(start div {block_words}, {last}), null)"))
    )
    return spread.withColumn("from_word", F.greatest("start", F.col("block") * block_words) - F.col("start")).withColumn(
        "to_word", F.least("end", (F.col("block") + 1) * block_words) - F.col("start")
    )


def mix(docs: DataFrame, block_words: int = 128, shard_slots: int = 65_536, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row of ``docs``."""
    spark = docs.sparkSession
    sized = stage(_sized(docs, seed), "sizes")
    plan = make_plan(sized, block_words)
    uses = (
        slot_blocks(spark, plan, shard_slots, seed)
        .groupBy("at", "block")
        .agg(F.count(F.lit(1)).alias("uses"))
        .hint("merge")  # slots grow out of a few rows, by which Spark would take them for small
    )
    row = ["doc_id", "source", "size", "source_size", "target", "at", "bucket", "row"]
    return (
        pieces(place(sized, plan), block_words)
        .join(uses, ["at", "block"], "left")
        .groupBy(*row)
        .agg(F.coalesce(F.sum((F.col("to_word") - F.col("from_word")) * F.col("uses")), F.lit(0)).alias("taken"))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, block_words: int = 128, shard_slots: int = 65_536, seed: int = 11) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each document and each pass
    over its source that takes something of it.

    A document that a pass takes whole keeps its text as it is; otherwise its text is the words
    taken, joined by spaces. n_chars, if there, follows the text.
    """
    names = docs.columns
    sized = stage(_sized(docs, seed), "sizes")
    plan = make_plan(sized, block_words)
    uses = slot_blocks(docs.sparkSession, plan, shard_slots, seed).select("at", "block", "turn").hint("merge")
    taken = (
        pieces(place(sized, plan), block_words)
        .join(uses, ["at", "block"])
        .groupBy(F.col("doc_id").alias("__id"), F.col("shuffled").alias("__key"), "at", "bucket", "row", "size", "turn")
        .agg(
            F.sum(F.col("to_word") - F.col("from_word")).alias("__taken"),
            F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("__spans"),
        )
        .select("__id", "__key", F.col("size").alias("__size"), "__taken", "__spans")
        .hint("merge")
    )
    texts = docs.withColumn("__key", _key(seed)).dropDuplicates(["doc_id", "__key"])
    joined = texts.join(taken, F.col("doc_id").eqNullSafe(F.col("__id")) & (texts["__key"] == taken["__key"]))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.transform(
        "__spans",
        lambda s: F.slice(F.col("__words"), (s["from_word"] + 1).cast("int"), (s["to_word"] - s["from_word"]).cast("int")),
    )
    partly = F.col("__taken") < F.col("__size")
    result = joined.withColumn("__words", F.when(partly, words)).withColumn(
        "text", F.when(partly, F.array_join(F.flatten(cut), " ")).otherwise(F.col("text"))
    )
    if "n_chars" in names:
        result = result.withColumn("n_chars", F.when(partly, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return result.select(*names)
