"""Exact copies by two passes over a Bloom filter, with DataFrame functions only.

Texts are equal when they agree after lower-casing A-Z. The first pass sets, for each row,
three bits of one 64-bit word of a filter, chosen by the hash of its text, and keeps the bits
that at least two rows set. The second pass tests every row: only a row whose three bits are
all among them may have a copy, and only such rows are grouped (and so shuffled) by the full
SHA-256 of their text. All others pass straight through as the only one of their kind. The
filter has ``BITS_PER_ROW`` bits for each row at every size, so about one unique row in
200 is grouped in vain.

The words of the filter are broadcast while there are at most ``BROADCAST_WORDS``, and joined
by a shuffle of the tested rows beyond that. Groups of more than one 4096th of the tested rows
(fewer than 4096 groups, whatever the input) are broadcast too, so that rows of one frequent text
never meet in one task; sizes and the row to keep are aggregated before they are shuffled.

Defined results: a null text equals an empty one; a null doc_id counts as smaller than any
other; rows that repeat doc_id and text are each reported with the same result, and
``drop_copies`` leaves one of them. Columns other than doc_id and text may have any name.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.session import stage

BITS_PER_ROW = 16
#: At most so many rows of two longs are broadcast as the filter: 16 MB.
BROADCAST_WORDS = 1 << 20
#: A group is heavy if it holds more than this share of the tested rows.
_HEAVY_SHARE = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHA, _WORD, _MASK, _BITS = "__sha", "__word", "__mask", "__bits"
_KEEP, _SIZE = "__keep", "__size"


def text_digest(text: Column) -> Column:
    """SHA-256, as bytes, of a text in which A-Z are small."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER).cast("binary"), 256))


def _marked(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` with the word of the filter that their digest falls into, and three bits of it."""
    bits = F.xxhash64(_SHA, F.lit(1))
    one = F.lit(1).cast("long")
    mask = F.lit(0).cast("long")
    for k in range(3):
        at = F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, at))
    return rows.withColumns({_WORD: F.pmod(F.xxhash64(_SHA), F.lit(words)), _MASK: mask})


def repeated_bits(rows: DataFrame, words: int) -> DataFrame:
    """The filter after the first pass: by word, the bits that two or more rows set."""
    places = F.array(*[F.lit(b) for b in range(64)])
    own = F.filter(places, lambda b: F.call_function("getbit", F.col(_MASK), b) == 1)
    return (
        _marked(rows, words)
        .groupBy(_WORD, _MASK)
        .count()
        .select(_WORD, F.explode(own).alias("bit"), "count")
        .groupBy(_WORD, "bit")
        .agg(F.sum("count").alias("rows"))
        .where("rows > 1")
        .groupBy(_WORD)
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias(_BITS))
    )


def _resolved(rows: DataFrame, bits_per_row: int, broadcast_words: int) -> DataFrame:
    """``rows`` (doc_id and their digest among the columns) with what stays and the group's size.

    ``rows`` is read four times and should be cheap to read.
    """
    words = max(1, -(-rows.count() * bits_per_row // 64))
    filter_words = stage(repeated_bits(rows.select(_SHA), words), "filter")
    if filter_words.count() <= broadcast_words:
        filter_words = F.broadcast(filter_words)
    tested = _marked(rows, words).join(filter_words, _WORD, "left")
    maybe = F.coalesce(F.col(_BITS).bitwiseAND(F.col(_MASK)) == F.col(_MASK), F.lit(False))
    tested = tested.withColumn("__maybe", maybe).drop(_WORD, _MASK, _BITS)

    groups = stage(
        tested.where("__maybe")
        .groupBy(_SHA)
        .agg(F.max("doc_id").alias(_KEEP), F.count(F.lit(1)).alias(_SIZE)),
        "groups",
    )
    flagged = groups.agg(F.sum(_SIZE)).first()[0] or 0
    heavy = groups.where(F.col(_SIZE) * _HEAVY_SHARE > flagged)
    light = groups.where(F.col(_SIZE) * _HEAVY_SHARE <= flagged)

    met = tested.join(F.broadcast(heavy), _SHA, "left")
    settled = met.where(~F.col("__maybe") | F.col(_SIZE).isNotNull())
    settled = settled.withColumns(
        {
            _KEEP: F.when(F.col(_SIZE).isNull(), F.col("doc_id")).otherwise(F.col(_KEEP)),
            _SIZE: F.coalesce(_SIZE, F.lit(1).cast("long")),
        }
    )
    others = met.where(F.col("__maybe") & F.col(_SIZE).isNull()).drop(_KEEP, _SIZE).join(light, _SHA)
    return settled.unionByName(others)


def copy_groups(
    docs: DataFrame, bits_per_row: int = BITS_PER_ROW, broadcast_words: int = BROADCAST_WORDS
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    rows = stage(docs.select("doc_id", text_digest(F.col("text")).alias(_SHA)), "digests")
    return _resolved(rows, bits_per_row, broadcast_words).select(
        "doc_id",
        F.col(_KEEP).alias("keep_id"),
        F.col(_SIZE).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col(_KEEP)).alias("kept"),
        F.lower(F.hex(_SHA)).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, bits_per_row: int = BITS_PER_ROW, broadcast_words: int = BROADCAST_WORDS
) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text. Rows without a copy are not shuffled."""
    rows = docs.withColumn(_SHA, text_digest(F.col("text")))
    kept = _resolved(rows, bits_per_row, broadcast_words).where(F.col("doc_id").eqNullSafe(F.col(_KEEP)))
    alone = kept.where(F.col(_SIZE) == 1)
    one_each = kept.where(F.col(_SIZE) > 1).dropDuplicates([_SHA])
    return alone.unionByName(one_each).select(*docs.columns)
