import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import mixing


def corpus(rows):
    data = []
    for i in range(600):
        source = [None, "a", "b", "c", "é"][i % 5] if i % 3 else "hot"
        data.append((i, " ".join(f"{source}{i}w{j}" for j in range(i % 97)), source, i, "x"))
    data += [(7, "same row", "a", 1, "x"), (7, "same row", "a", 1, "x"), (None, "no id here", "b", 2, "x"), (9, None, "c", 3, "x")]
    return rows(data, "doc_id long, text string, source string, n_chars long, at string")


def test_targets():
    size = np.array([100, 100, 100])
    assert mixing.targets(size, np.array([1.0, 2.0, 3.0])).tolist() == [50, 100, 150]
    got = mixing.targets(np.array([10, 500, 490]), np.array([1.0, 2.0, 3.0]))
    assert got == pytest.approx([30, 970 * 2 / 5, 970 * 3 / 5])
    assert mixing.targets(np.array([0, 10]), np.array([1.0, 2.0])).tolist() == [0, 10]
    assert mixing.targets(np.array([0, 0]), np.array([1.0, 2.0])).tolist() == [0, 0]


def test_draws_keep_the_sums():
    slots = np.array([5, 0, 1000, 37])
    drawn = mixing.draw_shards(slots, 100, 1)
    assert drawn.sum(0).tolist() == slots.tolist()
    assert len(drawn) == 11 and drawn.sum(1).max() - drawn.sum(1).min() <= 1


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    column = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(1))
    got = [r[0] for r in spark.range(n).select(column).collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or got != sorted(got)


def test_mix(rows):
    docs = corpus(rows)
    got = mixing.mix(docs, block_words=16, shard_slots=100).collect()
    assert len(got) == docs.count()
    by_source = {}
    for r in got:
        assert r.taken <= 3 * r["size"]
        by_source.setdefault(r.source, []).append(r)
    total = sum(r["size"] for r in got)
    order = sorted((s for s in by_source if s is not None)) + [None]
    sizes = np.array([sum(r["size"] for r in by_source[s]) for s in order])
    expected = mixing.targets(sizes, 1.0 + np.arange(len(order)) % 3)
    assert expected.sum() == pytest.approx(total)
    for s, size, target in zip(order, sizes, expected, strict=True):
        assert {r.source_size for r in by_source[s]} == {size}
        assert by_source[s][0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in by_source[s]) - target) <= 2 * 16
    again = mixing.mix(docs.repartition(7), block_words=16, shard_slots=100).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_documents_of_the_mix_hold_the_words_taken(rows):
    docs = corpus(rows).where("doc_id <> 7 or n_chars <> 1")
    sums = {r.doc_id: (r["size"], r.taken) for r in mixing.mix(docs, block_words=16, shard_slots=100).collect()}
    mixed = mixing.mixed_documents(docs, block_words=16, shard_slots=100)
    assert mixed.columns == docs.columns
    words = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in mixed.collect():
        taken = r.text.split()
        whole = texts[r.doc_id].split()
        assert set(taken) <= set(whole) and len(taken) == len(set(taken))
        if len(taken) == len(whole):
            assert r.text == texts[r.doc_id]
        words[r.doc_id] = words.get(r.doc_id, 0) + len(taken)
    assert words == {k: t for k, (_, t) in sums.items() if t}


def test_empty(rows):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(rows([], schema)).count() == 0
    assert [r.taken for r in mixing.mix(rows([(1, None, None), (2, " ", "a")], schema)).collect()] == [0, 0]
    assert mixing.mixed_documents(rows([], schema)).count() == 0
