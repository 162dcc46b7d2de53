import math
import zlib
from collections import Counter

import numpy as np
import pytest

from stayline.llm import elias_fano, scoring


@pytest.mark.parametrize(("n", "top"), [(0, 10), (1, 1), (5, 3), (1000, 50), (4096, 2**20), (8193, 8193), (9000, 2**62)])
def test_sequences(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    sequence = elias_fano.Sequence(np.frombuffer(elias_fano.encode(values), np.uint8))
    positions = np.sort(rng.integers(0, max(n, 1), 300))[: n and 300]
    assert (sequence.at(positions) == values[positions]).all()
    targets = np.sort(np.r_[rng.integers(0, top + 5, 300, dtype=np.uint64), values[:50]])
    place, value = sequence.successor(targets)
    expected = np.searchsorted(values, targets)
    assert (place == expected).all()
    assert (value[expected < n] == values[expected[expected < n]]).all()


def test_trie(tmp_path):
    rng = np.random.default_rng(1)
    keys = np.unique((rng.integers(0, 300, 9000).astype(np.uint64) << np.uint64(32)) | rng.integers(0, 2**32, 9000).astype(np.uint64))
    contexts = np.unique(keys >> np.uint64(32))
    codes, context_codes = rng.integers(1, 255, len(keys)), rng.integers(1, 255, len(contexts))
    path = str(tmp_path / "trie")
    elias_fano.write_trie(path, keys, codes, context_codes)
    trie = elias_fano.Trie(path)
    assert isinstance(trie.codes, np.memmap)
    asked = np.unique(np.r_[keys, keys + np.uint64(1), rng.integers(0, 400, 50).astype(np.uint64) << np.uint64(32)])
    got, got_context = trie.find(asked)
    known = dict(zip(keys.tolist(), codes.tolist(), strict=True))
    known_context = dict(zip(contexts.tolist(), context_codes.tolist(), strict=True))
    assert got.tolist() == [known.get(k, 0) for k in asked.tolist()]
    assert got_context.tolist() == [known_context.get(k >> 32, 0) for k in asked.tolist()]
    size = (tmp_path / "trie").stat().st_size
    assert size < 6.5 * len(keys)


def corpus():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)] + ["the"] * 150 + ["École", "A"]
    data = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(150)]
    data += [(3, "THE the École"), (200, None), (201, ""), (None, "the w1"), (202, "x" * 5000 + " y " * 3000), (203, "a b\x0bc\x1cd")]
    return data


def brute(data, order, discount=0.75):
    texts = [(t or "").encode().lower().split() + [b"\n"] for _, t in data]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in data]
    counts = [Counter() for _ in range(order + 1)]
    for text, out in zip(texts, held, strict=True):
        for k in range(1, order + 1) if not out else ():
            padded = [b" "] * (k - 1) + text
            counts[k].update(tuple(padded[j : j + k]) for j in range(len(text)))
    n, v = sum(counts[1].values()), len(counts[1])
    totals, followers = [Counter() for _ in counts], [Counter() for _ in counts]
    for k in range(2, order + 1):
        for gram, c in counts[k].items():
            totals[k][gram[:-1]] += c
            followers[k][gram[:-1]] += 1
    rows = []
    for (i, _), text, out in zip(data, texts, held, strict=True):
        base = score = 0.0
        for j, word in enumerate(text):
            p = (counts[1][word,] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                gram = tuple(([b" "] * (k - 1) + text)[j : j + k])
                total = totals[k][gram[:-1]]
                if total:
                    p = max(counts[k][gram] - discount, 0) / total + discount * followers[k][gram[:-1]] / total * p
            score += math.log10(p)
        rows.append((str(i), out, len(text), sum(counts[1][w,] > 0 for w in text), n, base, score))
    return sorted(rows)


@pytest.mark.parametrize(("order", "block", "shard"), [(2, 2_000, 300), (3, 4_000, 500)])
def test_scores_by_brute_force(rows, order, block, shard):
    data = corpus()
    docs = rows([(i, t, 1.0, 0) for i, t in data], "doc_id long, text string, score double, block int").repartition(3)
    found = scoring.score_texts(docs, order=order, block_bytes=block, shard_tokens=shard).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found)
    expected = brute(data, order)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[5] == pytest.approx(e[5])
        assert abs(g[6] - e[6]) <= 0.03 * order * e[2]  # quantised to steps of 1/20


def test_empty_and_untrained(rows):
    assert scoring.score_texts(rows([], "doc_id long, text string")).count() == 0
    from pyspark.sql import functions as F

    found = scoring.score_texts(rows([(1, "a b")], "doc_id long, text string"), held=F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found] == [(3, 0, 0, 0.0, 0.0)]


def test_the_model_predicts_held_out_texts_better_than_its_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = scoring.score_texts(docs).where("held_out").selectExpr("sum(base_score) base", "sum(score) score", "sum(n_tokens) n").first()
    assert held.score / held.n > held.base / held.n + 0.3


def test_the_query_scores_histories_of_two_words(spark):
    from stayline.llm.queries import op1_lm_scoring

    sf = "/root/testdata/sf0.001"
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in op1_lm_scoring(spark, sf).collect())
    for g, e in zip(got, brute(data, 3), strict=True):
        assert g[:5] == e[:5]
        assert abs(g[6] - e[6]) <= 0.09 * e[2]
