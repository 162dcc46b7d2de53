import random
import re
import zlib

import numpy as np
import pytest

from stayline.llm import variants
from stayline.session import stage

SCHEMA = "doc_id long, text string, word string, n int, near string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(data, modulus):
    n = {}
    for doc_id, text in data:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").encode().lower().decode()):
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] = n.get(run, 0) + 1
    n = {w: c for w, c in n.items() if c >= 2}
    others = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in others.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(others[w]), n.get(form[w])))
    return sorted(rows, key=str)


def corpus():
    rng = random.Random(5)
    letters = "aabcdeéßÿz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(60)]
    words += ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "abababab", "babababa", "Ünüsüal", "ünüsüal"]
    for w in list(words):
        for _ in range(2):
            i = rng.randrange(len(w) + 1)
            words += [w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]]
    data = []
    for d in range(400):
        picked = [words[min(int(rng.expovariate(0.03)), len(words) - 1)] for _ in range(30)]
        data.append((d, rng.choice([" ", "-", "1", "…"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in picked)))
    data += [(7, None), (8, ""), (None, "formless formless formless"), (None, None), (9, "a" * 5000), (10, "a" * 5000)]
    data += [(11, "b" * 300 + "c" + "b" * 300), (12, "b" * 601), (13, "b" * 300 + "c" + "b" * 300), (14, "b" * 601)]
    data += [(20, "populär " * 2000), (21, "popular popular popularr popularr poplar")] * 2
    # a chain of forms: each ten times as frequent as the one before
    data += [(30 + d, "longestwort " * 200 + "longestword " * 12 + "longestwoord ") for d in range(6)]
    return data


@pytest.mark.parametrize("modulus, symbols", [(31, None), (3, 2), (3, 11)])
def test_by_brute_force(spark, rows, modulus, symbols):
    data = corpus()
    docs = rows([(*r, "x", 1, "y") for r in data], SCHEMA).repartition(5)
    found = variants.spelling_variants(docs, modulus, symbols).collect()
    wanted = brute(data, modulus)
    assert sorted(map(tuple, found), key=str) == wanted
    assert any(r[1] is not None and r[2] != r[1] for r in wanted)


def test_small_blocks_and_buckets(spark, rows, monkeypatch):
    for name, value in (("_BLOCK_WORDS", 7), ("_HASHES_AT_ONCE", 50), ("_CELLS_AT_ONCE", 64), ("_WORDS_AT_ONCE", 5)):
        monkeypatch.setattr(variants, name, value)
    data = corpus()[:60]
    docs = rows(data, "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    words = stage(variants.vocabulary(docs).withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    found = variants.near_words(words, words_per_bucket=10).where("near is not null").select("word", "near").collect()
    known = [r.word for r in words.collect()]
    assert sorted(map(tuple, found)) == sorted((a, b) for a in known for b in known if near(a, b))


@pytest.mark.parametrize("symbols", [1, 2, 5])
def test_neighbourhoods_are_whole_and_without_repeats(symbols):
    rng = np.random.default_rng(1)
    for length in (1, 2, 7):
        values = rng.integers(1, symbols + 1, (20, length)).astype(np.uint64)

        def one(word):
            word = np.array([word], np.uint64).reshape(1, -1)
            return int(variants._mixed(variants._running(word, variants._powers(word.shape[1])))[0, -1])

        found = {}
        for row, hashes in variants.neighbourhoods(values, symbols):
            for r, x in zip(row.tolist(), hashes.tolist()):
                found.setdefault(r, []).append(x)
        for r, word in enumerate(values.tolist()):
            strings = {tuple(word)}
            for i in range(length + 1):
                strings |= {tuple(word[:i] + [s] + word[i:]) for s in range(1, symbols + 1)}
                if i < length:
                    strings |= {tuple(word[:i] + [s] + word[i + 1 :]) for s in range(1, symbols + 1)}
                    strings.add(tuple(word[:i] + word[i + 1 :]))
            assert sorted(found[r]) == sorted(one(list(s)) for s in strings)


def test_empty_table(spark, rows):
    assert variants.spelling_variants(rows([], "doc_id long, text string")).count() == 0
    assert variants.spelling_variants(rows([(1, None), (2, "")], "doc_id long, text string")).count() == 0
