import itertools
import random

import numpy as np
import pytest

from stayline.llm import jaccard
from stayline.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(data):
    sets = [(i, shingles(t)) for i, t in data]
    parent = {i: i for i, _ in data if i is not None}
    links = [0] * len(data)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (p, (i, a)), (q, (j, b)) in itertools.combinations(enumerate(sets), 2):
        if i is None or j is None or not a or not b:
            continue
        if 10 * len(a & b) >= 8 * len(a | b):
            links[p] += 1
            links[q] += 1
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return sorted((str(i), str(find(i) if i is not None else None), links[p]) for p, (i, _) in enumerate(sets))


def mutated(words, share, seed):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"new{seed}x{k}" for k, w in enumerate(words))


def corpus():
    r = random.Random(1)
    vocabulary = [f"word{i}" for i in range(3000)]
    data = [(i, " ".join(r.choices(vocabulary, k=r.randint(5, 80)))) for i in range(100, 160)]
    base = r.choices(vocabulary, k=120)
    data += [(200 + i, mutated(base, 0.02, i)) for i in range(40)]  # near copies, some linked through others
    data += [(300 + i, data[0][1].upper()) for i in range(25)]  # exact copies
    passage = " ".join(r.choices(vocabulary, k=60))
    data += [(400 + i, passage + " " + " ".join(r.choices(vocabulary, k=100))) for i in range(10)]
    data += [(500, None), (501, ""), (502, "a b"), (503, "A  b"), (504, "a b c"), (None, data[0][1]), (505, " ")]
    data += [(100, data[0][1]), (506, " ".join(r.choices(vocabulary, k=30_000)))]
    data.append((507, data[-1][1] + " one more"))
    return data


def test_classes_and_links_by_brute_force(rows, monkeypatch):
    data = corpus()
    docs = rows([(i, t, 0, "x") for i, t in data], "doc_id long, text string, class_id int, key string")
    expected = brute(data)
    got = jaccard.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == expected
    # the same through chunks: a group of 40 texts in blocks of at most 8
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 8)
    got = jaccard.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == expected
    kept = jaccard.keep_one(docs, jaccard.near_duplicates(docs))
    assert kept.columns == docs.columns
    classes = {c for i, c, _ in expected}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(classes)


def test_empty_table(rows):
    docs = rows([], "doc_id long, text string")
    assert jaccard.near_duplicates(docs).count() == 0


def test_bands():
    bands, size = jaccard.choose_bands()
    assert 1 - (1 - 0.8**size) ** bands >= jaccard.RECALL and bands * size <= jaccard.MOST_HASHES
    assert jaccard.choose_bands(0.5, 0.9, 64) == (18, 3)
    with pytest.raises(ValueError):
        jaccard.choose_bands(0.1, 0.999, 5)


def test_linked_by_definition():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(80)]

    def jaccard_of(a, b):
        a, b = set(a.tolist()), set(b.tolist())
        return len(a & b) / len(a | b)

    got = jaccard.linked(sets, sets, 0.5, True)
    cross = jaccard.linked(sets[:30], sets[30:], 0.5, False)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == (i != j and jaccard_of(a, b) >= 0.5)
            if i < 30 <= j:
                assert cross[i, j - 30] == got[i, j]


def test_components(rows):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 100), (50, 50), (70, 50), (200, 199)]
    got = {r.node: r.root for r in components(rows(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 70: 50, 100: 50, 199: 199, 200: 199}
    assert components(rows([], "u long, v long")).count() == 0
