import numpy as np
import pytest

from stayline.llm import quality
from stayline.llm.boosting import fit_trees

WORDS = [f"w{i}" for i in range(400)]


def brute(text):
    words = (text or "").encode().split()
    n = len(words)
    windows = {}
    for i in range(n - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    seen, repeated = set(), 0
    for line in lines:
        repeated += line in seen
        seen.add(line)
    return (
        n,
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text or ""),
        repeated,
        len(covered),
    )


TEXTS = [
    None,
    "",
    " \n\t",
    "ein Wörtchen # | ß",
    " ".join(WORDS),
    "a b c d e f g h " * 3,
    "a b c d e f g h " * 3 + " ".join(WORDS),
    "x\ny\nx\n x\n\n\ny",
    "no break space stays in its word",
    "long " * 50_000 + "end",
]


def test_statistics_by_brute_force(rows):
    data = [(i, t, 0.5, True, 3) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], 0.1, False, 1), (None, "x", None, None, 1)]
    docs = rows(data, "doc_id long, text string, score double, kept boolean, n_words int")
    found = quality.document_statistics(docs).collect()
    assert len(found) == len(data)
    for r in found:
        if r.doc_id is None:
            continue
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_empty_table_and_no_labels(rows):
    docs = rows([], "doc_id long, text string")
    labels = rows([], "doc_id long, quality int")
    stats = quality.document_statistics(docs)
    model = quality.fit_quality(stats, labels)
    assert model is None
    assert quality.score_quality(stats, model).count() == 0
    one = quality.document_statistics(rows([(1, " ".join(WORDS))], "doc_id long, text string"))
    assert [r.kept for r in quality.score_quality(one, None).collect()] == [True]


def test_held_out_accuracy_and_rows_pass_whole(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.document_statistics(docs).cache()
    model = quality.fit_quality(stats, labels.where("doc_id % 2 = 0"))
    scored = quality.score_quality(stats, model).join(labels, "doc_id").where("doc_id % 2 = 1 and not base_failed")
    good = scored.where("quality = 1").count()
    bad = scored.where("quality = 0").count()
    assert scored.where("quality = 1 and kept").count() == good
    assert scored.where("quality = 0 and not kept").count() >= 0.9 * bad
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema
    expected = {r.doc_id for r in quality.score_quality(stats, model).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == expected
    assert kept.exceptAll(docs).count() == 0


def test_trees_are_monotone_and_fit():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.3)).astype(float)
    noisy = np.where(rng.random(3000) < 0.05, 1 - y, y)
    trees = fit_trees(x, noisy, np.array([-1, 1, 0]))
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.97
    grid = np.repeat(rng.random((50, 3)), 101, axis=0)
    for j, sign in ((0, -1), (1, 1)):
        probe = grid.copy()
        probe[:, j] = np.tile(np.linspace(0, 1, 101), 50)
        steps = np.diff(trees.margin(probe).reshape(50, 101), axis=1) * sign
        assert steps.min() >= -1e-12


def test_scores_equal_a_walk_through_each_tree():
    rng = np.random.default_rng(1)
    x, y = rng.random((500, 4)), rng.integers(0, 2, 500).astype(float)
    trees = fit_trees(x, y, np.zeros(4, int), rounds=5, depth=3)
    for row, got in zip(x[:40], trees.margin(x[:40]), strict=True):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert got == pytest.approx(total)
