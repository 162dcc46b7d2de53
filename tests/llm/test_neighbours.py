import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import neighbours


def corpus():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(700, 8)).round(2)
    data = [(i, p.tolist()) for i, p in enumerate(points)]
    data += [(1000 + i, points[3].tolist()) for i in range(60)]  # ties
    data += [(5, points[5].tolist()), (6, points[7].tolist())]  # repeated rows, and another vector of a known id
    data += [(2000, None), (2010, [0.0] * 8), (2020, [1.0] * 7 + [None]), (2030, [float("nan")] * 8)]
    data += [(2040, [float("inf")] + [1.0] * 7), (None, points[0].tolist()), (2050, [1.0, 2.0]), (2060, [2.0, 2.0]), (2070, [])]
    return data


def brute(data, k):
    good = {}
    for i, v in data:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i, tuple(v)] = np.array(v)
    result = {}
    for own in {i for i, _ in good if i % 10 == 0}:
        found = [
            (float(np.sqrt(((p - q) ** 2).sum())), i)
            for (j, _), q in good.items()
            if j == own
            for (i, _), p in good.items()
            if i != own and len(p) == len(q)
        ]
        result[own] = sorted(found)[:k]
    return result


@pytest.mark.parametrize(("shard_rows", "query_rows"), [(100, 30), (10_000, 10_000)])
def test_factor_one_is_exact(rows, shard_rows, query_rows):
    data = corpus()
    vectors = rows([(i, v, 1, 0.5) for i, v in data], "vec_id long, embedding array<double>, rank int, score double")
    found = neighbours.nearest(vectors, F.col("vec_id") % 10 == 0, 10, 1.0, shard_rows, query_rows).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    expected = {i: f for i, f in brute(data, 10).items() if f}
    assert set(got) == set(expected)
    for i, f in expected.items():
        assert sorted(got[i]) == list(range(1, len(f) + 1))
        assert [got[i][k + 1][1] for k in range(len(f))] == [x for _, x in f]
        assert [got[i][k + 1][0] for k in range(len(f))] == pytest.approx([d for d, _ in f])


def test_larger_factors_prune_more_and_keep_most():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(4000, 4))
    tree = neighbours.Tree(np.arange(4000), points)
    calls = []
    plain = neighbours.distances

    def counted(p, q):
        calls.append(len(p))
        return plain(p, q)

    neighbours.distances = counted
    try:
        work, recall = {}, {}
        for factor in (1.0, 1.5, 3.0):
            calls.clear()
            hits = 0
            for own in range(0, 4000, 100):
                _, ids = tree.search(own, points[own], 10, factor)
                d = plain(points, points[own])
                d[own] = np.inf
                hits += len(set(ids) & set(np.argsort(d, kind="stable")[:10]))
            work[factor], recall[factor] = sum(calls), hits / 400
    finally:
        neighbours.distances = plain
    assert recall[1.0] == 1.0 and recall[1.5] >= 0.9
    assert work[3.0] < work[1.5] < work[1.0] < 40 * 4000 * 0.6


def test_empty(rows):
    vectors = rows([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(vectors, F.col("vec_id") % 10 == 0).count() == 0
