"""Nearest neighbours against brute force, with the operator's own parameters."""
import numpy as np
import pytest

from postloom.llm import vectors


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, codes string, key int").repartition(parts)


def exact(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if i != q][:k]
    return [(ids[i], d[i]) for i in order]


@pytest.mark.parametrize("n,dim,parts", [(30000, 32, 2), (3000, 64, 6)])
def test_recall_and_exact_scores(spark, n, dim, parts):
    x, ids = np.random.default_rng(0).normal(size=(n, dim)), np.arange(n)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = vectors.search(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], parts)).toPandas().sort_values(["query_id", "rank"])
    assert sorted(got.query_id.unique()) == list(range(0, n, 100)) and (got.groupby("query_id")["rank"].max() == 10).all()
    assert np.allclose(got.score, np.sqrt(((x[got.query_id] - x[got.vec_id]) ** 2).sum(1))) and (got.query_id != got.vec_id).all()
    hits = sum(len(set(g.vec_id) & {i for i, _ in exact(ids, x, q)}) for q, g in got.groupby("query_id"))
    print("recall", hits / len(got))
    assert hits >= 0.95 * len(got)


def test_small_tables_are_exact_whatever_they_hold(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(30, 3)), 1)
    x[5] = x[6] = x[7] = x[0]  # ties and copies
    good = [(i // 2 if i < 4 else i, v.tolist()) for i, v in enumerate(x)]  # ids 0, 0, 1, 1, 4, 5, ..
    odd = [(200, [1.0, 2.0]), (201, [2.0, 2.0]), (300, [5.0])]
    bad = [(100, None), (400, [0.0] * 3), (500, [float("nan")] * 3), (600, [1.0, None, 2.0]), (700, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (800, [])]
    got = vectors.search(frame(spark, good + odd + bad)).collect()
    ids, want = np.array([i for i, _ in good]), []
    for q in [i for i, v in enumerate(ids) if v % 100 == 0]:
        want += [(0, n + 1, int(i), round(d, 9)) for n, (i, d) in enumerate(exact(ids, x, q))]
    want.append((200, 1, 201, 1.0))
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(want)
    assert vectors.search(frame(spark, [])).count() == vectors.search(frame(spark, bad)).count() == 0
