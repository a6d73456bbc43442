import numpy as np
import pytest

from postloom.operators import manifold


def rows(n=150, seed=3, d=12):
    """Points on a rolled sheet, in more dimensions."""
    r = np.random.default_rng(seed)
    t, h = r.uniform(1.5, 4.5, n) * np.pi, r.uniform(0, 20, n)
    x = np.stack([t * np.cos(t), h, t * np.sin(t)], 1) @ np.linalg.qr(r.normal(size=(d, 3)))[0].T
    return [(i, v.tolist()) for i, v in enumerate(x)]


def trust(x, y, k=10):
    """Trustworthiness: how few of the k nearest in y are far in x."""
    n = len(x)
    d, e = (np.linalg.norm(z[:, None] - z[None], axis=2) + np.diag(np.full(n, np.inf)) for z in (x, y))
    rank = d.argsort(1).argsort(1) + 1
    near = e.argsort(1)[:, :k]
    over = np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * over


def plain_weights(x, k):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    p = np.zeros_like(d)
    mean = np.sort(d, 1)[:, : k - 1].sum() / (len(x) * k)
    for i in range(len(x)):
        near = np.argsort(d[i], kind="stable")[: k - 1]
        own = d[i][near]
        rho = min(own[own > 0], default=0.0)
        lo, hi = 0.0, 1e6
        for _ in range(200):
            mid = (lo + hi) / 2
            if sum(np.exp(-max(0, v - rho) / mid) for v in own) > np.log2(k):
                hi = mid
            else:
                lo = mid
        sigma = max(mid, 1e-3 * (own.sum() / k if rho > 0 else mean))
        p[i, near] = [1.0 if v <= rho else np.exp(-(v - rho) / sigma) for v in own]
    w = p + p.T - p * p.T
    return {(i, j): w[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if w[i, j] > 0}


def test_weights_equal_a_plain_program(spark):
    given = rows(80)
    df = spark.createDataFrame([*given, (1000, None), (None, [1.0]), (1001, [None, 1.0])], "id long, embedding array<double>").repartition(3)
    got = {(r.a, r.b): r.w for r in manifold.fuzzy_graph(df, 8, block=32).collect()}
    want = plain_weights(np.array([v for _, v in given]), 8)
    assert got.keys() == want.keys() and max(abs(got[p] - want[p]) for p in want) < 1e-6


def test_curve():
    a, b = manifold.curve(0.1)
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.01  # published values for a distance of 0.1


def low(df, **kw):
    return np.array([r.low for r in sorted(manifold.embed(df, **kw).collect())])


def test_keeps_neighbours_better_than_principal_components(spark):
    given = rows(300)
    x = np.array([v for _, v in given])
    df = spark.createDataFrame(given, "id long, embedding array<double>")
    y = low(df, dims=2, rounds=5, metric="euclidean")
    p = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert trust(x, y) > max(0.95, trust(x, (p[0] * p[1])[:, :2]) + 0.02)


@pytest.mark.parametrize("part", [4096, 60])
def test_the_same_for_any_partitioning(spark, part):
    df = spark.createDataFrame(rows(150), "id long, embedding array<double>")
    kw = dict(dims=3, rounds=2, epochs=5, part=part, k=6)
    one, four = low(df.repartition(1), **kw), low(df.repartition(4), **kw)
    assert one.shape == (150, 3) and (one == four).all()
    parts = manifold.parts_of(manifold.principal(df, 3), 0, 1, 3, part).groupBy("part").count().collect()
    assert max(r["count"] for r in parts) <= part and len(parts) >= 150 / part


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    assert manifold.embed(df, dims=3).count() == 2 and len(manifold.embed(df, dims=3).first().low) == 3
    assert manifold.embed(df.limit(0)).count() == 0
