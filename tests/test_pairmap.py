import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.operators import pairmap
from test_manifold import rows, trust


def test_pairs_equal_a_plain_program(spark):
    given = rows(90, seed=8)
    x = np.array([v for _, v in given])
    df = spark.createDataFrame([(10 * i, v) for i, v in given], "id long, v array<double>").repartition(3)
    numbers, n = pairmap.numbered(df, 4)
    numbers.cache()
    assert n == 90 and [r.num for r in numbers.orderBy("id").collect()] == list(range(90))
    near = pairmap.near_pairs(df, 5, block=32)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    order = np.argsort(d + np.diag(np.full(90, np.inf)), 1, kind="stable")
    s = np.take_along_axis(d, order[:, 3:6], 1).mean(1)
    want = {(10 * i, 10 * j) for i in range(90) for j in sorted(order[i][:55], key=lambda j: (round(d[i, j] ** 2 / s[i] / s[j], 12), j))[:5]}
    assert {tuple(r) for r in near.collect()} == want
    got = {(r.i, r.j, r.kind) for r in pairmap.sampled_pairs(numbers, near, n, 3, 8, seed=5).collect()}
    draws = lambda slots, seed: {(r.i, r.slot): r.num for r in pairmap.drawn(numbers, n, slots, seed).collect()}
    middling, plain = draws(18, 5), set()
    for i in range(90):
        for slot in range(3):
            of = sorted({(round(d[i, j] ** 2, 12), j) for t in range(6) if (j := middling.get((10 * i, 6 * slot + t))) is not None})
            if len(of) > 1:
                plain.add((10 * i, 10 * of[1][1], pairmap.MIDDLING))
    plain |= {(i, 10 * j, pairmap.FARTHER) for (i, _), j in draws(8, 6).items() if (i, 10 * j) not in want}
    assert got == plain and len(got) > 600


def test_gradient_is_that_of_the_cost():
    r = np.random.default_rng(1)
    y = r.normal(size=(6, 2))
    pairs = np.array([(a, b, k) for a in range(6) for b in range(6) for k in range(3) if a != b and r.random() < 0.4])
    both = np.concatenate([pairs, pairs[:, [1, 0, 2]]])

    def cost(y):
        d = 1 + ((y[pairs[:, 0]] - y[pairs[:, 1]]) ** 2).sum(1)
        c, w = np.array(pairmap.AGAINST)[pairs[:, 2]], np.array(pairmap.weights(7))[pairs[:, 2]]
        return (w * np.where(pairs[:, 2] == pairmap.FARTHER, 1 / (1 + d), d / (c + d))).sum()

    zero = np.zeros_like(y)
    m = pairmap.stepped((y, zero, zero), both[:, 0], both[:, 1], zero[both[:, 0]], both[:, 2], 7, 1, 1.0)[1] / 0.1
    for i in range(6):
        for axis in range(2):
            e = np.zeros_like(y)
            e[i, axis] = 1e-6
            assert abs((cost(y + e) - cost(y - e)) / 2e-6 - m[i, axis]) < 1e-4


def test_phases():
    assert pairmap.weights(0) == (2, 1000, 1) and pairmap.weights(150) == (3, 3, 1) and pairmap.weights(449) == (1, 0, 1)


@pytest.mark.parametrize("part", [20_000, 80])
def test_keeps_neighbours_and_does_not_depend_on_partitions(spark, part):
    given = rows(200)
    x = np.array([v for _, v in given])
    df = spark.createDataFrame([*given, (999, None)], "id long, embedding array<double>")
    run = lambda n: pairmap.universe(df.repartition(n), part=part, turns=150, k=10).orderBy("id").collect()
    one, three = run(1), run(3)
    assert one == three and len(one) == 200
    y = np.array([r[1:] for r in one])
    assert np.allclose(np.abs(y).max(0), 500) and np.abs(y.mean(0)).max() < 1e-6
    assert trust(x, y) > 0.95


def test_few_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    assert len(pairmap.pairmap(one).first().low) == 3 and pairmap.pairmap(one.limit(0)).count() == 0
    assert pairmap.universe(one.union(one.select(F.lit(2), "embedding"))).count() == 2
