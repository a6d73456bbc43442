import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.operators import density
from postloom.operators.components import connected_components


def points(seed, n=160):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(c, s, (n // 4, 2)) for c, s in (((0, 0), 0.3), ((3, 0), 0.3), ((0, 4), 0.6))] + [r.uniform(-2, 6, (n - 3 * (n // 4), 2))])
    x = np.round(x, 1)  # ties, and points that lie on each other
    return [(int(i), [float(a) for a in v]) for i, v in zip(r.permutation(len(x)), x)]


def plain(rows, least, samples):
    """Top down: the tree's edges are taken away from the longest on."""
    rows = sorted(rows)
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, min(samples, len(x) - 1)]
    w = np.maximum(np.maximum(d, core), core[:, None])
    edges = sorted((w[i, j], ids[i], ids[j]) for i in range(len(ids)) for j in range(i))
    edges = sorted((a, min(b, c), max(b, c)) for a, b, c in edges)
    root, tree = {i: i for i in ids}, []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        a, b = find(e[1]), find(e[2])
        if a != b:
            root[a] = b
            tree.append(e)
    label, sizes, total = dict.fromkeys(ids, -1), [], 0

    def split(members, tree, born):
        """Follow one cluster down; (its stability, whether it has children)."""
        stability, inside = 0.0, set(members)
        tree = [e for e in tree if e[1] in inside]
        while True:
            if not tree:
                return stability, False
            *rest, last = tree
            around, side, todo = {}, {last[1]}, [last[1]]
            for _, a, b in rest:
                around.setdefault(a, []).append(b)
                around.setdefault(b, []).append(a)
            while todo:
                for v in around.get(todo.pop(), []):
                    if v not in side:
                        side.add(v)
                        todo.append(v)
            other, rate = inside - side, 1 / max(last[0], density.LEAST)
            if len(side) >= least and len(other) >= least:
                for part in (side, other):
                    s, children = split(part, [e for e in rest if e[1] in part], rate)
                    sizes.append((len(part), s))
                    if not children:
                        label.update(dict.fromkeys(part, min(part)))
                return stability + (rate - born) * len(inside), True
            if len(side) < least and len(other) < least:
                return stability + (rate - born) * len(inside), False
            gone = side if len(side) < least else other
            stability += (rate - born) * len(gone)
            inside -= gone
            tree = [e for e in rest if e[1] in inside]

    split(ids, tree, 0.0)
    return dict(zip(ids, core)), sum(e[0] for e in tree), label, sorted(sizes)


@pytest.mark.parametrize("seed,n,block,most", [(1, 500, 128, 100_000), (2, 120, 40, 60)])
def test_equals_a_plain_program(spark, seed, n, block, most):
    rows = points(seed, n)
    core, weight, label, sizes = plain(rows, 8, 5)
    df = spark.createDataFrame([*rows, (None, [0.0, 0.0]), (10_001, None), (10_002, [1.0, None]), (10_003, [float("nan"), 1.0]), (10_004, [])], "id long, embedding array<double>").repartition(3)
    found = density.core_distances(df, 5, block=block)
    got = {r.id: r.core for r in found.collect()}
    assert got.keys() == core.keys() and all(abs(got[i] - core[i]) < 1e-12 for i in core)
    tree = density.minimum_forest(density.reachability_edges(found, block), most)
    assert tree.count() == len(rows) - 1
    assert abs(tree.agg(F.sum("w")).first()[0] - weight) < 1e-9
    labels, clusters = density.density_clusters(df, 8, 5, block=block, most=most)
    mine = {}
    for r in labels.collect():
        mine.setdefault(r.cluster, []).append(r.id)
    noise = set(mine.pop(-1, []))
    assert noise == {i for i, c in label.items() if c == -1} and len(mine) > 2
    assert sorted(map(sorted, mine.values())) == sorted(sorted(i for i in label if label[i] == c) for c in set(label.values()) - {-1})
    of = sorted((r["size"], r.stability) for r in clusters.where("parent is not null").collect())
    assert [s for s, _ in of] == [s for s, _ in sizes] and np.allclose([s for _, s in of], [s for _, s in sizes])


def test_few_points(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [1.0])], "id long, embedding array<double>")
    assert {tuple(r) for r in density.density_clusters(df)[0].collect()} == {(1, -1), (2, -1), (3, -1)}
    assert density.density_clusters(df.limit(0))[0].count() == 0 and density.pivot(df) == 0
    assert {r.id: r.core for r in density.core_distances(df, 1).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert density.core_distances(df.where("id = 1")).first().core == 0


def test_nearest_by_cosine(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = np.argsort(np.where(np.eye(60, dtype=bool), 9, 1 - unit @ unit.T), 1)[:, :4]
    for row in density.nearest(df, 4, metric="cosine", block=16).collect():
        assert [n.other for n in row.near] == want[row.id].tolist()
        assert abs(row.near[0].d - (1 - unit[row.id] @ unit[row.near[0].other])) < 1e-9


def test_components_of_an_ordered_path(spark, monkeypatch):
    """A path of 100,000 nodes in order of ids."""
    from postloom.operators import components

    written = []
    real = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, tag, *a: (written.append(tag), real(df, tag, *a))[1])
    path = spark.range(100_000).selectExpr("id a", "id + 1 b")
    got = connected_components(path.union(path.limit(10)))
    assert got.agg(F.min("component"), F.max("component"), F.count("*"), F.countDistinct("node")).first()[:] == (0, 0, 100_001, 100_001)
    assert written.count("joined") <= 40


def test_components_equal_a_search(spark):
    r = random.Random(6)
    pairs = [(f"n{r.randrange(150)}", f"n{r.randrange(150)}") for _ in range(110)]
    around, want = {}, {}
    for a, b in pairs:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    for v in sorted(around):
        if v not in want:
            todo = [v]
            want[v] = v
            while todo:
                for u in around[todo.pop()]:
                    if u not in want:
                        want[u] = v
                        todo.append(u)
    got = connected_components(spark.createDataFrame([*pairs, (None, "n1"), ("n2", None)], "a string, b string"))
    assert {x.node: x.component for x in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("n,block", [(90, 16), (3, 1024)])
def test_threshold_without_pairs(spark, monkeypatch, n, block):
    from postloom.operators import edges

    r = np.random.default_rng(n)
    x = np.round(r.normal(size=(n, 3)), 1)
    x[0] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0, 1.0, 1.0]), (1001, None), (1002, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    written = []
    real = edges.materialise
    monkeypatch.setattr(edges, "materialise", lambda df, tag, *a: (written.append(tag), real(df, tag, *a))[1])
    cos = (x @ x.T)[np.triu_indices(n, 1)]
    for percent in (0, 12.5, 50, 90, 100):
        assert abs(edges.adaptive_threshold(df, percent, block) - np.percentile(cos[cos > 0], percent)) < 1e-12
    assert set(written) == {"vectors"}
    with pytest.raises(ValueError):
        edges.adaptive_threshold(df.limit(1), 50)


def test_similar_leaves_out_what_cannot_be_compared(spark):
    from postloom.operators.edges import similar

    rows = [(1, [1.0, 0.0]), (2, [1.0, None]), (3, [0.9, 0.1]), (4, [1.0, 0.0, 0.0]), (5, [0.8, 0.0, 0.6]), (6, []), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert sorted((r.source, r.target) for r in similar(df, 0.5).collect()) == [(1, 3), (4, 5)]
