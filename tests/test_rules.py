"""Rules that outcomes depend on, each against a plain program or a worked example."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.operators import chains, edges as E, layout as L, models as M, posts as P

EDGE = "source long, target long, type string, force double"


def sequential(components, given, guard):
    """Edge after edge: (kept, {edge: why it goes})."""
    sizes, root = {}, {}
    for c in components.values():
        sizes[c] = sizes.get(c, 0) + 1
    base = dict(sizes)

    def find(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    kept, gone = set(), {}
    for e in sorted(given, key=lambda e: (E.JOINING.index(e[2]), -e[3], e[0], e[1])):
        a, b = components[e[0]], components[e[1]]
        x, y = find(a), find(b)
        if a == b:
            gone[e] = "inside"
        elif guard and max((base[a], base[b]) if guard == "static" else (sizes[x], sizes[y])) == 1 and x != y:
            gone[e] = "isolated"
        elif x == y:
            gone[e] = "redundant"
        else:
            root[x] = y
            sizes[y] += sizes[x]
            kept.add(e)
    return kept, gone


@pytest.mark.parametrize("guard", [None, "static", "dynamic"])
def test_pruning_equals_the_sequential_program(spark, guard):
    """A thousand random graphs side by side, with ties of force."""
    r, given, components = random.Random(11), [], {}
    for g in range(1000):
        at = g * 100
        n = r.randrange(3, 10)
        for i in range(n):
            components[at + i] = at + (0 if i < r.choice([0, 2]) else i)
        pairs = {tuple(r.sample(range(n), 2)) for _ in range(r.randrange(1, 14))}
        given += [(at + a, at + b, r.choice(E.JOINING), r.choice([0.1, 0.2, 0.3])) for a, b in pairs]
    c = spark.createDataFrame(list(components.items()), "node long, component long")
    kept, dropped = E.prune_bridges(spark.createDataFrame([*given, given[0]], EDGE), c, guard)
    want, gone = sequential(components, given, guard)
    assert {tuple(x) for x in kept.collect()} == want
    got = {tuple(x[:4]): x.reason for x in dropped.collect()}
    assert {e for e, why in got.items() if why == "inside"} == {e for e, why in gone.items() if why == "inside"}
    assert got.keys() == gone.keys()
    if guard == "dynamic":
        assert "isolated" in got.values() and {e for e, why in gone.items() if why == "isolated"} <= {e for e, why in got.items() if why == "isolated"}
    counts = {x.type: x for x in E.prune_counts(kept, dropped).collect()}
    assert sum(x.kept for x in counts.values()) == len(want) and sum(x.inside + x.isolated + x.redundant for x in counts.values()) == len(gone)


def test_unknown_ends_and_types_are_errors(spark):
    c = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "node long, component long")
    run = lambda *e: E.prune_bridges(spark.createDataFrame([e], EDGE), c)[0].collect()
    assert len(run(1, 3, "temporal", 1.0)) == 1
    for bad in ((1, 9, "temporal", 1.0), (None, 1, "temporal", 1.0), (1, 2, "bridge", 1.0), (1, 2, None, 1.0)):
        with pytest.raises(Exception, match="without a component|unknown edge type"):
            run(*bad)
    with pytest.raises(Exception, match="unknown edge type"):
        E.split_oversized(spark.createDataFrame([(1, 2, "odd", 1.0), (2, 3, "nova", 1.0)], EDGE), 1).collect()


def test_spokes_are_cut_before_chains(spark):
    e = [(1, 2, "nova", 0.5), (2, 3, "nova", 0.5), (3, 4, "nova", 0.2), (4, 5, "adept_spoke", 0.9), (5, 6, "nova", 0.5)]
    left = E.split_oversized(spark.createDataFrame(e, EDGE), 4)
    assert {tuple(x) for x in left.collect()} == {tuple(x) for x in e if x[2] == "nova"}


def test_labels(spark):
    said = ["no label here", "topic: N/A - Insufficient valid data", "topic: unclear", "topic: sorry state of roads", "Topic:\n  'Trains' ", "TOPIC: a\ntopic: b", "topic: one two three four five six seven eight nine", "topic: naval bases", "topic: \"\"", "topic: No clear topic", None, ""]
    got = [r.l for r in spark.createDataFrame(list(enumerate(said)), "i int, t string").orderBy("i").select(T.label_of(F.col("t")).alias("l")).collect()]
    assert got == [None, None, None, "sorry state of roads", "Trains", "a", None, "naval bases", None, None, None, None]


def test_repair_guesses_only_where_nothing_matches():
    run = lambda g: chains.repair(__import__("json").dumps({"subtopics": [g]}), ["p1", "p2", "p9"])[0]
    assert run({"post_ids": ["p1", "p9zz", "p2"]})["post_ids"] == ["p1", "p2"]
    assert run({"post_ids": ["p9zz", "[p2x]", "p9"[:1]]})["post_ids"] == ["p9", "p2", "p1"]
    bare = run({"ids": "p1", "label": "named"})
    assert bare["title"] == "named" and bare["post_ids"] == ["p1"] and bare["reasoning"] and bare["sentiment_arc"]
    assert run({"post_ids": None})["title"] == "Untitled Timeline" and run({"post_ids": None})["post_ids"] == []


def test_a_pioneer_needs_unlike_times(spark):
    rows = [(1, 2, 5), (2, 2, 5), (3, 2, None), (4, 5, 1), (5, 5, 3), (6, 5, 9), (7, 5, 4)]
    df = spark.createDataFrame(rows, "id long, hub long, t int").withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
    assert {r.id: r.role for r in P.pool_roles(df).collect()} == {1: "member", 2: "hub", 3: "member", 4: "pioneer", 5: "hub", 6: "latest", 7: "member"}


def test_shrinkage_is_the_published_formula():
    x = np.random.default_rng(1).normal(size=(12, 5))
    s = np.cov(x.T)
    p, n, t, t2 = 5, 12, np.trace(s), np.trace(s @ s)
    share, mu = M.oas(s, n)
    assert np.isclose(share, min(1, ((1 - 2 / p) * t2 + t**2) / ((n + 1 - 2 / p) * (t2 - t**2 / p)))) and np.isclose(mu, t / p)
    assert M.oas(np.eye(3), 9) == (1.0, 1.0)


def test_colours_follow_the_axes():
    assert L.colours({"a": [1.0, 2.0, 3.0]}) == {"a": "#5B8FF9"} and L.colours({}) == {}
    two = L.colours({"a": [0.0, 0.0, 0.0], "b": [3.0, 0.0, 0.0]})  # hue 0 and 360, saturation 58 %, lightness 63 %
    assert two["a"] == two["b"] == "#D76A6A"


@pytest.mark.parametrize("most", [3000, 12])
def test_trees_in_order_of_edges(spark, most):
    from collections import deque

    from postloom.operators import graph as G

    r = random.Random(4)
    edges = [(r.randrange(40), r.randrange(40), r.choice(["nova", "adept_spoke", "temporal"])) for _ in range(55)]
    role = {i: ("hub" if i % 5 == 0 else None, "named" if i % 7 == 0 else "") for i in range(40)}
    around = {}
    for a, b, kind in edges:
        around.setdefault(a, []).append((b, kind, True))
        around.setdefault(b, []).append((a, kind, False))
    pooled = lambda i: role[i][0] == "hub" or bool(role[i][1])

    def place(a, b, kind, along):
        if kind == "nova":
            return 0 if along else 8
        if kind == "adept_spoke":
            return 12 if pooled(a) else 18 if pooled(b) else 22
        return 30

    root = max(around, key=lambda i: (len(around[i]), i))
    want, todo = {root: (0, None)}, deque([root])
    while todo:
        a = todo.popleft()
        best = {}
        for b, kind, along in around[a]:
            best[b] = min(best.get(b, 99), place(a, b, kind, along))
        for b in sorted(best, key=lambda b: (best[b], -len(around[b]), str(b))):
            if b not in want and len(want) < most:
                want[b] = (want[a][0] + 1, a)
                todo.append(b)
    posts = spark.createDataFrame([(i, *role[i]) for i in range(40)], "id long, adept_role string, adept_pool_label string")
    got = G.ordered_tree(spark.createDataFrame(edges, "source long, target long, type string"), posts, root, most).orderBy("order").collect()
    assert [(x.id, x.depth, x.parent) for x in got] == [(i, *v) for i, v in want.items()] and len(got) > 10
    assert G.ordered_tree(spark.createDataFrame([], "source long, target long, type string"), posts, 7).collect()[0][:] == (0, 7, 0, None)


def test_blocks_are_packed_without_overlap(spark):
    r = np.random.default_rng(5)
    rows = [(i, i % 2 if i < 118 else None, f"u{i % 23}" if i % 3 else f"alone{i}", *map(float, r.normal(size=3) * 3), float(r.uniform(0.2, 1)) if i % 4 else None) for i in range(120)]
    rows += [(200, 7, "a", 0.0, 0.0, 0.0, 1.0), (201, 7, "b", 0.0, 0.0, 0.0, 1.0), (202, 0, "lost", None, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, cluster_id long, unit string, x double, y double, z double, radius double")
    runs = [sorted(map(tuple, L.pack_blocks(df.repartition(n)).select("id", "cluster_id", "unit", "x", "y", "z").collect()), key=lambda t: t[0]) for n in (1, 4)]
    assert all(np.allclose([t[3:] for t in runs[0] if t[3] is not None], [t[3:] for t in runs[1] if t[3] is not None]) for _ in "x") and len(runs[0]) == len(rows)
    was = {x[0]: x for x in rows}
    for c in (0, 1):
        spheres = {}
        for i, k, u, *p in runs[0]:
            if k == c and p[0] is not None:
                spheres.setdefault(u, []).append((np.array(p), was[i][6] or 1.0, np.array(was[i][3:6])))
        balls = []
        for held in spheres.values():
            p, q = np.array([h[0] for h in held]), np.array([h[2] for h in held])
            assert np.allclose(p - p.mean(0), q - q.mean(0))  # the form stays
            balls.append((p.mean(0), max(0.5, max(np.linalg.norm(a - p.mean(0)) + h[1] for a, h in zip(p, held)))))
        assert all(np.linalg.norm(a[0] - b[0]) >= 1.15 * (a[1] + b[1]) - 1e-6 for n, a in enumerate(balls) for b in balls[:n]) and len(balls) > 20
    stay = {t[0]: t[3:] for t in runs[0]}
    assert all(stay[i] == was[i][3:6] for i in (118, 119, 200, 201, 202))
