"""Operators that SQL cannot express: against plain programs, or by their round trip."""
import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.functions import text as T
from postloom.operators import chains, edges as E, graph as G, layout as L, models as M, pools as D, posts as P, retrieval as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def posts(spark, n=120, dim=8, clusters=3, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t0 = datetime.datetime(2024, 1, 1)
    data = [(i, x[i].tolist(), i % clusters if i % 11 else None, t0 + datetime.timedelta(hours=float(r.integers(0, 100))) if i % 13 else None, float(r.integers(1, 10)), f"post {i} of words") for i in range(n)]
    return spark.createDataFrame(data, "id long, embedding array<double>, cluster_id long, timestamp timestamp, engagement double, content string"), data


@pytest.mark.parametrize("block", [7, 1000])
def test_similar_pairs_whatever_the_blocks(spark, block):
    df, data = posts(spark)
    cos = {(a[0], b[0]): float(np.dot(a[1], b[1])) for a in data for b in data}
    hours = lambda p: p[3].timestamp() / 3600
    want = {(a[0], b[0]) for a in data for b in data if a[3] and b[3] and 0 < hours(b) - hours(a) <= 30 and cos[a[0], b[0]] > 0.2 and b[4] > a[4]}
    assert {(r.source, r.target) for r in E.similar(df, 0.2, 30, rising=True, block=block).collect()} == want and want
    want = {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and None not in (a[2], b[2]) and a[2] != b[2] and cos[a[0], b[0]] > 0.2}
    got = E.similar(df, 0.2, differ=True, block=block).collect()
    assert {(r.source, r.target) for r in got} == want and len(got) == len(want)
    assert "CartesianProduct" not in E.similar(df, 0.2)._jdf.queryExecution().toString()


def plain_split(nodes, links, cap):
    """The same rule by trying each edge: the slow way."""
    def pieces(nodes, links):
        left, out = set(nodes), []
        while left:
            seen, todo = set(), [min(left)]
            while todo:
                v = todo.pop()
                if v not in seen:
                    seen.add(v)
                    todo += [b if a == v else a for a, b, *_ in links if v in (a, b)]
            out.append(seen)
            left -= seen
        return out

    gone, todo = [], [(set(nodes), list(links))]
    while todo:
        part, mine = todo.pop()
        if len(part) <= cap:
            continue
        best = None
        for e in sorted(mine, key=lambda e: (e[2], e[3], e[:2])):
            two = pieces(part, [x for x in mine if x is not e])
            if len(two) == 2:
                worst = max(map(len, two))
                if worst <= cap:
                    best = e, two
                    break
                if best is None or worst < max(map(len, best[1])):
                    best = e, two
        if best:
            gone.append(best[0])
            for side in best[1]:
                todo.append((side, [x for x in mine if x is not best[0] and x[0] in side]))
    return sorted(gone)


@pytest.mark.parametrize("seed", range(25))
def test_split_equals_the_slow_way(seed):
    r = random.Random(seed)
    nodes = list(range(24))
    links = [(i, r.randrange(i), r.randrange(3), r.choice([0.1, 0.2, 0.3])) for i in nodes[1:]] + [(r.randrange(24), r.randrange(24), r.randrange(3), 0.5) for _ in range(3)]
    links = list({(a, b): (a, b, p, f) for a, b, p, f in links if a != b}.values())
    assert sorted(links[i] for i in E.split_component(nodes, links, 6)) == plain_split(nodes, links, 6)


def test_oversized_components_only(spark):
    e = [(i, i + 1, "temporal", 1.0 - i / 100) for i in range(20)] + [(100, 101, "semantic_inter", 0.1)]
    got = E.split_oversized(spark.createDataFrame(e, "source long, target long, type string, force double"), 8)
    sizes = G.component_sizes(G.component_map(spark.range(102).toDF("id"), got)).agg(F.max("n")).first()[0]
    assert sizes <= 8 and (100, 101, "semantic_inter", 0.1) in rows(got)


def test_edge_builder(spark):
    df, _ = posts(spark)
    nova = spark.createDataFrame([(1, 4, 1.0), (4, 7, 1.0)], "source long, target long, force double")
    spokes = spark.createDataFrame([(10, 13, 1.0), (10, 16, 1.0)], "source long, target long, force double")
    out = E.build(df, nova, spokes, {"least": 0.3, "percent": 10}, {"least": 0.3, "percent": 20}, 0.3, graft_least=0.0)
    assert 0 < E.split_oversized(out, 40).count() <= out.count()
    kinds = {r.type for r in out.collect()}
    assert {"nova", "adept_spoke", "adept_graft"} <= kinds <= {"nova", "adept_spoke", "adept_graft", "temporal_influence", "temporal", "semantic_inter"}
    assert out.groupBy("source", "target", "type").count().where("count > 1").isEmpty()
    kinds = lambda **gone: {r.type for r in E.build(df.withColumns({c: F.lit(None).cast(t) for c, t in gone.items()}), nova, spokes, {"least": 0.3}, {"least": 0.3}, 0.3).collect()}
    assert "temporal" not in kinds(timestamp="timestamp") and "temporal_influence" not in kinds(engagement="double")


def test_pools_follow_their_definition(spark):
    df, data = posts(spark, 90)
    got = {r.id: r for r in D.density(df, dc=10).collect()}
    for c in range(3):
        mine = [p for p in data if p[2] == c]
        dist = {(a[0], b[0]): float(np.linalg.norm(np.subtract(a[1], b[1]))) for a in mine for b in mine}
        cut = np.percentile([v for (a, b), v in dist.items() if a < b], 10)
        rho = {a[0]: sum(dist[a[0], b[0]] < cut for b in mine) - 1 for a in mine}
        for a in mine:
            denser = [b[0] for b in mine if (-rho[b[0]], b[0]) < (-rho[a[0]], a[0])]
            assert got[a[0]].rho == rho[a[0]] and got[a[0]].parent == (min(denser, key=lambda b: (round(dist[a[0], b], 9), b)) if denser else None)
    pools = D.pools(df, least=2, most=4, dc=10, membership=80)
    n = pools.groupBy("hub").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "hub").alias("hubs")).collect()
    assert n and all(2 <= r.n <= 4 and r.hubs == 1 for r in n) and pools.select("id").distinct().count() == pools.count()


def test_walk_visits_a_unit_before_those_behind_it(spark):
    u, e = ["a", "b", "c", "d", "z"], [("a", "b", "2", "x"), ("a", "c", "1", "y"), ("b", "d", "3", "w"), ("c", "b", "4", "v")]
    steps, extra = G.walk(u, e, "a")
    assert steps == [("a", None), ("b", 0), ("c", 1), ("d", 2), ("z", None)] and extra == [3]
    units = spark.createDataFrame([(1, x) for x in u] + [(2, "q")], "component int, unit string")
    links = spark.createDataFrame([(1, *x) for x in e], "component int, source_unit string, target_unit string, time string, source string")
    got = G.walks(units, links, spark.createDataFrame([(1, "a")], "component int, unit string"))
    one = got.where("component = 1")
    assert [tuple(r[2:]) for r in one.where("step is not null").orderBy("step").collect()] == [("a", None, None), ("b", "a", "b"), ("c", "a", "c"), ("d", "b", "d"), ("z", None, None)]
    assert [tuple(r[2:]) for r in one.where("step is null").collect()] == [(None, "c", "b")] and got.where("component = 2").first().unit == "q"


REPORT = "## Executive Summary\nx [E1]\n## Key Findings\ny [E2, id p_1]\n## Interpretation\n## Confidence Assessment\n- **Level:** High\n## Conclusion\nConfidence: High"


@pytest.mark.parametrize("change,problem", [(lambda r: r, None), (lambda r: r.replace("## Interpretation\n", ""), "missing heading"), (lambda r: r.replace("[E1]", "[E9]"), "unknown handle"), (lambda r: r.replace("p_1", "p_2"), "post not of handle"), (lambda r: r.replace("Level:** High", "Level:** Low"), "level unlike confidence"), (lambda r: r.replace("Confidence: High", ""), "missing confidence"), (lambda r: "## Caveats\n" + r, "place of heading"), (lambda r: r + "\n## Other\n", "unexpected heading"), (lambda r: r.replace("## Key Findings", "## K").replace("## Interpretation", "## Key Findings").replace("## K\n", "## Interpretation\n"), "order of headings")])
def test_report_contract(change, problem):
    found = [p for p, _ in R.validate(change(REPORT), {"E1": {"a"}, "E2": {"p_1"}})]
    assert found == ([] if problem is None else [problem])


def test_answers_and_rendering():
    said = iter(["bad", REPORT])
    assert R.answer(lambda p: next(said), "q", {"E1": {"a"}, "E2": {"p_1"}}) == (REPORT, [])
    assert R.cited("[e1] [E2, id p-1] [E3,q] [X1]") == [("E1", ""), ("E2", "p-1"), ("E3", "q")]
    assert R.linkify("[e1] [E2, id p] [E3]", {"E1", "E2"}) == "[\\[E1\\]](#cite-E1) [\\[E2, id p\\]](#cite-E2) [E3]"
    out = R.render([(1, [("E1", "chain", "t", [("p", None, "a\nb")])])])
    assert out.startswith("1 groups, 1 of kind chain") and "  > a\n  > b" in out
    assert R.transcript_name("Why, oh why?", datetime.datetime(2024, 1, 2, 3, 4, 5)) == "20240102-030405-why-oh-why.md"


def test_chains_from_an_analyst(spark):
    df, data = posts(spark, 40)
    got = chains.extract(df.where("cluster_id is not null"), chains.by_month)
    assert chains.complete(got)
    a, e, meta = chains.assemble(got, df)
    assert a.count() >= 30 and e.count() == a.count() - meta.count() and a.select("id").distinct().count() == a.count()
    assert chains.complete(chains.extract(df.where("id = 1"), chains.by_month)) and not chains.complete(chains.extract(df, lambda p: "no json"))
    first = a.where("nova_depth = 0").count()
    assert first == meta.count() == a.where("nova_role = 'pioneer'").count()


def test_repair_of_answers():
    fixed = chains.repair('```json\n{"topics": [{"title": "t", "posts": ["[p1]", "p2", "nope", "1"]}, {"ids": "p3"}, 5]}\n```', ["p1", "p2", "p3"])
    assert [g["post_ids"] for g in fixed] == [["p1", "p2"], ["p3"]] and fixed[0]["id"] == "1" and fixed[0]["title"] == "t"
    assert chains.repair("none", []) is None and chains.repair("{bad}", []) is None and chains.repair("{}", []) == []


def test_cluster_names(spark):
    df, _ = posts(spark, 30)
    terms = P.ctfidf(P.class_terms(df.select("id", F.col("cluster_id").cast("string").alias("cluster"), "content").where("cluster is not null")))
    assert {r.label for r in chains.name_clusters(df, terms).collect()} == {"post · words"}
    assert {r.label for r in chains.name_clusters(df, terms, lambda p: 'Topic: "Good name"').collect()} == {"Good name"}
    assert {r.label for r in chains.name_clusters(df, terms, lambda p: "topic: " + "word " * 9).collect()} == {"post · words"}


def test_whitening_and_moments(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 4)) @ r.normal(size=(4, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    n, mean, cov = M.moments(df)
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    white = np.stack([q.embedding for q in M.apply_linear(df, *M.whitening(df, 1e-9)).collect()])
    assert np.allclose(np.cov(white.T), np.eye(4), atol=1e-4)
    assert np.allclose([np.linalg.norm(q.embedding) for q in M.whitened(df).collect()], 1)
    assert len(M.project(df, 2).first().low) == 2


def blobs(spark, n=150):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.3, size=(n // 3, 3)) for c in ([0, 0, 0], [4, 0, 0], [0, 4, 0])])
    return spark.createDataFrame([(i, v.tolist(), i // (n // 3)) for i, v in enumerate(x)], "id long, low array<double>, truth int").repartition(2)


def test_mixtures_find_separate_groups(spark):
    df = blobs(spark)
    w, mu, var, like = M.diagonal_mixture(df, 3)
    got = M.assign(df, (w, mu, var))
    assert M.nmi(got.select(F.col("truth").alias("a"), F.col("label").alias("b"))).first()[0] > 0.99 and np.isclose(w.sum(), 1)
    k, bics, _ = M.sweep(df, [2, 3], alpha=0.1)
    assert k == 3 and bics[3] < bics[2]
    assert M.valid_seeds(got, 150, 3) and not M.valid_seeds(got, 150, 4)


def test_choice_of_k():
    assert M.choose_k("set", set_k=7) == [7] and M.choose_k("range", k_range=(2, 4)) == [2, 3, 4] and M.choose_k("cache", 5, cached=9) == [9] and M.choose_k("fast", 5) == [5]
    assert M.choose_k("auto", 10)[0] == 2 and M.choose_k("auto", 60)[0] == 12 and M.choose_k("auto", 60)[-1] == 108


def test_projection_and_refinement(spark):
    df = blobs(spark).withColumn("embedding", F.col("low")).withColumn("label", F.when(F.col("id") % 25 == 0, (F.col("truth") + 1) % 3).otherwise(F.col("truth")))
    spread, lin, means, loss = M.discriminant(df, 3, steps=15)
    assert lin.shape == (3, 3) and loss < 1.1 and means.shape == (3, 3)
    out, n, why = M.refine(df.select("id", "embedding", "label", "truth"), 3, rounds=2)
    assert n >= 1 and why in ("fixed", "rounds", "loss") and M.nmi(out.select(F.col("truth").alias("a"), F.col("label").alias("b"))).first()[0] > 0.9


def test_shrinkage_and_softmax():
    c = np.diag([1.0, 2.0, 3.0])
    assert np.allclose(np.trace(M.shrunk(c, 10)), 6) and np.ptp(np.diag(M.shrunk(c, 3))) < 2
    assert np.allclose(M.softmax(np.array([[1e4, 0.0]])), [[1, 0]])


def test_layout_kernels(spark):
    line = L.straighten([[0, 0, 0], [1, 0.1, 0], [2, -0.1, 0], [3, 0, 0.1]])
    assert np.abs(line[:, 1:]).max() < 0.09 and len(L.straighten([[0, 0, 0]])) == 1
    out = L.space_out([[0, 0, 0], [0.1, 0, 0], [0.2, 0, 0]], [1, 1, 1], 1.0)
    assert np.allclose(np.diff(out[:, 0]), [2, 2])
    c = L.push_apart([[0, 0, 0], [0.1, 0, 0], [0, 0, 0]], [1, 1, 1], 1.0)
    assert min(np.linalg.norm(c[i] - c[j]) for i in range(3) for j in range(i)) > 1.99
    p = L.collide([[0, 0, 0], [0.5, 0, 0]], [1, 1])
    assert np.linalg.norm(p[0] - p[1]) > 1.99
    f = L.force_layout(np.random.default_rng(0).normal(size=(12, 3)), [(0, 1, 5.0)], 200)
    far = np.linalg.norm(f[:, None] - f[None], axis=2)
    assert far[0, 1] < np.median(far[np.triu_indices(12, 1)])
    assert set(L.colours({"a": [1.0, 0.0], "b": [0.0, 1.0]})) == {"a", "b"} and len(L.colours({"a": [1.0]})["a"]) == 7
    df = spark.createDataFrame([(i // 6, i, float(i % 3), float(i % 2), 0.0) for i in range(14)], "cluster_id int, id int, x double, y double, z double")
    e = spark.createDataFrame([(0, 1, 1.0), (6, 7, 1.0), (0, 7, 1.0)], "source int, target int, weight double")
    got = {r.id: r for r in L.cluster_layout(df, e, 20).collect()}
    assert len(got) == 14 and (got[12].x, got[13].x) == (0.0, 1.0)
    s = df.selectExpr("cluster_id subtopic_id", "id pos", "id", "x", "y", "z", "0.1D radius")
    assert L.straight_chains(s).count() == 14


def test_time_and_word_functions(spark):
    row = spark.createDataFrame([(" word another", "1700000000", "Mon, 01 Jan 2024 10:00:00 +0100", "x")], "a string, t string, u string, w string")
    r = row.select(T.truncate_words(F.col("a"), 6).alias("cut"), F.unix_seconds(T.parse_time(F.col("t"))).alias("t"), F.unix_seconds(T.parse_time(F.col("u"))).alias("u"), T.parse_time(F.col("w")).alias("w"), T.cluster_name(F.lit(123456)).alias("c")).first()
    assert tuple(r) == (" word…", 1700000000, 1704099600, None, "cluster_123456")


def test_percentiles_equal_numpy(spark):
    x = [float(v) for v in np.random.default_rng(7).normal(size=30_000).round(2)] + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for q in (0, 0.1, 0.5, 0.803, 1):
        assert np.isclose(P.percentile(df, "x", q), np.percentile([v for v in x if v is not None and v == v], 100 * q))
    assert P.percentile(df.where("x is null"), "x", 0.5) is None
    assert rows(P.engagement_rank(spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 2.0)], "file string, engagement double")).select("rank"))[0] == (10.0,)


def test_graft_ties_and_floor(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 0, [0.0, 1.0]), (4, 1, [1.0, 0.0]), (5, 0, [0.0, 1.0])], "id int, cluster_id int, embedding array<double>")
    got = E.graft(df, df.where("id in (1, 2, 4)"), df.where("id in (3, 5)"), 0.5).select("source", "target", "cos")
    assert rows(got) == [(2, 3, 1.0)]


def test_json_of_chains_is_plain():
    assert json.loads(chains.by_month('<post id="a" date="2024-01-02T00:00">x</post>'))["subtopics"][0]["post_ids"] == ["a"]
