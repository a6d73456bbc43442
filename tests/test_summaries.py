from pyspark.sql import functions as F

from postloom.operators import summaries as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_joins_and_counts(spark):
    posts = spark.createDataFrame([(1, "a", 3.0), (2, "a", None), (3, None, 1.0), (4, "b", 9.0), (None, "b", 9.0)], "id long, cluster_id string, engagement double")
    vectors = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (9, [3.0])], "id long, embedding array<double>")
    assert rows(S.with_vectors(posts, vectors).select("id", "embedding")) == sorted([(1, [1.0]), (1, [2.0]), (2, None), (3, None), (4, None), (None, None)], key=repr)
    labels = spark.createDataFrame([("a", "A")], "cluster_id string, label string")
    for few in (0, 10):
        joined = S.labelled(posts, labels, few=few)
        assert rows(joined.select("id", "label")) == sorted([(1, "A"), (2, "A"), (3, None), (4, None), (None, None)], key=repr)
        assert ("BroadcastHashJoin" in joined._jdf.queryExecution().optimizedPlan().toString() or few == 0 or "broadcast" in joined._jdf.queryExecution().optimizedPlan().toString())
    assert rows(S.sizes(posts)) == sorted([("a", 2), ("b", 1), (None, 1)], key=repr)
    assert rows(S.extremes(S.sizes(posts).where("cluster_id is not null"))) == [("b", "a")] and rows(S.extremes(S.sizes(posts.limit(0)))) == [(None, None)]
    assert rows(S.value_counts(posts, "cluster_id", "c")) == sorted([("a", 2), ("b", 2), (None, 1)], key=repr)
    assert rows(S.distinct_values(posts, "cluster_id", "engagement")) == sorted([("a", 1, 3.0), ("b", 1, 9.0), (None, 1, 1.0)], key=repr)
    assert rows(S.fields(posts)) == [(False, True)] and rows(S.fields(posts.limit(0))) == [(False, False)]
    best = S.best_posts(posts.where("id is not null"), 1)
    assert rows(best.select("cluster_id", "id", "place", "more")) == sorted([("a", 1, 1, 1), ("b", 4, 1, 0), (None, 3, 1, 0)], key=repr)
    members = spark.createDataFrame([(1, i, "x" * 9 if i else None) for i in range(4)], "hub long, id long, content string")
    assert rows(S.first_members(members, 2, 4, order="id")) == [(1, [0, 1], ["", "xxx…"])]


def test_counts_of_a_context_and_of_clusters(spark):
    units = spark.createDataFrame([(1, "nova:1", 1), (1, "nova:1", 2), (1, "adept:9", 3), (2, "post:4", 4), (2, "nova:1", 1)], "group_no long, unit string, id long")
    assert rows(S.context_counts(units)) == [(2, 2, 1, 1, 5)] and rows(S.context_counts(units.limit(0))) == [(0, 0, 0, 0, 0)]
    posts = spark.createDataFrame([(1, "a", "s", None, 0), (2, "a", "s", None, 1), (3, "a", None, "h", None), (4, None, "t", None, 5)], "id long, cluster_id string, subtopic_id string, adept_pool_hub_id string, nova_depth int")
    edges = spark.createDataFrame([(1, 2, "nova"), (2, 3, "temporal"), (3, 4, "nova"), (1, 9, "nova")], "source long, target long, type string")
    assert rows(S.cluster_overview(posts, edges)) == [("a", 3, 1, 1, 1, 2)]
    assert [tuple(r) for r in S.edge_counts(edges).collect()] == [("nova", 3), ("temporal", 1)]
    pools = spark.createDataFrame([("a", 3, 3), ("a", 3, 1)], "cluster_id string, hub long, id long")
    assert rows(S.pool_counts(posts.withColumn("nova_role", F.col("subtopic_id")), pools, spark.createDataFrame([(3, 1)], "source long, target long"))) == [("a", 1, 1, 1)]


def test_viewer_rows(spark):
    posts = spark.createDataFrame([(i, float(i), 0.0, 1.0, float(i) if i else None, "a" if i < 20 else None, "t" * 400, "pioneer" if i == 3 else None, "hub" if i == 4 else None) for i in range(21)] + [(99, None, 0.0, 0.0, 20.0, "a", "x", None, None)], "id long, x double, y double, z double, engagement double, cluster_id string, content string, nova_role string, adept_role string").withColumn("timestamp", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    got = {r.id: r for r in S.viewer_rows(posts, spark.createDataFrame([("a", "#123456")], "cluster_id string, color string")).collect()}
    assert len(got) == 21 and len(got["0"].asDict()) == 28 and got["0"].engagement == 0 and got["0"].eng_cat == "normal" and got["0"].size == 7.5
    assert (got["20"].eng_cat, got["20"].label, got["20"].color, got["20"].cluster_id) == ("mega", "MEGA", "#555555", "")
    assert got["20"].size == round(2.5 * (0.6 + 0.4 * 2**0.5) * 1.9 * 3, 2)
    assert (got["3"].geometry, got["4"].geometry, got["5"].geometry) == ("icosahedron", "diamond", "sphere")
    assert len(got["5"].content) == 300 and len(got["5"].fullContent) == 400 and got["5"].timestamp == "2024-01-02T03:04:05" and got["5"].color == "#123456" and got["5"].nova_title == ""
    links = S.viewer_links(spark.createDataFrame([(1, 2, "nova", None), (1, 3, "odd", 1.0)], "source long, target long, type string, force double"))
    assert rows(links) == [("1", "2", "#F4A536", 0.35, 0.0, "nova"), ("1", "3", "#888", 0.5, 1.0, "odd")]
