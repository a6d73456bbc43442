"""Queries against their SQL on odd tables, and steps over pairs of rows that must not grow faster than they need to."""
import duckdb
import numpy as np
from pyspark.sql import functions as F

from postloom.plans import catalog


def tables(spark, folder, vectors, labels):
    """Posts as the queries read them: embeddings, and events of the same numbers, an hour apart."""
    rows = [(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(vectors, labels))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    e = spark.range(len(rows)).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") * 7 % 11).cast("double").alias("value"))
    e.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def same_as_sql(spark, folder, *names):
    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    for name in names:
        got = catalog.QUERIES[name](spark, folder)
        want = c.sql(catalog.ORACLES[name])
        order = [want.columns.index(x) for x in got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall()), name


def test_grafts_tie_at_six_places(spark, tmp_path):
    """Chain posts whose cosines differ in the eighth place only: SQL takes the smaller id."""
    v = np.zeros((30, 4))
    v[:, 0] = 1
    v[:, 1] = np.arange(30) * 1e-4  # the farther from 0, the smaller the product with a hub that leans the other way
    v[::7, 1] *= -1
    v[:, 0] += np.arange(30) * 3e-9
    same_as_sql(spark, tables(spark, tmp_path / "t", v, [i % 2 for i in range(30)]), "graft_top1")
    v[:, 0], v[:, 1] = 1, np.arange(30) * 3e-9
    v[::7, 1] = 1
    same_as_sql(spark, tables(spark, tmp_path / "u", v, [i % 2 for i in range(30)]), "graft_top1")


def test_rows_are_sent_to_few_blocks(spark):
    """Whatever the size of a table: before, a table of n rows was sent n / 1024 times."""
    from postloom.operators import blocks

    assert blocks.paired(spark.range(60_000)).count() <= 60_000 * blocks.BLOCKS


def test_copies_are_neighbours_by_id(spark):
    """More copies than neighbours, over pieces and blocks: the smaller ids are the nearest, at 0."""
    from postloom.operators import density

    df = spark.createDataFrame([(i, [0.1 * (i % 3), 0.3, 0.7]) for i in range(2400)], "id long, embedding array<double>")
    for row in density.nearest(df, 3).where("id % 400 < 3").collect():
        assert [(n.d, n.other) for n in row.near] == [(0.0, j) for j in range(row.id % 3, 15, 3) if j != row.id][:3]


def test_a_pool_cluster_is_many_tasks(spark, tmp_path):
    """Before, a cluster and all its distances were in one task; equal to SQL with more than one block of a cluster, and copies."""
    from postloom.operators import pools

    r = np.random.default_rng(3)
    v = r.normal(size=(1300, 9))
    v[1200:] = v[:100]
    folder = tables(spark, tmp_path / "t", v, np.arange(1300) % 7 == 0)
    df = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("id"))
    assert pools.paired_within(df, "cluster_id").select("g").distinct().count() > 2
    same_as_sql(spark, folder, "pool_rho_delta", "pool_members")


def test_pairs_of_old_posts_are_left_out(spark):
    """Before, incremental edges came from the pairs of all posts."""
    from postloom.operators import edges

    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=4).tolist(), i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, cluster_id int").withColumn("fresh", F.col("id") % 10 == 0)
    every, some = edges.bridges(df, 0.5), edges.bridges(df, 0.5, new="fresh")
    assert sorted(some.collect()) == sorted(every.where("source % 10 = 0 or target % 10 = 0").collect())


def test_the_tree_from_lists_is_that_from_all_pairs(spark, monkeypatch):
    """Copies, ties on a grid, vectors of unlike length and short lists: the same edges; and rows whose neighbours settle their part's edge are not compared with all rows."""
    from postloom.operators import density

    r = np.random.default_rng(11)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.r_[r.integers(0, 4, (60, 2)), r.normal(size=(80, 2)) * 0.1, r.normal(size=(60, 2)) + 9])]
    rows += [(300 + i, [float(i % 5)]) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    tree = lambda cores: sorted(map(tuple, density.reachability_edges(cores, block=64).select("a", "b", "w").collect()))
    want = tree(density.core_distances(df, 3))
    assert len(want) == len(rows) - 2
    for most in (4, 15):
        monkeypatch.setattr(density, "LISTED", most)
        assert tree(density.core_distances(df, 3, lists=True)) == want
    few = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(300, 3)))], "id long, embedding array<double>")
    cores = density.core_distances(few, 3, lists=True).localCheckpoint()
    sent, paired = [], density.paired
    monkeypatch.setattr(density, "paired", lambda p, block: (sent.append(p.where("ask").count()), paired(p, block))[1])
    density.reachability_edges(cores).count()
    assert sum(sent) < 300


def test_a_round_of_one_to_one_joins_no_edges_to_find_winners(spark, monkeypatch):
    """Before, all edges were joined with the best of both their ends, and a repeated edge won twice."""
    from postloom.operators import edges

    r = np.random.default_rng(2)
    rows = [(int(a), int(b), float(f)) for a, b, f in zip(r.integers(0, 40, 300), r.integers(0, 40, 300), r.integers(0, 9, 300) / 8)]
    rows += rows[:150]
    plans, kept = [], edges.materialise
    monkeypatch.setattr(edges, "materialise", lambda df, tag: (plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString())), kept(df, tag))[1])
    got = edges.one_to_one(spark.createDataFrame(rows, "source long, target long, force double")).collect()
    used, want = set(), []
    for a, b, f in sorted({x for x in rows if x[0] != x[1]}, key=lambda x: (-x[2], x[0], x[1])):
        if not used & {a, b}:
            used |= {a, b}
            want.append((a, b, f))
    assert sorted(map(tuple, got)) == sorted(want)
    assert [p for tag, p in plans if tag == "won"] and not any("Join" in p for tag, p in plans if tag == "won")
    assert all("strategy=broadcast" in p for tag, p in plans if tag == "left")  # so edges aren't shuffled either, unless very many posts are matched
    monkeypatch.setattr(edges, "SENT", 0)
    assert sorted(map(tuple, edges.one_to_one(spark.createDataFrame(rows, "source long, target long, force double")).collect())) == sorted(want)


def plain_pools(v, membership):
    """{id: (rho, delta, parent)} and {(id, hub)} of one cluster, by a plain program over whole vectors."""
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    n, cut = len(v), np.percentile(d[np.triu_indices(len(v), 1)], 20)
    rho = (d < cut).sum(1) - 1
    rank = {i: k for k, i in enumerate(sorted(range(n), key=lambda i: (-rho[i], i)))}
    best = [min(((round(d[i, j], 9), j) for j in range(n) if rank[j] < rank[i]), default=(d[i].max(), -1)) for i in range(n)]
    delta, gamma = np.array([b[0] for b in best]), [rho[i] * best[i][0] for i in range(n)]
    hub = {i for i in range(n) if gamma[i] >= np.percentile(gamma, 80) - 1e-9 and rho[i]}
    near = {i for i in range(n) if delta[i] <= np.percentile(delta, membership) + 1e-9 and best[i][1] >= 0}
    found = set()
    for i in set(range(n)) - hub:
        at = i
        while at not in hub and at in near:
            at = best[at][1]
        found |= {(i, at)} if at in hub else set()
    return {i: (int(rho[i]), round(best[i][0], 5), best[i][1]) for i in range(n)}, found


def far_out(spark, folder):
    """Vectors that differ after their eighth place only."""
    v = np.zeros((60, 12), np.float32)
    v[:, 8:] = np.random.default_rng(7).normal(size=(60, 4))
    return tables(spark, folder, v, [0] * len(v)), v.astype(float)


def test_pool_members_come_from_whole_vectors(spark, tmp_path):
    """Before, only the first eight dimensions of each vector were read: all distances were 0 and no post had a hub."""
    folder, v = far_out(spark, tmp_path / "t")
    got = {(r.id, r.hub) for r in catalog.QUERIES["pool_members"](spark, folder).collect()}
    assert got == plain_pools(v, 70)[1] and len(got) > 10
    same_as_sql(spark, folder, "pool_members")


def test_pool_rho_delta_come_from_whole_vectors(spark, tmp_path):
    """Before, only the first eight dimensions of each vector were read: every rho and delta was 0."""
    folder, v = far_out(spark, tmp_path / "t")
    got = {r.id: (r.rho, r.delta, r.parent) for r in catalog.QUERIES["pool_rho_delta"](spark, folder).collect()}
    want = plain_pools(v, 70)[0]
    assert {i: (r, p) for i, (r, _, p) in got.items()} == {i: (r, p) for i, (r, _, p) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 2e-5 for i in want) and min(d for _, d, _ in got.values()) > 0
    same_as_sql(spark, folder, "pool_rho_delta")
