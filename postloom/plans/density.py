"""Queries of density clustering and neighbour embedding, over all embeddings."""
from pyspark.sql import functions as F

from ..operators import density, manifold, models
from ..session import materialise, table
from .registry import query

U = "u AS (SELECT vec_id id, embedding::DOUBLE[] v FROM embeddings)"
CORE = f"""{U}, d AS (SELECT a.id a, b.id b, list_distance(a.v, b.v) d FROM u a JOIN u b ON a.id <> b.id),
c AS (SELECT a id, d core FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d) r FROM d) WHERE r = 7)"""


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query(f"WITH {CORE} SELECT id, round(core, 6) AS core FROM c")
def core_distances(s, d):
    return density.core_distances(vectors(s, d)).select("id", F.round("core", 6).alias("core"))


@query(f"""WITH RECURSIVE {CORE}, m AS (SELECT a, b, greatest(d, x.core, y.core) w FROM d JOIN c x ON x.id = a JOIN c y ON y.id = b),
t(id, w, done) USING KEY (id) AS (SELECT id, CASE WHEN id = (SELECT min(id) FROM u) THEN 0 ELSE 'inf'::DOUBLE END w, FALSE done FROM u
UNION (WITH n AS (SELECT id, w FROM recurring.t WHERE NOT done ORDER BY w, id LIMIT 1)
SELECT id, w, TRUE FROM n UNION ALL SELECT r.id, m.w, FALSE FROM n JOIN m ON m.a = n.id JOIN recurring.t r ON r.id = m.b WHERE NOT r.done AND m.w < r.w))
SELECT count(*) - 1 AS edges, round(sum(w), 4) AS weight FROM t""")
def spanning_tree_weight(s, d):
    """The minimum spanning tree of mutual reachability."""
    tree = density.minimum_forest(density.reachability_edges(materialise(density.core_distances(vectors(s, d), lists=True), "cores")))
    return tree.agg(F.count("*").alias("edges"), F.round(F.sum("w"), 4).alias("weight"))


@query()
def density_labels(s, d):
    return density.density_clusters(vectors(s, d))[0]


@query()
def density_tree(s, d):
    """The condensed tree, with the bounds of the numbers of clusters to try around its number of leaves."""
    clusters = density.density_clusters(vectors(s, d))[1]
    lo, hi = models.k_bounds(density.leaves(clusters).count())
    return clusters.withColumn("k_min", F.lit(lo)).withColumn("k_max", F.lit(hi))


@query(f"""WITH RECURSIVE {U}, x AS (SELECT a.id a, b.id b, round(1 - list_cosine_similarity(a.v, b.v), 12) d FROM u a JOIN u b ON a.id <> b.id),
n AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) r FROM x QUALIFY r <= 14),
g AS (SELECT a id, list(d ORDER BY r) ds, coalesce(min(d) FILTER (d > 0), 0) rho, sum(d) / 15 own FROM n GROUP BY a),
t AS (SELECT id, ds, rho, own, 0::DOUBLE lo, 'inf'::DOUBLE hi, 1::DOUBLE mid, 0 i FROM g UNION ALL
SELECT id, ds, rho, own, CASE WHEN h THEN lo ELSE mid END, CASE WHEN h THEN mid ELSE hi END, CASE WHEN h THEN (lo + mid) / 2 WHEN isinf(hi) THEN mid * 2 ELSE (mid + hi) / 2 END, i + 1
FROM (SELECT *, list_sum([exp(-greatest(0, x - rho) / mid) FOR x IN ds]) > log2(15) h FROM t WHERE i < 64)),
s AS (SELECT id, rho, greatest(mid, 0.001 * CASE WHEN rho > 0 THEN own ELSE (SELECT avg(own) FROM g) END) sigma FROM t WHERE i = 64),
p AS (SELECT least(a, b) a, greatest(a, b) b, CASE WHEN d <= rho THEN 1 ELSE exp(-(d - rho) / sigma) END p FROM n JOIN s ON s.id = a)
SELECT a, b, round(CASE WHEN count(*) = 2 THEN sum(p) - min(p) * max(p) ELSE sum(p) END, 5) AS w FROM p GROUP BY a, b""")
def fuzzy_weights(s, d):
    """The graph that the neighbour embedding is laid out by."""
    return manifold.fuzzy_graph(vectors(s, d)).withColumn("w", F.round("w", 5))


@query()
def neighbour_embedding(s, d):
    return manifold.embed(vectors(s, d), rounds=5)
