"""Queries of graphs, matchings, pools and geometry."""
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import edges as E, graph as G, layout as L, pools as D, posts as P, retrieval as R
from ..session import table
from .registry import POSTS, posts_v, query

#: A graph of customers and suppliers: lines of the first orders.
EDGES = "e AS (SELECT DISTINCT 'c' || o_custkey source, 's' || l_suppkey target FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 97 = 0)"
REACH = f"{EDGES}, b AS (SELECT source a, target b FROM e UNION SELECT target, source FROM e), r AS (SELECT a v, a r FROM b UNION SELECT b.b, r.r FROM r JOIN b ON b.a = r.v), c AS (SELECT v, min(r) component FROM r GROUP BY v)"


def edges_v(s, d):
    x = table(s, d, "lineitem").where("l_orderkey % 97 = 0").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target")).distinct()


def nodes_v(s, d):
    c = table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return c.unionByName(table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")))


NODES = "n AS (SELECT 'c' || c_custkey id FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier)"


@query(f"WITH RECURSIVE {REACH}, {NODES} SELECT id, coalesce(component, id) AS component FROM n LEFT JOIN c ON v = id")
def components_with_singletons(s, d):
    return G.component_map(nodes_v(s, d), edges_v(s, d))


@query(f"WITH RECURSIVE {REACH}, {NODES} SELECT coalesce(component, id) AS component, count(*) AS n FROM n LEFT JOIN c ON v = id GROUP BY 1")
def component_sizes(s, d):
    return G.component_sizes(G.component_map(nodes_v(s, d), edges_v(s, d)))


@query(f"WITH RECURSIVE {REACH} SELECT s.v AS seed, c.v AS id FROM c s JOIN c USING (component) WHERE s.v IN ('s1', 's2', 's3')")
def seed_components(s, d):
    m = G.component_map(nodes_v(s, d), edges_v(s, d))
    found = edges_v(s, d).select(F.col("target").alias("id")).distinct().where("id in ('s1', 's2', 's3')")
    return G.component_of(m, found)


@query(f"WITH RECURSIVE {REACH} SELECT source, target, a.component AS source_component, b.component AS target_component FROM e JOIN c a ON a.v = source JOIN c b ON b.v = target")
def edges_with_components(s, d):
    return G.edge_components(edges_v(s, d), G.component_map(nodes_v(s, d), edges_v(s, d)))


@query(f"WITH {EDGES} SELECT source AS id, target AS other FROM e UNION ALL SELECT target, source FROM e")
def adjacency(s, d):
    return G.adjacency(edges_v(s, d))


@query(f"WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT source id FROM e UNION ALL SELECT target FROM e) GROUP BY id")
def node_degrees(s, d):
    return G.degrees(edges_v(s, d))


@query(f"WITH {EDGES} SELECT source, target, TRUE AS both FROM e WHERE source LIKE '%1' AND target LIKE '%2' UNION ALL SELECT source, target, FALSE FROM e WHERE source LIKE '%1' OR target LIKE '%2'")
def edges_among(s, d):
    ids = nodes_v(s, d).where("(id like 'c%1') or (id like 's%2')")
    e = edges_v(s, d)
    return G.among(e, ids).withColumn("both", F.lit(True)).unionByName(G.among(e, ids, both=False).withColumn("both", F.lit(False)))


@query(f"WITH RECURSIVE {REACH}, g AS (SELECT id, count(*) degree FROM (SELECT source id FROM e UNION ALL SELECT target FROM e) GROUP BY id) SELECT component, arg_min(v, (-degree, substr(v, 2, 1), v)) AS root FROM c JOIN g ON g.id = v GROUP BY component")
def component_roots(s, d):
    e = edges_v(s, d)
    m = G.component_map(G.adjacency(e).select("id").distinct(), e)
    return G.roots(m, e, m.select("id", F.substring("id", 2, 1).alias("label")))


@query(f"WITH RECURSIVE {EDGES}, b AS (SELECT source a, target b FROM e UNION SELECT target, source FROM e), r AS (SELECT 's1' v, 0 depth UNION SELECT b.b, r.depth + 1 FROM r JOIN b ON b.a = r.v WHERE r.depth < 4), m AS (SELECT v, min(depth) depth FROM r GROUP BY v) SELECT m.v AS id, m.depth, CASE WHEN m.depth > 0 THEN min(p.v) END AS parent FROM m LEFT JOIN b ON b.b = m.v LEFT JOIN m p ON p.v = b.a AND p.depth = m.depth - 1 GROUP BY m.v, m.depth")
def breadth_first(s, d):
    return G.breadth_first(edges_v(s, d), s.createDataFrame([("s1",)], "id string"), limit=4)


#: Posts in chains and pools: conversations, where some are chains, some pools of a hub and some alone.
POSTED = "k AS (SELECT conv_id || '_' || turn id, conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'offspring' END nova_role, CASE WHEN conv_id % 3 = 0 THEN conv_id END subtopic_id, CASE WHEN conv_id % 3 = 1 THEN CASE WHEN turn = 0 THEN 'Hub' ELSE 'member' END END adept_role FROM conversations)"
UNIT = "CASE WHEN conv_id % 3 = 0 THEN 'nova:' || conv_id WHEN conv_id % 3 = 1 THEN 'adept:' || conv_id || '_0' ELSE 'post:' || id END"


def posted(s, d):
    return table(s, d, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("id"), "conv_id", "turn", F.expr("if(conv_id % 3 = 0, 'offspring', null)").alias("nova_role"), F.expr("if(conv_id % 3 = 0, conv_id, null)").alias("subtopic_id"),
        F.expr("case when conv_id % 3 = 1 then if(turn = 0, 'Hub', 'member') end").alias("adept_role"))


def posted_edges(s, d):
    p = posted(s, d)
    spokes = p.where("conv_id % 3 = 1 and turn > 0").select(F.concat(F.col("conv_id").cast("string"), F.lit("_0")).alias("source"), F.col("id").alias("target"), F.lit("adept_spoke").alias("type"))
    follow = p.select(F.col("id").alias("source"), F.concat_ws("_", (F.col("conv_id") + 1).cast("string"), F.col("turn").cast("string")).alias("target"), F.lit("follow").alias("type"))
    return spokes.unionByName(follow.join(p.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "type"))


@query(f"WITH {POSTED} SELECT id, {UNIT} AS unit FROM k")
def skeleton_units(s, d):
    """GR7, GR10: the unit of each post."""
    return G.units(posted(s, d), posted_edges(s, d))


@query(f"WITH {POSTED}, u AS (SELECT id, conv_id, turn, {UNIT} unit FROM k) SELECT a.id AS source, b.id AS target, 'follow' AS type, a.unit AS source_unit, b.unit AS target_unit FROM u a JOIN u b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn WHERE a.unit <> b.unit")
def unit_graph(s, d):
    return G.unit_edges(posted_edges(s, d), G.units(posted(s, d), posted_edges(s, d)))


@query(f"WITH {POSTED}, u AS (SELECT {UNIT} unit, turn FROM k) SELECT unit, min(turn) AS first, count(*) AS n FROM u GROUP BY unit")
def unit_entities(s, d):
    p = posted(s, d)
    return G.entities(p.withColumn("timestamp", F.col("turn")), G.units(p, posted_edges(s, d)))


FOLLOW = f"{POSTS}, f AS (SELECT a.id s, b.id t, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * exp(greatest(-88, -((epoch_us(b.ts) - epoch_us(a.ts)) / 3.6e9) / 6)) force FROM p a JOIN p b ON b.ts > a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 48 * 3.6e9 AND b.engagement > a.engagement AND list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3)"
TIER = "CASE " + " ".join(f"WHEN engagement < 1 + 9 * {r} THEN {i + 1}" for i, r in enumerate(T.RATIOS)) + " ELSE 6 END"


def greedy(out, into, taken="s.o[src] > 0 AND s.n[tgt] > 0", change="v - 1"):
    """Recursive SQL of a sequential greedy matching: two lists of what is left at each post."""
    step = lambda x, i: f"list_transform(s.{x}, lambda v, i: CASE WHEN i = {i} AND {taken} THEN {change} ELSE v END)"
    return f"""x AS (SELECT id, row_number() OVER (ORDER BY id) i, {TIER} tier FROM p), o AS (SELECT f.s, f.t, a.i src, b.i tgt, row_number() OVER (ORDER BY force DESC, f.s, f.t) k FROM f JOIN x a ON a.id = f.s JOIN x b ON b.id = f.t),
s AS (SELECT 0::BIGINT k, (SELECT list({out} ORDER BY i) FROM x) o, (SELECT list({into} ORDER BY i) FROM x) n, FALSE won, NULL::BIGINT s, NULL::BIGINT t UNION ALL SELECT o.k, {step("o", "src")}, {step("n", "tgt")}, {taken}, o.s, o.t FROM s JOIN o ON o.k = s.k + 1)
SELECT s AS source, t AS target FROM s WHERE won"""


@query(f"WITH RECURSIVE {FOLLOW}, {greedy('[1,2,3,4,5,5][tier]', '[1,1,1,1,3,0][tier]')}")
def bmatching_pass1(s, d):
    p = posts_v(s, d)
    return E.match(E.follow(p, 0.3, influence=True), E.tier_quotas(p)).select("source", "target")


ONE = greedy("1", "1", "s.o[src] > 0 AND s.o[tgt] > 0").replace("list_transform(s.o, lambda v, i: CASE WHEN i = src AND", "list_transform(s.o, lambda v, i: CASE WHEN (i = src OR i = tgt) AND")


@query(f"WITH RECURSIVE {FOLLOW}, {ONE}")
def one_to_one_matching(s, d):
    return E.one_to_one(E.follow(posts_v(s, d), 0.3, influence=True)).select("source", "target")


@query(f"WITH {POSTS}, x AS (SELECT id, {TIER} tier FROM p), t AS (SELECT id FROM x WHERE id % 5 = 0 OR id % 5 = 1), f AS (SELECT a.id s, b.id t FROM x a JOIN x b ON b.id = a.id + 2) SELECT s AS source, t AS target FROM f JOIN x b ON b.id = f.t WHERE s NOT IN (SELECT id FROM t) AND (t NOT IN (SELECT id FROM t) OR b.tier = 6)")
def pass2_exclusions(s, d):
    p = posts_v(s, d)
    first = p.where("id % 5 = 0").select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    first = first.join(p.select(F.col("id").alias("target")), "target", "left_semi").unionByName(p.where("id % 5 = 1").select(F.col("id").alias("source"), F.col("id").alias("target")).select("source", "target"))
    cand = p.select(F.col("id").alias("source"), (F.col("id") + 2).alias("target")).join(p.select(F.col("id").alias("target")), "target", "left_semi")
    return E.second_pass(cand, p, first, 2, 2)[0].select("source", "target")


TYPED = f"{POSTS}, f AS (SELECT a.id s, b.id t, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) force, ['temporal_influence', 'temporal', 'semantic_inter'][(a.id + b.id) % 3 + 1] ty, (a.id + b.id) % 3 pr FROM p a JOIN p b ON a.id < b.id AND a.cluster_id <> b.cluster_id AND list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.36)"


def typed_v(s, d):
    e = E.bridges(posts_v(s, d), 0.36)
    return e.withColumn("type", F.element_at(F.array(*map(F.lit, E.JOINING)), ((F.col("source") + F.col("target")) % 3 + 1).cast("int")))


@query(f"""WITH RECURSIVE {TYPED}, x AS (SELECT id, row_number() OVER (ORDER BY id) i FROM p), o AS (SELECT f.s, f.t, ty, a.i src, b.i tgt, row_number() OVER (ORDER BY pr, force DESC, f.s, f.t) k FROM f JOIN x a ON a.id = f.s JOIN x b ON b.id = f.t),
s AS (SELECT 0::BIGINT k, (SELECT list((i - 1) // 10 ORDER BY i) FROM x) c, FALSE won, NULL::BIGINT s, NULL::BIGINT t, '' ty UNION ALL SELECT o.k, list_transform(s.c, lambda v: CASE WHEN v = s.c[src] THEN s.c[tgt] ELSE v END), s.c[src] <> s.c[tgt], o.s, o.t, o.ty FROM s JOIN o ON o.k = s.k + 1)
SELECT s AS source, t AS target, ty AS type FROM s WHERE won""")
def spanning_forest(s, d):
    """GR4: components of ten posts in order of id, joined by a forest of bridges."""
    from pyspark.sql import Window as W

    p = posts_v(s, d).select("id").withColumn("i", F.row_number().over(W.orderBy("id")) - 1)
    c = p.select(F.col("id").alias("node"), F.expr("i div 10").alias("c"))
    c = c.join(c.groupBy("c").agg(F.min("node").alias("component")), "c").select("node", "component")
    return E.prune_bridges(typed_v(s, d), c)[0].select("source", "target", "type")


FOREST = f"""WITH RECURSIVE {TYPED}, x AS (SELECT id, row_number() OVER (ORDER BY id) i FROM p), z AS (SELECT (i - 1) // 10 c, count(*) n FROM x GROUP BY 1),
o AS (SELECT f.s, f.t, ty, (a.i - 1) // 10 src, (b.i - 1) // 10 tgt, a.i ai, b.i bi, row_number() OVER (ORDER BY pr, force DESC, f.s, f.t) k FROM f JOIN x a ON a.id = f.s JOIN x b ON b.id = f.t)"""


@query(f"""{FOREST}, s AS (SELECT 0::BIGINT k, (SELECT list((i - 1) // 10 ORDER BY i) FROM x) c, FALSE won, '' ty UNION ALL
SELECT o.k, list_transform(s.c, lambda v: CASE WHEN v = s.c[ai] THEN s.c[bi] ELSE v END), s.c[ai] <> s.c[bi], o.ty FROM s JOIN o ON o.k = s.k + 1)
SELECT s.ty AS type, count(*) FILTER (src = tgt) AS inside, 0::BIGINT AS isolated, count(*) FILTER (src <> tgt AND NOT won) AS redundant, count(*) FILTER (won) AS kept FROM s JOIN o USING (k) GROUP BY s.ty""")
def prune_statistics(s, d):
    from pyspark.sql import Window as W

    p = posts_v(s, d).select("id").withColumn("i", F.row_number().over(W.orderBy("id")) - 1)
    c = p.select(F.col("id").alias("node"), F.expr("i div 10").alias("c"))
    c = c.join(c.groupBy("c").agg(F.min("node").alias("component")), "c").select("node", "component")
    return E.prune_counts(*E.prune_bridges(typed_v(s, d), c))


@query(f"WITH {POSTS}, f AS (SELECT a.id s, b.id t FROM p a JOIN p b ON a.id < b.id AND a.cluster_id <> b.cluster_id AND list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3) SELECT s AS source, t AS target FROM f WHERE s % 10 = 0 OR t % 10 = 0")
def incremental_edges(s, d):
    """ST1: edges that touch a new post."""
    p = posts_v(s, d)
    return E.incremental(p.where("id % 10 = 0"), p.where("id % 10 <> 0"), lambda x: E.bridges(x, 0.3, new="is_new")).select("source", "target")


DPC = """v AS (SELECT label, vec_id id, embedding::DOUBLE[] e FROM embeddings), w AS (SELECT a.label, a.id, b.id other, list_distance(a.e, b.e) dist FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id),
c AS (SELECT label, quantile_cont(dist, 0.2) dc FROM w WHERE id < other GROUP BY label), r AS (SELECT label, id, count(*) FILTER (dist < dc) rho FROM w JOIN c USING (label) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rho DESC, id) rank FROM r),
n AS (SELECT w.label, w.id, min((round(dist, 9), other)) FILTER (b.rank < a.rank) best, max(dist) far, any_value(a.rho) rho FROM w JOIN k a ON a.id = w.id JOIN k b ON b.id = w.other GROUP BY ALL)"""


def labelled(s, d):
    return table(s, d, "embeddings").select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("id"), "embedding", F.expr("timestamp_seconds(vec_id div 3)").alias("timestamp"), (F.col("vec_id") % 10).cast("double").alias("engagement"))


@query(f"WITH {DPC} SELECT label AS cluster_id, id, rho, round(coalesce(best[1], far), 5) AS delta, coalesce(best[2], -1) AS parent FROM n")
def pool_rho_delta(s, d):
    return D.density(labelled(s, d), dc=20.0).select("cluster_id", "id", "rho", F.round("delta", 5).alias("delta"), F.coalesce("parent", F.lit(-1)).alias("parent"))


@query(f"""WITH RECURSIVE {DPC}, g AS (SELECT *, coalesce(best[1], far) delta, rho * coalesce(best[1], far) gamma, best[2] parent FROM n), q AS (SELECT label, quantile_cont(gamma, 0.8) gq, quantile_cont(delta, 0.7) dq FROM g GROUP BY label),
h AS (SELECT g.*, gamma >= gq - 1e-9 AND rho > 0 hub, delta <= dq + 1e-9 AND parent IS NOT NULL near FROM g JOIN q USING (label)), u AS (SELECT id start, id cur FROM h WHERE NOT hub UNION ALL SELECT u.start, h.parent FROM u JOIN h ON h.id = u.cur WHERE NOT h.hub AND h.near)
SELECT u.start AS id, u.cur AS hub FROM u JOIN h ON h.id = u.cur WHERE h.hub""")
def pool_members(s, d):
    return D.members(D.density(labelled(s, d), dc=20.0, membership=70.0)).select("id", "hub")


@query("SELECT hub, members, coalesce(excluded, 0) AS excluded FROM (SELECT user_id hub, count(*) members FROM events GROUP BY user_id) LEFT JOIN (SELECT user_id hub, count(*) excluded FROM events WHERE event_id % 3 = 0 GROUP BY user_id) USING (hub)")
def pool_counters(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("hub"), F.col("event_id").alias("id"))
    return D.counters(e, e.where("id % 3 = 0"))


@query("WITH v AS (SELECT user_id % 20 hub, event_id id FROM events WHERE event_id < 400) SELECT hub AS source, id AS target, 'adept_spoke' AS type, 1.0::DOUBLE AS force FROM v WHERE id <> hub AND NOT (id % 3 = 0) UNION ALL SELECT hub, id, 'gone', 0.0::DOUBLE FROM v WHERE id <> hub AND id % 3 = 0")
def pool_spokes(s, d):
    """ML14, ML15: pools without what was excluded, as edges, and what went."""
    v = table(s, d, "events").where("event_id < 400").select(F.lit(0).alias("cluster_id"), (F.col("user_id") % 20).alias("hub"), F.col("event_id").alias("id"))
    kept, gone = D.exclude(v, v.where("id % 3 = 0 or id = hub"))
    return D.spokes(kept).unionByName(gone.select(F.col("hub").alias("source"), F.col("excluded_id").alias("target"), F.lit("gone").alias("type"), F.lit(0.0).alias("force")))


@query("SELECT conv_id || '_' || turn AS id, 'pool ' || conv_id AS title FROM conversations WHERE conv_id % 3 = 1 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn > 0)")
def pool_metadata(s, d):
    p = posted(s, d)
    hubs = p.where("conv_id % 3 = 1 and turn = 0")
    return D.pool_metadata(p, posted_edges(s, d), hubs.select(F.col("id").alias("hub"), F.concat(F.lit("pool "), F.col("conv_id").cast("string")).alias("title")))


QUESTION = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)"
SCORES = f"v AS (SELECT vec_id id, label component, round(list_cosine_similarity(embedding::DOUBLE[], {QUESTION}), 6) score FROM embeddings), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY component ORDER BY score DESC, id) = 1)"


def question(s, d, i=3):
    return list(table(s, d, "embeddings").where(f"vec_id = {i}").first()["embedding"])


def posts_and_components(s, d):
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding"), e.select(F.col("vec_id").alias("id"), F.col("label").alias("component"))


@query(f"WITH {SCORES} SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS place, score FROM v QUALIFY place <= 100")
def ranked_search(s, d):
    from pyspark.sql import Window as W

    top = R.search(posts_and_components(s, d)[0], question(s, d)).limit(100)
    return top.select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("place"), "score")


@query(f"WITH {SCORES} SELECT * FROM b WHERE score >= 0.1 * (SELECT max(score) FROM b)")
def question_seeds(s, d):
    return R.seeds(*posts_and_components(s, d), question(s, d), ratio=0.1).select("id", "component", "score")


@query(f"WITH {SCORES}, x AS (SELECT b.*, n, row_number() OVER (ORDER BY score DESC, id) g FROM b JOIN (SELECT component, count(*) n FROM v GROUP BY component) USING (component) WHERE score >= 0.1 * (SELECT max(score) FROM b)), y AS (SELECT *, coalesce(sum(n) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM x) SELECT CAST(g AS INT) AS group_no, id AS seed, component, n FROM y WHERE before < 120")
def question_context(s, d):
    p, c = posts_and_components(s, d)
    return R.context(R.seeds(p, c, question(s, d), ratio=0.1), c, 120)


SPOTS = "v AS (SELECT vec_id id, label cluster_id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z FROM embeddings)"


def spots(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])


@query(f"WITH {SPOTS}, c AS (SELECT cluster_id, count(*) size, avg(x) cx, avg(y) cy, avg(z) cz FROM v GROUP BY cluster_id) SELECT cluster_id, size, round(cx, 6) AS cx, round(max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))), 6) AS radius FROM v JOIN c USING (cluster_id) GROUP BY ALL")
def cluster_geometry(s, d):
    return L.cluster_geometry(spots(s, d)).select("cluster_id", "size", F.round("cx", 6).alias("cx"), F.round("radius", 6).alias("radius"))


@query(f"WITH {SPOTS}, b AS (SELECT min(x) a, max(x) b, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) d, max(z) z FROM v) SELECT round(d, 6) AS diagonal, round(a - 0.2 * d, 6) AS nav_min_x, round((a + b) / 2, 6) AS spawn_x, round(z + 0.2 * d, 6) AS spawn_z FROM b")
def scene_bounds(s, d):
    return L.scene_bounds(spots(s, d)).select(*[F.round(c, 6).alias(c) for c in ("diagonal", "nav_min_x", "spawn_x", "spawn_z")])


@query(f"WITH {SPOTS}, m AS (SELECT avg(x) mx, avg(y) my, avg(z) mz FROM v), w AS (SELECT id, x - mx x, y - my y, z - mz z FROM v, m), t AS (SELECT greatest(max(abs(x)), max(abs(y)), max(abs(z))) t FROM w) SELECT id, round(x / t * 1000, 4) AS x, round(y / t * 1000, 4) AS y, round(z / t * 1000, 4) AS z FROM w, t")
def scaled_positions(s, d):
    return L.scaled(spots(s, d)).select("id", *[F.round(a, 4).alias(a) for a in "xyz"])


@query("SELECT event_id AS id, round(2.5 * (0.6 + 0.4 * sqrt(1 + value / greatest(1, (SELECT max(value) FROM events)))) * CASE WHEN value >= (SELECT quantile_cont(value, 0.95) FROM events) THEN 2.5 WHEN value >= (SELECT quantile_cont(value, 0.8) FROM events) THEN 1.5 ELSE 1 END * 3 * 1.5, 6) AS radius FROM events")
def node_radius(s, d):
    return L.node_radius(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("engagement"))).select("id", F.round("radius", 6).alias("radius"))


@query(f"WITH {SPOTS}, w AS (SELECT m.id, h.id hub, m.x, h.x hx, sqrt((m.x - h.x) ** 2 + (m.y - h.y) ** 2 + (m.z - h.z) ** 2) far FROM v m JOIN v h ON h.id = m.id - m.id % 10 AND m.id <> h.id) SELECT hub, id, round(CASE WHEN far >= 0.28 THEN x WHEN far > 1e-6 THEN hx + (x - hx) / far * 0.28 ELSE hx + 0.28 END, 6) AS x FROM w")
def spoke_spacing(s, d):
    p = spots(s, d)
    e = p.where("id % 10 <> 0").select((F.col("id") - F.col("id") % 10).alias("source"), F.col("id").alias("target"))
    return L.push_out(p, e, p.select("id", F.lit(0.1).alias("radius"))).select("hub", "id", F.round("x", 6).alias("x"))


@query("SELECT event_id AS id, round(value * CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 0.5 ELSE 0 END, 6) AS weight FROM events WHERE value > 0 AND event_type IN ('click', 'view')")
def layout_weights(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("value").alias("force"))
    return L.edge_weights(e, {"click": 2.0, "view": 0.5}).select("id", F.round("weight", 6).alias("weight"))


@query(f"WITH {SPOTS} SELECT doc_id AS id, round(coalesce(x, 0), 6) AS x, round(coalesce(y, 0), 6) AS second FROM documents LEFT JOIN v ON id = doc_id AND id % 2 = 0")
def attached_positions(s, d):
    p = L.positions(table(s, d, "documents").select(F.col("doc_id").alias("id")), spots(s, d).where("id % 2 = 0"))
    return p.select("id", F.round("x", 6).alias("x"), F.round(F.col("position_xyz")[1], 6).alias("second"))


@query(f"WITH {SPOTS}, c AS (SELECT cluster_id, count(*) n FROM v GROUP BY cluster_id) SELECT id, cluster_id, round(x, 6) AS x, substr(text, 1, 300) AS preview, lang AS label, printf('cluster_%04d', cluster_id) AS cluster_name FROM v JOIN documents ON doc_id = id JOIN c USING (cluster_id)")
def render_rows(s, d):
    """PF18: what a viewer shows of each post."""
    t = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    return spots(s, d).join(t, "id").select("id", F.col("cluster_id"), F.round("x", 6).alias("x"), F.substring("text", 1, 300).alias("preview"), "label", T.cluster_name(F.col("cluster_id")).alias("cluster_name"))
