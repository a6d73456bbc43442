"""Queries of joins, aggregations, windows, orders and sets."""
from pyspark.sql import Window as W, functions as F

from .. import runs
from ..functions import text as T
from ..operators import edges as E, models, pools, posts as P, retrieval as R, summaries as S
from ..session import table
from .registry import POSTS, docs_v, posts_v, query


@query("SELECT doc_id AS id, coalesce(len(embedding), -1) AS dim, coalesce(label, -1) AS label FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def posts_with_embeddings(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return S.with_vectors(docs_v(s, d).select("id"), e).select("id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).otherwise(-1).cast("long").alias("dim"), F.coalesce("label", F.lit(-1)).alias("label"))


@query("SELECT doc_id AS id, source AS file, coalesce(quality, -1) AS cluster_label, coalesce(toxic, -1) AS cluster_topic FROM documents LEFT JOIN labels USING (doc_id)")
def relabelled(s, d):
    """J2, J3: columns of a patch in place of a table's own."""
    patch = table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("cluster_label"), F.col("toxic").alias("cluster_topic"))
    x = docs_v(s, d).select("id", "file", F.lit("old").alias("cluster_label"), F.lit("old").alias("cluster_topic"))
    return runs.patched(x, patch).fillna(-1, ["cluster_label", "cluster_topic"])


@query("SELECT o_orderkey, n_name AS label FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def label_lookup(s, d):
    """J4, J17: a table of labels, broadcast if it is small."""
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"))
    x = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return S.labelled(x, n, "c_nationkey").select("o_orderkey", "label")


@query("SELECT c.conv_id, c.turn, f.text AS title FROM conversations c LEFT JOIN (SELECT conv_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1) f USING (conv_id)")
def chain_metadata(s, d):
    c = table(s, d, "conversations")
    first = P.best_per(c, "conv_id", ["turn"]).select("conv_id", F.col("text").alias("title"))
    return c.join(first, "conv_id", "left").select("conv_id", "turn", "title")


@query(f"WITH {POSTS} SELECT a.id AS source, b.id AS target, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS force FROM p a JOIN p b ON a.id < b.id AND a.engagement > b.engagement AND list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3")
def engagement_only_candidates(s, d):
    return E.by_engagement(posts_v(s, d), 0.3).withColumn("force", F.round("force", 6))


GRAFT = f"WITH {POSTS}, h AS (SELECT * FROM p WHERE id % 7 = 0), c AS (SELECT * FROM p WHERE id % 7 IN (1, 2)), x AS (SELECT h.id source, c.id target, round(list_inner_product(h.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) cos FROM h JOIN c USING (cluster_id))"


@query(f"{GRAFT} SELECT source, target, cos FROM x WHERE cos >= 0.1 QUALIFY row_number() OVER (PARTITION BY source ORDER BY cos DESC, target) = 1")
def graft_top1(s, d):
    p = posts_v(s, d)
    return E.graft(p, p.where("id % 7 = 0"), p.where("id % 7 in (1, 2)"), 0.1, places=6).select("source", "target", F.round("cos", 6).alias("cos"))


@query(f"WITH {POSTS}, c AS (SELECT list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) c FROM p a JOIN p b ON a.id < b.id) SELECT round(quantile_cont(c, 0.9), 6) AS threshold FROM c WHERE c > 0")
def adaptive_threshold(s, d):
    return s.createDataFrame([(round(E.adaptive_threshold(posts_v(s, d), 90), 6),)], "threshold double")


@query("SELECT label AS cluster_id, count(vec_id) AS size FROM embeddings GROUP BY label")
def cluster_sizes(s, d):
    return S.sizes(table(s, d, "embeddings").withColumnRenamed("label", "cluster_id"), id="vec_id")


@query("SELECT arg_min(source, (n, source)) AS smallest, arg_max(source, (n, source)) AS largest FROM (SELECT source, count(*) n FROM documents GROUP BY source)")
def cluster_extremes(s, d):
    return S.extremes(S.sizes(table(s, d, "documents"), "source", "doc_id"), "source")


@query("SELECT event_type AS role, count(*) AS n FROM events GROUP BY event_type")
def role_counts(s, d):
    return S.value_counts(table(s, d, "events"), "event_type", "role")


@query("SELECT lang, count(DISTINCT source) AS sources, CAST(list_sort(list(DISTINCT source))[1] AS VARCHAR) AS first_source FROM documents GROUP BY lang")
def distinct_values(s, d):
    return S.distinct_values(table(s, d, "documents"), "lang", "source").toDF("lang", "sources", "first_source")


@query("WITH v AS (SELECT vec_id, generate_subscripts(embedding[1:4], 1) - 1 i, unnest(embedding[1:4])::DOUBLE x FROM embeddings) SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM v a JOIN v b USING (vec_id) GROUP BY ALL")
def covariance(s, d):
    _, _, cov = models.moments(table(s, d, "embeddings").withColumn("e", F.slice("embedding", 1, 4)), "e")
    return s.createDataFrame([(i, j, round(float(c), 6) + 0.0) for i, r in enumerate(cov) for j, c in enumerate(r)], "i int, j int, cov double")


@query("""WITH c AS (SELECT label a, vec_id % 7 b, count(*) n FROM embeddings GROUP BY ALL), t AS (SELECT sum(n) t FROM c), h AS (SELECT sum(-n / t * ln(n / t)) h FROM c, t), x AS (SELECT sum(-m / t * ln(m / t)) h FROM (SELECT sum(n) m FROM c GROUP BY a), t), y AS (SELECT sum(-m / t * ln(m / t)) h FROM (SELECT sum(n) m FROM c GROUP BY b), t)
SELECT round(2 * (x.h + y.h - h.h) / (x.h + y.h), 9) AS nmi FROM h, x, y""")
def nmi_score(s, d):
    return models.nmi(table(s, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 7).alias("b"))).select(F.round("nmi", 9).alias("nmi"))


@query("""WITH v AS (SELECT label, generate_subscripts(embedding, 1) i, unnest(embedding)::DOUBLE x FROM embeddings), c AS (SELECT label, i, avg(x) m, count(*) n, var_pop(x) v FROM v GROUP BY ALL), g AS (SELECT i, avg(x) g FROM v GROUP BY i)
SELECT round(sum(n * (m - g) * (m - g)) / (count(DISTINCT label) - 1) / (sum(n * v) / ((SELECT count(*) FROM embeddings) - count(DISTINCT label))), 6) AS calinski_harabasz FROM c JOIN g USING (i)""")
def cluster_separation(s, d):
    return models.calinski_harabasz(table(s, d, "embeddings")).select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


@query("WITH b AS (SELECT source, 2 + row_number() OVER (ORDER BY source) k, sum(n_chars)::DOUBLE bic FROM documents GROUP BY source), e AS (SELECT min(k) k0, max(k) k1, min(bic) b0, max(bic) b1 FROM b) SELECT CAST(k AS INT) AS k, bic, round(bic + 0.5 * (b1 - b0) * (k - k0) / (k1 - k0), 6) AS penalised FROM b, e")
def penalised_bic(s, d):
    b = table(s, d, "documents").groupBy("source").agg(F.sum("n_chars").cast("double").alias("bic")).withColumn("k", 2 + F.row_number().over(W.orderBy("source")))
    return models.penalised(b.select("k", "bic"), 0.5).withColumn("penalised", F.round("penalised", 6))


@query("SELECT o_custkey % 9 AS pivot, greatest(2, o_custkey % 9 * 20 - 48)::INT AS lo, (o_custkey % 9 * 20 + 48)::INT AS hi FROM orders GROUP BY o_custkey % 9")
def k_bounds(s, d):
    return s.createDataFrame([(r.p, *models.k_bounds(r.p * 20)) for r in table(s, d, "orders").select((F.col("o_custkey") % 9).alias("p")).distinct().collect()], "pivot long, lo int, hi int")


@query("SELECT count(ts) > 0 AS has_time, count(value) > 0 AS has_engagement, count(CASE WHEN event_id < 0 THEN 1 END) > 0 AS has_none FROM events")
def field_probes(s, d):
    e = table(s, d, "events").withColumn("none", F.when(F.col("event_id") < 0, 1))
    return S.fields(e, has_time="ts", has_engagement="value", has_none="none")


@query("SELECT doc_id AS id, source AS file FROM documents ORDER BY source, doc_id LIMIT 50")
def limit_rows(s, d):
    return docs_v(s, d).select("id", "file").orderBy("file", "id").limit(50)


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, value DESC, user_id, event_id) AS INT) AS place FROM events QUALIFY place <= 1000")
def edge_order(s, d):
    """T2, T3: by type, then force, ties pinned."""
    e = table(s, d, "events").withColumn("kind", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other"))
    order = S.strongest(e, ("click", "view", "other"), ("user_id", "event_id"), "kind", "value")
    top = e.orderBy(*order).limit(1000)
    return top.select("event_id", F.row_number().over(W.orderBy(*order)).alias("place"))


@query("""WITH x AS (SELECT label, unnest(range(1, len(embedding) + 1)) i, unnest(embedding)::DOUBLE x FROM embeddings), m AS (SELECT label, list(a ORDER BY i) c FROM (SELECT label, i, avg(x) a FROM x GROUP BY ALL) GROUP BY label)
SELECT label AS cluster_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS score FROM embeddings JOIN m USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 15""")
def representative_posts(s, d):
    return P.representatives(table(s, d, "embeddings").select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("id"), "embedding")).select("cluster_id", "id", "score")


@query("SELECT user_id AS hub, event_id AS id, value AS delta FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) < 5")
def pool_cap(s, d):
    return pools.capped(table(s, d, "events").select(F.col("user_id").alias("hub"), F.col("event_id").alias("id"), F.col("value").alias("delta")), 5)


@query("SELECT conv_id, array_to_string(list(turn ORDER BY turn)[1:5], ',') AS first_five, string_agg(CASE WHEN length(text) <= 30 THEN coalesce(text, '') ELSE substr(text, 1, 29) || '…' END, '|' ORDER BY turn) FILTER (r <= 5) AS previews FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) r FROM conversations) GROUP BY conv_id")
def prompt_candidates(s, d):
    x = S.first_members(table(s, d, "conversations"), 5, 30, "conv_id", "turn", "text")
    return x.select("conv_id", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("first_five"), F.array_join("previews", "|").alias("previews"))


@query("SELECT label AS cluster_id, vec_id AS id, CAST(row_number() OVER w AS INT) AS place, greatest(count(*) OVER (PARTITION BY label) - 15, 0) AS more FROM embeddings JOIN events ON vec_id = event_id WINDOW w AS (PARTITION BY label ORDER BY value DESC, vec_id) QUALIFY place <= 15")
def cluster_best_posts(s, d):
    return S.best_posts(posts_v(s, d))


@query("SELECT count(DISTINCT lang) AS groups, count(CASE WHEN k = 0 THEN 1 END) AS chains, count(CASE WHEN k = 1 THEN 1 END) AS pools, count(CASE WHEN k = 2 THEN 1 END) AS isolated, sum(n)::BIGINT AS posts FROM (SELECT lang, source, length(source) % 3 k, count(*) n FROM documents GROUP BY ALL)")
def context_counts(s, d):
    """A15: units by kind."""
    kind = F.element_at(F.array(F.lit("nova:"), F.lit("adept:"), F.lit("post:")), F.length("source") % 3 + 1)
    return S.context_counts(table(s, d, "documents").select(F.col("lang").alias("group_no"), F.concat(kind, "source").alias("unit"), F.col("doc_id").alias("id")))


@query("""WITH p AS (SELECT doc_id id, lang cluster_id, CASE WHEN doc_id % 2 = 0 THEN source END chain, CASE WHEN doc_id % 3 = 0 THEN source END pool, n_chars depth FROM documents),
e AS (SELECT a.cluster_id, count(*) n FROM p a JOIN p b ON b.id = a.id + 1 AND b.cluster_id = a.cluster_id GROUP BY 1)
SELECT cluster_id, count(*) AS posts, count(DISTINCT chain) AS chains, count(DISTINCT pool) AS pools, max(depth) AS depth, any_value(coalesce(n, 0)) AS edges FROM p LEFT JOIN e USING (cluster_id) GROUP BY cluster_id""")
def cluster_overview(s, d):
    """A16: posts, chains, pools, depth and edges of each cluster."""
    p = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cluster_id"), F.expr("case when doc_id % 2 = 0 then source end").alias("subtopic_id"), F.expr("case when doc_id % 3 = 0 then source end").alias("adept_pool_hub_id"), F.col("n_chars").alias("nova_depth"))
    return S.cluster_overview(p, p.select(F.col("id").alias("source"), (F.col("id") + 1).alias("target")))


@query("SELECT user_id AS hub, event_id AS id, CASE WHEN event_id = h THEN 'hub' WHEN event_id = lo THEN 'pioneer' WHEN mx > mn AND event_id = la THEN 'latest' ELSE 'member' END AS role FROM (SELECT user_id, event_id, t, min(event_id) OVER w h, first_value(event_id) OVER (PARTITION BY user_id ORDER BY t NULLS LAST, event_id) lo, min(t) OVER w mn, max(t) OVER w mx, first_value(event_id) OVER (PARTITION BY user_id ORDER BY t DESC NULLS LAST, event_id) la FROM (SELECT *, CASE WHEN event_id % 4 > 0 THEN ts END t FROM events) WINDOW w AS (PARTITION BY user_id))".replace("event_id = lo", "mx > mn AND event_id = lo AND t IS NOT NULL"))
def pool_roles(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_id").alias("id"), F.expr("case when event_id % 4 > 0 then ts end").alias("timestamp"))
    hub = e.groupBy("user_id").agg(F.min("id").alias("hub"))
    return P.pool_roles(e.join(hub, "user_id"), "hub", "id", "timestamp").join(hub.select(F.col("hub"), F.col("user_id").alias("u")), "hub").select(F.col("u").alias("hub"), "id", "role")


SEEDS = "v AS (SELECT event_id % 50 id, round(value, 6) score FROM events), w AS (SELECT * FROM v UNION ALL SELECT id + 5, score / 2 FROM v WHERE id < 20)"


@query(f"WITH {SEEDS} SELECT id, max(score) AS score FROM w GROUP BY id")
def merge_seeds(s, d):
    v = table(s, d, "events").select((F.col("event_id") % 50).alias("id"), F.round("value", 6).alias("score"))
    return P.merge_seeds(v, v.where("id < 20").select((F.col("id") + 5).alias("id"), (F.col("score") / 2).alias("score")))


@query("WITH g AS (SELECT source, count(*) n, row_number() OVER (ORDER BY source) rank FROM documents GROUP BY source), x AS (SELECT *, coalesce(sum(n) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT before FROM g) SELECT source, n, CAST(rank AS INT) AS rank, before FROM x WHERE before < (SELECT count(*) / 3 FROM documents)")
def context_budget(s, d):
    g = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(W.orderBy("source")))
    return P.budgeted(g, table(s, d, "documents").count() / 3)


@query("WITH c AS (SELECT label, avg(embedding[1]::DOUBLE) x, avg(embedding[2]::DOUBLE) y FROM embeddings GROUP BY label) SELECT label, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS x, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()), 6) AS y FROM c")
def centroid_minmax(s, d):
    from ..operators import layout

    c = table(s, d, "embeddings").groupBy("label").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(n) for i, n in enumerate("xy")])
    return layout.between_0_and_1(c, "x", "y").select("label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT conv_id AS group_no, turn AS step, 'E' || row_number() OVER (ORDER BY conv_id, turn) AS handle FROM conversations")
def entity_handles(s, d):
    from ..operators import graph

    return graph.handles(table(s, d, "conversations").select(F.col("conv_id").alias("group_no"), F.col("turn").alias("step"))).select("group_no", "step", "handle")


@query("WITH v AS (SELECT conv_id c, turn g, unnest([turn * 2 % 5, turn * 3 % 7, turn]) p, generate_subscripts([1, 2, 3], 1) - 1 pos FROM conversations), f AS (SELECT DISTINCT ON (c, p) c, p, g, pos FROM v ORDER BY c, p, g, pos) SELECT c AS cluster, CAST(p AS BIGINT) AS post, g AS group_pos FROM f QUALIFY count(*) OVER (PARTITION BY c, g) >= 2")
def first_seen_assignment(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("cluster"), F.col("turn").alias("group_pos"), F.posexplode(F.array(F.col("turn") * 2 % 5, F.col("turn") * 3 % 7, F.col("turn"))).alias("pos", "post"))
    return P.first_seen(c).select("cluster", "post", "group_pos")


@query("SELECT doc_id AS id, 'documents' AS kind, n_chars AS size, NULL AS url FROM documents UNION ALL SELECT page_id, 'pages', -1, url FROM pages")
def union_by_name(s, d):
    """SO1, SO2, SO4: tables one after another by name, columns that one lacks null."""
    a = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("kind"), F.col("n_chars").alias("size"))
    return a.unionByName(table(s, d, "pages").select(F.col("page_id").alias("id"), F.lit("pages").alias("kind"), "url"), allowMissingColumns=True).fillna(-1, ["size"])


@query("SELECT doc_id AS id, 'both' AS side FROM documents JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'left' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def id_sets(s, d):
    """SO5, J15: which ids two tables share, by semi and anti join."""
    a, b = table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id")
    return a.join(b, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.lit("both").alias("side")).unionByName(a.join(b, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.lit("left").alias("side")))


@query("SELECT event_id AS run_id, CASE WHEN event_id % 10 = 0 THEN 'added' WHEN event_id % 10 = 1 THEN 'removed' ELSE 'changed' END AS change, CASE WHEN event_id % 10 = 2 THEN 'status' WHEN event_id % 10 = 3 THEN 'status,stage' ELSE '' END AS fields FROM events WHERE event_id % 10 < 4")
def run_snapshot_diff(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("status"), F.col("user_id").alias("stage"))
    new = e.where("run_id % 10 <> 1").withColumn("status", F.when(F.expr("run_id % 10 in (2, 3)"), "x").otherwise(F.col("status"))).withColumn("stage", F.when(F.expr("run_id % 10 = 3"), -1).otherwise(F.col("stage")))
    return runs.differences(e.where("run_id % 10 <> 0"), new)


@query("SELECT doc_id AS id, lang FROM documents WHERE lang NOT IN ('de', 'fr')")
def remaining_clusters(s, d):
    """SK7, N6, N8: what is left after the clusters that are done."""
    from ..operators import chains

    done = s.createDataFrame([("de",), ("fr",), ("xx",)], "lang string")
    return chains.remaining(table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang"), done, "lang").select("id", "lang")


@query("SELECT turn AS position, conv_id AS cluster_id, conv_id * 100 + turn AS hub, CASE WHEN turn % 2 = 0 THEN 't' || turn ELSE '' END AS title, CASE WHEN turn % 2 = 0 THEN 'r' || turn ELSE '' END AS reasoning FROM conversations")
def explanation_match(s, d):
    c = table(s, d, "conversations")
    p = c.select(F.col("conv_id").alias("cluster_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("hub"), F.col("turn").alias("position"))
    e = c.where("turn % 2 = 0").select(F.col("conv_id").alias("cluster_id"), F.col("turn").alias("group_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    e = e.select("*", F.concat(F.lit("t"), F.when(F.col("seq") == 1, F.col("group_id").cast("string")).otherwise("again")).alias("title"), F.concat(F.lit("r"), F.col("group_id").cast("string")).alias("reasoning"))
    return pools.explained(p, e)


@query("SELECT handle, array_to_string(list_sort(list(DISTINCT turn)), ',') AS ids FROM (SELECT 'E' || conv_id handle, turn FROM conversations) GROUP BY handle")
def citation_index(s, d):
    return R.citation_index(table(s, d, "conversations").select(F.concat(F.lit("E"), F.col("conv_id").cast("string")).alias("handle"), F.col("turn").alias("id"))).withColumn("ids", F.concat_ws(",", F.col("ids").cast("array<string>")))


UNITS = "u AS (SELECT 'E' || conv_id handle, conv_id || '_' || turn id, turn pos FROM conversations)"


@query(f"WITH {UNITS}, x AS (SELECT *, pos < 3 OR (pos = 5 AND handle LIKE '%0') k FROM u WHERE handle LIKE '%0' OR handle LIKE '%5') SELECT handle, id, pos, CAST(count(*) FILTER (NOT k) OVER (PARTITION BY handle) AS BIGINT) AS left_out FROM x QUALIFY k")
def source_appendix(s, d):
    c = table(s, d, "conversations")
    u = c.select(F.concat(F.lit("E"), F.col("conv_id").cast("string")).alias("handle"), F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("turn").alias("pos"))
    cited = u.where("handle like '%0' and pos = 5").select("handle", "id").unionByName(u.where("handle like '%0' or handle like '%5'").select("handle", F.lit("").alias("id")))
    return R.appendix(u, cited)


@query(f"WITH {UNITS}, c AS (SELECT handle, id FROM u WHERE pos = 0 UNION SELECT handle, id || 'x' FROM u WHERE pos = 1 UNION SELECT 'F' || handle, '' FROM u WHERE pos = 0) SELECT handle, id FROM c WHERE handle LIKE 'F%' OR id LIKE '%x'")
def unresolved_citations(s, d):
    c = table(s, d, "conversations")
    u = c.select(F.concat(F.lit("E"), F.col("conv_id").cast("string")).alias("handle"), F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("turn").alias("pos"))
    cited = u.where("pos = 0").select("handle", "id").union(u.where("pos = 1").select("handle", F.concat("id", F.lit("x")))).union(u.where("pos = 0").select(F.concat(F.lit("F"), "handle"), F.lit("")))
    return R.unresolved(cited, u)


@query("SELECT lang AS cluster, string_agg(term, ' · ' ORDER BY r) AS label FROM (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) r FROM (SELECT lang, term, count(*) n FROM (SELECT lang, unnest(string_split(lower(text), ' ')) term FROM documents) GROUP BY ALL)) WHERE r <= 5 GROUP BY lang")
def keyword_labels(s, d):
    t = table(s, d, "documents").select(F.col("lang").alias("cluster"), F.explode(F.split(F.lower("text"), " ")).alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("score"))
    t = t.withColumn("place", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("score"), "term")))
    return P.keyword_labels(t)


@query("SELECT lang AS cluster_id, string_agg('<post id=\"' || doc_id || '\" date=\"\">' || CASE WHEN length(l) <= 60 THEN l ELSE regexp_replace(CASE WHEN strpos(substr(l, 1, 60), ' ') > 0 AND 60 - strpos(reverse(substr(l, 1, 60)), ' ') > 0 THEN substr(l, 1, 60 - strpos(reverse(substr(l, 1, 60)), ' ')) ELSE substr(l, 1, 60) END, '\\s+$', '') || '…' END || '</post>', chr(10) ORDER BY doc_id) AS block FROM (SELECT lang, doc_id, translate(trim(regexp_replace(text, '\\s+', ' ', 'g')), '<>', '‹›') l FROM documents) GROUP BY lang")
def prompt_blocks(s, d):
    from ..operators import chains

    x = table(s, d, "documents").select(F.col("lang").alias("cluster_id"), F.col("doc_id").alias("id"), F.lit(None).cast("timestamp").alias("timestamp"), F.col("text").alias("content"))
    return chains.prompt_block(x, 60)


@query("SELECT count(*) AS n_chains, count(nullif(n, 1)) AS longer, max(n) - 1 AS max_depth, sum(n)::BIGINT AS posts FROM (SELECT conv_id, count(*) n FROM conversations GROUP BY conv_id)")
def context_summary(s, d):
    """A15, A16: counts of units and posts."""
    n = table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_chains"), F.count_if(F.col("n") > 1).alias("longer"), (F.max("n") - 1).alias("max_depth"), F.sum("n").alias("posts"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 > 0 THEN lang END AS nova_role, count(CASE WHEN doc_id % 4 > 0 THEN lang END) OVER () = 0 AS clustering_only FROM documents")
def run_mode(s, d):
    x = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.expr("case when doc_id % 4 > 0 then lang end").alias("nova_role"), F.lit(None).cast("string").alias("adept_role"))
    return x.select("id", "nova_role", F.lit(runs.clustering_only(x)).alias("clustering_only"))


@query("SELECT count(*) AS rows FROM lineitem")
def row_count(s, d):
    from ..sources import files

    return s.createDataFrame([(files.row_count(s, f"{d}/lineitem.parquet"),)], "rows long")


@query("SELECT o_orderkey AS run_id, o_orderpriority AS status, o_orderdate::VARCHAR AS started_at FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def runs_by_start(s, d):
    """T12: the first runs by their beginning."""
    return table(s, d, "orders").orderBy("o_orderdate", "o_orderkey").limit(100).select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("started_at"))
