"""Registered queries over the driver's tables, with the SQL each must equal."""
from pyspark.sql import Window as W, functions as F

from ..functions import text
from ..operators import edges, posts
from ..operators.components import connected_components
from ..session import table
from .registry import CLEAN, ORACLES, POSTS, QUERIES, docs_v, posts_v, query  # noqa: F401


@query(f"""WITH t AS (SELECT lang, doc_id, unnest(string_split({CLEAN}, ' ')) term FROM documents),
u AS (SELECT lang, term, count(*) n, count(DISTINCT doc_id) d FROM t WHERE length(term) >= 3 GROUP BY ALL),
g AS (SELECT term, sum(n) f FROM u GROUP BY term HAVING sum(d) >= 2 ORDER BY f DESC, term LIMIT 50000), c AS (SELECT lang, u.term, n, f FROM u JOIN g USING (term)),
z AS (SELECT lang, sum(n) size FROM c GROUP BY 1), s AS (SELECT c.lang AS cluster, term, round(sqrt(n / size) * ln((SELECT floor(avg(size)) FROM z) / greatest(f, 1) + 1), 6) score FROM c JOIN z ON z.lang = c.lang)
SELECT cluster, term, score, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS INT) place FROM s QUALIFY place <= 10""")
def ctfidf_top_terms(s, d):
    return posts.ctfidf(posts.class_terms(docs_v(s, d)))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in posts.STOP) + "]"


@query(f"""WITH w AS (SELECT lang, doc_id, list_filter(string_split({CLEAN}, ' '), lambda x: length(x) >= 3 AND NOT list_contains({STOP_SQL}, x)) x FROM documents),
t AS (SELECT lang, doc_id, unnest(list_concat(x, list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]))) term FROM w), u AS (SELECT lang, term, count(*) n, count(DISTINCT doc_id) d FROM t GROUP BY ALL),
g AS (SELECT term, sum(n) f FROM u GROUP BY term HAVING sum(d) >= 2 ORDER BY f DESC, term LIMIT 50000), c AS (SELECT lang, u.term, n, f FROM u JOIN g USING (term)),
z AS (SELECT lang, sum(n) size FROM c GROUP BY 1), s AS (SELECT c.lang AS cluster, term, round(sqrt(n / size) * ln((SELECT floor(avg(size)) FROM z) / greatest(f, 1) + 1), 6) score FROM c JOIN z ON z.lang = c.lang)
SELECT cluster, term, score, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS INT) place FROM s QUALIFY place <= 10""")
def ctfidf_top_ngrams(s, d):
    return posts.ctfidf(posts.class_terms(docs_v(s, d), stop=posts.STOP, grams=2))


@query("SELECT doc_id AS id, 1 + 9 * (rank() OVER (PARTITION BY source ORDER BY n_chars) + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2) / count(n_chars) OVER (PARTITION BY source) AS rank FROM documents")
def engagement_rank_per_file(s, d):
    return posts.engagement_rank(docs_v(s, d), constant=None).select("id", "rank")


@query("""WITH v AS (SELECT doc_id AS id, doc_id % 3 AS file, CASE WHEN doc_id % 3 = 0 THEN 7 ELSE n_chars END AS e FROM documents)
SELECT id, CASE WHEN min(e) OVER f = max(e) OVER f THEN 10.0::DOUBLE ELSE 1 + 9 * (rank() OVER (PARTITION BY file ORDER BY e) + (count(*) OVER (PARTITION BY file, e) - 1) / 2) / count(e) OVER f END AS rank FROM v WINDOW f AS (PARTITION BY file)""")
def engagement_rank_constant_file(s, d):
    v = table(s, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("file"), F.expr("case when doc_id % 3 = 0 then 7 else n_chars end").alias("engagement"))
    return posts.engagement_rank(v).select("id", "rank")


@query("SELECT event_id AS id, coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, (SELECT quantile_cont(value, 0.5) FROM events WHERE event_id % 3 <> 0), 5.5) AS engagement FROM events")
def engagement_fill(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.expr("case when event_id % 3 <> 0 then value end").alias("engagement"))
    return posts.fill_median(e)


@query("SELECT doc_id, substr(sha1(text), 1, 16) AS id FROM documents")
def content_hash_ids(s, d):
    return table(s, d, "documents").select("doc_id", text.content_id("text").alias("id"))


@query("""WITH v AS (SELECT doc_id, source, text, CASE WHEN doc_id % 3 = 0 THEN '  ' WHEN doc_id % 3 = 1 THEN NULL ELSE 'p' || (doc_id // 6) END id FROM documents), w AS (SELECT *, coalesce(trim(id), '') = '' made, CASE WHEN coalesce(trim(id), '') = '' THEN substr(sha1(text), 1, 16) ELSE id END k FROM v)
SELECT doc_id, k || CASE WHEN NOT made AND n > 1 THEN '__dup' || (n - 1) ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY k, made ORDER BY source, doc_id) n FROM w)""")
def repaired_ids(s, d):
    x = table(s, d, "documents").select("doc_id", "source", "text", F.expr("case when doc_id % 3 = 0 then '  ' when doc_id % 3 = 2 then concat('p', doc_id div 6) end").alias("id"))
    return posts.ensure_ids(x, ("source", "doc_id"), content="text").select("doc_id", "id")


@query("SELECT doc_id, h || CASE WHEN n = 1 THEN '' ELSE '__dup' || (n - 1) END AS unique_id FROM (SELECT doc_id, substr(sha1(text), 1, 16) h, row_number() OVER (PARTITION BY sha1(text) ORDER BY source, doc_id) n FROM documents)")
def dup_suffix(s, d):
    x = table(s, d, "documents").select("doc_id", text.content_id("text").alias("id"), "source")
    return posts.suffix_duplicates(x, order=("source", "doc_id")).select("doc_id", "unique_id")


@query(f"SELECT doc_id, {CLEAN} AS cleaned, len(list_filter(string_split({CLEAN}, ' '), lambda x: length(x) >= 3)) AS n_tokens FROM documents")
def clean_text_tokens(s, d):
    return table(s, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"), F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def pair_sql(extra):
    return f"""WITH {POSTS} SELECT a.id AS source, b.id AS target, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * exp(greatest(-88, -((epoch_us(b.ts) - epoch_us(a.ts)) / 3.6e9) / 6)), 6) AS force
FROM p a JOIN p b ON b.ts > a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 48 * 3.6e9 AND list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3 {extra}"""


@query(pair_sql(""))
def follow_candidates(s, d):
    return edges.follow(posts_v(s, d), 0.3).withColumn("force", F.round("force", 6))


@query(pair_sql("AND b.engagement > a.engagement"))
def influence_candidates(s, d):
    return edges.follow(posts_v(s, d), 0.3, influence=True).withColumn("force", F.round("force", 6))


@query(f"SELECT * FROM ({pair_sql('')}) WHERE force > 0.01")
def follow_above_force(s, d):
    return edges.follow(posts_v(s, d), 0.3, threshold=0.01).withColumn("force", F.round("force", 6))


@query(f"SELECT * FROM ({pair_sql('AND b.engagement > a.engagement')}) WHERE force > 0.01")
def influence_above_force(s, d):
    return edges.follow(posts_v(s, d), 0.3, influence=True, threshold=0.01).withColumn("force", F.round("force", 6))


BRIDGE = f"WITH {POSTS} SELECT a.id AS source, b.id AS target, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS force FROM p a JOIN p b ON a.id < b.id AND a.cluster_id <> b.cluster_id AND list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3"


@query(BRIDGE)
def bridge_candidates(s, d):
    return edges.bridges(posts_v(s, d), 0.3).withColumn("force", F.round("force", 6))


@query(f"WITH RECURSIVE e AS (SELECT source, target FROM ({BRIDGE})), b AS (SELECT source a, target b FROM e UNION SELECT target, source FROM e), c AS (SELECT a v, a r FROM b UNION SELECT b.b, c.r FROM c JOIN b ON b.a = c.v) SELECT v AS node, min(r) AS component FROM c GROUP BY v")
def components_min_label(s, d):
    return connected_components(edges.bridges(posts_v(s, d), 0.3), "source", "target")


@query(f"WITH {POSTS}, t AS (SELECT id, CASE " + " ".join(f"WHEN engagement < 1 + 9 * {r} THEN {i + 1}" for i, r in enumerate(text.RATIOS)) + " ELSE 6 END t FROM p) SELECT id, [1,2,3,4,5,5][t] AS cap_out, [1,1,1,1,3,0][t] AS cap_in FROM t")
def tier_quotas(s, d):
    return edges.tier_quotas(posts_v(s, d))


@query("SELECT conv_id, turn, concat(conv_id, '_', lag(turn) OVER w) AS parent, CAST(row_number() OVER w - 1 AS INT) AS depth, CASE WHEN row_number() OVER w = 1 THEN 'pioneer' ELSE 'offspring' END AS role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)".replace("concat(conv_id, '_', lag(turn) OVER w)", "lag(conv_id || '_' || turn) OVER w"))
def chain_links(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.concat_ws("_", "conv_id", "turn").alias("id"))
    return posts.chain_links(c, "conv_id", "turn", "id").drop("id")


@query("WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN value END v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) s FROM events), a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY v, s) r FROM e WHERE v IS NOT NULL), b AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s) r FROM e WHERE v IS NOT NULL) SELECT user_id, event_id, CAST(s AS INT) AS new_slot FROM a JOIN b USING (user_id, r) UNION ALL SELECT user_id, event_id, CAST(s AS INT) FROM e WHERE v IS NULL")
def chrono_reorder_pinned(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.expr("case when event_id % 5 <> 0 then value end").alias("v"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("s"))
    return posts.pinned_order(e, "user_id", "s", "v", "event_id")


SCORED = "q AS (SELECT embedding::DOUBLE[] e FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)), 6) score FROM embeddings)"


def scored(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    norm = lambda c: F.sqrt(text.dot(F.col(c), F.col(c)))
    return e.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("id"), "label", F.round(text.dot(F.col("embedding"), F.col("q")) / norm("embedding") / norm("q"), 6).alias("score"))


@query(f"WITH {SCORED} SELECT * FROM v")
def vector_search(s, d):
    return scored(s, d)


@query(f"WITH {SCORED} SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, id) = 1")
def seed_dedupe_by_component(s, d):
    return posts.best_per(scored(s, d), "label", [F.desc("score"), "id"])


@query(f"WITH {SCORED} SELECT * FROM v WHERE score >= 0.8 * greatest((SELECT max(score) FROM v WHERE id <> 0), 0) AND id <> 0")
def relevance_floor(s, d):
    return posts.relevance_floor(scored(s, d).where("id <> 0"))


@query(f"WITH {SCORED} SELECT id, label, -abs(score) - 1 AS score FROM v ORDER BY score DESC, id LIMIT 10")
def relevance_floor_fallback(s, d):
    """All scores negative: the ten best stay."""
    return posts.relevance_floor(scored(s, d).withColumn("score", -F.abs("score") - 1))


@query("SELECT label AS cluster_id, count(*) AS size, round(avg(embedding[1]::DOUBLE), 6) AS first_mean FROM embeddings GROUP BY label")
def cluster_stats(s, d):
    return table(s, d, "embeddings").groupBy(F.col("label").alias("cluster_id")).agg(F.count("*").alias("size"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("first_mean"))


@query("WITH v AS (SELECT label, embedding, len(embedding) n FROM embeddings WHERE label IS NOT NULL), x AS (SELECT label, unnest(range(0, n)) pos, unnest(embedding)::DOUBLE x FROM v), c AS (SELECT label, count(*) size FROM v GROUP BY 1) SELECT label AS cluster_id, size, CAST(pos AS INT) AS pos, round(avg(x), 6) AS mean FROM x JOIN c USING (label) GROUP BY ALL")
def cluster_mean_vectors(s, d):
    m = posts.mean_vectors(table(s, d, "embeddings").select(F.col("label").alias("cluster_id"), "embedding"))
    return m.select("cluster_id", "size", F.posexplode("mean_vector").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


@query("SELECT event_id, CASE WHEN value >= (SELECT quantile_cont(value, 0.95) FROM events) THEN 'mega' WHEN value >= (SELECT quantile_cont(value, 0.8) FROM events) THEN 'big' ELSE 'normal' END AS size FROM events")
def size_buckets(s, d):
    return posts.size_buckets(table(s, d, "events"), "value").select("event_id", "size")


from . import density, graphs, tables, texts  # noqa: E402, F401  registers their queries
