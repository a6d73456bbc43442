"""Queries of this subpackage: each applies an operator to its whole table."""
import public_tokenizers as P
from pyspark.sql import functions as F

from ..session import table
from . import bpe, changes, divergence, jaccard, licences, likelihood, packing, quality, search, toxicity, vectors, words


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_byte_bpe(spark, sf_dir, vocabulary=P.path("byte_bpe_multi_50k.tiktoken"), pattern=P.PATTERN):
    out = bpe.decode(bpe.encode(documents(spark, sf_dir), vocabulary, pattern), vocabulary)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_topk_search(spark, sf_dir):
    return search.topk(documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


def op3_quality(spark, sf_dir):
    return quality.resample(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard.classes_of(documents(spark, sf_dir))


def op5_licence_scan(spark, sf_dir):
    return licences.scan(documents(spark, sf_dir))


def op6_nearest_neighbours(spark, sf_dir):
    return vectors.search(table(spark, sf_dir, "embeddings"))


def op7_token_matrices(spark, sf_dir, tokenizer=P.path("word_bpe_49k.json")):
    out = packing.matrices(documents(spark, sf_dir), tokenizer)
    return out.select("sequence_id", "doc_ids", "starts", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("position_ids_crc32"))


def op8_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = toxicity.chain_probabilities(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *[F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(toxicity.CHAIN)], "toxic")


def op9_best_fit_packing(spark, sf_dir, tokenizer=P.path("word_bpe_49k.json")):
    return packing.pack(documents(spark, sf_dir), tokenizer).drop("ids")


def op10_masked_likelihood(spark, sf_dir):
    return likelihood.score(documents(spark, sf_dir))


def op11_word_table(spark, sf_dir, tokenizer=P.path("word_bpe_49k.json")):
    out = words.round_trip(documents(spark, sf_dir), tokenizer)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_change_applier(spark, sf_dir):
    out = changes.apply_changes(table(spark, sf_dir, "client_changes"))
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long").alias("cents")
    return out.select("change_id", "client_id", "status", "batch", "missed", "city", cents, "current")


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_topk_search, op3_quality, op4_jaccard_join, op5_licence_scan, op6_nearest_neighbours, op7_token_matrices, op8_toxicity, op9_best_fit_packing, op10_masked_likelihood, op11_word_table, op12_source_divergence, op13_change_applier)}
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op2_topk_search": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) t FROM documents),
p AS (SELECT doc_id, t, count(*) tf FROM w GROUP BY ALL), l AS (SELECT doc_id, sum(tf) n FROM p GROUP BY ALL),
s AS (SELECT (SELECT count(*) FROM documents) c, (SELECT sum(n) FROM l) / (SELECT count(*) FROM documents) a), f AS (SELECT t, count(*) df FROM p GROUP BY t),
r AS (SELECT q.doc_id query_id, p.doc_id, sum(ln(1 + (c - df + 0.5) / (df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * n / a))) score
FROM p q JOIN p ON p.t = q.t JOIN f ON f.t = q.t JOIN l ON l.doc_id = p.doc_id, s WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank, doc_id, round(score, 6) AS score FROM r QUALIFY rank <= 10""",
    "op12_source_divergence": r"""WITH d AS (SELECT row_number() OVER () r, coalesce(lang, '') lang, coalesce(source, '') source,
regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
o AS (SELECT r, lang, source, unnest(w) term FROM d), k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) n FROM o JOIN k USING (lang, term) GROUP BY ALL), v AS (SELECT lang, count(*) v FROM k GROUP BY 1),
g AS (SELECT lang, source, coalesce(n, 0) n, coalesce(v, 0) v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) n FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) p FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, sum(n) t FROM c GROUP BY lang),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (max(t) + max(v)) q FROM c JOIN v USING (lang) JOIN t USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0) f FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // q FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(f AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, item) AS INT) AS rank FROM u QUALIFY part = 'pair' OR rank <= 200""",
    "op4_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') x FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) = 0 OR x IS NULL THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')] ELSE [array_to_string(x[i:i+4], ' ') FOR i IN range(1, len(x) - 3)] END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1), i AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
c AS (SELECT doc_id v, doc_id r FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(c.r) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.v = d.doc_id GROUP BY d.doc_id, n.n""",
}
