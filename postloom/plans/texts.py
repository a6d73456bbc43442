"""Queries of text, time and vector functions."""
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table
from ..sources import files
from .registry import query


def docs(s, d):
    return table(s, d, "documents")


HEAD = "substr(text, 1, 200)"


@query(f"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(CASE WHEN length({HEAD}) - strpos(reverse({HEAD}), ' ') > 0 AND strpos({HEAD}, ' ') > 0 THEN substr({HEAD}, 1, length({HEAD}) - strpos(reverse({HEAD}), ' ')) ELSE {HEAD} END, '\\s+$', '') || '…' END AS short FROM documents""")
def truncate_words(s, d):
    return docs(s, d).select("doc_id", T.truncate_words(F.col("text"), 200).alias("short"))


@query("SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 39) || '…' END AS label, substr(regexp_replace(text, '[|\\r\\n]', ' ', 'g'), 1, 160) AS snippet FROM documents")
def truncate_hard(s, d):
    return docs(s, d).select("doc_id", T.truncate_hard(F.col("text"), 40).alias("label"), T.snippet(F.col("text")).alias("snippet"))


@query("SELECT page_id, translate(substr(html, 1, 500), '<>', '＜＞') AS wide, translate(substr(html, 1, 500), '<>', '‹›') AS narrow, trim(regexp_replace(substr(html, 1, 500), '\\s+', ' ', 'g')) AS line FROM pages")
def defused_lines(s, d):
    h = F.substring("html", 1, 500)
    return table(s, d, "pages").select("page_id", T.defuse(h).alias("wide"), T.defuse(h, False).alias("narrow"), T.single_line(h).alias("line"))


@query("SELECT doc_id, CASE WHEN s = '' THEN 'query' ELSE s END AS slug, replace(regexp_replace(lower(trim(substr(text, 1, 60))), '[^\\p{L}\\p{N}_ -]', '', 'g'), ' ', '-') AS heading FROM (SELECT doc_id, text, substr(regexp_replace(regexp_replace(lower(substr(text, 1, 60)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 40) s FROM documents)")
def slugs(s, d):
    h = F.substring("text", 1, 60)
    return docs(s, d).select("doc_id", T.slug(h).alias("slug"), T.heading_slug(h).alias("heading"))


SAID = "'see [E' || turn || '] and [e' || conv_id || ', id p' || conv_id || '_1] not [X1] ' || substr(text, 1, 20)"


@query(f"WITH v AS (SELECT conv_id, turn, {SAID} t FROM conversations) SELECT conv_id, turn, upper(unnest(regexp_extract_all(t, '(?i)\\[(E[0-9]+)(?:, *id +([\\w-]+))?\\]', 1))) AS handle, coalesce(unnest(regexp_extract_all(t, '(?i)\\[(E[0-9]+)(?:, *id +([\\w-]+))?\\]', 2)), '') AS id FROM v")
def citations(s, d):
    c = table(s, d, "conversations").withColumn("t", F.expr(SAID.replace("turn ||", "cast(turn as string) ||")))
    return c.select("conv_id", "turn", F.explode(T.citations(F.col("t"))).alias("c")).select("conv_id", "turn", "c.handle", "c.id")


@query(r"""WITH v AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'So:' || chr(10) || 'Topic: "' || regexp_extract(text, '^\S+(\s+\S+)?') || '"' WHEN 1 THEN 'topic: ' || text WHEN 2 THEN 'topic: N/A - insufficient data on ' || regexp_extract(text, '^\S+') ELSE text END t FROM conversations),
w AS (SELECT conv_id, turn, trim(regexp_replace(regexp_extract(t, '(?i)topic:\s*([^\n]+)', 1), '^[\s"'']+|[\s"'']+$', '', 'g')) l FROM v)
SELECT conv_id, turn, CASE WHEN l <> '' AND len(regexp_split_to_array(l, '\s+')) <= 8 AND NOT regexp_matches(l, '(?i)\b(n/?a|insufficient|unable to|cannot determine|not enough (data|information)|no (clear |sufficient )?(topic|data|information)|unclear)\b') THEN l END AS label FROM w""")
def analyst_labels(s, d):
    said = F.expr(r"""case turn % 4 when 0 then concat('So:\n', 'Topic: "', regexp_extract(text, r'^\S+(\s+\S+)?', 0), '"') when 1 then concat('topic: ', text) when 2 then concat('topic: N/A - insufficient data on ', regexp_extract(text, r'^\S+', 0)) else text end""")
    return table(s, d, "conversations").select("conv_id", "turn", T.label_of(said).alias("label"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'so: ' || props || ' done' ELSE 'none' END t FROM events) SELECT event_id, CASE WHEN event_id % 3 < 2 THEN regexp_extract(t, '(?s)\\{.*\\}', 0) END AS found, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract(regexp_extract(t, '(?s)\\{.*\\}', 0), '$.k') AS BIGINT) ELSE -1 END AS k FROM v""")
def outer_json(s, d):
    said = F.expr("case event_id % 3 when 0 then concat('```json\n', props, '\n```') when 1 then concat('so: ', props, ' done') else 'none' end")
    return table(s, d, "events").select("event_id", T.outer_json(said).alias("found")).withColumn("k", F.coalesce(F.get_json_object("found", "$.k").cast("long"), F.lit(-1)))


@query("""WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['what of ' || user_id, 'and why'] WHEN 1 THEN ['q' || event_id] WHEN 2 THEN ['q' || event_id] ELSE ['q' || event_id] END q FROM events) SELECT event_id, CAST(generate_subscripts(q, 1) AS INT) AS place, unnest(q) AS question FROM v""")
def sub_questions(s, d):
    said = F.expr("""case event_id % 4 when 0 then concat('{"sub_queries": ["what of ', user_id, '", " and why ", ""]}') when 1 then 'no json' when 2 then '{"sub_queries": []}' else '{"other": 1}' end""")
    q = T.sub_questions(said, F.concat(F.lit("q"), F.col("event_id").cast("string")))
    return table(s, d, "events").select("event_id", F.posexplode(q).alias("place", "question")).withColumn("place", F.col("place") + 1)


@query("SELECT doc_id, regexp_replace(text || chr(7) || 'x' || chr(13) || chr(9) || chr(10), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g') AS clean, 'Instruct: find' || chr(10) || 'Query:' || text AS prompt, substr(sha256('m:' || text), 1, 16) AS key FROM documents")
def embedding_inputs(s, d):
    t = F.concat("text", F.lit("\x07x\r\t\n"))
    return docs(s, d).select("doc_id", T.sanitise(t).alias("clean"), T.instruct("find", F.col("text")).alias("prompt"), T.cache_key("m", F.col("text")).alias("key"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%dT%H:%M') AS minute, left(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 19) AS second, strftime(ts, '%b %-d, %Y') AS day FROM events")
def time_formats(s, d):
    ts = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    return table(s, d, "events").select("event_id", T.iso(ts).alias("iso"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("minute"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("second"), F.date_format("ts", "MMM d, yyyy").alias("day"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch(date_trunc('second', ts)) WHEN 1 THEN epoch(date_trunc('second', ts)) WHEN 2 THEN epoch(date_trunc('second', ts)) - 7200 WHEN 3 THEN epoch(date_trunc('day', ts)) WHEN 4 THEN epoch(date_trunc('minute', ts)) ELSE -1 END::BIGINT AS seconds FROM events""")
def parsed_times(s, d):
    ts = F.col("ts").cast("timestamp")
    said = F.when(F.expr("event_id % 6 = 0"), F.floor(F.unix_micros(ts) / 1_000_000).cast("string")).when(F.expr("event_id % 6 = 1"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.expr("event_id % 6 = 2"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss'+02:00'"))
    said = said.when(F.expr("event_id % 6 = 3"), F.date_format(ts, "MM/dd/yyyy")).when(F.expr("event_id % 6 = 4"), F.date_format(ts, "yyyy/MM/dd HH:mm")).otherwise("soon")
    return table(s, d, "events").select("event_id", F.coalesce(F.unix_seconds(T.parse_time(said)), F.lit(-1)).alias("seconds"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 3 THEN 1.5 ELSE -1 END::DOUBLE AS number FROM events")
def safe_numbers(s, d):
    said = F.expr("case event_id % 4 when 0 then cast(value as string) when 1 then 'NaN' when 2 then 'Infinity' else '1.5' end")
    return table(s, d, "events").select("event_id", T.number(said, -1).alias("number"))


@query("SELECT vec_id, CASE WHEN label > 0 THEN printf('cluster_%04d', (label - 1) * 3000) END AS cluster FROM embeddings")
def cluster_names(s, d):
    return table(s, d, "embeddings").select("vec_id", T.cluster_name(F.expr("if(label = 0, -1, cast((label - 1) * 3000 as int))")).alias("cluster"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) e FROM embeddings) SELECT vec_id, CAST(generate_subscripts(e, 1) - 1 AS INT) AS pos, round(unnest(e) / greatest(sqrt(list_inner_product(e, e)), 1e-10), 6) AS x FROM v")
def truncated_vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", F.posexplode(T.truncated(F.col("embedding"), 16)).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("WITH v AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: CASE WHEN vec_id % 5 = 0 THEN 0 ELSE x::DOUBLE * 3 END) e FROM embeddings) SELECT vec_id, CAST(generate_subscripts(e, 1) - 1 AS INT) AS pos, round(unnest(e) / CASE WHEN list_inner_product(e, e) = 0 THEN 1 ELSE sqrt(list_inner_product(e, e)) END, 6) + 0 AS x FROM v")
def unit_vectors(s, d):
    e = table(s, d, "embeddings").withColumn("e", F.transform(F.slice("embedding", 1, 3), lambda x: F.when(F.col("vec_id") % 5 == 0, 0.0).otherwise(x.cast("double") * 3)))
    return e.select("vec_id", F.posexplode(T.unit(F.col("e"))).alias("pos", "x")).withColumn("x", F.round("x", 6) + 0)


@query("""SELECT conv_id, turn, CASE WHEN b = '' THEN t WHEN t = '' THEN b ELSE t || chr(10) || chr(10) || b END AS content FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN '' ELSE '' END t, CASE turn % 3 WHEN 1 THEN trim(text) WHEN 0 THEN trim(text) ELSE '' END b FROM conversations)""")
def canonical_content(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.expr("case turn % 3 when 0 then concat(' ', role) when 1 then null else '  ' end").alias("Headline"), F.expr("if(turn % 3 = 2, null, text)").alias("SelfText"))
    return files.canonical(c).select("conv_id", "turn", "content")


@query("SELECT event_id::VARCHAR AS id, user_id, value::DOUBLE AS engagement, epoch(date_trunc('second', ts))::BIGINT AS seconds, event_type AS content FROM events")
def mapped_fields(s, d):
    e = table(s, d, "events").select("event_id", "user_id", F.col("value").alias("Score"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("Created_At"), F.col("event_type").alias("Message"))
    x = files.canonical(files.mapped(e, {"id": "event_id", "other": "missing"}))
    return x.select("id", "user_id", "engagement", F.unix_seconds("timestamp").alias("seconds"), "content")


@query("SELECT doc_id FROM documents WHERE strip_accents(lower(substr(text, 1, 300))) LIKE '%ee%'")
def plain_label_filter(s, d):
    return docs(s, d).where(T.plain(F.substring("text", 1, 300)).contains("ee")).select("doc_id")


@query("SELECT doc_id, round(2.5 * (0.6 + 0.4 * sqrt(1 + n_chars / (SELECT max(n_chars) FROM documents))) * 3, 6) AS size FROM documents")
def node_sizes(s, d):
    x = docs(s, d)
    top = x.agg(F.max("n_chars").alias("top"))
    return x.crossJoin(F.broadcast(top)).select("doc_id", F.round(T.node_size(F.col("n_chars"), F.col("top"), 3.0), 6).alias("size"))
