"""Where queries and their SQL are registered."""
from pyspark.sql import functions as F

from ..session import table

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'http\S+', ' ', 'g'), '@[\p{L}\p{N}_]+', ' ', 'g'), '#([\p{L}\p{N}_]+)', '\1', 'g'), '[^\p{L}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
POSTS = "p AS (SELECT vec_id id, embedding, label cluster_id, ts, value engagement FROM embeddings JOIN events ON vec_id = event_id)"


def posts_v(s, d):
    """Posts: embeddings with the events of their number."""
    e, v = table(s, d, "embeddings"), table(s, d, "events")
    return e.join(v, e.vec_id == v.event_id).select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster_id"), F.col("ts").alias("timestamp"), F.col("value").alias("engagement"))


def docs_v(s, d):
    """Documents as posts of a file."""
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("file"), F.col("n_chars").alias("engagement"), F.col("lang").alias("cluster"))
