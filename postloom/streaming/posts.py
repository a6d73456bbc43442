"""Streams of posts: beyond the batch operators, but with their meaning. Each takes and gives a DataFrame, streaming or not."""
from pyspark.sql import functions as F

from ..functions import text


def new_posts(posts, late="2 days"):
    """Posts once each by id, or by the content's hash where that is missing; repeats are known as long as the watermark lasts."""
    blank = F.trim(F.coalesce(F.col("id").cast("string"), F.lit(""))) == ""
    x = posts.withColumn("id", F.when(blank, text.content_id(F.col("content"))).otherwise(F.col("id").cast("string"))).withWatermark("timestamp", late)
    return x.dropDuplicatesWithinWatermark(["id"]) if x.isStreaming else x.dropDuplicates(["id"])


def follow(posts, least, tau=6.0, hours=48):
    """Follow edges as posts arrive: a stream joined with itself on time, both sides forgotten once no later post can reach them. An equality on time buckets carries the join."""
    t = F.unix_micros("timestamp") / F.lit(3.6e9)
    p = posts.where("id is not null and embedding is not null").select("id", "timestamp", F.col("embedding").cast("array<double>").alias("v"), t.alias("t"))
    a = p.select(F.col("id").alias("source"), F.col("timestamp").alias("t0"), F.col("v").alias("x"), F.col("t").alias("ta"), F.explode(F.array(F.floor(F.col("t") / hours), F.floor(F.col("t") / hours) + 1)).alias("k0"))
    b = p.select(F.col("id").alias("target"), F.col("timestamp").alias("t1"), F.col("v").alias("y"), F.col("t").alias("tb"), F.floor(F.col("t") / hours).alias("k1"))
    a, b = a.withWatermark("t0", f"{hours} hours"), b.withWatermark("t1", f"{hours} hours")
    x = a.join(b, F.expr(f"k0 = k1 and t1 > t0 and t1 <= t0 + interval {hours} hours")).withColumn("cos", text.dot(F.col("x"), F.col("y"))).where(F.col("cos") > least)
    return x.select("source", "target", (F.col("cos") * F.exp(F.greatest(F.lit(-88.0), -(F.col("tb") - F.col("ta")) / tau))).alias("force"))


def hourly(posts, late="1 hour", width="1 hour"):
    """Posts and mean engagement of each cluster in windows of time; what comes later than the watermark is left out."""
    return posts.withWatermark("timestamp", late).groupBy(F.window("timestamp", width).alias("w"), "cluster_id").agg(F.count("*").alias("n"), F.avg("engagement").alias("engagement")).select(F.col("w.start").alias("start"), "cluster_id", "n", "engagement")


def watch(spark, folder, schema="run_id string, status string, stage string"):
    """A stream of run manifests as they are written."""
    return spark.readStream.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "run.json").json(folder)


def into(stream, existing, make, sink, checkpoint):
    """Edges of each batch of new posts with all before it, by `make(new, existing)`; existing() gives the table so far and sink(new, edges) stores both."""

    def one(batch, _):
        batch = batch.persist()
        sink(batch, make(batch, existing()))
        batch.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
