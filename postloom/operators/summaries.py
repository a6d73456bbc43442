"""Joins, counts, orders and rows that reports and viewers ask for."""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from . import posts as P
from .edges import place_of

#: Rows of labels that may be broadcast.
FEW = 100_000


def with_vectors(posts, vectors, id="id"):
    """posts with the columns of vectors, null where a post has none. A post whose id stands in several rows of vectors comes as often; null ids match nothing."""
    return posts.join(vectors, id, "left")


def labelled(rows, labels, key="cluster_id", few=FEW):
    """rows with the columns of labels by key, null where there is no label. Labels are broadcast if they are `few` at most, else joined by a shuffle."""
    small = labels.limit(few + 1).count() <= few
    return rows.join(F.broadcast(labels) if small else labels, key, "left")


def sizes(posts, cluster="cluster_id", id="id"):
    """cluster, size: its posts with an id; null is a cluster of its own."""
    return posts.groupBy(cluster).agg(F.count(id).alias("size"))


def extremes(sizes_, cluster="cluster_id", size="size"):
    """smallest, largest: the clusters of least and of most posts; ties go to the first name for the smallest, to the last for the largest. One row, of nulls for an empty table."""
    by = F.struct(size, cluster)
    return sizes_.agg(F.min_by(cluster, by).alias("smallest"), F.max_by(cluster, by).alias("largest"))


def value_counts(df, column, alias=None):
    """Each value of a column, null included, and n, its rows."""
    return df.groupBy(F.col(column).alias(alias or column)).agg(F.count("*").alias("n"))


def distinct_values(df, group, value):
    """group, n, first: the number of unlike non-null values in each group, and the first of them in order; counted in two steps, so that a hot group is spread by its values."""
    return df.select(group, value).distinct().groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("first"))


def fields(posts, **columns):
    """One row with a boolean for each name=column: whether any row has a value there; false for a column that is not there. Without names: has_time and has_engagement, which choose the plan of edges."""
    columns = columns or {"has_time": "timestamp", "has_engagement": "engagement"}
    return posts.agg(*[(F.count(c) > 0 if c in posts.columns else F.lit(False)).alias(n) for n, c in columns.items()])


def strongest(edges, kinds=None, order=("source", "target"), kind="type", force="force"):
    """What to order edges by: the place of their type in `kinds` if given (an unknown type is an error), falling force, then `order`, which settles ties."""
    return [*([place_of(kinds, F.col(kind))] if kinds else []), F.desc(force), *order]


def best_posts(posts, most=15, cluster="cluster_id", value="engagement", id="id"):
    """cluster, id, place, more: the `most` posts of greatest value of each cluster, ties to the smaller id, null values last; more is how many the cluster has besides. Of a hot cluster each task hands on `most` rows."""
    n = posts.groupBy(cluster).agg(F.count("*").alias("_n"))
    top = posts.select(cluster, id, value).withColumn("place", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc_nulls_last(value), id))).where(F.col("place") <= most)
    joined = top.join(n.withColumnRenamed(cluster, "_c"), F.col(cluster).eqNullSafe(F.col("_c")))
    return joined.select(cluster, id, "place", F.greatest(F.col("_n") - most, F.lit(0)).alias("more"))


def first_members(members, most=5, cut=200, group="hub", order="id", content="content"):
    """group, ids, previews: the first members of each group in order, with their texts cut; null texts are empty. Each task hands on `most` members of a group."""
    top = members.select(group, order, content).withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("_r") <= most)
    top = top.withColumn("_t", F.coalesce(text.truncate_hard(F.col(content), cut), F.lit("")))
    x = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", order, "_t"))).alias("x"))
    return x.select(group, F.col(f"x.{order}").alias("ids"), F.col("x._t").alias("previews"))


def context_counts(units_):
    """One row of counts over the units of a context (group_no, unit, id): groups, chains, pools, isolated, posts. A unit counts once for each group it is in."""
    of = lambda kind: F.count_if(F.startswith("unit", F.lit(f"{kind}:")))
    units = units_.groupBy("group_no", "unit").agg(F.count("*").alias("n"))
    return units.agg(F.count_distinct("group_no").alias("groups"), of("nova").alias("chains"), of("adept").alias("pools"), of("post").alias("isolated"), F.coalesce(F.sum("n"), F.lit(0)).alias("posts"))


def cluster_overview(posts, edges):
    """cluster_id, posts, chains, pools, depth, edges: of each cluster its posts, unlike chains and pools, the greatest depth in a chain, and edges with both ends in it. posts: id, cluster_id, subtopic_id, adept_pool_hub_id, nova_depth."""
    once = lambda c: posts.where(F.col(c).isNotNull()).select("cluster_id", c).distinct().groupBy("cluster_id").agg(F.count("*").alias("_n"))
    chains, pools = (once(c).withColumnRenamed("_n", n) for c, n in (("subtopic_id", "chains"), ("adept_pool_hub_id", "pools")))
    of = posts.where("cluster_id is not null").select("id", "cluster_id")
    inside = edges.join(of.toDF("source", "_a"), "source").join(of.toDF("target", "_b"), "target").where("_a = _b").groupBy(F.col("_a").alias("cluster_id")).agg(F.count("*").alias("edges"))
    out = posts.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("posts"), F.coalesce(F.max("nova_depth"), F.lit(0)).alias("depth"))
    for x in (chains, pools, inside):
        out = out.join(x, "cluster_id", "left")
    return out.na.fill(0, ["chains", "pools", "edges"]).select("cluster_id", "posts", "chains", "pools", "depth", "edges")


def edge_counts(edges):
    """type, n of edges, the commonest first, ties by type."""
    return value_counts(edges, "type").orderBy(F.desc("n"), "type")


def pool_counts(posts, pools_, spokes):
    """cluster_id, n_orphans, n_pools, n_edges: posts outside chains, pools and spokes of each cluster. posts: id, cluster_id, nova_role; pools_: cluster_id, hub, id; spokes: source, target."""
    orphans = posts.where("cluster_id is not null").groupBy("cluster_id").agg(F.count_if(F.col("nova_role").isNull()).alias("n_orphans"))
    n = pools_.select("cluster_id", "hub").distinct().groupBy("cluster_id").agg(F.count("*").alias("n_pools"))
    e = spokes.join(posts.select(F.col("id").alias("source"), "cluster_id"), "source").groupBy("cluster_id").agg(F.count("*").alias("n_edges"))
    return orphans.join(n, "cluster_id", "left").join(e, "cluster_id", "left").na.fill(0, ["n_pools", "n_edges"])


#: What a viewer's row says of chains and pools, by the column of posts it comes from; a missing column is empty text.
TOLD = {
    "cluster_label": "cluster_label", "adept_role": "adept_role", "nova_role": "nova_role", "subtopic_label": "subtopic_label", "nova_id": "subtopic_id", "adept_pool_label": "adept_pool_label",
    "adept_pool_hub_id": "adept_pool_hub_id", "pool_reasoning": "pool_reasoning", "nova_title": "nova_title", "nova_reasoning": "nova_reasoning", "nova_sentiment_arc": "nova_sentiment_arc", "source": "source",
}
#: Factors of a node's size, and its label, by size bucket; the grey of posts without a cluster.
SIZE_OF, LABEL_OF, GREY = {"mega": 1.9, "big": 1.3, "normal": 1.0}, {"mega": "MEGA", "big": "BIG"}, "#555555"
#: Shapes by role, a sphere for any other; colour and opacity of edges by type.
SHAPES = {"nova": "icosahedron", "pioneer": "octahedron", "hub": "diamond", "latest": "sphere", "member": "sphere", "offspring": "sphere", "orphan": "sphere_small"}
EDGE_COLOURS = {"nova": "#F4A536", "adept_spoke": "#E85D2C", "adept_graft": "#9B7FE0", "semantic_inter": "#3DDC97", "temporal": "#4C8DFF", "temporal_influence": "#F0349D"}
EDGE_OPACITY = {"nova": 0.35, "adept_spoke": 0.5, "adept_graft": 0.4, "semantic_inter": 0.9, "temporal": 0.7, "temporal_influence": 0.7}


def looked_up(table, c, other):
    """What a small dict says of a column's value, else `other`."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), c), F.lit(other))


def viewer_rows(posts, colours, mult=3.0, size_of=None):
    """A row a post with a place: id, x, y, z, color, size, label, content (300 characters), fullContent, timestamp, engagement, eng_cat, cluster_id, those of TOLD, adept_is_pioneer, geometry and depth.

    posts: id, x, y, z, engagement, cluster_id, content, timestamp and whatever of TOLD there is; colours: cluster_id, color. Posts that lack a coordinate are left out, but count for the size buckets and the largest engagement. A missing engagement is 0; a null text or name is empty; a cluster without a colour gets grey. The shape is that of a chain for a chain's first post, else that of the role in a pool.
    """
    posts = P.size_buckets(posts.withColumn("engagement", F.coalesce(P.numeric(F.col("engagement")), F.lit(0.0))), "engagement").withColumnRenamed("size", "eng_cat")
    top = posts.agg(F.greatest(F.lit(1.0), F.max("engagement")).alias("_top"))
    x = posts.where("x is not null and y is not null and z is not null").crossJoin(F.broadcast(top))  # one row
    x = labelled(x, colours.select("cluster_id", "color"))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in x.columns else F.lit("")
    role = F.when(said("nova_role") == "pioneer", "nova").otherwise(F.lower(said("adept_role")))
    size = F.round(2.5 * (0.6 + 0.4 * F.sqrt(1 + F.col("engagement") / F.col("_top"))) * looked_up(size_of or SIZE_OF, F.col("eng_cat"), 1.0) * mult, 2)
    told = {n: said(c).alias(n) for n, c in TOLD.items()}
    pioneer = F.coalesce(F.col("adept_is_pioneer").cast("boolean"), F.lit(False)) if "adept_is_pioneer" in x.columns else F.lit(False)
    depth = F.coalesce(F.col("nova_depth").cast("int"), F.lit(0)) if "nova_depth" in x.columns else F.lit(0)
    return x.select(
        F.col("id").cast("string").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.coalesce("color", F.lit(GREY)).alias("color"), size.alias("size"),
        looked_up(LABEL_OF, F.col("eng_cat"), "").alias("label"), F.substring(said("content"), 1, 300).alias("content"), said("content").alias("fullContent"), F.coalesce(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("timestamp"),
        "engagement", "eng_cat", said("cluster_id").alias("cluster_id"), *told.values(), pioneer.alias("adept_is_pioneer"), looked_up(SHAPES, role, "sphere").alias("geometry"), depth.alias("depth"),
    )


def viewer_links(edges):
    """source, target, color, opacity, force, group: edges as a viewer takes them. Another type than the six is grey and half opaque; a null force is 0."""
    kind = F.coalesce("type", F.lit(""))
    force = F.coalesce(F.col("force").cast("double"), F.lit(0.0)).alias("force")
    ends = [F.col(c).cast("string").alias(c) for c in ("source", "target")]
    return edges.select(*ends, looked_up(EDGE_COLOURS, kind, "#888").alias("color"), looked_up(EDGE_OPACITY, kind, 0.5).alias("opacity"), force, kind.alias("group"))
