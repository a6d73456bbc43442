"""Graphs of posts: components, neighbours, units, walks. Edges hold source and target; direction doesn't matter here."""
from pyspark.sql import Window as W, functions as F

from ..session import materialise
from .components import connected_components

#: Edge types that lie within a unit.
ABSORBED = ("nova", "adept_spoke")


def adjacency(edges, *cols):
    """Every edge in both directions: id, other."""
    e = edges.where("source is not null and target is not null")
    return e.select(F.col("source").alias("id"), F.col("target").alias("other"), *cols).union(e.select("target", "source", *cols))


def component_map(posts, edges):
    """id, component of every post; a post without edges is its own component. Edges to unknown posts don't count."""
    ids = posts.select("id").where("id is not null").distinct()
    e = edges.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")
    c = connected_components(e, "source", "target")
    return ids.join(c, ids.id == c.node, "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(components):
    return components.groupBy("component").agg(F.count("*").alias("n"))


def component_of(components, seeds):
    """All posts of the seeds' components: seed, id."""
    s = seeds.select(F.col("id").alias("seed")).join(components.select(F.col("id").alias("seed"), "component"), "seed")
    return s.join(components, "component").select("seed", "id")


def edge_components(edges, components):
    """Edges with the component of both ends; null for an unknown one."""
    c = components.select("id", "component")
    return edges.join(c.toDF("source", "source_component"), "source", "left").join(c.toDF("target", "target_component"), "target", "left")


def among(edges, ids, both=True):
    """Edges of which both ends, or one, are in ids."""
    i = ids.select("id").distinct()
    if both:
        return edges.join(i.toDF("source"), "source", "left_semi").join(i.toDF("target"), "target", "left_semi").select(*edges.columns)
    left = edges.join(i.toDF("source"), "source", "left_semi").select(*edges.columns)
    return left.unionByName(edges.join(i.toDF("source"), "source", "left_anti").join(i.toDF("target"), "target", "left_semi").select(*edges.columns))


def degrees(edges):
    return adjacency(edges).groupBy("id").agg(F.count("*").alias("degree"))


def units(posts, edges, spoke="adept_spoke"):
    """id, unit: the chain of a post, else its pool (hub and spokes), else the post itself."""
    hubs = posts.where(F.lower("adept_role") == "hub").select("id")
    spokes = edges.where(F.col("type") == spoke).join(hubs.toDF("source"), "source", "left_semi").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("hub"))
    spokes = hubs.select("id", F.col("id").alias("hub")).unionByName(spokes.join(hubs, "id", "left_anti"))
    chain = F.when(F.col("nova_role").isNotNull() & F.col("subtopic_id").isNotNull(), F.concat(F.lit("nova:"), F.col("subtopic_id").cast("string")))
    unit = F.coalesce(chain, F.concat(F.lit("adept:"), F.col("hub").cast("string")), F.concat(F.lit("post:"), F.col("id").cast("string")))
    return posts.join(spokes, "id", "left").select("id", unit.alias("unit"))


def unit_edges(edges, units_):
    """Edges between unlike units, once for a source, target and type."""
    u = units_.select("id", "unit")
    e = edges.where(~F.col("type").isin(*ABSORBED)).join(u.toDF("source", "source_unit"), "source").join(u.toDF("target", "target_unit"), "target").where("source_unit <> target_unit")
    return e.select("source", "target", "type", "source_unit", "target_unit").distinct()


def breadth_first(edges, seeds, limit=None):
    """id, depth, parent of all posts reachable from seeds, by rounds; of several parents the smallest. At most `limit` rounds."""
    around = materialise(adjacency(edges).distinct(), "around")
    found = front = materialise(seeds.select("id", F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["id"].dataType).alias("parent")).dropDuplicates(["id"]), "front")
    depth = 0
    while not front.isEmpty() and (limit is None or depth < limit):
        depth += 1
        step = front.select("id").join(around, "id").groupBy(F.col("other").alias("next")).agg(F.min("id").alias("parent"))
        front = step.join(found.select(F.col("id").alias("next")), "next", "left_anti").select(F.col("next").alias("id"), F.lit(depth).alias("depth"), "parent")
        front = materialise(front, f"front{depth}")
        found = materialise(found.unionByName(front), f"found{depth}")
    return found


#: What a tree follows first: a chain's edge along its direction and against it, a spoke from a pool's hub or named post, to one, and between others, and any other edge.
CHAIN, SPOKE, ANY = (0, 8), (12, 18, 22), 30


def ordered_tree(edges, posts, root, most=3000):
    """order, id, depth, parent of the first `most` posts of a breadth-first tree from root, in the order of the walk: a post's neighbours are taken by the place of the best edge to them (see CHAIN, SPOKE, ANY), then by falling degree, then by id as text; a post belongs to the first that reaches it.

    edges: source, target, type; posts: id, adept_role, adept_pool_label. A level is one job: what reaches the driver and is broadcast is at most `most` rows, whatever a post's degree. Edges of posts that are not in posts count; a root without edges is alone; repeated edges add to the degree.
    """
    both = edges.where("source is not null and target is not null")
    both = both.select(F.col("source").alias("id"), F.col("target").alias("other"), "type", F.lit(True).alias("along")).union(both.select("target", "source", "type", F.lit(False)))
    pool = (F.lower(F.coalesce("adept_role", F.lit(""))) == "hub") | (F.coalesce("adept_pool_label", F.lit("")) != "")
    pooled = posts.where(pool).select(F.col("id").alias("p")).distinct().withColumn("is", F.lit(True))
    x = both.join(pooled.toDF("id", "from_pool"), "id", "left").join(pooled.toDF("other", "to_pool"), "other", "left")
    place = F.when(F.col("type") == "nova", F.when(F.col("along"), CHAIN[0]).otherwise(CHAIN[1]))
    place = place.when(F.col("type") == "adept_spoke", F.when(F.col("from_pool"), SPOKE[0]).when(F.col("to_pool"), SPOKE[1]).otherwise(SPOKE[2])).otherwise(ANY)
    x = x.select("id", "other", place.alias("place")).groupBy("id", "other").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    degree = x.groupBy(F.col("id").alias("other")).agg(F.sum("n").alias("degree"))
    around = materialise(x.drop("n").join(degree, "other"), "around")
    spark, kind = edges.sparkSession, edges.schema["source"].dataType.simpleString()
    out = [(0, root, 0, None)]
    front = out
    while front and len(out) < most:
        level = F.broadcast(spark.createDataFrame([(r[0], r[1], r[2]) for r in front], f"at int, id {kind}, depth int"))
        seen = F.broadcast(spark.createDataFrame([(r[1],) for r in out], f"other {kind}"))
        step = around.join(level, "id").join(seen, "other", "left_anti")
        step = step.groupBy("other").agg(F.min(F.struct("at", "place", (-F.col("degree")).alias("d"), F.col("other").cast("string").alias("name"), "id", "depth")).alias("b"))
        step = step.orderBy("b.at", "b.place", "b.d", "b.name").limit(most - len(out)).collect()
        front = [(len(out) + k, r.other, r.b.depth + 1, r.b.id) for k, r in enumerate(step)]
        out = out + front
    return spark.createDataFrame(out, f"order int, id {kind}, depth int, parent {kind}")


def roots(components, edges, labels):
    """component, root: the node of highest degree, then of smallest label, then of smallest id."""
    x = components.join(degrees(edges), "id", "left").join(labels.select("id", "label"), "id", "left")
    best = F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), F.coalesce("label", F.lit("")).alias("label"), "id")
    return x.groupBy("component").agg(F.min(best).alias("b")).select("component", F.col("b.id").alias("root"))


def walk(units_, edges, root):
    """(steps, extra): steps are (unit, index of the edge by which it was reached, or None) of one component, from `root`, a unit before those only reached through it; extra are the indices of the other edges.

    A unit gets its step when it is first seen from a neighbour, not when it is walked on from; siblings are seen from the latest to the earliest by (time, source), and the walk goes on from the one seen last. Units that are not reached stand at the end, in the order given. edges: list of (source_unit, target_unit, time, source).
    """
    around = {}
    for k, (a, b, t, s) in enumerate(edges):
        around.setdefault(a, []).append((t or "", s, k, b))
        around.setdefault(b, []).append((t or "", s, k, a))
    steps, todo = {root: None}, [root]
    while todo:
        for _, _, k, other in sorted(around.get(todo.pop(), []), key=lambda x: x[:3], reverse=True):
            if other not in steps:
                steps[other] = k
                todo.append(other)
    used = set(steps.values())
    out = [*steps.items(), *[(u, None) for u in units_ if u not in steps]]
    return out, [k for k in range(len(edges)) if k not in used]


def walks(units_, edges, seeds):
    """component, step, unit, source_unit, target_unit: the walk of every component from its seed's unit, each unit with the edge by which it was reached (null for the first, and for those not reached); edges not walked follow with a null step and unit.

    units_: component, unit; edges: component, source_unit, target_unit, time, source; seeds: component, unit. One task a component; a component without a seed starts at its smallest unit; repeated units count once.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    rows = units_.select("component", "unit").distinct().withColumn("kind", F.lit(0)).unionByName(seeds.select("component", "unit").withColumn("kind", F.lit(1)))
    rows = rows.select("component", "unit", "kind", *none("to", "time", "source"))
    rows = rows.unionByName(edges.select("component", F.col("source_unit").alias("unit"), F.lit(2).alias("kind"), F.col("target_unit").alias("to"), text("time"), text("source")))
    kind = rows.schema["component"].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        names = sorted(pdf[pdf.kind == 0].unit)
        start = pdf[pdf.kind == 1].unit
        e = pdf[pdf.kind == 2].sort_values(["time", "source", "unit", "to"])
        e = list(zip(e.unit, e.to, e.time, e.source))
        steps, extra = walk(names, e, start.min() if len(start) else names[0])
        out = [(n, u, *((None, None) if k is None else e[k][:2])) for n, (u, k) in enumerate(steps)] + [(None, None, *e[k][:2]) for k in extra]
        out = pd.DataFrame(out, columns=["step", "unit", "source_unit", "target_unit"])
        return out.assign(component=pdf.component.iloc[0], step=out.step.astype("Int32"))[["component", "step", "unit", "source_unit", "target_unit"]]

    return rows.groupBy("component").applyInPandas(run, f"component {kind}, step int, unit string, source_unit string, target_unit string")


def entities(posts, units_):
    """unit, first time, posts: what a unit is for ordering two of them."""
    return posts.join(units_, "id").groupBy("unit").agg(F.min("timestamp").alias("first"), F.count("*").alias("n"))


def handles(steps):
    """Handles E1, E2, ... of units in the order of groups, then of their walk."""
    return steps.withColumn("handle", F.concat(F.lit("E"), F.row_number().over(W.orderBy("group_no", "step")).cast("string")))
