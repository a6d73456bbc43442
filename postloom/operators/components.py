"""Connected components by contraction under random orders."""
from pyspark.sql import functions as F

from ..session import materialise


def connected_components(edges, a="a", b="b"):
    """(node, component) of every node on an edge; component is the smallest node reachable. Nulls and self-loops are ignored, repeated edges count once, and no edges give no rows.

    In each round a node joins the one among itself and its neighbours that comes first in an order drawn anew by hash, and edges are contracted. About half of the nodes of a path, in any order of ids, go in a round, so rounds are logarithmic. What is written shrinks with the rounds; nodes get their component once, from the last round's map back to the first.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = materialise(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while not e.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), F.col(c)).alias("h"), F.col(c).alias("p"))  # noqa: B023, E731
        first = e.union(e.select("b", "a")).groupBy("a").agg(F.min(place("b")).alias("best"))
        up = materialise(first.select(F.col("a").alias("v"), F.least(place("a"), "best")["p"].alias("p")), "joined")
        maps.append(up)
        pa, pb = up.select(F.col("v").alias("a"), F.col("p").alias("pa")), up.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        e = e.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        e = materialise(e, "edges")
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps.pop().select("v", F.col("p").alias("root"))
    while maps:
        last = found.select(F.col("v").alias("p"), "root")
        found = materialise(maps.pop().join(last, "p", "left").select("v", F.coalesce("root", "p").alias("root")), "roots")
    least = found.groupBy("root").agg(F.min("v").alias("component"))
    return found.join(least, "root").select(F.col("v").alias("node"), "component")
