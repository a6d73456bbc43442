"""Projection by three kinds of pairs (PaCMAP, Wang et al. 2021): near, middling and far ones, laid out in three phases by Adam."""
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialise
from .blocks import BLOCK, vectors
from .density import nearest
from .layout import scaled
from .manifold import parts_of, principal

#: Published values: more neighbours that are looked at than taken; places of those whose mean distance is a row's scale; draws for a middling pair.
MORE, SCALE, DRAWS = 50, (4, 6), 6
#: Published values: iterations of the phases, and the weights of near, middling and far pairs in them, middling ones at the phase's begin and end.
PHASES = ((100, 2, (1000, 3), 1), (100, 3, (3, 3), 1), (250, 1, (0, 0), 1))
#: Published values: what a pair's distance is held against, by kind.
AGAINST = (10, 10_000, 1)
NEAR, MIDDLING, FARTHER = 0, 1, 2


def numbered(p, parts=None):
    """p with num, from 0, in order of id: rows are dealt by range, and a part's numbers begin after those of the parts before."""
    parts = parts or int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = materialise(p.repartitionByRange(parts, "id").withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = sorted((r["_part"], r["count"]) for r in p.groupBy("_part").count().collect())  # a row a part
    begins, at = [], 0
    for part, n in sizes:
        begins.append((part, at))
        at += n
    begins = p.sparkSession.createDataFrame(begins, "_part int, _begin long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy("id")) - 1
    return p.withColumn("_local", local).join(F.broadcast(begins), "_part").withColumn("num", F.col("_begin") + F.col("_local")).drop("_part", "_local", "_begin"), at


def near_pairs(rows, k, metric="euclidean", block=BLOCK):
    """i, j: of the k + 50 nearest others of each row, the k of least d^2 / (s_i s_j), where s is a row's mean distance to its 4th to 6th nearest; ties to the smaller id."""
    found = materialise(nearest(rows, k + MORE, "id", "v", metric, block).select("id", "near"), "near")
    lo, hi = SCALE
    at = F.expr(f"transform(slice(near, {lo}, {hi - lo + 1}), x -> x.d)")
    last = F.when(F.size("near") >= lo, at).otherwise(F.expr("transform(near, x -> x.d)"))
    s = materialise(found.withColumn("a", last).select("id", F.greatest(F.expr("aggregate(a, 0d, (t, x) -> t + x)") / F.greatest(F.size("a"), F.lit(1)), F.lit(1e-10)).alias("s")), "scales")
    e = found.select(F.col("id").alias("i"), F.explode("near").alias("n")).select("i", F.col("n.other").alias("j"), "n.d")
    e = e.join(s.toDF("i", "si"), "i").join(s.toDF("j", "sj"), "j").withColumn("q", F.round(F.col("d") * F.col("d") / F.col("si") / F.col("sj"), 12))
    e = e.groupBy("i").agg(F.slice(F.array_sort(F.collect_list(F.struct("q", "j"))), 1, k).alias("x"))
    return e.select("i", F.explode("x.j").alias("j"))


def drawn(rows, n, slots, seed):
    """i, slot, num: for each row the numbers drawn by hash for its slots, all below n."""
    d = rows.select(F.col("id").alias("i"), F.col("num").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    return d.withColumn("num", F.pmod(F.xxhash64(F.lit(seed), "i", "slot"), F.lit(n))).where("num <> own").drop("own")


def sampled_pairs(rows, near, n, middling, farther, seed=42, metric="euclidean"):
    """i, j, kind of the middling and the far pairs. rows: id, v, num. For each middling one six rows are drawn and the second nearest taken; far ones are drawn among those that are not near. A draw that hits the row itself, or what it has as such a pair, is lost; so is a middling pair with fewer than two draws left."""
    to = rows.select("num", F.col("id").alias("j"), F.col("v").alias("y"))
    d = drawn(rows, n, middling * DRAWS, seed).join(to, "num").join(rows.select(F.col("id").alias("i"), F.col("v").alias("x")), "i")
    if metric == "cosine":
        dot = F.expr("aggregate(zip_with(x, y, (a, b) -> a * b), 0d, (s, t) -> s + t)")
        norm = lambda c: F.sqrt(F.expr(f"aggregate({c}, 0d, (s, t) -> s + t * t)"))
        far = 1 - dot / F.greatest(norm("x") * norm("y"), F.lit(1e-300))
    else:
        far = F.expr("aggregate(zip_with(x, y, (a, b) -> (a - b) * (a - b)), 0d, (s, t) -> s + t)")
    d = d.where(F.size("x") == F.size("y")).select("i", F.expr(f"slot div {DRAWS}").alias("slot"), "j", F.round(far, 12).alias("d")).distinct()
    second = d.groupBy("i", "slot").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("x")).where("size(x) > 1").select("i", F.expr("x[1].j").alias("j"))
    far = drawn(rows, n, farther, seed + 1).join(to.select("num", "j"), "num").select("i", "j").distinct().join(near, ["i", "j"], "left_anti")
    kind = lambda x, k: x.select("i", "j", F.lit(k).alias("kind"))
    return kind(second.distinct(), MIDDLING).union(kind(far, FARTHER))


def weights(turn):
    """(near, middling, far) weights of an iteration."""
    for n, near, (begin, end), far in PHASES:
        if turn < n:
            return near, begin + (end - begin) * turn / n, far
        turn -= n
    return near, end, far


def stepped(state, i, j, at, kind, begin, turns, rate):
    """State (y, m, v: positions and Adam's means) after so many iterations. i, j: places of a pair's ends, j -1 where it is not here and stays at `at`. A near or middling pair costs w d / (c + d), a far one w / (1 + d), d = 1 + squared distance; the gradient is on i, as each pair is there in both directions."""
    y, m, v = (x.copy() for x in state)
    against = np.array(AGAINST, float)[kind]
    for turn in range(begin, begin + turns):
        w = np.array(weights(turn), float)[kind]
        d = y[i] - np.where((j >= 0)[:, None], y[j], at)
        square = 1 + (d * d).sum(1)
        slope = np.where(kind == FARTHER, -1.0, against) * 2 * w / (against + square) ** 2
        grad = np.zeros_like(y)
        np.add.at(grad, i, slope[:, None] * d)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        y = y - rate * np.sqrt(1 - 0.999 ** (turn + 1)) / (1 - 0.9 ** (turn + 1)) * m / (np.sqrt(v) + 1e-7)
    return y, m, v


def pairmap(df, dims=3, k=15, middling=0.5, farther=2.0, id="id", vector="embedding", metric="euclidean", turns=30, part=20_000, block=BLOCK, seed=42, rate=1.0):
    """id, low: positions in `dims` dimensions, begun at a hundredth of the principal components.

    Pairs are fixed at the start. The 450 iterations go in rounds of `turns`, each round cut into parts of bounded size by a projection of its own; a task moves one part's vertices, with the others at the positions of the last round, and Adam's means go from round to round. With one part this is the published descent. Everything is drawn by hash of ids and the seed, so the result depends on the table alone. Rows that cannot take part (see nearest) are left out; an empty table gives no rows; a row alone stays.
    """
    rows = materialise(vectors(df, id, vector), "vectors")
    if rows.isEmpty():
        return rows.select("id", F.col("v").alias("low"))
    rows, n = numbered(rows)
    rows = materialise(rows, "numbered")
    near = materialise(near_pairs(rows.select("id", "v"), k, metric, block), "near_pairs")
    pairs = near.select("i", "j", F.lit(NEAR).alias("kind")).union(sampled_pairs(rows, near, n, round(k * middling), round(k * farther), seed, metric))
    pairs = materialise(pairs.union(pairs.select("j", "i", "kind")), "pairs")
    kind = rows.schema["id"].dataType.simpleString()
    zero = F.expr("transform(y, x -> 0d)")
    y = principal(rows, dims, "id", "v").withColumn("y", F.expr("transform(y, x -> x / 100)"))
    state = materialise(y.withColumn("m", zero).withColumn("v", zero), "state")
    whole = sum(p[0] for p in PHASES)
    for begin in range(0, whole, turns):
        steps = min(turns, whole - begin)
        placed = materialise(parts_of(state.select("id", "y"), begin, seed, dims, part).select("id", "part").join(state, "id"), "placed")
        e = pairs.join(placed.select("id", "part").toDF("i", "home"), "i").join(placed.select("id", "y").toDF("j", "at"), "j").select("home", "i", "j", "at", "kind")

        def move(left, right):
            left, right = left.sort_values("id"), right.sort_values(["i", "j", "kind"])
            place = {x: n for n, x in enumerate(left.id)}
            held = tuple(np.stack(left[c].to_numpy()).astype(float) for c in ("y", "m", "v"))
            if len(right):
                ends = right.i.map(place).to_numpy(), right.j.map(place).fillna(-1).astype(int).to_numpy()
                held = stepped(held, *ends, np.stack(right["at"].to_numpy()).astype(float), right.kind.to_numpy(), begin, steps, rate)  # noqa: B023
            return pd.DataFrame({"id": left.id, **{c: list(x) for c, x in zip(("y", "m", "v"), held)}})

        moved = placed.groupBy("part").cogroup(e.groupBy("home")).applyInPandas(move, f"id {kind}, y array<double>, m array<double>, v array<double>")
        state = materialise(moved, "state")
    return state.select("id", F.col("y").alias("low"))


def universe(df, size=500.0, uniform=False, **kw):
    """id, x, y, z: the three-dimensional projection, centred and scaled so that the largest absolute coordinate, of each axis or of all, is `size`."""
    low = pairmap(df, 3, **kw)
    return scaled(low.select("id", *[F.col("low")[i].alias(c) for i, c in enumerate("xyz")]), size, uniform)
