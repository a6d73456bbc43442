"""Neighbour embedding: a fuzzy graph of nearest neighbours, laid out in few dimensions by attraction along its edges and repulsion of samples."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..session import materialise
from .blocks import BLOCK
from .density import nearest
from .models import moments

#: Vertices that one task moves at a time, about, and vertices of all others that each task sees.
PART, FAR = 4096, 512
#: Bins of a projection, from which parts are cut.
BINS = 4096


def memberships(near, k):
    """id, near with rho and sigma: rho is the least positive distance; sigma solves sum(exp(-max(0, d - rho) / sigma)) = log2(k) over the neighbours, by 64 bisections, and is a thousandth of the mean distance at least."""
    overall = near.select(F.explode("near.d").alias("d")).agg(F.sum("d")).first()[0] or 0.0
    mean = overall / max(1, near.count() * k)
    kind = near.schema["id"].dataType.simpleString()

    def run(frames):
        for f in frames:
            n = len(f)
            if not n:
                continue
            d = np.full((n, max(1, max(len(x) for x in f.d))), np.inf)
            for i, x in enumerate(f.d):
                d[i, : len(x)] = x
            some = np.isfinite(d)
            rho = np.where(d > 0, d, np.inf).min(1)
            rho[~np.isfinite(rho)] = 0
            over = np.where(some, np.maximum(d - rho[:, None], 0), np.inf)
            lo, hi, mid = np.zeros(n), np.full(n, np.inf), np.ones(n)
            for _ in range(64):
                high = np.exp(-over / mid[:, None]).sum(1) > np.log2(k)
                hi, lo = np.where(high, mid, hi), np.where(high, lo, mid)
                mid = np.where(np.isinf(hi), mid * 2, (lo + hi) / 2)
            own = np.where(some, d, 0).sum(1) / k
            yield pd.DataFrame({"id": f.id, "rho": rho, "sigma": np.maximum(mid, 1e-3 * np.where(rho > 0, own, mean))})

    found = near.select("id", F.col("near.d").alias("d")).where(F.size("d") > 0).mapInPandas(run, f"id {kind}, rho double, sigma double")
    return near.join(found, "id")


def fuzzy_graph(df, k=15, id="id", vector="embedding", metric="cosine", block=BLOCK):
    """a, b, w: the fuzzy union of neighbour graphs, a before b. Of two rows, each gives the other the membership exp(-max(0, d - rho) / sigma) if it is among its k - 1 nearest others (a row counts as its own first neighbour), and w = p + q - p q.

    Rows that cannot take part (see nearest) are left out; a row alone has no edge.
    """
    m = memberships(materialise(nearest(df, k - 1, id, vector, metric, block).select("id", "near"), "near"), k)
    e = m.select("id", "rho", "sigma", F.explode("near").alias("n"))
    p = F.exp(-F.greatest(F.lit(0.0), F.col("n.d") - F.col("rho")) / F.col("sigma"))
    e = e.select(F.least("id", "n.other").alias("a"), F.greatest("id", "n.other").alias("b"), F.when(F.col("n.d") <= F.col("rho"), 1.0).otherwise(p).alias("p"))
    e = e.groupBy("a", "b").agg(F.max("p").alias("p"), F.min("p").alias("q"), F.count("*").alias("n"))
    return e.select("a", "b", F.when(F.col("n") == 2, F.col("p") + F.col("q") - F.col("p") * F.col("q")).otherwise(F.col("p")).alias("w"))


def curve(least=0.0, spread=1.0):
    """(a, b) of 1 / (1 + a x^2b) nearest to a fall from 1 at `least` by exp(-(x - least) / spread), by damped least squares."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(x < least, 1, np.exp(-(x - least) / spread))
    p, damp = np.zeros(2), 1.0

    def off(p):
        return 1 / (1 + np.exp(p[0]) * x ** (2 * np.exp(p[1]))) - want

    for _ in range(200):
        r, step = off(p), 1e-6
        j = np.stack([(off(p + step * e) - r) / step for e in np.eye(2)], 1)
        move = np.linalg.solve(j.T @ j + damp * np.eye(2), -j.T @ r)
        if (off(p + move) ** 2).sum() < (r**2).sum():
            p, damp = p + move, damp / 3
        else:
            damp *= 3
    return float(np.exp(p[0])), float(np.exp(p[1]))


def principal(df, dims, id="id", vector="embedding"):
    """id, y: the first principal components of vectors of norm 1, the largest part of each positive, scaled to at most 10 and rounded, so that the order of summation leaves no trace."""
    unit = df.withColumn("_n", F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)))
    unit = unit.select(F.col(id).alias("id"), F.transform(vector, lambda x: x / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0)).alias("v"))
    _, mean, cov = moments(unit, "v")
    values, u = np.linalg.eigh(cov)
    u = u[:, np.argsort(-values, kind="stable")[:dims]]
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    kind = unit.schema["id"].dataType.simpleString()

    def run(frames):
        for f in frames:
            y = (np.stack(f.v.to_numpy()) - mean) @ u if len(f) else np.empty((0, dims))
            yield pd.DataFrame({"id": f.id, "y": list(np.pad(y, ((0, 0), (0, dims - y.shape[1]))))})

    y = materialise(unit.mapInPandas(run, f"id {kind}, y array<double>"), "principal")
    most = y.select(F.max(F.array_max(F.transform("y", F.abs)))).first()[0] or 1.0
    return y.select("id", F.transform("y", lambda x: F.round(x * 10 / most, 6)).alias("y"))


def parts_of(y, turn, seed, dims, part):
    """y with `part`: rows are cut by a projection that is drawn for each turn, at the edges of bins, so that about `part` rows are together and near rows mostly are; a bin of more rows is dealt by hash."""
    n = y.count()
    if n <= part:
        return y.withColumn("part", F.lit(0).cast("long"))
    axis = np.random.default_rng([seed, turn]).normal(size=dims)
    p = y.withColumn("t", sum((F.col("y")[i] * float(a) for i, a in enumerate(axis)), F.lit(0.0)))
    lo, hi = p.agg(F.min("t"), F.max("t")).first()
    p = p.withColumn("bin", F.least(F.floor((F.col("t") - lo) / max((hi - lo) / BINS, 1e-300)), F.lit(BINS - 1)))
    first, shares, held, number = {}, {}, 0, 0
    for b, m in sorted((r.bin, r["count"]) for r in p.groupBy("bin").count().collect()):  # BINS rows at most
        if held and held + m > part:
            number, held = number + shares[last], 0
        first[b], last = number, b
        shares[b] = -(-m // part)
        held += m
    plan = y.sparkSession.createDataFrame([(b, first[b], shares[b]) for b in first], "bin long, first long, shares long")
    p = p.join(F.broadcast(plan), "bin")
    return p.select("id", "y", (F.col("first") + F.expr("pmod(xxhash64(id), shares)")).alias("part"))


def moved(ids, y, edges, far, share, a, b, rng, epochs, begin, end, negatives):
    """Positions after `epochs` epochs. edges: (place of a vertex, place of its neighbour or -1, the neighbour's position, weight). An epoch takes each edge with a chance of its weight, in eight lots; vertices that are not here stay where they are. Repulsion is from `negatives` vertices an edge, drawn from here, or from those of afar with a chance of 1 - share."""
    i, j, at, w = edges
    y, w = y.copy(), w / w.max()
    for epoch in range(epochs):
        rate = begin + (end - begin) * epoch / epochs
        taken = rng.permutation(np.flatnonzero(rng.random(len(w)) < w))
        for lot in np.array_split(taken, 8):
            if not len(lot):
                continue
            u, v = i[lot], j[lot]
            d = y[u] - np.where((v >= 0)[:, None], y[v], at[lot])
            square = (d * d).sum(1)
            pull = np.where(square > 0, -2 * a * b * np.maximum(square, 1e-12) ** (b - 1) / (1 + a * square**b), 0)
            np.add.at(y, u, rate * np.clip(pull[:, None] * d, -4, 4))
            u = np.repeat(u, negatives)
            inside = rng.random(len(u)) < share
            other = rng.integers(0, len(y), len(u))
            out = y[other]
            if len(far):
                out = np.where(inside[:, None], out, far[rng.integers(0, len(far), len(u))])
            d = y[u] - out
            square = (d * d).sum(1)
            push = 2 * b / ((0.001 + square) * (1 + a * square**b))
            push[(inside | (not len(far))) & (other == u)] = 0
            np.add.at(y, u, rate * np.clip(push[:, None] * d, -4, 4))
    return y


def embed(df, dims=5, k=15, min_dist=0.0, id="id", vector="embedding", metric="cosine", rounds=10, epochs=20, negatives=5, part=PART, block=BLOCK, seed=42):
    """id, low: positions in `dims` dimensions, begun at the principal components and moved along the fuzzy graph.

    A round cuts the vertices into parts of bounded size by a projection of its own. A task moves the vertices of one part for some epochs; neighbours in other parts are there with their last positions, and a sample of all vertices, drawn by hash, stands for those afar. Everything is drawn from the seed, the round, the part and ids, so the result depends on the table alone, not on how Spark deals it. Rows that cannot take part (see nearest) are left out; rows without neighbours stay at their principal components; fewer than three rows, too.
    """
    from .blocks import vectors

    rows = materialise(vectors(df, id, vector), "vectors")
    if rows.isEmpty():
        return rows.select("id", F.col("v").alias("low"))
    g = fuzzy_graph(rows, k, "id", "v", metric, block)
    g = materialise(g.select(F.col("a").alias("i"), F.col("b").alias("j"), "w").union(g.select("b", "a", "w")), "graph")
    y = materialise(principal(rows, dims, "id", "v"), "positions")
    n, kind = y.count(), y.schema["id"].dataType.simpleString()
    if n < 3:
        return y.withColumnRenamed("y", "low")
    a, b = curve(min_dist)
    for turn in range(rounds):
        placed = materialise(parts_of(y, turn, seed, dims, part), "parts")
        far = [r.y for r in y.withColumn("h", F.xxhash64(F.lit(seed), F.lit(turn), "id")).orderBy("h", "id").limit(FAR).collect()] if n > part else []
        begin, end = 1 - turn / rounds, 1 - (turn + 1) / rounds
        e = g.join(placed.select("id", "part").toDF("i", "home"), "i").join(placed.select("id", "y").toDF("j", "at"), "j")

        def move(key, left, right):
            left, right = left.sort_values("id"), right.sort_values(["i", "j"])
            place = {v: m for m, v in enumerate(left.id)}
            here = np.stack(left.y.to_numpy()).astype(float)
            if len(right):
                edges = right.i.map(place).to_numpy(), right.j.map(place).fillna(-1).astype(int).to_numpy(), np.stack(right["at"].to_numpy()).astype(float), right.w.to_numpy()
                rng = np.random.default_rng([seed, turn, int(key[0])])  # noqa: B023
                here = moved(left.id, here, edges, np.array(far, float), len(left) / n, a, b, rng, epochs, begin, end, negatives)  # noqa: B023
            return pd.DataFrame({"id": left.id, "y": list(here)})

        y = materialise(placed.groupBy("part").cogroup(e.select("home", "i", "j", "at", "w").groupBy("home")).applyInPandas(move, f"id {kind}, y array<double>"), "positions")
    return y.withColumnRenamed("y", "low")
