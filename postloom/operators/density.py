"""Density clustering of vectors: nearest neighbours, core distances, the minimum spanning tree of mutual reachability, the condensed tree and the clusters taken from it."""
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import materialise
from .blocks import BLOCK, about, exact, paired, pieces, sides, vectors
from .components import connected_components

#: Edges that one task contracts at a time.
RANGE = 1_000_000
#: Neighbours of a row that are kept for the spanning tree.
LISTED = 15
#: Weights below count as this in 1 / weight.
LEAST = 1e-12


def merged(best, i, j, d):
    """Put pairs (row, other, distance) into the rows' lists, best: (distances, others), each of fixed length in order of (distance, other). Others that are new come after those in the lists."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.r_[True, i[1:] != i[:-1]]
    place = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
    rows, at, keep = i[first], np.cumsum(first) - 1, place < best[0].shape[1]
    new = np.full((len(rows), best[0].shape[1]), np.inf), np.full((len(rows), best[0].shape[1]), -1)
    for new_of, found in zip(new, (d, j)):
        new_of[at[keep], place[keep]] = found[keep]
    all_d, all_j = (np.concatenate([b[rows], n], 1) for b, n in zip(best, new))
    order = np.argsort(all_d, 1, kind="stable")[:, : best[0].shape[1]]
    best[0][rows], best[1][rows] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_j, order, 1)


def nearest_of(x, y, same, k, cosine):
    """((distances, places in y) of the k nearest of each vector of x, (distances, places in x) of each of y) for two lists; -1 where there are fewer. A product tells which pairs may be near enough, and only their distances are worked out."""
    best = [(np.full((len(z), k), np.inf), np.full((len(z), k), -1)) for z in (x, y)]
    for at_x, at_y, a, b in pieces(x, x if same else y, False):
        square, off, scale = about(a, b)
        off += 1e-11 if cosine else 0
        if same and at_x[0] == at_y[0]:
            np.fill_diagonal(square, np.inf)
        for side in (0,) if same else (0, 1):
            rows, m = (at_x, square) if side == 0 else (at_y, square.T)
            last = best[side][0][rows, -1]
            least = (2 * last if cosine else last * scale * last * scale) + off
            new = np.isinf(last)
            if new.any() and m.shape[1] > k:
                least[new] = np.partition(m[new], k - 1, 1)[:, k - 1] + 2 * off
            i, j = np.nonzero(square <= (least[:, None] if side == 0 else least))
            i, j = (z[np.isfinite(square[i, j])] for z in (i, j))
            if not len(i):
                continue
            d = exact(a, b, i, j)
            d = np.round(d**2 / 2, 12) if cosine else d  # so that copies are at 0
            i, j, d = (z[np.isfinite(d)] for z in (at_x[i], at_y[j], d))
            if len(i):
                merged(best[side], *((i, j) if side == 0 else (j, i)), d)
    return best


def nearest(df, k, id="id", vector="embedding", metric="euclidean", block=BLOCK):
    """id, v, near: the k nearest other rows, array<struct<d, other>> from the nearest, ties to the smaller id; fewer where there are no more.

    metric: euclidean, or cosine (1 - the dot product of vectors of norm 1, to twelve places). Vectors of unlike length are not neighbours. Rows without id, or whose vector is null, empty or holds null or non-finite numbers take no part. Rows of one id are told apart by nothing, so ids must be unique. Every pair of blocks is visited once.
    """
    p = materialise(vectors(df, id, vector), "vectors")
    kind = p.schema["id"].dataType.simpleString()
    cosine = metric == "cosine"

    def meet(table):
        x, y, same = sides(table.to_pandas())
        a, b = list(x.v), list(y.v)
        if cosine:
            a, b = ([np.asarray(v) / (np.linalg.norm(v) or 1) for v in z] for z in (a, b))
        ids, near = [], []
        for (d, j), own, other in zip(nearest_of(a, b, same, k, cosine), (x, y), (y, x)):
            some = j >= 0
            ends = pa.array(np.r_[0, some.sum(1).cumsum()], pa.int32())
            theirs = table["id"].take(pa.array(other.index.to_numpy()[j[some]])).combine_chunks()
            near.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(d[some]), theirs], ["d", "other"])))
            ids.append(table["id"].take(pa.array(own.index.to_numpy())).combine_chunks())
            if same:
                break
        return pa.table({"id": pa.chunked_array(ids), "near": pa.chunked_array(near)})

    found = paired(p, block).groupBy("g").applyInArrow(meet, f"id {kind}, near array<struct<d: double, other: {kind}>>")
    found = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return p.join(found, "id")


def core_distances(df, k=7, id="id", vector="embedding", block=BLOCK, lists=False):
    """id, v, core: the distance to the k-th nearest other row, or to the last where there are fewer; 0 for a row alone. lists: with near, the LISTED nearest or more (see nearest), and least, below which no row that it lacks is."""
    if not lists:
        found = nearest(df, k, id, vector, block=block)
        return found.select("id", "v", F.coalesce(F.try_element_at("near", F.lit(-1))["d"], F.lit(0.0)).alias("core"))
    most = max(k + 1, LISTED)
    found, last = nearest(df, most, id, vector, block=block), F.try_element_at("near", F.lit(-1))["d"]
    core = F.coalesce(F.try_element_at("near", F.lit(k))["d"], last, F.lit(0.0))
    return found.select("id", "v", core.alias("core"), "near", F.when(F.size("near") < most, F.lit(float("inf"))).otherwise(last).alias("least"))


def least_out(best, part, w, lo, hi):
    """Keep in best (w, lo, hi of each part) the least of the edges (part, w, lo, hi)."""
    order = np.lexsort((hi, lo, w, part))
    order = order[np.r_[True, part[order][1:] != part[order][:-1]]]
    part, w, lo, hi = part[order], w[order], lo[order], hi[order]
    of_w, of_lo, of_hi = (z[part] for z in best)
    less = (w < of_w) | (w == of_w) & ((lo < of_lo) | (lo == of_lo) & (hi < of_hi))
    for z, found in zip(best, (w, lo, hi)):
        z[part[less]] = found[less]


def leaving(pdf):
    """part, other, w, a, b: the least edge of mutual reachability by (w, a, b) from the rows of each part that ask, in a pair of blocks (id, v, core, part, ask, bound, side), to any other part there; edges above a part's bound may be left out."""
    pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
    pdf["code"], names = pd.factorize(pdf.part)
    pdf = pdf.sort_values("code", kind="stable")  # a piece of one part only is passed over
    x, y, same = pdf[pdf.side != 1], pdf[pdf.side != 0], bool((pdf.side == 2).any())
    bound, best = np.full(len(names), np.inf), (np.full(len(names), np.inf), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64))
    bound[pdf.code] = pdf.bound.to_numpy() ** 2
    for own, other in ((x, y),) if same else ((x, y), (y, x)):
        own = own[own.ask]
        other = other[other.core <= own.bound.max()] if len(own) else other
        (core_x, part_x, rank_x), (core_y, part_y, rank_y) = ((z.core.to_numpy(), z.code.to_numpy(), z.index.to_numpy()) for z in (own, other))
        for at_x, at_y, a, b in pieces(list(own.v), list(other.v), False):
            of_x, of_y = part_x[at_x], part_y[at_y]
            if of_x[0] == of_x[-1] == of_y[0] == of_y[-1]:
                continue
            square, off, scale = about(a, b)
            of_a, of_b = core_x[at_x], core_y[at_y]
            np.maximum(square, ((of_a * scale) ** 2)[:, None], out=square)
            np.maximum(square, (of_b * scale) ** 2, out=square)
            square[of_x[:, None] == of_y] = np.inf
            off += 1e-11 * square[np.isfinite(square)].max(initial=0)
            low = square.min(1)
            np.minimum.at(bound, of_x, low / scale / scale)
            least = bound[of_x] * scale * scale + off
            some = np.flatnonzero((low <= least) & np.isfinite(low))
            if not len(some):
                continue
            m = square[some]
            r, j = np.nonzero((m <= least[some][:, None]) & np.isfinite(m))
            i = some[r]
            w = np.maximum(np.maximum(exact(a, b, i, j), of_a[i]), of_b[j])
            u, v = rank_x[at_x[i]], rank_y[at_y[j]]
            fine = np.isfinite(w)
            if fine.any():
                least_out(best, of_x[i][fine], w[fine], np.minimum(u, v)[fine], np.maximum(u, v)[fine])
    some = np.flatnonzero(np.isfinite(best[0]))
    w, lo, hi = (z[some] for z in best)
    pdf = pdf.sort_index()
    code, ids = pdf.code.to_numpy(), pdf.id.to_numpy()
    other = np.where(code[lo] == some, code[hi], code[lo])
    return pd.DataFrame({"part": np.asarray(names)[some], "other": np.asarray(names)[other], "w": w, "a": ids[lo], "b": ids[hi]})


def joined(edges, a, b, most):
    """As connected_components, of at most `most` edges in one task."""
    if edges.count() > most:
        return connected_components(edges, a, b)
    kind = edges.schema[a].dataType.simpleString()

    def join(pdf):
        root = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        for x, y in zip(pdf.a, pdf.b):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        nodes = list(dict.fromkeys([*pdf.a, *pdf.b]))
        return pd.DataFrame({"node": nodes, "component": [find(x) for x in nodes]})

    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(0).alias("one"))
    return edges.groupBy("one").applyInPandas(join, f"node {kind}, component {kind}")


def reachability_edges(cores, block=BLOCK, most=RANGE):
    """a, b, w: the minimum spanning tree of mutual reachability, max(distance, both core distances), by (w, a, b), a before b.

    cores: id, v, core, and near and least if known (see core_distances). Vectors of unlike length are joined by no edge. Borůvka's rounds: the least edge out of each part is found, then parts are joined, so rounds are logarithmic. The nearest rows give an edge out of most parts at once, and only rows that may have a lesser one to a row not listed are compared with all others; no edge but these leaves its task.
    """
    listed = "near" in cores.columns
    if not listed:
        cores = cores.withColumn("least", F.lit(0.0))
    cores = materialise(cores, "cores")
    kind = cores.schema["id"].dataType.simpleString()
    if listed:
        near = cores.select("id", "core", F.explode("near").alias("x")).select("id", "core", "x.d", F.col("x.other").alias("o"))
        near = near.join(cores.select(F.col("id").alias("o"), F.col("core").alias("of_o")), "o")
        near = materialise(near.select("id", "o", F.greatest("d", "core", "of_o").alias("w"), F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")), "near")
    rows = cores.select("id", "v", "core", "least")
    parts, tree, edge = materialise(cores.select("id", F.col("id").alias("part")), "parts"), None, F.struct("w", "a", "b", "other").alias("e")
    while parts.select("part").distinct().limit(2).count() > 1:
        best = None
        asking = rows.join(parts, "id").withColumn("bound", F.lit(float("inf")))
        if listed:
            out = near.join(parts, "id").join(parts.toDF("o", "other"), "o").where("part <> other")
            out = out.select("part", edge).union(out.select("other", F.struct("w", "a", "b", F.col("part").alias("other"))))
            best = materialise(out.groupBy("part").agg(F.min("e").alias("e")), "listed")
            asking = asking.drop("bound").join(best.select("part", F.col("e.w").alias("bound")), "part", "left").fillna(float("inf"), ["bound"])
        asking = materialise(asking.select("id", "v", "core", "part", "bound", (F.col("least") <= F.col("bound")).alias("ask")), "asking")
        highest = asking.where("ask").agg(F.max("bound").alias("m")).first()["m"]
        if highest is not None:
            sent = asking.where(F.col("ask") | (F.col("core") <= F.lit(highest)))
            found = paired(sent, block).groupBy("g").applyInPandas(leaving, f"part {kind}, other {kind}, w double, a {kind}, b {kind}").select("part", edge)
            best = found if best is None else best.union(found)
        won = materialise(best.groupBy("part").agg(F.min("e").alias("e")).select("part", "e.*"), "won")
        if won.isEmpty():
            break
        edges = won.select("a", "b", "w").distinct()
        tree = edges if tree is None else tree.union(edges)
        now = joined(won, "part", "other", most).toDF("part", "next")
        parts = materialise(parts.join(now, "part", "left").select("id", F.coalesce("next", "part").alias("part")), "parts")
    return cores.sparkSession.createDataFrame([], f"a {kind}, b {kind}, w double") if tree is None else tree


def minimum_forest(edges, most=RANGE):
    """The edges (a, b, w) of the minimum spanning forest by (w, a, b), a before b. Nulls, self-loops and repeated edges are ignored.

    Borůvka's rounds: each part takes its least edge out, then parts and edges are contracted, of parallel edges the least stays. When at most `most` edges are left, one task ends the work.
    """
    edges = edges.where("a <> b and w is not null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    left = materialise(edges.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")), "left")
    kind, kept = edges.schema["a"].dataType.simpleString(), edges.limit(0)

    def finish(pdf):
        pdf = pdf.sort_values(["w", "a", "b"]).reset_index(drop=True)
        root = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        taken = []
        for i, (x, y) in enumerate(zip(pdf.x, pdf.y)):
            x, y = find(x), find(y)
            if x != y:
                root[x] = y
                taken.append(i)
        return pdf.loc[taken, ["a", "b", "w"]]

    while True:
        n = left.count()
        if not n:
            return kept
        if n <= most:
            return kept.union(left.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(finish, f"a {kind}, b {kind}, w double"))
        key = F.struct("w", "a", "b", "x", "y").alias("key")
        best = left.select(F.col("x").alias("c"), key).union(left.select("y", key)).groupBy("c").agg(F.min("key").alias("key"))
        won = materialise(best.select("key.*").distinct(), "won")
        kept = kept.union(won.select("a", "b", "w"))
        parts = materialise(connected_components(won, "x", "y"), "parts")
        left = left.join(parts.toDF("x", "nx"), "x", "left").join(parts.toDF("y", "ny"), "y", "left")
        left = left.select("a", "b", "w", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y")).where("x <> y")
        least = left.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(F.struct("w", "a", "b")).alias("key"))
        left = materialise(least.select("key.a", "key.b", "key.w", "x", "y"), "left")


STATE = "part {0}, size long, cluster long, mass double"
EVENTS = "event string, part {0}, to {0}, home long, cluster long, parent long, size long, weight double, mass double, stability double"


def contract(edges, states, least, number):
    """Merge parts by edges (x, y, w) in order. states: {part: (size, open cluster or None, mass)}, by default (1, None, 0). Yields events: `part` (part, to, home of its points if they got one now), `state` of what is left, `cluster` (cluster, parent, size, weight of its birth, stability).

    A part becomes a cluster when it reaches `least` points. Two clusters that meet end both and begin their parent. Points that come to a cluster belong to it. mass is the sum of 1 / weight at which each point leaves the cluster.
    """
    root, own, inside, home = {}, dict(states), {}, {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    seen = dict.fromkeys(p for e in edges for p in e[:2])
    for p in seen:
        own.setdefault(p, (1, None, 0.0))
        if own[p][1] is None:
            inside[p] = [p]
    ended = []
    for x, y, w in edges:
        x, y = find(x), find(y)
        if x == y:
            continue
        rate = 1 / max(w, LEAST)
        if own[x][1] is None and own[y][1] is not None:
            x, y = y, x
        (m, c, mass), (n, d, other) = own.pop(x), own.pop(y)
        root[y] = x
        if c is not None and d is not None:
            ended += [(c, number, m, w, mass - m * rate), (d, number, n, w, other - n * rate)]
            own[x] = (m + n, number, (m + n) * rate)
            number += 1
        elif c is not None:
            home.update(dict.fromkeys(inside.pop(y), c))
            own[x] = (m + n, c, mass + n * rate)
        else:
            held = inside.pop(x) + inside.pop(y)
            if m + n >= least:
                home.update(dict.fromkeys(held, number))
                own[x] = (m + n, number, (m + n) * rate)
                number += 1
            else:
                inside[x] = held
                own[x] = (m + n, None, 0.0)
    for p in seen:
        yield {"event": "part", "part": p, "to": find(p), "home": home.get(p)}
    for p in {find(p) for p in seen}:
        n, c, mass = own[p]
        yield {"event": "state", "part": p, "cluster": c, "size": n, "mass": mass}
    for c, parent, n, w, stability in ended:
        yield {"event": "cluster", "cluster": c, "parent": parent, "size": n, "weight": w, "stability": stability}
    yield {"event": "next", "cluster": number}


def condensed(points, tree, least=15, most=RANGE):
    """(homes, clusters): homes is id, home: the cluster in which a point was when it last belonged to one; clusters is cluster, parent, size, weight, stability, with the root, whose parent is null, if there is one.

    tree: a, b, w, a spanning forest of points (id). Edges are taken in ranges of about `most` by (w, a, b); a range's edges, and the parts they touch, are contracted in one task, so no task grows with the input.
    """
    kind = points.schema["id"].dataType.simpleString()
    ranges = -(-tree.count() // most)
    nodes = points.select("id", F.col("id").alias("part"), F.lit(None).cast("long").alias("home"))
    spark = points.sparkSession
    states = spark.createDataFrame([], STATE.format(kind))
    clusters = spark.createDataFrame([], "cluster long, parent long, size long, weight double, stability double")
    number, names = 0, [x.split(" ")[0] for x in EVENTS.split(", ")]
    tree = materialise(tree.repartitionByRange(max(1, ranges), "w", "a", "b").withColumn("range", F.spark_partition_id()), "tree")
    for r in range(ranges):
        x, y = nodes.select(F.col("id").alias("a"), F.col("part").alias("x")), nodes.select(F.col("id").alias("b"), F.col("part").alias("y"))
        mine = materialise(tree.where(f"range = {r}").join(x, "a").join(y, "b").select("x", "y", "w", "a", "b"), "range")
        touched = states.join(mine.select(F.col("x").alias("part")).union(mine.select("y")).distinct(), "part", "left_semi")
        begin = number

        def merge(left, right):
            left = left.sort_values(["w", "a", "b"])
            known = {p: (int(n), None if pd.isna(c) else int(c), m) for p, n, c, m in zip(right.part, right["size"], right.cluster, right.mass)}
            found = pd.DataFrame(contract(list(zip(left.x, left.y, left.w)), known, least, begin), columns=names)  # noqa: B023
            longs = [n for n, t in (x.split(" ") for x in EVENTS.split(", ")) if t == "long"]
            return found.astype(dict.fromkeys(longs, "Int64"))

        one = lambda df: df.withColumn("one", F.lit(0)).groupBy("one")
        events = one(mine).cogroup(one(touched)).applyInPandas(merge, EVENTS.format(kind))
        events = materialise(events, "events")
        number = events.where("event = 'next'").first()["cluster"]
        moved = events.where("event = 'part'").select("part", "to", F.col("home").alias("now"))
        nodes = materialise(nodes.join(moved, "part", "left").select("id", F.coalesce("to", "part").alias("part"), F.coalesce("home", "now").alias("home")), "nodes")
        states = states.join(moved, "part", "left_anti").union(events.where("event = 'state'").select("part", "size", "cluster", "mass"))
        states = materialise(states, "states")
        clusters = clusters.union(events.where("event = 'cluster'").select("cluster", "parent", "size", "weight", "stability"))
    roots = states.where("cluster is not null").select("cluster", F.lit(None).cast("long").alias("parent"), "size", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("stability"))
    return nodes.select("id", "home"), clusters.union(roots)


def leaves(clusters):
    """The clusters of a condensed tree that hold no other; a root is none, even alone."""
    return clusters.where("parent is not null").join(clusters.select(F.col("parent").alias("cluster")).where("cluster is not null").distinct(), "cluster", "left_anti")


def density_clusters(df, least=15, samples=7, id="id", vector="embedding", block=BLOCK, most=RANGE):
    """(id, cluster; clusters): density clusters of at least `least` points by leaf selection, -1 for noise, and the condensed tree.

    A core distance is that to the `samples`-th other point. Edges are taken by (mutual reachability, smaller id, larger id), which settles ties, so the result depends neither on partitions nor on blocks. A leaf holds all points it had when it began, also those that leave it later. With one cluster in all, as with fewer than two times `least` points, all is noise. Rows that cannot take part (see nearest) are not returned; an empty table gives no rows.
    """
    cores = materialise(core_distances(df, samples, id, vector, block, lists=True), "cores")
    tree = materialise(minimum_forest(reachability_edges(cores, block, most), most), "forest")
    homes, clusters = condensed(cores.select("id"), tree, least, most)
    clusters = materialise(clusters, "clusters")
    picked = leaves(clusters).select(F.col("cluster").alias("home"), F.col("cluster").alias("picked"))
    return homes.join(picked, "home", "left").select("id", F.coalesce("picked", F.lit(-1)).alias("cluster")), clusters


def pivot(df, **kw):
    """The number of density clusters, noise aside: where the search for the number of mixture components starts."""
    return leaves(density_clusters(df, **kw)[1]).count()
