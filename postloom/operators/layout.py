"""Geometry of posts in space: scaling, radii, spacing, bounds, colours."""
import colorsys

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import text
from .posts import size_buckets

#: Layout weight of each edge type by default, and size factors of the engagement buckets.
WEIGHTS = {"nova": 1.0, "adept_spoke": 1.0, "adept_graft": 1.0, "temporal_influence": 1.0, "temporal": 1.0, "semantic_inter": 1.0}
SIZES = {"normal": 1.0, "big": 1.5, "mega": 2.5}


def pick(c, table, default=None):
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def edge_weights(edges, weights=WEIGHTS):
    """Edges with force * the weight of their type; those of no weight go."""
    return edges.withColumn("weight", F.col("force") * pick(F.col("type"), weights, 0.0)).where("weight > 0")


def node_radius(posts, sizes=SIZES, mult=3.0, scale=1.5):
    """id, radius: by engagement over the largest (1 at least) and its size bucket."""
    x = posts.withColumn("engagement", text.number(F.col("engagement")))
    top = max(1.0, x.agg(F.max("engagement")).first()[0] or 0.0)
    x = size_buckets(x)
    return x.select("id", text.node_size(F.col("engagement"), F.lit(top), pick(F.col("size"), sizes), mult * scale).alias("radius"))


def push_out(posts, spokes, radius, margin=1.4):
    """id, x, y, z of spokes, moved away from their hub to (hub radius + own radius) * margin if they are nearer; one on the hub moves along x."""
    p = posts.select("id", "x", "y", "z").join(radius, "id")
    s = spokes.select(F.col("source").alias("hub"), F.col("target").alias("id")).where("hub <> id")
    h = p.select(F.col("id").alias("hub"), *[F.col(c).alias(f"h{c}") for c in ("x", "y", "z", "radius")])
    m = s.join(p, "id").join(h, "hub")
    far = F.sqrt(sum(((F.col(c) - F.col(f"h{c}")) * (F.col(c) - F.col(f"h{c}")) for c in "xyz"), F.lit(0.0)))
    least = (F.col("hradius") + F.col("radius")) * margin
    m = m.withColumn("far", far).withColumn("least", least)
    to = lambda c: F.when(F.col("far") >= F.col("least"), F.col(c)).when(F.col("far") > 1e-6, F.col(f"h{c}") + (F.col(c) - F.col(f"h{c}")) / F.col("far") * F.col("least")).otherwise(F.col(f"h{c}") + (F.col("least") if c == "x" else F.lit(0.0)))
    return m.select("hub", "id", *[to(c).alias(c) for c in "xyz"])


def positions(posts, at):
    """Posts with x, y, z and position_xyz; those without a place at the origin."""
    x = posts.join(at.select("id", "x", "y", "z"), "id", "left").fillna(0.0, ["x", "y", "z"])
    return x.withColumn("position_xyz", F.array("x", "y", "z"))


def cluster_geometry(posts):
    """cluster_id, size, cx, cy, cz, radius (the farthest post's distance from the centroid)."""
    c = posts.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("size"), *[F.avg(a).alias(f"c{a}") for a in "xyz"])
    d = posts.join(c, "cluster_id").withColumn("d", F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz"), F.lit(0.0))))
    return c.join(d.groupBy("cluster_id").agg(F.max("d").alias("radius")), "cluster_id")


def scene_bounds(posts, margin=0.2):
    """One row: the box of all posts, its diagonal, the box with a margin, and where a camera starts."""
    b = posts.agg(*[f(a).alias(f"{a}_{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    b = b.withColumn("diagonal", F.sqrt(sum(((F.col(f"{a}_max") - F.col(f"{a}_min")) * (F.col(f"{a}_max") - F.col(f"{a}_min")) for a in "xyz"), F.lit(0.0))))
    for a in "xyz":
        b = b.withColumn(f"nav_min_{a}", F.col(f"{a}_min") - F.col("diagonal") * margin).withColumn(f"nav_max_{a}", F.col(f"{a}_max") + F.col("diagonal") * margin)
    return b.withColumn("spawn_x", (F.col("nav_min_x") + F.col("nav_max_x")) / 2).withColumn("spawn_y", (F.col("nav_min_y") + F.col("nav_max_y")) / 2).withColumn("spawn_z", F.col("nav_max_z"))


def between_0_and_1(df, *cols):
    """Columns as their place between the column's least and greatest value; 0.5 where these are equal."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    x = df.crossJoin(F.broadcast(ends))
    out = {c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.5) for c in cols}
    return x.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def scaled(df, size=1000.0, uniform=True, cols=("x", "y", "z")):
    """Places centred on their mean and scaled so that the largest absolute coordinate (of all axes, or of each) is `size`."""
    mean = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    x = df.crossJoin(F.broadcast(mean)).select(*[(F.col(c) - F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])
    top = x.agg(*[F.max(F.abs(c)).alias(f"_t_{c}") for c in cols])
    all_ = F.greatest(*[F.col(f"_t_{c}") for c in cols])
    x = x.crossJoin(F.broadcast(top))
    by = {c: all_ if uniform else F.col(f"_t_{c}") for c in cols}
    return x.select(*[F.when(by[c] == 0, 0.0).otherwise(F.col(c) / by[c] * size).alias(c) if c in cols else F.col(c) for c in df.columns])


#: The colour of a single cluster; base and span of saturation and lightness, in hundredths, and what the second and third axis add to the hue, in degrees.
ONLY = "#5B8FF9"
SATURATION, LIGHTNESS, TURNS = (58, 14), (63, 10), (42, 24)


def colours(centroids):
    """{cluster: '#RRGGBB'} from its centroid (cluster -> vector): the first principal axis is the hue, the second saturation, the third lightness, each scaled to 0 to 1, a flat one to 0.5. For the K rows of a clustering; no clusters give none."""
    names = sorted(centroids)
    if len(names) < 2:
        return dict.fromkeys(names, ONLY)
    x = np.array([centroids[n] for n in names], float)
    x = x - x.mean(0)
    p = x @ np.linalg.svd(x, full_matrices=False)[2][:3].T
    p = np.hstack([p, np.zeros((len(p), 3 - p.shape[1]))])
    lo, span = p.min(0), np.ptp(p, 0)
    p = np.where(span < 1e-9, 0.5, (p - lo) / np.where(span < 1e-9, 1, span))
    out = {}
    for n, (a, b, c) in zip(names, p):
        hue = (360 * a + TURNS[0] * (b - 0.5) + TURNS[1] * (c - 0.5)) % 360
        s, light = ((base + by * (v - 0.5)) / 100 for (base, by), v in ((SATURATION, b), (LIGHTNESS, c)))
        out[n] = "#" + "".join(f"{round(255 * v):02X}" for v in colorsys.hls_to_rgb(hue / 360, light, s))
    return out


def straighten(p, keep=0.1):
    """Places (n x 3) drawn to their principal axis: what lies off it is kept to a tenth. Fewer than three stay."""
    p = np.asarray(p, float)
    if len(p) < 3:
        return p
    mid = p.mean(0)
    axis = np.linalg.svd(p - mid, full_matrices=False)[2][0]
    along = ((p - mid) @ axis)[:, None] * axis
    return mid + along + keep * (p - mid - along)


def space_out(p, radius, margin=1.4):
    """Places of a chain in order, moved along its axis so that neighbours are at least (sum of radii) * margin apart; none moves back."""
    p = np.asarray(p, float)
    if len(p) < 2:
        return p
    axis = p[-1] - p[0]
    axis = axis / np.linalg.norm(axis) if np.linalg.norm(axis) > 1e-9 else np.array([1.0, 0, 0])
    at, out, last = (p - p[0]) @ axis, p.copy(), None
    for i in range(len(p)):
        to = at[i] if last is None else max(at[i], last + (radius[i - 1] + radius[i]) * margin)
        out[i] += (to - at[i]) * axis
        last = to
    return out


def straight_chains(posts, keep=0.1, margin=1.4):
    """id, x, y, z of the posts of chains, straightened and spaced, a task a chain. posts: subtopic_id, pos, id, x, y, z, radius."""
    kind = posts.schema["id"].dataType.simpleString()

    def run(pdf):
        pdf = pdf.sort_values(["pos", "id"]).reset_index(drop=True)
        p = space_out(straighten(pdf[["x", "y", "z"]].to_numpy(), keep), pdf.radius.to_numpy(), margin)
        return pd.DataFrame({"id": pdf.id, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return posts.groupBy("subtopic_id").applyInPandas(run, f"id {kind}, x double, y double, z double")


def push_apart(centres, radius, margin=1.1, rounds=200, seed=0):
    """Centres (k x 3) of balls moved until none overlap, larger ones less; for the K rows of a clustering."""
    c, r = np.array(centres, float), np.asarray(radius, float) * margin
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        gap = c[:, None] - c[None]
        far = np.linalg.norm(gap, axis=2)
        same = (far < 1e-9) & ~np.eye(len(c), dtype=bool)
        if same.any():
            c += rng.normal(0, 1e-3, c.shape)
            continue
        over = np.maximum(0, r[:, None] + r[None] - far)
        np.fill_diagonal(over, 0)
        if over.max(initial=0) < 1e-6:
            break
        share = r[None] ** 3 / (r[:, None] ** 3 + r[None] ** 3)
        c += (gap / np.where(far > 0, far, 1)[..., None] * (over * share)[..., None]).sum(1)
    return c


def collide(p, radius, margin=1.0, passes=6):
    """Places moved apart pairwise, along the sorted x axis, so that balls don't overlap, in at most `passes` sweeps."""
    p, r = np.array(p, float), np.asarray(radius, float)
    for _ in range(passes):
        order, moved, reach = np.argsort(p[:, 0]), False, 2 * r.max(initial=0) * margin
        for a, i in enumerate(order):
            for j in order[a + 1 :]:
                if p[j, 0] - p[i, 0] > reach:
                    break
                gap, least = p[j] - p[i], (r[i] + r[j]) * margin
                far = np.linalg.norm(gap)
                if far < least:
                    way = gap / far if far > 1e-9 else np.array([1.0, 0, 0])
                    p[i] -= way * (least - far) / 2
                    p[j] += way * (least - far) / 2
                    moved = True
        if not moved:
            break
    return p


def force_layout(p, edges, steps=100, repulsion=1.0, gravity=1.0, pinned=None):
    """ForceAtlas2 in space: repulsion by degree over distance, attraction along edges (i, j, weight), gravity; speed by how much forces swing. Pinned places act but don't move."""
    p = np.array(p, float)
    n = len(p)
    mass, last, speed = np.ones(n), np.zeros_like(p), 1.0
    i, j, w = (np.array(x) for x in zip(*edges)) if edges else (np.empty(0, int), np.empty(0, int), np.empty(0))
    np.add.at(mass, i.astype(int), 1)
    np.add.at(mass, j.astype(int), 1)
    free = np.ones(n, bool) if pinned is None else ~np.asarray(pinned)
    i, j = i.astype(int), j.astype(int)
    for _ in range(steps):
        gap = p[:, None] - p[None]
        far2 = np.maximum((gap**2).sum(2), 1e-6)
        f = (gap * (repulsion * mass[:, None] * mass[None] / far2)[..., None]).sum(1)
        pull = (p[i] - p[j]) * w[:, None]
        np.subtract.at(f, i, pull)
        np.add.at(f, j, pull)
        f -= gravity * mass[:, None] * p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-6)
        swing, pace = np.linalg.norm(f - last, axis=1), np.linalg.norm(f + last, axis=1) / 2
        speed = min(speed * 1.5, (mass * pace).sum() / max((mass * swing).sum(), 1e-9))
        p[free] += (f * (speed / (1 + np.sqrt(speed * swing)))[:, None])[free]
        last = f
    return p


def cluster_layout(posts, edges, steps=100, seed=0):
    """id, x, y, z: each cluster of three posts or more laid out by force from where it is, a task a cluster; smaller ones stay. posts: cluster_id, id, x, y, z; edges: source, target, weight."""
    kind = posts.schema["id"].dataType.simpleString()
    at = posts.select("cluster_id", "id")
    e = edges.join(at.toDF("cluster_id", "source"), "source").join(at.toDF("c2", "target"), "target").where("cluster_id = c2").select("cluster_id", "source", "target", "weight")

    def run(a, b):
        a = a.sort_values("id").reset_index(drop=True)
        p = a[["x", "y", "z"]].to_numpy(float)
        if len(a) >= 3:
            place = {v: k for k, v in enumerate(a.id)}
            mid = p.mean(0)
            links = sorted((place[s], place[t], w) for s, t, w in zip(b.source, b.target, b.weight))
            p = mid + force_layout(p - mid + np.random.default_rng(seed).normal(0, 1e-3, p.shape), links, steps)
        return pd.DataFrame({"id": a.id, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return posts.groupBy("cluster_id").cogroup(e.groupBy("cluster_id")).applyInPandas(run, f"id {kind}, x double, y double, z double")


def free_along(centre, direction, least, places, radii):
    """The smallest distance from centre along a direction of norm 1, `least` or more, at which a point lies in none of the spheres (places, radii)."""
    gap = centre - places
    along = gap @ direction
    under = along**2 - (gap * gap).sum(1) + radii**2
    hit = under > 0
    half = np.sqrt(under[hit])
    lo, hi = -along[hit] - half, -along[hit] + half
    at = least
    for a, b in sorted(zip(lo, hi)):
        if a >= at:
            break
        at = max(at, b)
    return at


def pack_bubbles(centre, places, radii, margin, rng, tries=8):
    """New centres of spheres, in the order given, so that none is nearer to another than margin times their radii together: from where each is, out along its direction from the centre, or along one of `tries` directions near it, drawn by rng, if that is nearer to where it was. A sphere at the centre goes in a drawn direction."""
    out, eps = np.empty_like(places), 1e-9
    for n in range(len(places)):
        away = places[n] - centre
        far = float(np.linalg.norm(away))
        first = away / far if far > 1e-6 else rng.normal(size=3)
        ways = [first, *(first + 0.3 * rng.normal(size=(tries, 3)))]
        best = None
        for way in ways:
            way = way / (np.linalg.norm(way) + 1e-12)
            t = free_along(centre, way, far if far > 1e-6 else 0.0, out[:n], (radii[:n] + radii[n]) * margin + eps) if n else far
            spot = centre + t * way
            moved = float(np.linalg.norm(spot - places[n]))
            if best is None or moved < best[0] - eps:
                best = moved, spot
            if best[0] <= eps:
                break
        out[n] = best[1]
    return out


def pack_blocks(posts, margin=1.15, seed=0, least_posts=4):
    """posts with x, y, z moved so that no two blocks of a cluster overlap: a block (a chain, a pool or a single post) keeps its form and is moved as one.

    posts: id, cluster_id, unit, x, y, z, radius (null counts as 1). A block is a sphere around its mean place that holds its posts with their radii, 0.5 at least; the largest are placed first, ties by unit. Clusters of under `least_posts` posts or two blocks, posts without a cluster, and those without a place stay. Draws depend on the seed and the cluster. One task gets the spheres of a cluster, not its posts; its work is quadratic in their number.
    """
    some = posts.where("cluster_id is not null and unit is not null and x is not null and y is not null and z is not null")
    mean = [F.avg(c).alias(f"c{c}") for c in "xyz"]
    blocks = some.groupBy("cluster_id", "unit").agg(*mean, F.count("*").alias("n"))
    centres = some.groupBy("cluster_id").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], F.count("*").alias("posts"), F.count_distinct("unit").alias("blocks"))
    centres = centres.where((F.col("posts") >= least_posts) & (F.col("blocks") > 1))
    reach = F.sqrt(sum((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz")) + F.coalesce("radius", F.lit(1.0))
    radius = some.join(blocks, ["cluster_id", "unit"]).groupBy("cluster_id", "unit").agg(F.greatest(F.lit(0.5), F.max(reach)).alias("r"))
    spheres = blocks.join(radius, ["cluster_id", "unit"]).join(centres, "cluster_id")
    kinds = {c: posts.schema[c].dataType.simpleString() for c in ("cluster_id", "unit")}

    def place(pdf):
        pdf = pdf.sort_values(["r", "unit"], ascending=[False, True])
        was = pdf[["cx", "cy", "cz"]].to_numpy()
        rng = np.random.default_rng([seed, int.from_bytes(str(pdf.cluster_id.iloc[0]).encode(), "big") % 2**63])
        new = pack_bubbles(pdf[["mx", "my", "mz"]].to_numpy()[0], was, pdf.r.to_numpy(), margin, rng)
        return pd.DataFrame({"cluster_id": pdf.cluster_id, "unit": pdf.unit, **{f"d{c}": (new - was)[:, k] for k, c in enumerate("xyz")}})

    moves = spheres.groupBy("cluster_id").applyInPandas(place, f"cluster_id {kinds['cluster_id']}, unit {kinds['unit']}, dx double, dy double, dz double")
    x = posts.join(moves, ["cluster_id", "unit"], "left")
    return x.select(*[(F.col(c) + F.coalesce(f"d{c}", F.lit(0.0))).alias(c) if c in ("x", "y", "z") else F.col(c) for c in posts.columns])
