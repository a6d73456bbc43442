"""Candidate edges between posts (id, embedding, cluster_id, timestamp, engagement), greedy matching, and the edge builder.

Similar pairs come from one kernel: posts are dealt into blocks, and each pair of blocks that may hold pairs meets in one task, where matrix products of pieces give all cosines and only those that pass leave it.
"""
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window as W, functions as F

from ..functions.text import IN, OUT, tier
from ..session import materialise
from .blocks import BLOCK, LARGEST, SOME, finite, paired, pieces, sides, vectors
from .components import connected_components


def similar(posts, least, hours=None, rising=False, falling=False, differ=False, block=BLOCK, new=None):
    """(source, target, cos, dt) of pairs whose embeddings' dot product is above `least`. Null ids, and embeddings that are null, empty or hold null or non-finite numbers, take no part; vectors of unlike length are not compared.

    hours: source is older, by at most so many (else source < target and dt is null); rising: the target's engagement is greater, falling: the source's; differ: both have clusters, unlike ones; new: the name of a column that is true for at least one of them.
    A time bucket, or the whole table without hours, is split by id into blocks (see blocks), so a hot bucket is many tasks.
    """
    p = posts.where(F.col("id").isNotNull() & finite("embedding"))
    single = posts.schema["embedding"].dataType.simpleString() == "array<float>"  # sent as it is
    p = p.select("id", (F.col("embedding") if single else F.col("embedding").cast("array<double>")).alias("v"), "cluster_id" if differ else F.lit(None).cast("int").alias("cluster_id"), F.col("engagement").cast("double").alias("e") if rising or falling else F.lit(0.0).alias("e"), (F.unix_micros(F.col("timestamp").cast("timestamp")) / F.lit(3.6e9)).alias("t") if hours else F.lit(0.0).alias("t"), F.coalesce(F.col(new), F.lit(False)).alias("new") if new else F.lit(True).alias("new"))
    if hours:
        p = p.where("t is not null")
    if differ:
        p = p.where("cluster_id is not null")
    if not hours:
        return paired(p, block).groupBy("g").applyInPandas(meeting(least, hours, rising, falling, differ), PAIR.format(posts.schema["id"].dataType.simpleString()))
    p = p.withColumn("k", F.floor(F.col("t") / hours))
    subs = p.groupBy("k").agg(F.greatest(F.least(F.ceil(F.count("*") / block), F.lit(SOME)), F.ceil(F.count("*") / LARGEST)).alias("subs"))
    after = subs.select((F.col("k") - 1).alias("k"), F.col("subs").alias("next"))
    before = subs.select((F.col("k") + 1).alias("k"), F.col("subs").alias("last"))
    p = p.join(subs.join(after, "k", "left").join(before, "k", "left"), "k")
    p = p.withColumn("s", F.expr("pmod(xxhash64(id), subs)"))
    # a group is (bucket, block, bucket or the next one, block); a post is on its left, its right or both
    own = F.expr("transform(sequence(0L, subs - 1), x -> named_struct('g', named_struct('k', k, 'a', least(s, x), 'l', k, 'b', greatest(s, x)), 'side', if(s = x, 2, if(s < x, 0, 1))))")
    later = F.expr("transform(sequence(0L, coalesce(next, 0L)), x -> named_struct('g', named_struct('k', k, 'a', s, 'l', k + 1, 'b', x), 'side', 0))")
    earlier = F.expr("transform(sequence(0L, coalesce(last, 0L)), x -> named_struct('g', named_struct('k', k - 1, 'a', x, 'l', k, 'b', s), 'side', 1))")
    groups = F.concat(own, F.slice(later, 1, F.coalesce("next", F.lit(0)).cast("int")), F.slice(earlier, 1, F.coalesce("last", F.lit(0)).cast("int")))
    p = p.select("id", "v", "cluster_id", "e", "t", "new", F.explode(groups).alias("x")).select("id", "v", "cluster_id", "e", "t", "new", "x.side", F.col("x.g").alias("g"))
    return p.groupBy("g").applyInPandas(meeting(least, hours, rising, falling, differ), PAIR.format(posts.schema["id"].dataType.simpleString()))


PAIR = "source {0}, target {0}, cos double, dt double"


def meeting(least, hours, rising, falling, differ):
    """What a task does with a pair of blocks: see similar."""

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames), ignore_index=True).sort_values("new", ascending=False, kind="stable")
        both = bool((pdf.side == 2).any())
        x, y = pdf[pdf.side != 1].reset_index(drop=True), pdf[pdf.side != 0].reset_index(drop=True)
        del pdf
        new_x, new_y = x.new.to_numpy(bool), y.new.to_numpy(bool)
        for at_x, at_y, a, b in pieces(list(x.v), list(y.v), both):
            if not (new_x[at_x].any() or new_y[at_y].any()):
                continue
            cos = a @ b.T
            i, j = np.nonzero(cos > least)
            c, i, j = cos[i, j], at_x[i], at_y[j]
            if both:
                once = i < j
                c, i, j = c[once], i[once], j[once]
            if not len(i):
                continue
            ix, iy, tx, ty, ex, ey = x.id.to_numpy()[i], y.id.to_numpy()[j], x.t.to_numpy()[i], y.t.to_numpy()[j], x.e.to_numpy()[i], y.e.to_numpy()[j]
            dt = ty - tx
            turn = (dt < 0) if hours else (ix > iy)
            es, et = np.where(turn, ey, ex), np.where(turn, ex, ey)
            ok = new_x[i] | new_y[j]
            if hours:
                ok &= (np.abs(dt) > 0) & (np.abs(dt) <= hours)
            if rising:
                ok &= et > es
            if falling:
                ok &= es > et
            if differ:
                ok &= (x.cluster_id.to_numpy()[i] != y.cluster_id.to_numpy()[j]).astype(bool)
            yield pd.DataFrame({"source": np.where(turn, iy, ix)[ok], "target": np.where(turn, ix, iy)[ok], "cos": c[ok], "dt": np.abs(dt)[ok] if hours else None})

    return meet


def decayed(tau):
    return F.col("cos") * F.exp(F.greatest(F.lit(-88.0), -F.col("dt") / tau))


def follow(posts, least, tau=6.0, hours=48.0, influence=False, threshold=None):
    """Follow edges, or influence edges (the newer post more engaged), with force cos * exp(-dt / tau), above `threshold` if given."""
    e = similar(posts, least, hours, rising=influence).select("source", "target", decayed(tau).alias("force"))
    return e if threshold is None else e.where(F.col("force") > threshold)


def by_engagement(posts, least, threshold=None):
    """Where there are no times: from the more engaged post to a less engaged one of greater id, force the cosine."""
    e = similar(posts, least, falling=True).select("source", "target", F.col("cos").alias("force"))
    return e if threshold is None else e.where(F.col("force") > threshold)


def bridges(posts, least, new=None):
    """Pairs of different clusters above a cosine, smaller id first; with a column `new`, those that hold a new post."""
    return similar(posts, least, differ=True, new=new).select("source", "target", F.col("cos").alias("force"))


#: Fixed by the form of a double: the bits of a positive one are in order of its value. How far to shift, and how many bits to look at, in each pass.
DIGITS = ((43, 20), (22, 21), (0, 22))


def kth_cosines(posts, ranks_of, block=BLOCK):
    """Positive cosines of all pairs at given ranks (from 0): ranks_of gets their number. None if there are none.

    Each task counts its pairs by the leading bits of their cosines, and hands on the counts; a second and a third pass count the next bits of those that agree with a wanted one so far. No pair is stored; what comes to the driver is at most 2^22 counts a pass, whatever the input.
    """
    p = materialise(vectors(posts), "vectors")
    wanted = None
    for shift, bits in DIGITS:
        heads = None if wanted is None else sorted({head for head, _ in wanted})

        def count(pdf):
            x, y, same = sides(pdf)
            total, some = np.zeros(1 << bits if heads is None else 0, np.int64), {}  # noqa: B023
            for i, j, a, b in pieces(list(x.v), list(y.v), same):
                cos = a @ b.T
                if same:
                    cos = cos[i[:, None] < j]
                key = np.ascontiguousarray(cos[cos > 0]).view(np.int64)
                if heads is None:  # noqa: B023
                    total += np.bincount(key >> shift, minlength=len(total))  # noqa: B023
                    continue
                head, mine = key >> (shift + bits), np.zeros(len(key), bool)  # noqa: B023
                for h in heads:  # noqa: B023
                    mine |= head == h
                for k, n in zip(*np.unique(key[mine] >> shift, return_counts=True)):  # noqa: B023
                    some[int(k)] = some.get(int(k), 0) + int(n)
            if heads is None:  # noqa: B023
                found = np.flatnonzero(total)
                return pd.DataFrame({"bits": found, "n": total[found]})
            return pd.DataFrame({"bits": list(some), "n": list(some.values())}, dtype="int64")

        found = paired(p, block).groupBy("g").applyInPandas(count, "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n")).collect()
        found = sorted((r.bits, r.n) for r in found)
        if wanted is None:
            total = sum(n for _, n in found)
            if not total:
                return None
            wanted = [(0, r) for r in ranks_of(total)]
        after = []
        for head, rank in wanted:
            for b, n in found:
                if b >> bits != head:
                    continue
                if rank < n:
                    after.append((b, rank))
                    break
                rank -= n
        wanted = after
    return [float(np.array([b], np.int64).view(np.float64)[0]) for b, _ in wanted]


def adaptive_threshold(posts, percent, block=BLOCK):
    """The exact percentile (0 to 100), interpolated, of the positive cosines of all pairs of posts that can take part (see similar); an error if there are none. Nothing is written for each pair."""
    place = {}

    def ranks(n):
        at = percent / 100 * (n - 1)
        place["part"] = at - int(at)
        return [int(at), min(int(at) + 1, n - 1)]

    found = kth_cosines(posts, ranks, block)
    if found is None:
        raise ValueError("no positive cosine")
    return found[0] + (found[1] - found[0]) * place["part"]


def graft(posts, hubs, chain_posts, least, force=1.0, places=12):
    """Each hub to the nearest chain post of its cluster at a cosine of `least` or more, cosines taken to so many decimal places and ties to the smaller id. hubs and chain_posts hold an id each."""
    p = posts.select("id", "cluster_id", F.col("embedding").cast("array<double>").alias("v")).where("cluster_id is not null")
    h, c = p.join(hubs.select("id"), "id", "left_semi"), p.join(chain_posts.select("id"), "id", "left_semi")
    # a cluster's chain posts are split into blocks; each block's best competes
    salts = c.groupBy("cluster_id").agg(F.ceil(F.count("*") / BLOCK).alias("salts"))
    c = c.join(salts, "cluster_id").withColumn("salt", F.expr("pmod(xxhash64(id), salts)")).select(F.col("cluster_id").alias("k"), F.col("salt").alias("part"), F.col("id").alias("target"), F.col("v").alias("y"))
    h = h.join(salts, "cluster_id").select("cluster_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("source"), F.col("v").alias("x"))
    kind = posts.schema["id"].dataType.simpleString()

    def nearest(key, left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"source": [], "target": [], "cos": []})
        right = right.sort_values("target")
        cos = np.round(np.stack(left.x.to_numpy()) @ np.stack(right.y.to_numpy()).T, places)
        at = cos.argmax(1)
        return pd.DataFrame({"source": left.source.to_numpy(), "target": right.target.to_numpy()[at], "cos": cos[np.arange(len(at)), at]})

    found = h.groupBy("cluster_id", "salt").cogroup(c.groupBy("k", "part")).applyInPandas(nearest, f"source {kind}, target {kind}, cos double")
    best = found.groupBy("source").agg(F.min(F.struct((-F.col("cos")).alias("cos"), "target")).alias("best"))
    best = best.select("source", "best.target", (-F.col("best.cos")).alias("cos"))
    return best.where(F.col("cos") >= least).select("source", "target", F.lit(float(force)).alias("force"), "cos")


def match(edges, quotas):
    """Greedy b-matching by (force desc, source, target) in locally dominant rounds. quotas: id, cap_out, cap_in."""
    left, taken = materialise(edges, "edges"), None
    used = quotas
    while not left.isEmpty():
        order = [F.desc("force"), "source", "target"]
        e = left.join(used.selectExpr("id source", "cap_out"), "source").join(used.selectExpr("id target", "cap_in"), "target").where("cap_out > 0 and cap_in > 0")
        e = e.withColumn("o", F.row_number().over(W.partitionBy("source").orderBy(*order))).withColumn("i", F.row_number().over(W.partitionBy("target").orderBy(*order)))
        e = materialise(e.withColumn("won", F.expr("o <= cap_out and i <= cap_in")), "round")
        won = e.where("won").select("source", "target", "force")
        taken = won if taken is None else taken.unionByName(won)
        so, si = won.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_out")), won.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_in"))
        used = materialise(used.join(so, "id", "left").join(si, "id", "left").selectExpr("id", "cap_out - coalesce(n_out, 0) cap_out", "cap_in - coalesce(n_in, 0) cap_in"), "caps")
        left = e.where("not won").select("source", "target", "force")
    return taken if taken is not None else edges


def tier_quotas(posts):
    t = tier(F.col("engagement"))
    return posts.select("id", F.element_at(F.array(*map(F.lit, OUT)), t).alias("cap_out"), F.element_at(F.array(*map(F.lit, IN)), t).alias("cap_in"))


#: Ids of posts matched in a round that may be broadcast; beyond, the edges left are shuffled to lose theirs.
SENT = 1_000_000


def one_to_one(edges):
    """Greedy matching by (force desc, source, target) in which no post has two edges, whichever end: rounds of edges that are the best at both their ends. Repeated edges count once.

    An edge has won if it is the best of two posts, so only each post's best is exchanged to tell.
    """
    left, taken = materialise(edges.where("source <> target"), "edges"), None
    while not left.isEmpty():
        key = F.struct((-F.col("force")).alias("f"), "source", "target")
        ends = left.select(F.col("source").alias("id"), key.alias("key")).union(left.select("target", key))
        best = ends.groupBy("id").agg(F.min("key").alias("best")).groupBy("best").agg(F.count("*").alias("posts"))
        won = materialise(best.where("posts = 2").select("best.source", "best.target", (-F.col("best.f")).alias("force")), "won")
        taken = won if taken is None else taken.unionByName(won)
        gone = won.select(F.col("source").alias("id")).union(won.select("target"))
        if 2 * won.count() <= SENT:
            gone = F.broadcast(gone)
        left = left.join(gone.toDF("source"), "source", "left_anti").join(gone.toDF("target"), "target", "left_anti")
        left = materialise(left, "left")
    return taken if taken is not None else edges.limit(0).select("source", "target", "force")


def second_pass(candidates, posts, first, cap_out, cap_in):
    """(candidates, quotas) of the second matching: posts that the first one touched drop out, but for those of the top tier, which may still be targets."""
    touched = first.select(F.col("source").alias("id")).union(first.select("target")).distinct()
    top = posts.where(tier(F.col("engagement")) == 6).select("id")
    barred = touched.join(top, "id", "left_anti")
    kept = candidates.join(barred.toDF("source"), "source", "left_anti").join(barred.toDF("target"), "target", "left_anti")
    kept = kept.join(touched.join(top, "id", "left_semi").toDF("source"), "source", "left_anti")
    return kept, posts.select("id", F.lit(cap_out).alias("cap_out"), F.lit(cap_in).alias("cap_in"))


#: Types of the edges that join components, the first to be kept first.
JOINING = ("temporal_influence", "temporal", "semantic_inter")
#: All types, the first to be cut first when a component is too large.
CUT_FIRST = ("semantic_inter", "temporal", "temporal_influence", "adept_graft", "adept_spoke", "nova")


def place_of(kinds, c):
    """A type's place in a list; an unknown type is an error."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in zip(kinds, range(len(kinds))) for x in kv]), c)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown edge type: "), F.coalesce(c, F.lit("null")))).cast("int"))


def between(edges, components):
    """source, target, type, force with the components a and b of its ends; an end without a component is an error."""
    comp = components.select("node", "component")
    e = edges.join(comp.toDF("source", "a"), "source", "left").join(comp.toDF("target", "b"), "target", "left")
    kind = components.schema["component"].dataType

    def known(c, end):
        said = F.concat(F.lit("an edge's end without a component: "), F.coalesce(F.col(end).cast("string"), F.lit("null")))
        return F.coalesce(F.col(c), F.raise_error(said).cast(kind)).alias(c)

    return e.select("source", "target", "type", "force", known("a", "source"), known("b", "target"))


def order_key():
    return F.struct(place_of(JOINING, F.col("type")).alias("p"), (-F.col("force")).alias("f"), "source", "target", "type")


def guarded(e, components, guard):
    """(edges that may join, edges that may not) of e with its key. An edge between two components of one post is barred: by `static` always, by `dynamic` as long as neither has been joined to another by an edge before it.

    In the dynamic case a single post is joined first by its earliest edge to a component that was more than one post by then; so its time is the earliest arrival along edges of rising order, found in rounds from the larger components on.
    """
    single = components.groupBy("component").agg(F.count("*").alias("n")).where("n = 1").select("component")
    alone = e.join(single.toDF("a"), "a", "left_semi").join(single.toDF("b"), "b", "left_semi")
    if guard == "static":
        return e.join(alone.select("key"), "key", "left_anti"), alone
    both = materialise(e.select("a", "b", "key").union(e.select("b", "a", "key")).join(single.toDF("b"), "b", "left_semi").select("a", "b", "key"), "to_single")
    new = materialise(both.join(single.toDF("a"), "a", "left_anti").groupBy("b").agg(F.min("key").alias("at")), "joined")
    found = new
    while not new.isEmpty():
        reached = both.join(new.select(F.col("b").alias("a"), "at"), "a").where("key > at").groupBy("b").agg(F.min("key").alias("now"))
        new = materialise(reached.join(found, "b", "left").where("at is null or now < at").select("b", F.col("now").alias("at")), "earlier")
        found = materialise(found.union(new).groupBy("b").agg(F.min("at").alias("at")), "joined")
    times = found.select("b", "at")
    late = alone.join(times.toDF("a", "at_a"), "a", "left").join(times.toDF("b", "at_b"), "b", "left").where("(at_a is null or at_a >= key) and (at_b is null or at_b >= key)")
    late = materialise(late.select(*alone.columns), "barred")
    return e.join(late.select("key"), "key", "left_anti"), late


def prune_bridges(edges, components, guard=None):
    """(kept, dropped with a reason) of typed edges between components: those within one go (inside), with a guard those between single posts go (isolated, see guarded), and of the rest a spanning forest stays, by (type's place in JOINING, force desc, source, target); what is left goes (redundant).

    Borůvka rounds: each component takes its best edge out, which is the sequential result as the order is strict. components: node, component of every post; an unknown end or type is an error. Repeated edges count once.
    """
    components = materialise(components.select("node", "component"), "components")
    e = materialise(between(edges, components).distinct(), "between")
    inside = e.where("a = b").withColumn("reason", F.lit("inside"))
    every = e.where("a <> b").withColumn("key", order_key())
    left, barred = guarded(every, components, guard) if guard else (every, every.limit(0))
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    least = lambda left: materialise(left.groupBy(*ends).agg(F.min("key").alias("key")), "left")  # noqa: E731  of parallel edges
    left, kept = least(left), every.limit(0).select("key")
    while not left.isEmpty():
        x = F.struct("key", "a", "b").alias("x")
        best = left.select(F.col("a").alias("c"), x).union(left.select("b", x)).groupBy("c").agg(F.min("x").alias("x"))
        won = materialise(best.select("x.*").distinct(), "won")
        kept = kept.union(won.select("key"))
        c = materialise(connected_components(won, "a", "b"), "parts")
        left = left.join(c.toDF("a", "na"), "a", "left").join(c.toDF("b", "nb"), "b", "left")
        left = least(left.select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "key").where("a <> b"))
    cols = ["source", "target", "type", "force"]
    reason = lambda x, why: x.select(*cols, F.lit(why).alias("reason"))
    rest = every.join(kept, "key", "left_anti").join(barred.select("key"), "key", "left_anti")
    stay = kept.select("key.source", "key.target", "key.type", (-F.col("key.f")).alias("force"))
    return stay, reason(inside, "inside").unionByName(reason(barred, "isolated")).unionByName(reason(rest, "redundant"))


def prune_counts(kept, dropped):
    """type, inside, isolated, redundant, kept: how many edges of each type went why, and how many stayed."""
    x = dropped.select("type", "reason").unionByName(kept.select("type", F.lit("kept").alias("reason")))
    return x.groupBy("type").agg(*[F.count_if(F.col("reason") == r).alias(r) for r in ("inside", "isolated", "redundant", "kept")])


def cut_edges(nodes, links):
    """{link index: size of one side} of the links (pairs of positions) whose loss parts their component, by one depth-first walk."""
    around = [[] for _ in nodes]
    for k, (a, b) in enumerate(links):
        around[a].append((b, k))
        around[b].append((a, k))
    order, low, size, cut = {}, {}, {}, {}
    for root in range(len(nodes)):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        size[root], stack = 1, [(root, None, iter(around[root]))]
        while stack:
            v, via, rest = stack[-1]
            for w, k in rest:
                if k == via:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = len(order)
                    size[w] = 1
                    stack.append((w, k, iter(around[w])))
                    break
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u], size[u] = min(low[u], low[v]), size[u] + size[v]
                    if low[v] > order[u]:
                        cut[via] = size[v]
    return cut


def split_component(nodes, edges, cap):
    """Indices of the edges cut so that pieces hold at most `cap` nodes, as far as cut edges allow. edges: (source, target, place of the type in CUT_FIRST, force), undirected.

    One edge at a time, the first type in that list and then the weakest force first: the first that leaves both sides within the cap, else the one that halves the piece best.
    """
    gone, todo = [], [(list(nodes), list(range(len(edges))))]
    while todo:
        part, mine = todo.pop()
        if len(part) <= cap:
            continue
        at = {v: i for i, v in enumerate(part)}
        links = [(at[edges[k][0]], at[edges[k][1]]) for k in mine]
        found = cut_edges(part, links)
        if not found:
            continue
        ranked = sorted(found, key=lambda i: (edges[mine[i]][2], edges[mine[i]][3], edges[mine[i]][:2]))
        fits = [i for i in ranked if found[i] <= cap and len(part) - found[i] <= cap]
        pick = fits[0] if fits else min(ranked, key=lambda i: abs(len(part) - 2 * found[i]))
        gone.append(mine[pick])
        keep = [k for i, k in enumerate(mine) if i != pick]
        side, stack, around = {part[links[pick][0]]}, [part[links[pick][0]]], {}
        for k in keep:
            around.setdefault(edges[k][0], []).append(edges[k][1])
            around.setdefault(edges[k][1], []).append(edges[k][0])
        while stack:
            for w in around.get(stack.pop(), []):
                if w not in side:
                    side.add(w)
                    stack.append(w)
        todo.append(([v for v in part if v in side], [k for k in keep if edges[k][0] in side]))
        todo.append(([v for v in part if v not in side], [k for k in keep if edges[k][0] not in side]))
    return sorted(gone)


def split_oversized(edges, cap):
    """Typed edges without those cut to bring components within `cap` nodes. Smaller components pass through untouched; only larger ones reach a task, one each. A type that CUT_FIRST lacks is an error; of repeated edges all go or none; no edges give none."""
    comp = connected_components(edges, "source", "target")
    edges = edges.withColumn("place", place_of(CUT_FIRST, F.col("type")))
    big = comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("component")
    at = edges.join(comp.select(F.col("node").alias("source"), "component"), "source").join(big, "component")
    kind = edges.schema["source"].dataType.simpleString()

    def cut(pdf):
        pdf = pdf.sort_values(["source", "target", "type"]).reset_index(drop=True)
        rows = list(zip(pdf.source, pdf.target, pdf.place, pdf.force))
        return pdf.loc[split_component(sorted({*pdf.source, *pdf.target}), rows, cap), ["source", "target", "type"]]

    gone = at.select("component", "source", "target", "type", "place", "force").groupBy("component").applyInPandas(cut, f"source {kind}, target {kind}, type string")
    return edges.drop("place").join(gone, ["source", "target", "type"], "left_anti")


#: Settings of a matching: cosines at least, decay and window in hours, and the percentile of pair similarities that forces must pass, if any.
PASS = {"least": 0.9, "tau": 6.0, "hours": 48.0, "percent": None}


def build(posts, nova, spokes, first=None, second=None, bridge_least=0.9, caps=(2, 2), graft_least=0.3, graft_force=0.3, guard=None, cap=None):
    """All edges of a corpus (source, target, type, force): grafts, the two matchings, pruned bridges, and the chains' and pools' own edges; components over `cap` split.

    posts: id, embedding, cluster_id, timestamp, engagement. nova and spokes: source, target, force. first and second replace entries of PASS for the matching by influence and for that in time. The first needs engagement, and goes without times if there are none; the second needs times. Posts with times are those whose timestamp is not null. guard: see guarded.
    """
    cols = ["source", "target", "type", "force"]
    typed = lambda e, t: e.withColumn("type", F.lit(t)).select(*cols)
    first, second = PASS | (first or {}), PASS | (second or {})
    posts = materialise(posts, "posts")
    has = posts.agg(F.count("timestamp").alias("timed"), F.count("engagement").alias("engaged")).first()
    thresholds = {q: adaptive_threshold(posts, q) for q in {first["percent"], second["percent"]} - {None}}
    ends = nova.select(F.col("source").alias("id")).union(nova.select("target")).distinct()
    grafts = graft(posts, spokes.select(F.col("source").alias("id")).distinct(), ends, graft_least, graft_force)
    skeleton = typed(nova, "nova").unionByName(typed(spokes, "adept_spoke")).unionByName(typed(grafts, "adept_graft"))
    skeleton = materialise(skeleton, "skeleton")
    loose, of_first = skeleton.limit(0), skeleton.limit(0).select("source", "target", "force")
    if has.engaged:
        above = thresholds.get(first["percent"])
        e = follow(posts, first["least"], first["tau"], first["hours"], True, above) if has.timed else by_engagement(posts, first["least"], above)
        of_first = materialise(match(e, tier_quotas(posts)), "first")
        loose = loose.unionByName(typed(of_first, "temporal_influence"))
    if has.timed:
        e = follow(posts, second["least"], second["tau"], second["hours"], False, thresholds.get(second["percent"]))
        loose = loose.unionByName(typed(match(*second_pass(e, posts, of_first, *caps)), "temporal"))
    loose = loose.unionByName(typed(one_to_one(bridges(posts, bridge_least)), "semantic_inter"))
    comp = connected_components(skeleton, "source", "target")
    comp = posts.select(F.col("id").alias("node")).distinct().join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    joined, _ = prune_bridges(loose, comp, guard)
    out = skeleton.unionByName(joined)
    return split_oversized(materialise(out, "edges"), cap) if cap else out


def incremental(new, existing, make):
    """Edges that touch a new post: `make` over both tables (columns that one lacks are null), then those with a new end. A column is_new tells new posts, for a `make` that can leave other pairs out."""
    both = new.withColumn("is_new", F.lit(True)).unionByName(existing.withColumn("is_new", F.lit(False)), allowMissingColumns=True)
    e, ids = make(both), new.select("id").distinct()
    flag = lambda end: ids.select(F.col("id").alias(end), F.lit(True).alias(f"new_{end}"))
    touched = e.join(flag("source"), "source", "left").join(flag("target"), "target", "left").where("new_source or new_target")
    return touched.select(*e.columns)
