"""Exact n-gram Jaccard join by universe partition: signatures of segment subsets and one-deletion neighbourhoods, cost-based allocation, exact verification.

A vertex of the link graph is a set of shingles, not an id: rows of equal sets are one class, named `node`, the first 64 bits of the set's digest.
"""
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W, functions as F

from ..operators.components import connected_components
from ..session import materialise, release
from .arrow import U, by_bytes, lists, mix, words_of_rows

GRAM = 5


def sets_of(column, n=GRAM):
    """For each row of a string column, the sorted distinct 64-bit hashes of its n-word shingles; fewer words make one shingle; no words, none."""
    h, at = words_of_rows(column)
    m = max(0, len(h) - n + 1)
    whole = np.full(m, n, U)
    for i in range(n):
        whole = mix(whole * U(0x9E3779B97F4A7C15) + h[i : i + m])
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= n:
            yield np.unique(whole[lo : hi - n + 1])
        elif hi == lo:
            yield np.empty(0, U)
        else:
            one = np.full(1, hi - lo, U)
            for x in h[lo:hi]:
                one = mix(one * U(0x9E3779B97F4A7C15) + x)
            yield one


def most(r, s):
    """Largest symmetric difference of linked sets of r and s elements: 9 * difference <= r + s at similarity 0.8."""
    return (r + s) // 9


#: The cost model takes this share of all documents to share some passage, and such a passage to be half of a document.
COMMON, SHARED = 1e-3, 0.5


@lru_cache(1024)
def allocate(hi, docs):
    """(one-deletion segments m1, exact segments m0, universe share of the former, subset size k) of a size band, by least expected cost.

    Of D differences either some one-deletion segment holds at most one, or at most D - 2 * m1 fall in the m0 exact segments. A document keeps D - 2 * m1 + k
    of these, by an order that depends on their content alone, so two linked sets keep k in common: every k-subset of those kept is a signature.
    Cost: signatures a document emits, plus documents expected to meet it by chance under each.
    """
    h, size, best = most(hi, hi * 5 // 4), 0.75 * hi, None
    for m1 in range(0, min(3, (h + 1) // 2) + 1):
        for k in (1, 2):
            need = h - 2 * m1 + k
            if need < k:
                need, ms = 0, [0]
            else:
                ms = sorted({int(np.ceil(need * x)) for x in (1, 1.1, 1.25, 1.5)})
            for m0 in ms:
                share = 2 * m1 / (2 * m1 + m0) if m1 else 0.0
                keys = need * (need - 1) / 2 if k == 2 else need
                held = size * (1 - share) / m0 if m0 else 0
                met = keys * np.exp(-held * (1 - SHARED) * k)
                short = m1 * (1 + size * share / m1) * np.exp(-size * share / m1 * (1 - SHARED)) if m1 else 0
                cost = keys + m1 + size * share + (met + short) * docs * COMMON
                if best is None or cost < best[0]:
                    best = cost, m1, m0, share, k
    return best[1:]


def band(n):
    return int(n).bit_length()


def signatures(s, docs):
    """Signatures of a sorted set: own band's scheme, and the band below if a linked set may lie there. Two linked sets share one. `docs` steers the cost only.

    Segments are ranges of the hash universe; larger ones, which fewer documents share, are kept first.
    """
    n, out = len(s), []
    total, at = np.zeros(n + 1, U), s >> U(11)
    np.cumsum(mix(s), out=total[1:])
    at = at.astype(np.float64) / 2.0**53
    for b in (band(n), band(n) - 1):
        top = 2**b - 1
        if b < 3 or (b < band(n) and 5 * top < 4 * n):
            continue
        m1, m0, share, k = allocate(top, docs)
        limit = most(n, n * 5 // 4 if b == band(n) else top)
        edges = np.concatenate([np.arange(m1) * share / max(m1, 1), share + np.arange(m0) * (1 - share) / max(m0, 1)])
        cut = np.searchsorted(at, edges)
        cut[0], cut = 0, np.append(cut, n)
        sums, count = total[cut[1:]] - total[cut[:-1]], np.diff(cut)
        seed = mix(np.arange(m1 + m0).astype(U) + U(b << 32))
        full = mix(sums ^ seed)
        out.append(full[:m1])
        for i in range(m1):
            out.append(mix((sums[i] - mix(s[cut[i] : cut[i + 1]])) ^ seed[i]))
        keep = max(0, limit - 2 * m1 + k) if m0 else 0
        kept = full[m1:][np.lexsort((full[m1:], -count[m1:]))[:keep]]
        if k == 2 and len(kept):
            i, j = np.triu_indices(len(kept), 1)
            kept = mix(np.minimum(kept[i], kept[j]) * U(3) + np.maximum(kept[i], kept[j]))
        out.append(kept)
    return np.unique(np.concatenate(out)) if out else np.empty(0, U)


NARROW, PARITY = 400, [f"p{i}" for i in range(8)]


def parity(s, bits=512):
    """`bits` parity bits as longs. Two sets' bits differ in no more places than their elements do, so the count bounds the difference from below."""
    return np.packbits((np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def wide(s):
    """For a set of over NARROW elements, 2 to 4 parity bits an element: 512 would say nothing of large differences."""
    return parity(s, 2 << band(len(s))) if len(s) > NARROW else None


def may_link(a, b):
    """SQL over n{a}, p0{a}.., w{a} and those of b: false only for pairs that cannot be linked, by sizes and by parity bits. The longer array of bits is folded onto the shorter."""
    apart = " + ".join(f"bit_count({p}{a} ^ {p}{b})" for p in PARITY)
    half = "transform(slice({0}, 1, size({0}) div 2), (v, i) -> v ^ {0}[i + size({0}) div 2])"
    x, y = (f"if(size({p}) > size({q}), {half.format(p)}, {p})" for p, q in ((f"w{a}", f"w{b}"), (f"w{b}", f"w{a}")))
    by_wide = f"9 * aggregate(zip_with({x}, {y}, (u, v) -> bit_count(u ^ v)), 0, (t, c) -> t + c) <= n{a} + n{b}"
    return f"5 * least(n{a}, n{b}) >= 4 * greatest(n{a}, n{b}) and 9 * ({apart}) <= n{a} + n{b} and (w{a} is null or w{b} is null or {by_wide})"


FACTS = [("n", pa.int64()), *[(p, pa.int64()) for p in PARITY], ("w", pa.list_(pa.int64()))]
PROFILE = "key long, th long, doc_id long, node long, n long, " + ", ".join(f"{p} long" for p in PARITY) + ", w array<long>, sigs array<long>"


def profiles(df, id_col, text_col, nameless=False):
    """One row per row of df, from one reading of its text: a row number, the text's hash (JVM), the set's node, size, parity bits and signatures, unless this worker has just given them for the set. A row with a null id has none if it takes no part (not `nameless`), so that another row of its set gets them."""
    docs = df.count()
    x = df.select(F.xxhash64(F.col(text_col)).alias("th"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        key, seen = TaskContext.get().partitionId() << 33, set()
        for b in by_bytes(batches, 2):
            node, n, bits, ws, sigs = [], [], [], [], []
            part = np.full(b.num_rows, True) if nameless else b.column(1).is_valid().to_numpy(zero_copy_only=False)
            for s, takes_part in zip(sets_of(b.column(2)), part.tolist()):
                d = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
                node.append(int.from_bytes(d, "little", signed=True) if len(s) else None)
                n.append(len(s))
                bits.append(parity(s))
                ws.append(wide(s))
                if not takes_part or len(s) < 4 or d in seen:
                    sigs.append(None)
                else:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(d)
                    sigs.append(signatures(s, docs).view(np.int64))
            bits = np.array(bits, np.int64).reshape(-1, len(PARITY))
            key, keys = key + len(n), pa.array(np.arange(key, key + len(n)))
            some = lambda xs: pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [0 if x is None else len(x) for x in xs]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *[x for x in xs if x is not None]])), mask=pa.array([x is None for x in xs]))
            cols = [keys, b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(PARITY))], some(ws), some(sigs)]
            names = ["key", "th", "doc_id", "node", "n", *PARITY, "w", "sigs"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return materialise(x.mapInArrow(run, PROFILE), "profile")


def bitmap(nodes, words=1 << 17):
    """(place, bits): a map of `words` longs at most in which every hash of a one-column frame has its bit; its size does not grow with the data."""
    h = nodes.toDF("h").where("h is not null")
    return h.selectExpr(f"cast(pmod(shiftright(h, 6), {words}) as int) place", "shiftleft(1L, cast(h & 63 as int)) bit").groupBy("place").agg(F.bit_or("bit").alias("bits"))


def sets_for(df, text_col, hashes):
    """(node, s) of the rows whose text hash is in a one-column frame, and of a few others that share its bit. The text does not move."""
    x = df.select(F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("text"))
    x = x.withColumn("place", F.expr(f"cast(pmod(shiftright(h, 6), {1 << 17}) as int)")).join(F.broadcast(bitmap(hashes)), "place").where("shiftleft(1L, cast(h & 63 as int)) & bits <> 0").select("text")

    def run(batches):
        seen = set()
        for b in by_bytes(batches, 0):
            node, out = [], []
            for s in sets_of(b.column(0)):
                d = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                if len(s) and d not in seen:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(d)
                    node.append(d)
                    out.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), lists(out, np.int64)], names=["node", "s"])

    return x.mapInArrow(run, "node long, s array<long>")


def verify(df, text_col, pairs, classes):
    """The linked ones of pairs (a, b) of nodes, by exact intersection of their sets."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    hashes = nodes.join(classes.select("node", "th"), "node").select("th")
    sets = materialise(sets_for(df, text_col, hashes).join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")
    return pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").where("180 * size(array_intersect(x, y)) >= 80 * (size(x) + size(y))").select("a", "b")


def buckets(df, id_col, text_col, nameless=False):
    """(profile, classes of equal sets, (sig, node, lead) of every signature that several classes share). Rows with a null id are in classes only if `nameless`."""
    profile = profiles(df, id_col, text_col, nameless)
    known = profile.where("node is not null" if nameless else "node is not null and doc_id is not null")
    first = known.groupBy("node").agg(F.min("key").alias("key"), F.min("doc_id").alias("rep"))
    facts = known.select("key", "th", *[c for c, _ in FACTS])
    classes = materialise(first.join(facts, "key").drop("key"), "classes")
    found = known.select("node", F.explode("sigs").alias("sig"))
    shared = found.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig")  # copies count too: this shuffle takes half the room of one with the nodes
    met = materialise(found.join(shared, "sig").distinct(), "shared")
    leads = met.groupBy("sig").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last").select("sig", "lead")
    met = materialise(met.join(leads, "sig"), "buckets")
    release(df.sparkSession)
    return profile, classes, met


def once(met, *keep):
    """Of buckets that hold the same classes, the one of least signature: a row per bucket, with what `keep` aggregates."""
    same = [F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2")]
    return met.groupBy("sig").agg(*same, *keep)


def candidates(x, y, on, apart, tried=None):
    pairs = x.join(y, on).where(f"{apart} and " + may_link("_x", "_y")).selectExpr("least(node_x, node_y) a", "greatest(node_x, node_y) b").distinct()
    return materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")


def side(df, k, *keys):
    return df.select(*keys, *[F.col(c).alias(f"{c}{k}") for c in ("node", *[c for c, _ in FACTS], "c") if c in df.columns])


def links_of(df, id_col="doc_id", text_col="text"):
    """(links, members): every pair (a < b) of classes of equal sets that are linked, and doc_id, n_shingles, class_id, n_links, component_id of every row.

    a, b and class_id are the class's node; n_links counts the other classes that a row's class is linked with. Null or empty text has no class; rows with a null id
    have none either and are linked with nothing. Every pair of classes that shares a bucket and may be linked is verified, also within a component: as many steps as there are
    links, at least, so quadratic in a group of near copies. Components are those of classes_of, which does not need every link. Extra columns are not carried.
    """
    profile, classes, met = buckets(df, id_col, text_col)
    kept = once(met).groupBy("k", "h1", "h2").agg(F.min("sig").alias("sig")).select("sig")
    at = materialise(met.select("sig", "node").join(kept, "sig").join(classes, "node"), "members")
    pairs = candidates(side(at, "_x", "sig"), side(at, "_y", "sig"), "sig", "node_x < node_y")
    links = materialise(verify(df, text_col, pairs, classes), "links")
    comp = connected_components(links, "a", "b").toDF("node", "c")
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    out = named_rows(profile, classes.join(comp, "node", "left").select("node", "rep", F.coalesce("c", "node").alias("c")))
    out = out.join(degree, "node", "left")
    return links, out.selectExpr("doc_id", "n_shingles", "case when doc_id is not null then node end class_id", "case when doc_id is null then 0 else coalesce(n_links, 0) end n_links", "component_id")


def named_rows(profile, named):
    """Every row with its component's smallest id: named is (node, rep, c)."""
    least = named.groupBy("c").agg(F.min("rep").alias("component"))
    return profile.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named.join(least, "c").select("node", "component"), "node", "left").withColumn("component_id", F.expr("case when doc_id is null then null else coalesce(component, doc_id) end"))


#: Classes of a bucket that the second round verifies its members against.
LEADS = 4


def components_of(df, text_col, classes, met):
    """(node, rep, c): c is equal for classes that links join.

    In each bucket every class is verified against the bucket's smallest; then, in buckets that still hold several components, against a few more; then
    all pairs of different components that sizes and parity bits leave are verified, so no link that could join two components is lost.
    """

    def merged(named, pairs):
        """named with the components that verified pairs join."""
        at = named.select("node", "c")
        ends = verify(df, text_col, pairs, classes).join(at.toDF("a", "ca"), "a").join(at.toDF("b", "cb"), "b").select("ca", "cb")
        comp = connected_components(ends, "ca", "cb").toDF("c", "to")
        return materialise(named.join(comp, "c", "left").select("node", "rep", *[c for c, _ in FACTS], F.coalesce("to", "c").alias("c")), "named")

    def unsettled(named):
        """Members (sig, node) of buckets that hold several components, once for buckets of the same members; and some leads of each."""
        told = materialise(met.select("sig", "node").join(named.select("node", "c"), "node"), "told")
        leads = F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(2, 2 + LEADS)])).alias("leads")
        mixed = once(told, F.min("c").alias("lo"), F.max("c").alias("hi"), leads).where("lo <> hi")
        mixed = mixed.groupBy("k", "h1", "h2").agg(F.min_by(F.struct("sig", "leads"), "sig").alias("m")).select("m.*")
        return told.select("sig", "node").join(mixed, "sig")

    named = classes.drop("th").withColumn("c", F.col("node"))
    near, tried = met.where("node <> lead").select("node", "lead").distinct(), None
    for last in (False, True):
        x = near.join(named.select("node", *[F.col(c).alias(f"{c}_x") for c in (*[c for c, _ in FACTS], "c")]), "node").withColumnRenamed("node", "node_x")
        y = named.select(F.col("node").alias("lead"), *[F.col(c).alias(f"{c}_y") for c in (*[c for c, _ in FACTS], "c")])
        pairs = candidates(x, y.withColumn("node_y", F.col("lead")), "lead", "c_x <> c_y", tried)
        tried = pairs if tried is None else tried.union(pairs)
        named = merged(named, pairs)
        left = unsettled(named)
        if not last:
            near = left.select("node", F.explode("leads").alias("lead")).where("node <> lead").distinct()
    left = materialise(left.select("sig", "node").join(named, "node"), "mixed")
    pairs = candidates(side(left, "_x", "sig"), side(left, "_y", "sig"), "sig", "c_x < c_y", tried)
    return named if pairs.isEmpty() else merged(named, pairs)


def classes_of(df, id_col="doc_id", text_col="text"):
    """doc_id, n_shingles, component_id of every row: components of the graph that links sets of Jaccard similarity 0.8 or more.

    Null or empty text: an empty set, its own component. Null ids: component null, linked with nothing. Rows that repeat an id each keep their own text's component.
    An empty table gives no rows. Links within a component are left to links_of. Extra columns are not carried.
    """
    profile, classes, met = buckets(df, id_col, text_col)
    return named_rows(profile, components_of(df, text_col, classes, met)).select("doc_id", "n_shingles", "component_id")


def keep_first(df, id_col="doc_id", text_col="text"):
    """One row of df for each component, that of the smallest id (null ids last), as it is; all rows without words.

    Of rows that repeat an id and text one stays, and a text of its own stays whatever its id. All of df's columns come back, whatever their names.
    """
    profile, classes, met = buckets(df, id_col, text_col, nameless=True)
    named = components_of(df, text_col, classes, met).select("node", "c")
    # the first row of each class, then of each component: both aggregate before they shuffle
    first = profile.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "th")).alias("f"))
    kept = materialise(first.join(named, "node").groupBy("c").agg(F.min("f").alias("f")).select("f.doc_id", "f.th"), "kept")
    text = F.col(text_col).cast("string")
    words = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = df.where(words).select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["th"] == kept["th"]), "left_semi")
    once = rows.withColumn("r", F.row_number().over(W.partitionBy("doc_id", "th").orderBy("doc_id")))  # partitioned and sorted so already
    return once.where("r = 1").select("row.*").unionByName(df.where(~words))
