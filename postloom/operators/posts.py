"""Posts: normalisation, ranking, terms, chains."""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window as W, functions as F

from ..functions import text
from ..session import materialise


def engagement_rank(df, file="file", value="engagement", constant=10.0):
    """1 + 9 * percentile rank with average ties within a file; null, NaN and non-numeric values get null. A file whose values are all equal gets `constant`, if given."""
    df = df.withColumn(value, numeric(F.col(value)))
    w = W.partitionBy(file)
    n = F.count(value).over(w)
    r = F.rank().over(w.orderBy(F.col(value).asc_nulls_last())) + (F.count("*").over(W.partitionBy(file, value)) - 1) / 2
    rank = F.when(F.col(value).isNotNull(), 1 + 9 * r / n)
    if constant is not None:
        rank = F.when(F.col(value).isNotNull() & (F.min(value).over(w) == F.max(value).over(w)), F.lit(constant)).otherwise(rank)
    return df.withColumn("rank", rank)


def mean_vectors(df, cluster="cluster_id", vector="embedding"):
    """cluster, size and mean vector of each cluster, null clusters left out."""
    x = df.where(F.col(cluster).isNotNull())
    means = x.select(cluster, F.posexplode(vector).alias("pos", "x")).groupBy(cluster, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    means = means.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).getField("mean").alias("mean_vector"))
    return x.groupBy(cluster).agg(F.count("*").alias("size")).join(means, cluster, "left")


def numeric(c):
    """As a double; null where it is none or NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def order_statistic(df, value, rank, few=10_000):
    """The value of a rank (from 0) among the non-null doubles of a column: counted in ranges, the one that holds the rank refined until it has few values. No task sees a whole column's distinct values."""
    x = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    lo, hi, n = x.agg(F.min("x"), F.max("x"), F.count("*")).first()
    while lo < hi and n > few:
        width = (hi - lo) / 1024
        if lo + width <= lo:
            break
        part = x.where(F.col("x").between(lo, hi)).withColumn("b", F.least(F.floor((F.col("x") - lo) / width), F.lit(1023)))
        for r in sorted(part.groupBy("b").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()):
            if rank < r.n:
                lo, hi, n = r.lo, r.hi, r.n
                break
            rank -= r.n
    if lo == hi:
        return lo
    return sorted(r.x for r in x.where(F.col("x").between(lo, hi)).collect())[rank]


def percentile(df, value, q):
    """The exact percentile (q from 0 to 1), interpolated between neighbours; None for a column without values."""
    n = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).count()
    if not n:
        return None
    at = q * (n - 1)
    low = order_statistic(df, value, int(at))
    if at == int(at):
        return low
    return low + (at - int(at)) * (order_statistic(df, value, int(at) + 1) - low)


def fill_median(df, value="engagement", default=5.5):
    """Missing values get the median of the others, or `default` where there are none."""
    mid = percentile(df, value, 0.5)
    return df.withColumn(value, F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None)), F.lit(default if mid is None else mid)))


def size_buckets(df, value="engagement", cuts=(0.8, 0.95)):
    """'mega', 'big' or 'normal' by the column's percentiles; a missing value counts as 0."""
    had = df.columns
    df = df.withColumn("_v", F.coalesce(numeric(F.col(value)), F.lit(0.0)))
    value = "_v"
    big, mega = (percentile(df, value, q) for q in cuts)
    v = F.col(value)
    return df.withColumn("size", F.when(v >= F.lit(mega), "mega").when(v >= F.lit(big), "big").otherwise("normal")).select(*[c for c in had if c != "size"], "size")


def ensure_ids(df, order, key="id", content="content"):
    """Missing or blank ids become the content's hash, which may repeat; a source id that repeats gets a suffix in `order`."""
    blank = F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == ""
    df = df.withColumn("_made", blank).withColumn(key, F.when(blank, text.content_id(F.col(content))).otherwise(F.col(key).cast("string")))
    n = F.row_number().over(W.partitionBy(key, "_made").orderBy(*order)) - 1
    return df.withColumn(key, F.when(~F.col("_made") & (n > 0), F.concat(key, F.lit("__dup"), n.cast("string"))).otherwise(F.col(key))).drop("_made")


def suffix_duplicates(df, key="id", order=("file", "pos")):
    n = F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn("unique_id", F.when(n == 0, F.col(key)).otherwise(F.concat(key, F.lit("__dup"), n.cast("string"))))


#: Common English words that are no terms.
STOP = tuple(
    "about above after again against all also although always among and another any anyone anything are around because been before behind being below between both but can cannot could did does doing done down during each either else enough even "
    "ever every everyone everything few first for former from further get give had has have having hence her here hers herself him himself his how however into its itself just last latter least less made make many may might mine more moreover most "
    "much must myself neither never nevertheless next nobody none nor not nothing now off often once one only onto other others otherwise our ours ourselves out over own per perhaps please put rather same see seem seemed seems several she should "
    "since some someone something sometimes somewhere still such than that the their theirs them themselves then thence there therefore these they this those though through thus together too toward towards under until upon very was well were what "
    "whatever when whence whenever where whereas wherever whether which while who whoever whole whom whose why will with within without would yet you your yours yourself yourselves".split()
)


#: Words, about, that a task counts at a time.
HELD = 2_000_000


def packed(*columns):
    """Columns of whole numbers from 0 as one whose order is theirs."""
    out = columns[0]
    for c in columns[1:]:
        size = int(c.max(initial=0)) + 1
        if (int(out.max(initial=0)) + 1) * size > 2**62:
            out = np.unique(out, return_inverse=True)[1]
        out = out * size + c
    return out


def counted(table, grams):
    """cluster, term, n, posts of a table of cluster, post (whether it counts as one), words: a row is a post of its own."""
    words = table["words"].combine_chunks()
    doc = np.repeat(np.arange(len(words)), pc.list_value_length(words).fill_null(0).to_numpy(False))
    flat = words.flatten().dictionary_encode()
    first = flat.indices.to_numpy(False).astype(np.int64)
    second = np.zeros(len(first), np.int64)
    if grams == 2:
        next_to = np.flatnonzero(doc[1:] == doc[:-1])
        first, second, doc = np.r_[first, first[next_to]], np.r_[second, first[next_to + 1] + 1], np.r_[doc, doc[next_to]]
    cluster = table["cluster"].combine_chunks().dictionary_encode("encode")
    term = packed(cluster.indices.to_numpy(False).astype(np.int64)[doc], first, second)
    order = np.argsort(packed(term, doc))
    term, doc = term[order], doc[order]
    begin = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
    seen = np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])][: len(term)] & table["post"].to_numpy()[doc]
    at = order[begin]
    after = pa.array(second[at] - 1, mask=second[at] == 0)
    terms = pc.binary_join_element_wise(flat.dictionary.take(pa.array(first[at])), flat.dictionary.take(after), " ", null_handling="skip")
    of = cluster.dictionary.take(cluster.indices).take(pa.array(doc[begin]))
    n, posts = np.diff(np.r_[begin, len(term)]), np.add.reduceat(seen.astype(np.int64), begin) if len(begin) else begin
    return pa.RecordBatch.from_arrays([of, terms, pa.array(n), pa.array(posts)], ["cluster", "term", "n", "posts"])


def counting(grams, held):
    """What a task does with batches for `counted`: it takes about `held` words at a time."""

    def count(batches):
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += len(batch.column("words").flatten())
            if size >= held:
                yield counted(pa.Table.from_batches(kept), grams)
                kept, size = [], 0
        if kept:
            yield counted(pa.Table.from_batches(kept), grams)

    return count


def class_terms(df, cluster="cluster", content="content", key="id", least_posts=2, most=50_000, stop=(), grams=1, held=HELD):
    """Term, cluster, count for the commonest terms that at least `least_posts` posts hold: words but `stop`, and with grams=2 pairs of words next to each other once those are taken out.

    Texts are read once, a task's counts are added up before they are sent, and are sent once, to their term's partition. Posts whose id repeats, which count once in a cluster, are counted apart.
    """
    if grams not in (1, 2):
        raise ValueError("grams: 1 or 2")
    t = df.select(F.col(cluster).alias("cluster"), F.col(key).alias("post"), F.col(content).alias("content"))
    again = materialise(t.where("post is not null").groupBy("post").agg(F.count("*").alias("rows")).where("rows > 1").select("post"), "repeated")
    words = text.tokens(F.col("content"))
    words = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    apart = None
    if not again.isEmpty():
        apart, t = t.join(again, "post", "left_semi").select("cluster", "post", words.alias("words")), t.join(again, "post", "left_anti")
    t = t.select("cluster", F.col("post").isNotNull().alias("post"), words.alias("words"))
    per = t.mapInArrow(counting(grams, held), f"cluster {df.schema[cluster].dataType.simpleString()}, term string, n long, posts long")
    if apart is not None:
        if grams == 2:
            pairs = F.zip_with(F.expr("slice(words, 1, greatest(size(words) - 1, 0))"), F.expr("slice(words, 2, greatest(size(words) - 1, 0))"), lambda x, y: F.concat_ws(" ", x, y))
            apart = materialise(apart, "apart").withColumn("words", F.concat("words", pairs))
        apart = apart.select("cluster", "post", F.explode("words").alias("term"))
        per = per.union(apart.groupBy("cluster", "term").agg(F.count("*").alias("n"), F.count_distinct("post").alias("posts")))
    per = per.where("term is not null").repartition("term")
    # totals and counts read the same columns (the cluster's hash decides nothing), so they come from one exchange
    total = per.groupBy("term").agg(F.sum("n").alias("f"), F.sum("posts").alias("posts"), F.max(F.xxhash64("cluster")).alias("any")).where(F.col("posts") >= least_posts)
    total = total.orderBy(F.desc("f"), "term", "any").limit(most).select("term", "f")
    counts = per.join(F.broadcast(total), "term").groupBy("cluster", "term", "f").agg(F.sum("n").alias("n"), F.sum("posts").alias("posts"))
    return materialise(counts, "counts").select(F.col("cluster").alias(cluster), "term", "n", "f")


def ctfidf(counts, cluster="cluster", top=10):
    """Top terms by sqrt(share of the cluster) * ln(mean cluster size / term total + 1)."""
    size = counts.groupBy(cluster).agg(F.sum("n").alias("size"))
    mean = size.agg(F.floor(F.avg("size")).alias("mean"))
    s = counts.join(size, cluster).crossJoin(F.broadcast(mean))
    s = s.withColumn("score", F.round(F.sqrt(F.col("n") / F.col("size")) * F.log(F.col("mean") / F.greatest("f", F.lit(1)) + 1), 6))
    r = F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("score"), "term"))
    return s.withColumn("place", r).where(F.col("place") <= top).select(cluster, "term", "score", "place")


def chain_links(df, chain, order, key):
    """Parent, depth and role along each chain."""
    w = W.partitionBy(chain).orderBy(order)
    return df.withColumn("parent", F.lag(key).over(w)).withColumn("depth", F.row_number().over(w) - 1).withColumn("role", F.when(F.col("depth") == 0, "pioneer").otherwise("offspring"))


def pinned_order(df, chain, slot, ts, key):
    """Dated rows in time order on the slots dated rows hold; undated rows keep theirs."""
    dated, w = df.where(F.col(ts).isNotNull()), W.partitionBy(chain)
    slots = dated.select(chain, F.col(slot).alias("new_slot"), F.row_number().over(w.orderBy(slot)).alias("r"))
    byt = dated.select(chain, key, F.row_number().over(w.orderBy(ts, slot)).alias("r"))
    return byt.join(slots, [chain, "r"]).select(chain, key, "new_slot").unionByName(df.where(F.col(ts).isNull()).select(chain, key, F.col(slot).alias("new_slot")))


def best_per(df, group, order):
    return df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where("_r = 1").drop("_r")


def relevance_floor(df, score="score", ratio=0.8, fallback=10, key="id"):
    """Rows of at least ratio * the best score (0 if that is not positive); where none is left, the `fallback` best."""
    best = df.agg(F.max(score)).first()[0]
    if best is None:
        return df.limit(0)
    floor = ratio * best if best > 0 else 0.0
    if best >= floor or not fallback:
        return df.where(F.col(score) >= F.lit(floor))
    return df.orderBy(F.desc(score), key).limit(fallback)


def representatives(df, most=15, cluster="cluster_id", key="id", vector="embedding"):
    """The posts of each cluster nearest by cosine to its mean vector: all of them where there are no more than `most`."""
    x = df.where(F.col(cluster).isNotNull())
    s = x.join(mean_vectors(x, cluster, vector).select(cluster, "mean_vector"), cluster).withColumn("score", F.round(text.cosine(F.col(vector), F.col("mean_vector")), 6))
    s = s.select(cluster, key, "score").withColumn("place", F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("score"), key)))
    return s.where(F.col("place") <= most)


def keyword_labels(terms, cluster="cluster", top=5):
    """A cluster's label: its best terms, joined."""
    best = terms.where((F.col("place") <= top) & (F.col("score") > 0)).groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    return best.select(cluster, F.array_join(F.col("t.term"), " · ").alias("label"))


def first_seen(df, group="group_pos", post="post", cluster="cluster", least=2):
    """Of posts that several groups of a cluster claim, each stays with the first; groups then below `least` go, and what they claimed stays used up."""
    x = df.withColumn("_r", F.row_number().over(W.partitionBy(cluster, post).orderBy(group, "pos"))).where("_r = 1").drop("_r")
    return x.join(x.groupBy(cluster, group).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(cluster, group), [cluster, group], "left_semi")


def merge_seeds(*frames, key="id", score="score"):
    """Union of the seeds of several questions, each post once with its best score."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return best_per(out, key, [F.desc(score)])


def pool_roles(df, pool="hub", key="id", ts="timestamp"):
    """hub, pioneer (earliest), latest or member of each post of a pool; only a pool of unlike times has a pioneer and a latest. Undated posts are neither, and ties go to the smaller id."""
    dated = F.struct(ts, key)
    of = df.where(F.col(ts).isNotNull()).groupBy(pool).agg(F.min(dated).alias("lo"), F.max(F.struct(F.col(ts))).alias("hi"), F.min(F.struct(F.col(ts))).alias("first"))
    last = df.where(F.col(ts).isNotNull()).join(of.select(pool, F.col(f"hi.{ts}").alias("_t")), pool).where(F.col(ts) == F.col("_t")).groupBy(pool).agg(F.min(key).alias("_last"))
    x = df.join(of, pool, "left").join(last, pool, "left")
    differ = F.col(f"hi.{ts}") > F.col(f"first.{ts}")
    role = F.when(F.col(key) == F.col(pool), "hub").when(differ & (F.col(key) == F.col(f"lo.{key}")), "pioneer").when(differ & (F.col(key) == F.col("_last")), "latest").otherwise("member")
    return x.select(*df.columns, role.alias("role"))


def budgeted(df, budget, size="n", order="rank"):
    """Groups in order until their sizes add up to `budget`, the one that crosses it included. Groups are few: one a seed."""
    before = F.sum(size).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < budget)
