"""Source divergence audit: how far each source's words lie from those of every other source of its language, and which words set it apart from the language; words are found by upper bounds of count buckets, pairs are summed from postings."""
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import LOWER, by_bytes, utf8

#: Bytes of a term: ASCII letters, and all that is not ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True
COUNTED = "lang string, term string, docs long, sources array<string>, counts array<long>"
SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
UNIT = 1_000_000_000


def terms_of(column):
    """(terms of all rows as a string array, row of each): runs of INSIDE, A-Z lower-cased, not across rows."""
    data, at = utf8(column)
    inside = INSIDE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(data)]
    start[first] = inside[first]
    begins = np.flatnonzero(start)
    offset = np.append((np.cumsum(inside) - 1)[begins], np.count_nonzero(inside)).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offset), pa.py_buffer(LOWER[data[inside]]))
    return terms, np.searchsorted(at, begins, "right") - 1


def codes(column):
    found = pc.fill_null(column, "").dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def counted(docs):
    """Of each stretch of 16 MB of texts: its terms by language, with the number of documents and the counts by source."""

    def run(batches):
        for b in by_bytes(batches, 2, 1 << 24):
            lang, langs = codes(b.column(0))
            source, sources = codes(b.column(1))
            terms, row = terms_of(b.column(2))
            if not len(terms):
                continue
            found = terms.dictionary_encode()
            term, known = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
            of_lang = lambda doc: pd.unique(doc * len(known) + term)  # noqa: E731  a document has a term once
            pairs = of_lang(row)
            key, docs_of = np.unique(pairs % len(known) * len(langs) + lang[pairs // len(known)], return_counts=True)
            triple, n = np.unique((term * len(langs) + lang[row]) * len(sources) + source[row], return_counts=True)
            ends = np.append(np.flatnonzero(np.diff(triple // len(sources), prepend=-1)), len(triple)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (sources.take(pa.array(triple % len(sources))), pa.array(n.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(key % len(langs))), known.take(pa.array(key // len(langs))), pa.array(docs_of.astype(np.int64)), *lists], schema=SCHEMA)

    return docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]).mapInArrow(run, COUNTED)


def merged(parts, least):
    """One row for each (lang, term) of at least `least` documents, with counts summed by source. Rows of a term follow one another, and are added up batch by batch."""

    def add(lang, term, docs, sources, counts):
        """Sums of rows sorted by term and language."""
        (l, _), (t, _), (s, names) = codes(lang), codes(term), codes(sources.flatten())
        first = np.flatnonzero((np.diff(l, prepend=-1) != 0) | (np.diff(t, prepend=-1) != 0))
        group = np.zeros(len(l), np.int64)
        group[first] = 1
        group = np.cumsum(group) - 1
        entry = np.repeat(group, pc.list_value_length(sources).to_numpy()) * max(1, len(names)) + s
        key, at = np.unique(entry, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, counts.flatten().to_numpy())
        ends = np.searchsorted(key // max(1, len(names)), np.arange(len(first) + 1)).astype(np.int32)
        held = pa.array(ends)
        own = [pa.ListArray.from_arrays(held, names.take(pa.array(key % max(1, len(names))))), pa.ListArray.from_arrays(held, pa.array(total))]
        return [lang.take(pa.array(first)), term.take(pa.array(first)), pa.array(np.add.reduceat(docs.to_numpy(), first)), *own]

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [c if held is None else pa.concat_arrays([h, c]) for h, c in zip(held or b.columns, b.columns)]
            out = pa.RecordBatch.from_arrays(add(*columns), schema=SCHEMA)
            held = [pa.concat_arrays([c.slice(len(c) - 1)]) for c in out.columns]
            done = out.slice(0, out.num_rows - 1)
            yield done.filter(pc.greater_equal(done.column(2), least))
        if held and held[2][0].as_py() >= least:
            yield pa.RecordBatch.from_arrays(held, schema=SCHEMA)

    return parts.repartition("lang", "term").sortWithinPartitions("term", "lang").mapInArrow(run, COUNTED)


def share(count, total, terms):
    """1 + floor(10^9 (count + 1) / (total + terms))."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(20, 0)) * {UNIT}) div greatest({total} + {terms}, 1)")


def spread(p, q):
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


PAIRS = "lang string, source string, item string, own long, other long, n long"


def shared(postings, most=2_000_000):
    """How many terms two sources of a language have with such counts each, from the terms that both have; source before item."""

    def run(batches):
        for b in batches:
            lang, langs = codes(b.column(0))
            length = pc.list_value_length(b.column(1)).to_numpy().astype(np.int64)
            work, lo = np.cumsum(length * length), 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + most, "right")))
                sources, names = codes(b.column(1).slice(lo, hi - lo).flatten())
                order = np.argsort(pc.rank(names, sort_keys="ascending").to_numpy()) if len(names) else np.empty(0, np.int64)
                place = np.empty(len(names), np.int64)
                place[order] = np.arange(len(names))
                source, count, n = place[sources], b.column(2).slice(lo, hi - lo).flatten().to_numpy(), length[lo:hi]
                begin = np.cumsum(n) - n
                x = np.repeat(np.arange(len(source)), np.repeat(n, n))
                y = np.repeat(np.repeat(begin, n) - np.append(0, np.cumsum(np.repeat(n, n))[:-1]), np.repeat(n, n)) + np.arange(len(x)) if len(x) else x
                keep = source[x] < source[y]
                x, y = x[keep], y[keep]
                of = np.repeat(lang[lo:hi], n)
                found = pd.DataFrame({"l": of[x], "s": source[x], "o": source[y], "cs": count[x], "co": count[y]}).value_counts(sort=False).reset_index()
                names = names.take(pa.array(order))
                texts = [langs.take(pa.array(found.l)), names.take(pa.array(found.s)), names.take(pa.array(found.o))]
                yield pa.RecordBatch.from_arrays([*texts, pa.array(found.cs), pa.array(found.co), pa.array(found["count"])], names=[c.split(" ")[0] for c in PAIRS.split(", ")])
                lo = hi

    found = postings.select("lang", "sources", "counts").mapInArrow(run, PAIRS)
    return found.groupBy("lang", "source", "item", "own", "other").agg(F.sum("n").alias("n"))


def pairs(entries, postings, groups):
    """lang, source, item, value: the sum over all kept terms. All terms count as if both sources lacked them; counts of one source correct that by its histogram; terms that both have are corrected once more, from the postings."""
    a = groups.selectExpr("lang", "source", "total a_total", "terms", "zero a_zero")
    b = groups.selectExpr("lang", "source item", "total b_total", "zero b_zero")
    both = materialise(a.join(b, "lang").where("source <> item"), "pairs")
    base = both.select("lang", "source", "item", (F.col("terms") * spread("a_zero", "b_zero")).alias("value"))
    bars = materialise(entries.groupBy("lang", "source", "c").agg(F.count("*").alias("n")), "histograms")
    own = both.join(bars, ["lang", "source"]).withColumn("p", share("c", "a_total", "terms"))
    own = own.select("lang", "source", "item", (F.col("n") * (spread("p", "b_zero") - spread("a_zero", "b_zero"))).alias("value"))
    other = both.join(bars.withColumnRenamed("source", "item"), ["lang", "item"]).withColumn("q", share("c", "b_total", "terms"))
    other = other.select("lang", "source", "item", (F.col("n") * (spread("a_zero", "q") - spread("a_zero", "b_zero"))).alias("value"))
    met = materialise(shared(postings), "shared")
    met = met.union(met.select("lang", "item", "source", "other", "own", "n"))
    met = met.join(both, ["lang", "source", "item"]).withColumn("p", share("own", "a_total", "terms")).withColumn("q", share("other", "b_total", "terms"))
    met = met.select("lang", "source", "item", (F.col("n") * (spread("p", "q") - spread("p", "b_zero") - spread("a_zero", "q") + spread("a_zero", "b_zero"))).alias("value"))
    parts = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (own, other, met)]
    found = base
    for x in parts:
        found = found.union(x)
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


#: Counts up to 31 are buckets of their own; beyond, there are 16 to a power of two.
BUCKET = "if(c < 32, c, (length(bin(c)) - 1) * 16 + shiftright(c, cast(length(bin(c)) - 5 as int)))"


def top_terms(entries, groups, k, growth=8):
    """lang, source, item, value, rank of the k terms of largest value of each group, among those it has with p > q.

    A bucket's bound is the value that its largest count would have with its least probability in the language; value grows with p and falls with q where p > q. Buckets are evaluated by falling bounds, `growth` times as many terms in each round, until the bounds of all that is left lie strictly below the group's k-th value.
    """
    entries = entries.withColumn("bucket", F.expr(BUCKET))
    buckets = entries.groupBy("lang", "source", "bucket").agg(F.count("*").alias("n"), F.max("c").alias("c"), F.min("all").alias("all"))
    buckets = buckets.join(groups, ["lang", "source"]).withColumn("p", share("c", "total", "terms")).withColumn("q", share("all", "of_lang", "terms")).where("p > q")
    buckets = buckets.withColumn("bound", spread("p", "q"))
    before = F.sum("n").over(Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")) - F.col("n")
    buckets = materialise(buckets.select("lang", "source", "bucket", "bound", "total", "terms", "of_lang", before.alias("before")), "buckets")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    spark, found, upto, done = entries.sparkSession, None, k, 0
    while True:
        left = buckets.where(f"before >= {done}")
        if found is not None:
            kth = found.groupBy("lang", "source").agg(F.count("*").alias("have"), F.min("value").alias("kth")).where(f"have >= {k}")
            left = left.join(kth.drop("have"), ["lang", "source"], "left").where("kth is null or bound >= kth").drop("kth")
            if left.isEmpty():
                break
        new = entries.join(left.where(f"before < {upto}"), ["lang", "source", "bucket"]).withColumn("p", share("c", "total", "terms")).withColumn("q", share("all", "of_lang", "terms"))
        new = new.where("p > q").select("lang", "source", F.col("term").alias("item"), spread("p", "q").alias("value"))
        new = new if found is None else found.union(new)
        found = materialise(new.withColumn("r", F.row_number().over(best)).where(f"r <= {k}").drop("r"), "best")
        done, upto = upto, upto * growth
    return found.withColumn("rank", F.row_number().over(best))


def audit(docs, least=3, k=200):
    """lang, source, part, item, value long, rank int. Terms are runs of ASCII letters and of what is not ASCII, A-Z lower-cased; a language keeps those in at least `least` of its documents, V in number.

    A group, a source of a language or the whole language, gives a kept term p = 1 + floor(10^9 (count + 1) / (N + V)), N the sum of its counts over kept terms; value = floor((p - q)^2 / q), p the group's. Part `pair`: each other source of the language, q its p, summed over all kept terms. Part `term`: kept terms that the group has with p > q, q the language's, the k first. Ranks by falling value, then by item in UTF-8 order.

    Null text, lang and source are ''. Each row is a document, whatever its id; repeated rows count each. A group without kept terms has its pairs (0 where the language keeps none) and no terms; a language with one source has no pairs; an empty table gives no rows. Other columns are not used. Sums are exact as long as V is below 8 * 10^9: then no value passes 2^63.
    """
    postings = materialise(merged(counted(docs), least), "postings")
    entries = postings.withColumn("all", F.expr("aggregate(counts, 0l, (a, x) -> a + x)"))
    entries = entries.select("lang", "term", "all", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", F.col("e.sources").alias("source"), "term", F.col("e.counts").alias("c"), "all")
    own = entries.groupBy("lang", "source").agg(F.sum("c").alias("total"))
    of_lang = postings.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.expr("aggregate(counts, 0l, (a, x) -> a + x)")).alias("of_lang"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    groups = materialise(groups.withColumn("zero", share("0", "total", "terms")), "groups")
    apart = pairs(entries, postings, groups)
    apart = apart.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return apart.withColumn("part", F.lit("pair")).select(out).union(top_terms(entries, groups, k).withColumn("part", F.lit("term")).select(out))
