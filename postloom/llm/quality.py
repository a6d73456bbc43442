"""Importance resampling: hashed n-gram models of target and raw text, their ratio, and Gumbel top-k."""
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import in_parts

BUCKETS, SHAPES = 1 << 15, 8


def shape(word):
    """0 lower or plain, 1 capitalised, 2 upper, 3 marks only, 4 letters with odd marks, 5 digits, 6 mixed case."""
    core = word.strip(".,;:!?\"'()")
    if not re.search(r"\w", word):
        return 3
    if re.search(r"[^\w.,;:'()\"-]", word):
        return 4
    if core.isupper() and len(core) > 1:
        return 2
    return 5 if core.isdigit() else 0 if core.islower() or not core[:1].isalpha() else 1 if core[1:].islower() or len(core) == 1 else 6


def features(text, cache):
    """Buckets of a text's word unigrams and bigrams (hashed) and of its shape trigrams, where shape 7 is a word repeated."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    for w in set(words).difference(cache):  # of the dict: a difference from its keys view walks the whole cache
        cache[w] = zlib.crc32(w.lower().encode()) << 3 | shape(w)
    x = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    if len(cache) > 300_000:
        cache.clear()
    h, s = x >> 3, x & 7
    s[1:][h[1:] == h[:-1]] = 7
    two = (h[:-1] * 1_000_003 ^ h[1:]) * 2_654_435_761 >> 7
    pad = np.concatenate([[0, 0], s])
    tri = pad[:-2] * 64 + pad[1:-1] * 8 + s
    return np.concatenate([h % (BUCKETS // 2), BUCKETS // 2 + two % (BUCKETS // 2), BUCKETS + tri])


def sample_labels(labels, column, most=20_000):
    """doc_id -> 0 or 1 of about `most` labelled documents, or all if there are fewer, chosen by a hash; the smaller of conflicting labels holds. Null labels are ignored."""
    one = labels.where(f"doc_id is not null and {column} is not null").groupBy("doc_id").agg(F.min(column).alias("y"))
    n = one.count()
    some = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most) if n > most else one
    return {r.doc_id: int(r.y) for r in some.collect()}


def count_models(texts, good):
    """Counts of each bucket in raw text (all rows) and in target text (rows in `good`)."""
    sent, size = texts.sparkSession.sparkContext.broadcast(good), BUCKETS + 512

    def run(batches):
        cache, total = {}, np.zeros((2, size))
        for b in in_parts(batches, 100):
            got = [features(t, cache) for t in b.column(1).to_pylist()]
            total[0] += np.bincount(np.concatenate(got), minlength=size)
            mine = [x for x, d in zip(got, b.column(0).to_pylist()) if d in sent.value]
            if mine:
                total[1] += np.bincount(np.concatenate(mine), minlength=size)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[0, some]), pa.array(total[1, some])], names=["i", "raw", "target"])

    cells = texts.mapInArrow(run, "i int, raw double, target double").groupBy("i").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    out = np.zeros((2, size))
    out[:, cells.i] = cells[["raw", "target"]].to_numpy().T
    return out


def log_ratio(counts, prior=50.0):
    """log target / raw per bucket; target shrinks towards raw by `prior` occurrences a bucket."""
    out = np.zeros(counts.shape[1])
    for part in (slice(0, BUCKETS // 2), slice(BUCKETS // 2, BUCKETS), slice(BUCKETS, None)):
        raw, target = counts[0, part] + 0.5, counts[1, part]
        q, b = raw / raw.sum(), prior * (len(raw) if part.start != BUCKETS else 2)
        out[part] = np.log((target + b * q) / (target.sum() + b)) - np.log(q)
    return out


def threshold(scores, y, even=True):
    """The cut between labelled documents of kind 0 and 1 of best accuracy, in the middle of its gap; if even, both kinds weigh the same."""
    order = np.argsort(scores)
    s, y = scores[order], np.asarray(y)[order]
    if not len(y) or y.all() or not y.any():
        return -np.inf
    gain = np.concatenate([[0], np.cumsum(np.where(y == 0, 1 / (y == 0).sum(), -1 / y.sum()) if even else np.where(y == 0, 1, -1))])
    k = int(gain.argmax())
    return -np.inf if k == 0 else (s[k - 1] + s[min(k, len(s) - 1)]) / 2


def kth_largest(df, col, k):
    """Value of the k-th largest long of a column, by counting in 4096 ranges and refining the one that holds it."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    while lo < hi:
        width = (hi - lo) // 4096 + 1
        bins = {r.b: r["count"] for r in df.where(F.col(col).between(lo, hi)).groupBy(F.expr(f"({col} - {lo}L) div {width}L").alias("b")).count().collect()}
        for b in sorted(bins, reverse=True):
            if k <= bins[b]:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            k -= bins[b]
    return lo


def resample(docs, labels, carry=False, seed=7, most=20_000):
    """doc_id, log_weight, gumbel_key, keep of every row, and with carry the row itself as a struct: keep the k largest log weight + Gumbel keys, compared at 2^-20, ties kept.

    k is the number of documents whose log weight passes the cut learnt on about `most` labelled rows, so the sample is as large as the text
    that resembles the target. Null or empty text weighs 0. Without labels of both kinds every row is kept. Null ids are scored like others, and
    rows of one id share its Gumbel draw. The names of other columns don't matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    y = sample_labels(labels, "quality", most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratio = spark.sparkContext.broadcast(log_ratio(count_models(texts, {d for d, v in y.items() if v})) if any(y.values()) else np.zeros(BUCKETS + 512))

    @F.pandas_udf("double")
    def weigh(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = {}
        for part in parts:
            yield pd.Series([float(ratio.value[features(t, cache)].sum()) for t in part])

    uniform = f"(shiftrightunsigned(xxhash64(doc_id, {seed}), 11) + 0.5D) / 9007199254740992D"

    def scores(carry):
        x = docs.select(*([F.struct("*").alias("row")] if carry else []), F.col("doc_id").cast("long").alias("doc_id"), weigh(F.col("text").cast("string")).alias("log_weight"))
        return x.withColumn("gumbel_key", F.expr(f"log_weight - ln(-ln({uniform}))")).withColumn("k", F.expr("cast(floor(gumbel_key * 1048576) as bigint)"))

    scored = materialise(scores(False), "weights")
    cut = -np.inf
    if len(set(y.values())) == 2:
        known = spark.createDataFrame(list(y.items()), "doc_id long, y int")
        lab = scored.select("doc_id", "log_weight").join(F.broadcast(known), "doc_id").toPandas()
        cut = threshold(lab.log_weight.to_numpy(), lab.y.to_numpy())
    k = scored.where(F.col("log_weight") >= float(cut)).count()
    edge = kth_largest(scored, "k", k) if k else 2**62
    # with rows, weights are found anew as the rows are read, which gives the same ones: a second copy of all text would be dearer
    return (scores(True) if carry else scored).withColumn("keep", F.col("k") >= F.lit(edge)).drop("k")
