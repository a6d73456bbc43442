"""Masked pseudo-likelihood of every word: a window network in numpy predicts its class from the classes of two words on either side, counts over the corpus the word in its class."""
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import materialise, release
from .arrow import U, by_bytes, mix, words_of_rows
from .quality import kth_largest

#: Commonest words whose counts every worker holds; those of the others are joined.
TOP = 1 << 17
V, ENDINGS, D, OFFSETS = 128, 32, 16, (-2, -1, 1, 2)  # classes, of which so many by ending; width; places seen
SHAPE = len(OFFSETS) * V * D + D * V + V


def split(p):
    e, u = len(OFFSETS) * V * D, D * V
    return p[:e].reshape(len(OFFSETS), V, D), p[e : e + u].reshape(D, V), p[e + u :]


CUT = "chunk long, ids array<long>, lens array<long>, x binary, w array<long>, h array<int>, n array<long>"
CODED = "key long, ids array<long>, lens array<long>, x binary, within array<double>, rest_doc array<long>, rest_w array<long>"


def cut(batches, most=2**18):
    """A row for each chunk of whole documents, of about `most` words and as many documents at most: ids, lengths, words as places in the chunk's list of words, and that list with each word's ending class and count."""
    from pyspark import TaskContext

    chunk, held = TaskContext.get().partitionId() << 16, []

    def emit():
        words = np.concatenate([x[2] for x in held])
        w, first, at, n = np.unique(words, return_index=True, return_inverse=True, return_counts=True)
        h = mix(np.concatenate([x[3] for x in held])[first].astype(U)) % U(ENDINGS)
        row = [[chunk], [[d for x in held for d in x[0]]], [np.concatenate([x[1] for x in held])], [at.astype(np.int32).tobytes()], [w.view(np.int64)], [h.astype(np.int32)], [n]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in CUT.split(", ")])

    for b in by_bytes(batches, 1):
        h, at, last = words_of_rows(b.column(1), endings=True)
        held.append((b.column(0).to_pylist(), np.diff(at), h, last))
        if sum(len(x[2]) for x in held) >= most or sum(len(x[0]) for x in held) >= most:
            yield emit()
            chunk, held = chunk + 1, []
    if held:
        yield emit()


def code(top, rest):
    """Chunks with words as classes, and each document's sum of log P(word | class) but for the counts of words that are not among the commonest, which are listed with their document's key."""
    top_w, top_class, top_log = top
    least = np.log(np.maximum(rest, 1))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                chunk, ids, lens, x, w, h = (b.column(i)[r] for i in range(6))
                w, h, lens = w.values.to_numpy(), h.values.to_numpy(), lens.values.to_numpy()
                at = np.frombuffer(x.as_buffer(), np.int32)
                place = np.minimum(np.searchsorted(top_w, w), len(top_w) - 1) if len(top_w) else np.zeros(len(w), np.int64)
                known = top_w[place] == w if len(top_w) else np.zeros(len(w), bool)
                classes = np.where(known, top_class[place] if len(top_w) else 0, h + (V - ENDINGS)).astype(np.uint8)
                log_p = np.where(known, top_log[place] if len(top_w) else 0, -least[h])
                doc = np.repeat(np.arange(len(lens)), lens)
                within = np.bincount(doc, log_p[at], len(lens))
                key = chunk.as_py() << 20
                more = ~known[at]
                cols = [pa.array([key]), pa.array([ids.values], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([classes[at].tobytes()], pa.binary()), pa.array([within], pa.list_(pa.float64())), pa.array([key + doc[more]], pa.list_(pa.int64())), pa.array([w[at[more]]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in CODED.split(", ")])

    return run


def documents(batch):
    """(key of the first, ids, lengths, arrays of classes, sums within classes) of each chunk in a batch."""
    for r in range(batch.num_rows):
        key, ids, lens, x, within = (c[r] for c in batch.columns[:5])
        n = lens.values.to_numpy()
        yield key.as_py(), ids.values, n, np.split(np.frombuffer(x.as_buffer(), np.uint8).astype(np.int64), np.cumsum(n)[:-1]), within.values.to_numpy()


MOST = 1024
_room = np.empty((MOST + 4, V), np.float32)  # each worker's own: large arrays made anew for every window cost page faults


def forward(x, p):
    """Hidden states, contexts, and exponentials of the logits (in shared room) with their row maxima taken off, for at most MOST + 4 words; id 0 stands beyond the ends.

    Also the logits of the words themselves, less the maxima.
    """
    e, u, c = p
    pad = np.concatenate([[0, 0], x, [0, 0]])
    ctx = [pad[2 + o : len(pad) - 2 + o] for o in OFFSETS]
    h = np.tanh(sum(e[i][t] for i, t in enumerate(ctx)))
    z = np.matmul(h, u, out=_room[: len(x)])
    z += c
    z -= z.max(1, keepdims=True)
    own = z[np.arange(len(x)), x]
    return h, ctx, np.exp(z, out=z), own


def step(x, p, rate):
    h, ctx, g, _ = forward(x, p)
    g /= g.sum(1, keepdims=True) * len(x)
    g[np.arange(len(x)), x] -= np.float32(1 / len(x))
    e, u, c = p
    dz = (g @ u.T) * (1 - h * h) * np.float32(rate)
    u -= rate * (h.T @ g)
    c -= rate * g.sum(0)
    for i, t in enumerate(ctx):
        order = np.argsort(t)
        words, first = np.unique(t[order], return_index=True)
        e[i][words] -= np.add.reduceat(dz[order], first)


def log_likelihood(x, p):
    """Sum over the words of a document, in windows that see two words beyond their ends."""
    total = 0.0
    for at in range(0, len(x), MOST):
        lo, to = max(0, at - 2), min(len(x), at + MOST)
        _, _, z, own = forward(x[lo : min(len(x), to + 2)], p)
        total += float((own - np.log(z.sum(1)))[at - lo : to - lo].sum(dtype=np.float64))
    return total


def score(docs, rate=2.0, id_col="doc_id", text_col="text", seed=1):
    """doc_id, n_words, log_likelihood (sum), mean_log_likelihood of every row; null or empty text: 0 words, 0, null.

    Words end at space and U+0009 to U+000D; only A-Z are lower-cased. P(word | neighbours) = P(class | neighbours' classes) * P(word | class). Words are counted over all documents, in a
    distributed table that grows with the corpus; the commonest are classes of their own, each other one belongs to one of ENDINGS classes by its last three bytes and has its share of that class's count.
    Null and repeated ids are rows like others; extra columns don't matter; an empty table gives no rows.
    Every partition trains on its whole text from one start; the parameters are averaged, weighted by words, in two levels.
    """
    spark = docs.sparkSession
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cuts = materialise(x.mapInArrow(cut, CUT), "cuts")
    words = cuts.select("chunk", F.posexplode(F.arrays_zip("w", "h", "n")).alias("j", "a")).select("chunk", "j", "a.w", "a.h", "a.n")
    size = {r.h: r.n for r in words.groupBy("h").agg(F.sum("n").alias("n")).collect()}
    totals = materialise(words.groupBy("w").agg(F.min("h").alias("h"), F.sum("n").alias("total")).where("total > 1"), "words")  # a word that is not there occurs once
    edge = kth_largest(totals, "total", TOP) if totals.count() > TOP else 1  # not by a sorted limit, of which each task would send TOP rows to the driver
    top = totals.where(F.col("total") > int(edge)).toPandas().sort_values(["total", "w"], ascending=[False, True], ignore_index=True)
    own = np.arange(len(top)) < V - ENDINGS - 1
    rest = np.array([size.get(h, 0) for h in range(ENDINGS)], float) - np.bincount(top.h[own], top.total[own], ENDINGS)
    classes = np.where(own, np.arange(len(top)) + 1, top.h + (V - ENDINGS))
    log_p = np.where(own, 0.0, np.log(top.total / np.maximum(rest, 1)[top.h]))
    order = np.argsort(top.w.to_numpy())
    run = code((top.w.to_numpy()[order], classes[order], log_p[order]), rest)
    coded = materialise(cuts.select("chunk", "ids", "lens", "x", "w", "h").mapInArrow(run, CODED), "coded")
    counts = coded.select(F.explode(F.arrays_zip("rest_doc", "rest_w")).alias("a")).select(F.col("a.rest_doc").alias("key"), F.col("a.rest_w").alias("w"))
    more = materialise(counts.join(totals.select("w", F.log("total").alias("log_total")), "w").groupBy("key").agg(F.sum("log_total").alias("more")), "more")
    release(spark)
    coded = coded.select("key", "ids", "lens", "x", "within")
    begin = np.random.default_rng(seed).normal(0, 0.1, SHAPE).astype(np.float32)

    def train(batches):
        from pyspark import TaskContext

        flat, n = begin.copy(), 0
        p = split(flat)
        for b in batches:
            for _, _, _, texts, _ in documents(b):
                for ids in texts:
                    for at in range(0, len(ids), MOST):
                        step(ids[at : at + MOST], p, rate)
                    n += len(ids)
        parts = [part.tobytes() for part in np.array_split(flat, 8)]
        yield pa.RecordBatch.from_arrays([pa.array(range(8), pa.int32()), pa.array([TaskContext.get().partitionId() % 32] * 8, pa.int32()), pa.array([n] * 8, pa.int64()), pa.array(parts, pa.binary())], names=["k", "g", "n", "p"])

    def mean(f):
        n = int(f.n.sum())
        p = sum(np.frombuffer(b, np.float32) * np.float32(m / max(n, 1)) for b, m in zip(f.p, f.n))
        return pd.DataFrame({"k": [f.k.iloc[0]], "n": [n], "p": [np.asarray(p, np.float32).tobytes()]})

    halves = coded.mapInArrow(train, "k int, g int, n long, p binary").groupBy("k", "g").applyInPandas(mean, "k int, n long, p binary")
    parts = materialise(halves.groupBy("k").applyInPandas(mean, "k int, n long, p binary"), "network").orderBy("k").collect()
    flat = np.concatenate([np.frombuffer(r.p, np.float32) for r in parts]) if parts else begin
    net = spark.sparkContext.broadcast(flat)

    def judge(batches):
        p = split(net.value)
        for b in batches:
            for key, ids, n, texts, within in documents(b):
                sums = within + np.array([log_likelihood(t, p) for t in texts])
                yield pa.RecordBatch.from_arrays([pa.array(key + np.arange(len(n))), ids, pa.array(n, pa.int64()), pa.array(sums, pa.float64())], names=["key", "doc_id", "n_words", "log_likelihood"])

    got = coded.mapInArrow(judge, "key long, doc_id long, n_words long, log_likelihood double").join(more, "key", "left")
    got = got.select("doc_id", "n_words", (F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))
    return got.withColumn("mean_log_likelihood", F.expr("log_likelihood / nullif(n_words, 0)"))
