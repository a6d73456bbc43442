"""Toxicity by classifier chains: each linear model also reads the probabilities of the categories before it, out of fold in training.

Labels say only toxic or not. The categories are learnt: features that mark toxic documents are grouped by the documents they occur in, and a toxic document is of a category if it holds a feature of that group.
"""
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import materialise
from .quality import sample_labels, threshold

CATEGORIES = 3
CHAIN = [*[f"category_{i + 1}" for i in range(CATEGORIES)], "toxic"]
SIZE = 1 << 20
word = re.compile(r"[^\W\d_]+").findall


def grams(w):
    """Hashes of a word and of its 5-character pieces."""
    return {zlib.crc32(x.encode()) % SIZE for x in (w, *(w[i : i + 5] for i in range(len(w) - 4)))}


#: A feature may also be that two words, and this share of a text's distinct words, have a gram: what marks a text need not be rare in others.
SHARES = (0.01, 0.03)


def share(gram, i):
    return zlib.crc32(b"%d of %d" % (i, gram)) % SIZE


def features(text):
    """Sorted distinct feature hashes of a text's distinct lower-cased words: their grams, and grams that many of them have. Null or empty text has none."""
    words = set(word((text or "").lower()))
    n = Counter(g for w in words for g in grams(w))
    return sorted({*n, *(share(g, i) for g, k in n.items() if k >= 2 for i, s in enumerate(SHARES) if k >= s * len(words))})


def fit(x, y, steps=300, rate=0.15, l2=1e-3):
    """Logistic regression by Adam on a dense matrix; weights and, last, bias."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    w = m = v = np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        error = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30))) - y
        g = x.T @ error.astype(np.float32) / len(y) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def predict(x, w):
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def group_features(x, k=CATEGORIES, steps=20):
    """Group of each column of a 0/1 matrix of toxic documents: k-means on the cosine of columns, from columns far apart; group 0 holds the column met most."""
    c = x.T / np.maximum(np.linalg.norm(x.T, axis=1, keepdims=True), 1e-9)
    centres = [c[x.sum(0).argmax()]]
    while len(centres) < min(k, len(c)):
        centres.append(c[np.max(c @ np.array(centres).T, axis=1).argmin()])
    centres = np.array(centres)
    for _ in range(steps):
        of = (c @ centres.T).argmax(1)
        new = np.array([c[of == i].sum(0) if (of == i).any() else centres[i] for i in range(len(centres))])
        centres = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
    return of


def train(x, y, ids, folds=3):
    """(weights of each model of the chain, cut, out-of-fold probabilities of toxic) from a 0/1 feature matrix, 0/1 labels and ids that choose the folds."""
    of = group_features(x[y == 1])
    labels = [(x[:, of == c].any(1) & (y == 1)).astype(float) for c in range(CATEGORIES)] + [y.astype(float)]
    weights, fold = [], np.array([zlib.crc32(str(i).encode()) % folds for i in ids])
    for target in labels:
        out = np.zeros(len(x))
        for k in range(folds):
            if (fold == k).any() and (fold != k).any():
                out[fold == k] = predict(x[fold == k], fit(x[fold != k], target[fold != k]))
        weights.append(fit(x, target))
        x = np.hstack([x, out[:, None].astype(np.float32)])
    return weights, threshold(out, y, even=False), out


def learn(docs, labels, most=6000, keep=600):
    """(feature -> column, chain weights, cut) from about `most` labelled documents; None without both kinds of label.

    Features, counted in a distributed table: at most `keep` that toxic documents hold more often than clean ones do, by over 4 deviations and in 3 documents at least.
    The driver gets those and the chosen ones of each labelled document. Null ids and labels take no part; each row of a repeated id does.
    """
    y = sample_labels(labels, "toxic", most)
    if len(set(y.values())) < 2:
        return None
    known = docs.sparkSession.createDataFrame(list(y.items()), "doc_id long, y int")
    x = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")

    def run(batches):
        for b in batches:
            for d, t, v in zip(*[c.to_pylist() for c in b.columns]):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([v], pa.int32()), pa.array([features(t)], pa.list_(pa.int32()))], names=["doc_id", "y", "f"])

    held = materialise(x.mapInArrow(run, "doc_id long, y int, f array<int>"), "features")
    sizes = {r.y: r["count"] for r in held.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    counts = held.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.count_if(F.col("y") == 0).alias("clean"), F.count_if(F.col("y") == 1).alias("toxic"))
    due = f"({sizes[1]} * (clean + 0.5D) / {sizes[0] + 1}D)"
    best = counts.where("toxic >= 3").withColumn("z", F.expr(f"(toxic - {due}) / sqrt({due} + 0.25D)")).orderBy(F.desc("z"), "f").limit(keep).collect()
    chosen = [r.f for r in best if r.z > 4] or [r.f for r in best[:1]]
    if not chosen:
        return None
    got = held.select("doc_id", "y", F.array_intersect("f", F.array(*map(F.lit, chosen))).alias("f")).orderBy("doc_id", "y", "f").collect()
    at = {f: i for i, f in enumerate(chosen)}
    m = np.zeros((len(got), len(chosen)), np.float32)
    for i, r in enumerate(got):
        m[i, [at[f] for f in r.f]] = 1
    weights, cut, _ = train(m, np.array([r.y for r in got]), [r.doc_id for r in got])
    return at, weights, cut


def chain_probabilities(docs, model, carry=False):
    """doc_id, p (a probability for each category of CHAIN, 0 without a model) and toxic, of every row; with carry, the row itself too, as a struct.

    Null text counts as empty text; null and repeated ids are rows like others; the names of other columns don't matter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, weights, _ = sent.value or ({}, [], 0)
        cache, n = {}, len(at)
        for part in parts:
            rows, found = [], []
            for i, t in enumerate(part):
                words, seen = set(word((t or "").lower())), Counter()
                for w in words:
                    if w not in cache:
                        if len(cache) > 300_000:
                            cache.clear()
                        cache[w] = tuple(g for g in grams(w) if g in at or any(share(g, j) in at for j in range(len(SHARES))))
                    if cache[w]:
                        seen.update(cache[w])
                mine = {at[g] for g in seen if g in at}
                mine |= {at[f] for g, k in seen.items() if k >= 2 for j, s in enumerate(SHARES) if k >= s * len(words) and (f := share(g, j)) in at}
                rows += [i] * len(mine)
                found += mine
            rows, found, p = np.array(rows, np.int64), np.array(found, np.int64), np.zeros((len(part), len(CHAIN)))
            for k, w in enumerate(weights):
                z = np.bincount(rows, w[found], len(part)) + p[:, :k] @ w[n : n + k] + w[-1]
                p[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pd.Series(list(p))

    cut = model[2] if model else 2.0
    out = docs.select(*([F.struct("*").alias("row")] if carry else []), F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("p"))
    return out.withColumn("toxic", F.element_at("p", -1) >= F.lit(float(cut)))
