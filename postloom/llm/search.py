"""Exact BM25 top-k: an inverted index with stored block maxima, searched per shard by block-max WAND and merged with global statistics.

The pivot is a block of documents, not a single one, so that numpy handles it, and queries are searched in lots: the best blocks of a query, by the sum of their lists' stored maxima, give a first k-th best score,
and of the others only those whose sum reaches it are scored, a few blocks at a time, as one product for all queries of the lot that need one of them. The lists beyond a shard's commonest terms hold few postings;
they are read first and sharpen the bounds of the blocks. A shard's documents are laid out by likeness, so that a block's maxima stay near its documents' impacts.
"""
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F
from xxhash import xxh3_64_digest

from ..session import materialise
from .arrow import Packed, by_bytes, settings

K1, B, BLOCK = 1.2, 0.75, 32
#: Bytes of a shard's matrix of common terms by documents, and of text that a shard holds at most, but for one document.
ROOM, SHARD = 1 << 26, 1 << 26
#: Common terms of a shard, at most: with more, the product costs more than the lists it saves.
COMMON = 1024
#: Queries of a lot, at most; blocks that are scored by one product; blocks of a query that give its first k-th best score.
LOT, TILE, FIRST = 256, 8, 8
#: A row of the index is tens of MB: rows are read, and sent to Python, one by one.
ROW_BY_ROW = {"spark.sql.parquet.columnarReaderBatchSize": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
#: One shard in so many is searched first; its k-th best scores bound the search of the others.
AHEAD = 8
#: Likeness: groups by the nearest of so many centres, in so many common terms.
GROUPS, LOOKED_AT = 8, 256
#: Distinct terms of the queries that are sent out at once.
SENT = 1 << 21
terms_of = re.compile(r"[^\W_]+").findall


def term_cache():
    """White-space separated unit -> the 64-bit hashes of its terms: one term if it is letters and digits throughout."""
    return Packed(lambda u: xxh3_64_digest(u) if u.isalnum() else b"".join(map(xxh3_64_digest, terms_of(u))), 250_000)


def terms(text, cache):
    """64-bit hashes of the lower-cased runs of letters and digits, with counts, and the length."""
    h = np.frombuffer(b"".join(map(cache.__getitem__, (text or "").lower().split())), np.uint64)
    return (*np.unique(h, return_counts=True), len(h))


RAW = "n long, total long, ids binary, len binary, terms binary, starts binary, doc binary, tf binary"


def build(batches):
    """One index row per shard: term hashes, list starts, postings (place of the document, count) in document order, lengths."""
    cache, ids, got, held = term_cache(), [], [], 0

    def shard():
        places = laid_out(got)
        own = np.array(ids, np.int64)[places]
        ln = np.array([got[i][2] for i in places], np.int64)
        doc = np.repeat(np.arange(len(got), dtype=np.int32), [len(got[i][0]) for i in places])
        h, tf = np.concatenate([got[i][0] for i in places]), np.concatenate([got[i][1] for i in places])
        got.clear()
        order = np.argsort(h, kind="stable")
        h, doc, tf = h[order], doc[order], (tf.astype(np.uint16) if tf.max(initial=0) < 1 << 16 else tf)[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        parts = [own, ln, h[first], np.append(first, len(h)).astype(np.int64), doc, tf]
        return pa.RecordBatch.from_arrays([pa.array([len(own)]), pa.array([int(ln.sum())]), *map(one_value, parts)], names=[x.split()[0] for x in RAW.split(", ")])

    for b in by_bytes(batches, 1):
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(d)
            h, n, ln = terms(t, cache)
            got.append((h, n.astype(np.int32), ln))
            held += len(t or "")
            if held >= SHARD:
                yield shard()
                ids, got, held = [], [], 0
    if ids:
        yield shard()


def laid_out(got):
    """Order of documents (hashes, counts, length): like ones beside each other, within these by length."""
    n = np.array([len(g[0]) for g in got])
    looked_at, often = max(1, min(LOOKED_AT, ROOM // (32 * len(got)))), np.zeros(1 << 16, np.int64)
    kinds = lambda lo: (np.concatenate([g[0] for g in got[lo : lo + 256]]) & np.uint64(0xFFFF)).astype(np.int64)  # noqa: E731 terms that share 16 bits pass as one
    for lo in range(0, len(got), 256):
        often += np.bincount(kinds(lo), minlength=1 << 16)
    row = np.full(1 << 16, -1)
    row[np.argsort(-often, kind="stable")[:looked_at]] = np.arange(looked_at)
    x = np.zeros((len(got), looked_at), np.float32)
    for lo in range(0, len(got), 256):
        at = row[kinds(lo)]
        x[np.repeat(np.arange(lo, min(lo + 256, len(got))), n[lo : lo + 256])[at >= 0], at[at >= 0]] = 1
    x -= x.mean(0)
    x /= np.sqrt(np.maximum((x * x).sum(1, keepdims=True), 1e-9))
    best, centres = np.full(len(got), -1, np.float32), [x[np.argmax(n)]]
    for _ in range(1, GROUPS):  # each far from those before
        best = np.maximum(best, x @ centres[-1])
        centres.append(x[np.argmin(np.where(n >= np.median(n), best, 2))])
    for _ in range(6):
        group = (x @ np.array(centres).T).argmax(1)
        centres = [x[group == g].mean(0) if (group == g).any() else c for g, c in enumerate(centres)]
        centres = [c / max(1e-9, float(np.sqrt(c @ c))) for c in centres]
    return np.lexsort((n, group)).tolist()


def one_value(x):
    """An array of one binary value: the bytes of a numpy array or a buffer, which are not copied."""
    b = pa.py_buffer(x)
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, b.size], np.int32)), b])


def index_rows(batches):
    """{column: value}, binary ones as buffers, which are not copied."""
    for b in batches:
        for i in range(b.num_rows):
            yield {name: c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for name, c in zip(b.schema.names, b.columns)}


def read(row, *kinds):
    return [np.frombuffer(row[name], kind) for name, kind in kinds]


POSTINGS = (("ids", np.int64), ("len", np.int64), ("terms", np.uint64), ("starts", np.int64), ("doc", np.int32), ("common", np.int32), ("maxima", np.float32))
INDEX = "ids binary, len binary, terms binary, starts binary, doc binary, tf binary, common binary, maxima binary"


def counts(buffer, n):
    """The n counts of a buffer of 16-bit numbers, or of 32-bit ones where some don't fit."""
    return np.frombuffer(buffer, np.uint16 if len(memoryview(buffer)) == 2 * n else np.int32)


def impact_of(tf, ln, doc, mean):
    norm = (K1 * (1 - B + B * ln / mean)).astype(np.float32)[doc]
    tf = tf.astype(np.float32)
    norm += tf
    tf *= np.float32(K1 + 1)
    tf /= norm
    return tf


def impacts(mean):
    """Adds the shard's commonest terms (as places) and, for these, the maximum of every block of documents."""

    def run(batches):
        for r in index_rows(batches):
            ln, starts, doc = read(r, ("len", np.int64), ("starts", np.int64), ("doc", np.int32))
            impact = impact_of(counts(r["tf"], len(doc)), ln, doc, mean)
            most = max(1, min(COMMON, ROOM // (4 * len(ln))))
            df = np.diff(starts)
            common = np.sort(np.argsort(-df, kind="stable")[:most]).astype(np.int32)
            maxima = np.concatenate([matrix(common[x : x + 64], starts, doc, impact, len(ln)).reshape(-1, -(-len(ln) // BLOCK), BLOCK).max(2) for x in range(0, max(1, len(common)), 64)])
            yield pa.RecordBatch.from_arrays([*map(one_value, (r["ids"], r["len"], r["terms"], r["starts"], r["doc"], r["tf"], common, maxima))], names=[x.split()[0] for x in INDEX.split(", ")])

    return run


def matrix(common, starts, doc, impact, docs):
    """Impacts of the common terms by documents, padded to whole blocks."""
    out = np.zeros((len(common), -(-docs // BLOCK) * BLOCK), np.float32)
    for i, t in enumerate(common.tolist()):
        out[i, doc[starts[t] : starts[t + 1]]] = impact[starts[t] : starts[t + 1]]
    return out


class Shard:
    """A shard's index, ready for queries."""

    def __init__(self, row, mean):
        self.ids, self.len, self.terms, self.starts, self.doc, common, maxima = read(row, *POSTINGS)
        self.impact = impact_of(counts(row["tf"], len(self.doc)), self.len, self.doc, mean)
        self.docs, self.blocks = len(self.ids), -(-len(self.ids) // BLOCK)
        self.matrix = matrix(common, self.starts, self.doc, self.impact, self.docs).reshape(len(common), self.blocks, BLOCK)
        self.maxima = maxima.reshape(len(common), self.blocks)
        self.row = np.full(len(self.terms), -1, np.int64)
        self.row[common] = np.arange(len(common))
        by_doc = np.argsort(self.doc.astype(np.uint16) if self.docs <= 1 << 16 else self.doc, kind="stable")
        self.terms_in, self.tf_in = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.starts))[by_doc], counts(row["tf"], len(self.doc))[by_doc]
        self.starts_in = np.append(0, np.cumsum(np.bincount(self.doc, minlength=self.docs)))
        self.visited = 0

    def lot(self):
        """How many queries are searched at once: their scores take ROOM / 4 bytes at most, but for one query."""
        return max(1, min(LOT, ROOM // (16 * BLOCK * max(1, self.blocks))))

    def candidates(self, lists, weights, k, least=0.0):
        """Places of the documents that may be among the k best and reach `least`. lists: places of the query's terms; weights: their idf."""
        return self.candidates_of([lists], [weights], k, [least])[0]

    def candidates_of(self, lists, weights, k, least):
        """As candidates, for each query of a lot."""
        w = np.zeros((len(lists), len(self.matrix)), np.float32)
        score = np.empty((len(lists), self.blocks * BLOCK), np.float32)
        for i, (terms_, weight) in enumerate(zip(lists, weights)):
            row = self.row[terms_]
            is_rare = row < 0
            w[i, row[~is_rare]] = weight[~is_rare]
            rare = terms_[is_rare]
            first, n = self.starts[rare], self.starts[rare + 1] - self.starts[rare]
            at = np.repeat(first - (np.cumsum(n) - n), n)
            at += np.arange(len(at))
            score[i] = np.bincount(self.doc[at], np.repeat(weight[is_rare], n) * self.impact[at], score.shape[1])
        bound = score.reshape(len(w), self.blocks, BLOCK).max(2) + w @ self.maxima
        slack, edge, many = 1e-4 * bound.max(1, initial=0) + 1e-9, np.array(least, float), len(w) >= TILE
        for i in np.flatnonzero(edge <= 0) if many else ():
            best = np.argpartition(-bound[i], FIRST)[:FIRST] if self.blocks > FIRST else np.arange(self.blocks)
            row = np.flatnonzero(w[i])
            s = score[i].reshape(-1, BLOCK)[best] + np.tensordot(w[i, row], self.matrix[row[:, None], best[None]], 1)
            self.visited += len(best)
            if s.size > k:
                edge[i] = np.partition(s.ravel(), s.size - k)[s.size - k]
        blocks, flat = np.flatnonzero((bound >= (edge - slack)[:, None]).any(0)), self.matrix.reshape(len(self.matrix), -1)
        if not many:  # the best first; many queries take them as they lie, like ones beside each other
            blocks = blocks[np.argsort(-bound[:, blocks].sum(0), kind="stable")]
        found, tops = [], np.zeros((len(w), k), np.float32)
        for tile in (blocks[x : x + TILE] for x in range(0, len(blocks), TILE)):
            needed = bound[:, tile] >= (edge - slack)[:, None]
            tile, q = tile[needed.any(0)], np.flatnonzero(needed.any(1))
            if not len(tile):
                continue
            c = (tile[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            c = slice(c[0], c[-1] + 1) if (np.diff(tile) == 1).all() else c
            s = w[q] @ flat[:, c]
            s += score[:, c][q]
            self.visited += len(q) * len(tile)
            i, j = np.nonzero(s >= np.maximum(edge - slack, 1e-30)[q, None])
            found.append((q[i].astype(np.int32), (c.start + j if isinstance(c, slice) else c[j]).astype(np.int32), s[i, j]))
            if len(i):
                i = i[np.r_[True, i[1:] != i[:-1]]]
                tops[q[i]] = np.partition(np.concatenate([tops[q[i]], s[i]], 1), -k)[:, -k:]
                edge[q[i]] = np.maximum(edge[q[i]], tops[q[i], 0])
        q, c, s = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.float32))
        order = np.argsort(q, kind="stable")
        c, s, ends, out = c[order], s[order], np.searchsorted(q[order], np.arange(len(w) + 1)), []
        for i in range(len(w)):
            mine, scores = c[ends[i] : ends[i + 1]], s[ends[i] : ends[i + 1]]
            if len(mine) > k:
                mine = mine[scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - slack[i]]
            out.append(mine.astype(np.int64))
        return out

    def top(self, lists, weights, k, mean, least=0.0):
        """(ids, exact scores) of the k best, by scores to nine places, ties to the smaller id."""
        return self.best_of(self.candidates(lists, weights, k, least), lists, weights, k, mean)

    def best_of(self, c, lists, weights, k, mean):
        """As top, of a query's candidates. Terms are added in the order given, so that equal documents score the same in every shard."""
        lists, tf = lists.astype(np.int32), np.zeros((len(lists), len(c)))
        for i, d in enumerate(c.tolist()):
            here = slice(self.starts_in[d], self.starts_in[d + 1])
            of = self.terms_in[here]
            at = np.minimum(np.searchsorted(of, lists), len(of) - 1)
            tf[:, i] = np.where(of[at] == lists, self.tf_in[here][at], 0)
        exact = (weights[:, None] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.len[c] / mean)))).sum(0)
        best = np.lexsort((self.ids[c], -np.round(exact, 9)))[:k]
        return self.ids[c][best], exact[best]


def topk(docs, k=10, every=100, id_col="doc_id", text_col="text"):
    """query_id, rank, doc_id, score: for rows whose id divides by `every`, the k best of all rows by BM25 over the query's distinct terms.

    A row may find itself. Scores that agree to nine places tie, and ties go to the smaller id; rows without a shared term are not returned, nor rows with a null id; null text has no terms.
    A repeated id is a separate row, and if it is a query's, its rows' terms are one query. Extra columns don't matter; an empty table gives no rows.
    Frequencies are counted over all documents. Queries go out in blocks of about SENT terms, one job a block.
    """
    spark = docs.sparkSession
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    raw = materialise(x.mapInArrow(build, RAW), "postings")
    n, total = raw.agg(F.sum("n"), F.sum("total")).first()
    none = spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    if not total:
        return none
    mean = total / n
    with settings(spark, ROW_BY_ROW):
        index = materialise(raw.mapInArrow(impacts(mean), INDEX), "index")

    def hashes(batches):
        cache = term_cache()
        for b in by_bytes(batches, 1):
            got = [terms(t, cache)[0].view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "t"])

    queries = materialise(x.where(f"doc_id % {every} = 0").mapInArrow(hashes, "doc_id long, t array<long>"), "queries")
    blocks, out = -(-(queries.agg(F.sum(F.size("t"))).first()[0] or 0) // SENT), None
    for at in range(blocks):
        q = {}
        for r in queries.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == at).toLocalIterator():
            q.setdefault(r.doc_id, []).append(np.array(r.t, np.int64).view(np.uint64))
        q = [(i, np.unique(np.concatenate(t))) for i, t in sorted(q.items())]
        if not any(len(t) for _, t in q):
            continue
        vocab = np.unique(np.concatenate([t for _, t in q]))
        words = spark.sparkContext.broadcast(vocab)

        def frequency(batches):
            df = np.zeros(len(words.value), np.int64)
            for r in index_rows(batches):
                t, s = read(r, ("terms", np.uint64), ("starts", np.int64))
                if len(t):
                    i = np.minimum(np.searchsorted(t, words.value), len(t) - 1)
                    df += np.where(t[i] == words.value, np.diff(s)[i], 0)
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["i", "df"])

        with settings(spark, ROW_BY_ROW):
            got = index.select("terms", "starts").mapInArrow(frequency, "i long, df long").groupBy("i").agg(F.sum("df").alias("df")).toPandas()
        df = np.zeros(len(vocab))
        df[got.i] = got.df
        weight = spark.sparkContext.broadcast(np.log(1 + (n - df + 0.5) / (df + 0.5)))
        sent = spark.sparkContext.broadcast([(i, np.searchsorted(vocab, t).astype(np.int32)) for i, t in q])

        def score(known):
            def run(batches):
                tops = np.repeat(known.value[:, None], k, 1)  # the k best scores of each query so far, as far as this task knows them: later shards need not look below them
                for r in index_rows(batches):
                    s = Shard(r, mean)
                    if not len(s.terms):
                        continue
                    at = np.minimum(np.searchsorted(s.terms, words.value), len(s.terms) - 1)
                    has, found = s.terms[at] == words.value, []
                    for lo in range(0, len(sent.value), s.lot()):
                        lot = [(j, i, w[has[w]]) for j, (i, w) in enumerate(sent.value[lo : lo + s.lot()], lo)]
                        lot = [(j, i, at[w], weight.value[w]) for j, i, w in lot if len(w)]
                        places = s.candidates_of([x[2] for x in lot], [x[3] for x in lot], k, [tops[x[0]].min() for x in lot]) if lot else []
                        for (j, i, lists, weights), c in zip(lot, places):
                            if len(c):
                                d, v = s.best_of(c, lists, weights, k, mean)
                                tops[j] = np.sort(np.concatenate([tops[j], v]))[-k:]
                                found += zip([i] * len(d), d.tolist(), v.tolist())
                    del s  # before the next is made
                    cols = list(zip(*found)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "doc_id", "score"])

            return run

        best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
        ahead, known, part = F.pmod(F.xxhash64("ids"), F.lit(AHEAD)) == 0, np.zeros(len(q)), None
        for turn, shards in enumerate((index.where(ahead), index.where(~ahead))):
            # few tasks, so that a task sees several shards, but twice as many as cores
            new = shards.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(score(spark.sparkContext.broadcast(known)), "query_id long, doc_id long, score double")
            new = new if part is None else new.unionByName(part.drop("rank"))
            with settings(spark, ROW_BY_ROW):
                part = materialise(new.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "doc_id", "score"), "found")
            if turn == 0:
                low = part.where(F.col("rank") == k).select("query_id", "score").toPandas()
                known[np.searchsorted([i for i, _ in q], low.query_id)] = low.score
        out = part if out is None else out.unionByName(part)
    return none if out is None else out
