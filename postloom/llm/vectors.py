"""Approximate nearest neighbours by additive quantisation: beam-searched full-dimensional residual codebooks, stored codes and norms, table scoring, exact reranking."""
import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from ..session import materialise


def train(x, books=16, words=256, steps=6, seed=0):
    """books x words x dim residual codebooks by k-means on a sample."""
    rng, out, rest = np.random.default_rng(seed), [], np.array(x, np.float32)
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(steps):
            near = ((c**2).sum(1) - 2 * rest @ c.T).argmin(1)
            n = np.bincount(near, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, near, rest)
            c[n > 0] = total[n > 0] / n[n > 0, None]
        rest = rest - c[((c**2).sum(1) - 2 * rest @ c.T).argmin(1)]
        out.append(c)
    return np.array(out)


def encode(x, books, beam=4):
    """Codes (n x books, uint8) and squared norms of their sums: the best `beam` partial sums are kept after each book."""
    n, rest = len(x), x[:, None, :].astype(np.float32)
    codes = np.zeros((n, 1, 0), np.uint8)
    for c in books:
        cost = (rest**2).sum(2)[..., None] + (c**2).sum(1) - 2 * rest @ c.T
        flat = cost.reshape(n, -1)
        k = min(beam, flat.shape[1])
        best = np.argpartition(flat, k - 1, axis=1)[:, :k]
        was, word = best // len(c), best % len(c)
        i = np.arange(n)[:, None]
        rest, codes = rest[i, was] - c[word], np.concatenate([codes[i, was], word[..., None].astype(np.uint8)], 2)
    i, b = np.arange(n), (rest**2).sum(2).argmin(1)
    return codes[i, b], ((x - rest[i, b]) ** 2).sum(1)


def usable(df, id_col, vec_col):
    """key (a row number), vec_id, v of the rows that take part."""
    v = df.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return v.where("vec_id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x <> 0)")


def matrix(column):
    """n x dim array of a column of lists of one length."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def search(df, k=10, every=100, sample=8192, depth=0.03, least=40, id_col="vec_id", vec_col="embedding"):
    """query_id, rank, vec_id, score: the k nearest found, by Euclidean distance in double precision, of the rows whose id divides by `every`, among all other rows of their dimension.

    Null, zero and non-finite vectors and null ids take no part. A repeated id is a row of its own, as query and as candidate. Ties go to the smaller id; extra columns don't matter; an empty table gives no rows.
    For each dimension, codebooks come from a sample of about `sample` rows, chosen by a hash, then every row's codes and norm are stored once. Of each Arrow batch the max(least, depth * rows) nearest by tables are
    reranked on the original vectors. Queries go out in blocks of bounded size, one job a block.
    """
    spark = df.sparkSession
    x = materialise(usable(df, id_col, vec_col), "vectors")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in sorted(x.groupBy(F.size("v").alias("d")).count().collect(), key=lambda r: r.d):
        out = out.unionByName(of_dimension(x.where(F.size("v") == r.d), r.d, k, every, sample, depth, least))
    return out


def of_dimension(x, dim, k, every, sample, depth, least):
    spark = x.sparkSession
    rows = x.count()
    some = x.where(F.pmod(F.xxhash64("vec_id", "key"), F.lit(max(rows, sample))) < sample).select("v", F.xxhash64("key").alias("h")).toPandas().sort_values("h") if rows > sample else x.select("v").toPandas()
    books = spark.sparkContext.broadcast(train(np.stack(some.v)))

    def store(batches):
        for b in batches:
            if b.num_rows:
                codes, norms = zip(*[encode(v, books.value) for v in np.array_split(matrix(b.column(2)), -(-b.num_rows // 1000))])
                codes = np.concatenate(codes)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.concatenate(norms).astype(np.float32))], names=["key", "vec_id", "v", "codes", "norm"])

    coded = materialise(x.mapInArrow(store, "key long, vec_id long, v array<double>, codes binary, norm float"), "codes")
    queries = coded.where(f"vec_id % {every} = 0").select("key", "vec_id", "v")
    blocks, out = -(-queries.count() * dim // (1 << 19)), None
    for at in range(blocks):
        q = queries.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == at).toPandas()
        if q.empty:
            continue
        sent = spark.sparkContext.broadcast((q.key.to_numpy(), q.vec_id.to_numpy(), np.stack(q.v)))

        def run(batches):
            keys, names, qs = sent.value
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                key, own, v, norms = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2)), b.column(4).to_numpy()
                codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(n, -1)
                depth_of = min(n, max(least, int(np.ceil(depth * n))) + 1)  # one more, as the query itself may be among them
                found = []
                for lo in range(0, len(keys), 64):
                    part = qs[lo : lo + 64]
                    near = np.repeat(norms[None], len(part), 0)
                    for m, book in enumerate(books.value):
                        near -= (2 * part.astype(np.float32) @ book.T)[:, codes[:, m]]
                    c = np.argpartition(near, depth_of - 1, axis=1)[:, :depth_of]
                    d = np.sqrt(((v[c] - part[:, None]) ** 2).sum(2))
                    d[key[c] == keys[lo : lo + 64, None]] = np.inf
                    best = np.lexsort((own[c], d))[:, :k]
                    ids, d = np.take_along_axis(own[c], best, 1), np.take_along_axis(d, best, 1)
                    row, col = np.nonzero(d < np.inf)
                    found.append((keys[lo + row], names[lo + row], ids[row, col], d[row, col]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["q", "query_id", "vec_id", "score"])

        best = Window.partitionBy("q").orderBy("score", "vec_id")
        part = coded.mapInArrow(run, "q long, query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
        part = materialise(part.select("query_id", "rank", "vec_id", "score"), "found")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out
