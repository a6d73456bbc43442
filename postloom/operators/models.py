"""Models of embeddings: covariance, whitening, projections, mixtures and their choice, cluster scores, and the refinement loop."""
import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.text import unit


def moments(df, vector="embedding"):
    """(rows, mean, covariance with n - 1) of a vector column: partial sums per batch, added up by entry."""

    def part(frames):
        for f in frames:
            if len(f):
                x = np.stack(f.iloc[:, 0].to_numpy()).astype(float)
                yield pd.DataFrame({"n": [len(x)], "s": [x.sum(0).tolist()], "q": [(x.T @ x).ravel().tolist()]})

    p = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(part, "n long, s array<double>, q array<double>")
    p = p.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n").alias("n"), *[F.expr(f"aggregate(collect_list({c}), cast(array() as array<double>), (a, b) -> if(size(a) = 0, b, zip_with(a, b, (x, y) -> x + y)))").alias(c) for c in ("s", "q")])
    rows = p.select("n", "s", "q").collect()  # a row a task
    if not rows:
        return 0, None, None
    n, s = sum(r.n for r in rows), np.sum([r.s for r in rows], 0)
    q = np.sum([r.q for r in rows], 0).reshape(len(s), len(s))
    return n, s / n, (q - np.outer(s, s) / n) / max(n - 1, 1)


def whitening(df, eps=1e-3, vector="embedding"):
    """(mean, W) of soft ZCA: W = U (L + eps I)^-1/2 U' of the covariance."""
    _, mean, cov = moments(df, vector)
    values, u = np.linalg.eigh(cov)
    return mean, u @ np.diag(1 / np.sqrt(np.maximum(values, 0) + eps)) @ u.T


def apply_linear(df, mean, w, vector="embedding", out=None):
    """(x - mean) W of a vector column, batch by batch."""
    sent = df.sparkSession.sparkContext.broadcast((np.asarray(mean), np.asarray(w)))

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        m, w = sent.value
        return pd.Series(list((np.stack(v.to_numpy()).astype(float) - m) @ w)) if len(v) else pd.Series([], dtype=object)

    return df.withColumn(out or vector, run(F.col(vector).cast("array<double>")))


def whitened(df, eps=1e-3, vector="embedding"):
    """Vectors whitened and brought to norm 1."""
    x = apply_linear(df, *whitening(df, eps, vector), vector)
    return x.withColumn(vector, unit(F.col(vector)))


def project(df, k=5, vector="embedding", out="low"):
    """The first k principal components: stands in for the neighbour embeddings (five or three wide) of libraries that are not here."""
    x = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_low").fit(x).transform(x).withColumn(out, vector_to_array("_low")).drop("_v", "_low")


def k_bounds(pivot, margin=48, least=2):
    """Numbers of clusters to try around a pivot."""
    return max(least, pivot - margin), pivot + margin


def penalised(scores, alpha=1.0, k="k", bic="bic"):
    """scores with penalised = BIC + alpha * range(BIC) * (k - k_min) / (k_max - k_min); the best is the least, ties to the smaller k."""
    e = scores.agg(F.min(k).alias("_k0"), F.max(k).alias("_k1"), F.min(bic).alias("_b0"), F.max(bic).alias("_b1"))
    p = F.col(bic) + F.when(F.col("_k1") > F.col("_k0"), alpha * (F.col("_b1") - F.col("_b0")) * (F.col(k) - F.col("_k0")) / (F.col("_k1") - F.col("_k0"))).otherwise(0.0)
    return scores.crossJoin(F.broadcast(e)).withColumn("penalised", p).drop("_k0", "_k1", "_b0", "_b1")


def sweep(df, ks, alpha=1.0, vector="low", seed=42, tries=1):
    """(k, {k: BIC}, model): full-covariance mixtures for each k; the best of `tries` starts; a k that can't be fitted is left out."""
    x = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))).select("_v").cache()
    n, d = x.count(), len(x.first()["_v"])
    bics, models = {}, {}
    for k in ks:
        for t in range(tries):
            try:
                m = GaussianMixture(k=k, featuresCol="_v", maxIter=50, seed=seed + t).fit(x)
            except Exception as e:  # a singular covariance is Spark's own error
                if "nonconvergence" not in str(e).lower() and "singular" not in str(e).lower() and "IllegalArgument" not in str(e):
                    raise
                continue
            bic = -2 * m.summary.logLikelihood + (k - 1 + k * d + k * d * (d + 1) / 2) * np.log(n)
            if k not in bics or bic < bics[k]:
                bics[k], models[k] = bic, m
    x.unpersist()
    if not bics:
        return None, {}, None
    lo, hi, k0, k1 = min(bics.values()), max(bics.values()), min(bics), max(bics)
    best = min(bics, key=lambda k: (bics[k] + (alpha * (hi - lo) * (k - k0) / (k1 - k0) if k1 > k0 else 0), k))
    return best, bics, models[best]


def choose_k(mode, pivot=None, set_k=None, k_range=None, cached=None):
    """Numbers of clusters to try: 'set' one, 'range' a pair, 'cache' the last one found, 'fast' the pivot alone, 'auto' the bounds around the pivot."""
    if mode == "set":
        return [set_k]
    if mode == "range":
        return list(range(k_range[0], k_range[1] + 1))
    if mode == "cache" and cached:
        return [cached]
    if mode == "fast":
        return [pivot]
    lo, hi = k_bounds(pivot)
    return list(range(lo, hi + 1))


def diagonal_mixture(df, k, steps=50, tries=3, tol=1e-3, floor=1e-6, seed=42, vector="low"):
    """(weights, means, variances, mean log-likelihood) of the best of `tries` diagonal mixtures; each step sums responsibilities over batches in one job."""
    x = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).cache()
    n, mean, cov = moments(x, "v")
    best = None
    for t in range(tries):
        some, rng = np.stack([r.v for r in x.orderBy(F.xxhash64("v", F.lit(seed + t)), "v").limit(50 * k).collect()]), np.random.default_rng(seed + t)
        start = [some[0]]  # far apart: each next one by its squared distance to those there
        while len(start) < min(k, len(some)):
            far = ((some[:, None] - np.array(start)) ** 2).sum(2).min(1)
            start.append(some[rng.choice(len(some), p=far / far.sum())] if far.sum() > 0 else some[len(start)])
        start = np.array(start)
        w, mu, var, last = np.full(len(start), 1 / len(start)), start, np.tile(np.maximum(np.diag(cov), floor), (len(start), 1)), -np.inf
        for _ in range(steps):
            sent = df.sparkSession.sparkContext.broadcast((w, mu, var))

            def part(frames):
                w, mu, var = sent.value
                for f in frames:
                    if not len(f):
                        continue
                    z = np.stack(f.v.to_numpy())
                    logp = np.log(w) - 0.5 * (np.log(2 * np.pi * var).sum(1) + ((z[:, None] - mu) ** 2 / var).sum(2))
                    top = logp.max(1, keepdims=True)
                    total = top[:, 0] + np.log(np.exp(logp - top).sum(1))
                    r = np.exp(logp - total[:, None])
                    yield pd.DataFrame({"s": [np.concatenate([[total.sum()], r.sum(0), (r.T @ z).ravel(), (r.T @ z**2).ravel()]).tolist()]})

            s = np.sum([r.s for r in x.mapInPandas(part, "s array<double>").collect()], 0)
            like, d = s[0] / n, mu.shape[1]
            m = np.maximum(s[1 : 1 + len(w)], 1e-9)
            mu = s[1 + len(w) : 1 + len(w) + len(w) * d].reshape(len(w), d) / m[:, None]
            var = np.maximum(s[1 + len(w) + len(w) * d :].reshape(len(w), d) / m[:, None] - mu**2, floor)
            w = m / m.sum()
            if like - last < tol:
                break
            last = like
        if best is None or like > best[3]:
            best = w, mu, var, like
    x.unpersist()
    return best


def assign(df, mixture, vector="low", out="label"):
    """Label of the likeliest part of a diagonal mixture."""
    sent = df.sparkSession.sparkContext.broadcast(mixture[:3])

    @F.pandas_udf("int")
    def run(v: pd.Series) -> pd.Series:
        w, mu, var = sent.value
        z = np.stack(v.to_numpy()) if len(v) else np.empty((0, mu.shape[1]))
        return pd.Series((np.log(w) - 0.5 * (np.log(var).sum(1) + ((z[:, None] - mu) ** 2 / var).sum(2))).argmax(1))

    return df.withColumn(out, run(F.col(vector).cast("array<double>")))


def nmi(df, a="a", b="b"):
    """Normalised mutual information of two labellings, over their mean entropy; 1 where neither tells anything apart."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    entropy = lambda k: c.groupBy(k).agg(F.sum("n").alias("m")).crossJoin(total).agg(F.sum(-F.col("m") / F.col("t") * F.log(F.col("m") / F.col("t"))).alias(f"h_{k}"))
    joint = c.crossJoin(total).agg(F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias("h"))
    x = joint.crossJoin(entropy(a)).crossJoin(entropy(b))
    return x.select(F.when(F.col(f"h_{a}") + F.col(f"h_{b}") == 0, 1.0).otherwise(2 * (F.col(f"h_{a}") + F.col(f"h_{b}") - F.col("h")) / (F.col(f"h_{a}") + F.col(f"h_{b}"))).alias("nmi"))


def calinski_harabasz(df, label="label", vector="embedding"):
    """Between-cluster over within-cluster variance, each by its degrees of freedom."""
    x = df.where(F.col(label).isNotNull()).select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    c = x.groupBy(label, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"), F.var_pop("x").alias("v"))
    g = x.groupBy("pos").agg(F.avg("x").alias("g"))
    s = c.join(g, "pos").agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count_distinct(label).alias("k"))
    n = df.where(F.col(label).isNotNull()).agg(F.count("*").alias("rows"))
    return s.crossJoin(n).select((F.col("between") / (F.col("k") - 1) / (F.col("within") / (F.col("rows") - F.col("k")))).alias("calinski_harabasz"))


def valid_seeds(labels, n, k):
    """Whether seed labels fit: one a row, k unlike ones."""
    r = labels.agg(F.count("label").alias("n"), F.count_distinct("label").alias("k")).first()
    return r.n == n and r.k == k


def oas(cov, n):
    """(share, mu) of oracle-approximating shrinkage of a covariance of n rows (Chen et al. 2010, eq. 23): its share of the identity times mu = tr(S) / p; 1 where the covariance is one already."""
    p = len(cov)
    mu, square, trace = np.trace(cov) / p, float((cov * cov.T).sum()), np.trace(cov)
    low = (n + 1 - 2 / p) * (square - trace**2 / p)
    return (min(1.0, ((1 - 2 / p) * square + trace**2) / low) if low > 0 else 1.0), mu


def shrunk(cov, n):
    """A covariance drawn towards a scaled identity by oas."""
    share, mu = oas(cov, n)
    return (1 - share) * cov + share * mu * np.eye(len(cov))


class Adam:
    """Adam steps of one array."""

    def __init__(self, rate=1e-2, b1=0.9, b2=0.999):
        self.rate, self.b1, self.b2, self.m, self.v, self.t = rate, b1, b2, 0.0, 0.0, 0

    def __call__(self, g):
        self.t += 1
        self.m, self.v = self.b1 * self.m + (1 - self.b1) * g, self.b2 * self.v + (1 - self.b2) * g * g
        return self.rate * (self.m / (1 - self.b1**self.t)) / (np.sqrt(self.v / (1 - self.b2**self.t)) + 1e-8)


def softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def discriminant(df, k, steps=60, rate=0.02, tol=1e-4, vector="embedding", label="label", seed=0):
    """(mean, L, class means, loss): a projection L, from the identity, under which a softmax over negative squared distances to the class means predicts the labels.

    Cross-entropy by Adam; a step's gradient is the sum over batches of one job. The L of least loss is kept, paired with its own loss.
    """
    x = df.where(F.col(label).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("int").alias("y")).cache()
    c = x.select("y", F.posexplode("v").alias("pos", "x")).groupBy("y", "pos").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"), F.count("*").alias("n")).toPandas()
    d, names = c.pos.max() + 1, sorted(c.y.unique())
    means = c.pivot(index="y", columns="pos", values="m").to_numpy()
    counts = c.pivot(index="y", columns="pos", values="n").to_numpy()
    spread = np.sqrt((c.pivot(index="y", columns="pos", values="s").to_numpy() * counts).sum(0) / counts.sum(0)) + 1e-9  # within classes
    means = means / spread
    lin, best, adam = np.eye(d) + np.random.default_rng(seed).normal(0, 1e-3, (d, d)), (None, np.inf), Adam(rate)
    for _ in range(steps):
        sent = df.sparkSession.sparkContext.broadcast((lin, means, spread, names))

        def part(frames):
            lin, means, spread, names = sent.value
            at = {n: i for i, n in enumerate(names)}
            for f in frames:
                if not len(f):
                    continue
                z, y = np.stack(f.v.to_numpy()) / spread, f.y.map(at).to_numpy()
                gap = z[:, None] - means  # n x k x d
                p = gap @ lin
                r = softmax(-(p**2).sum(2))
                loss = -np.log(r[np.arange(len(y)), y] + 1e-300).sum()
                r = -r
                r[np.arange(len(y)), y] += 1  # d loss / d squared distance
                g = 2 * np.einsum("nk,nkd,nke->de", r, gap, p)
                yield pd.DataFrame({"s": [[float(len(y)), float(loss), *g.ravel().tolist()]]})

        s = np.sum([r.s for r in x.mapInPandas(part, "s array<double>").collect()], 0)
        loss, g = s[1] / s[0], s[2:].reshape(d, d) / s[0]
        if loss < best[1]:
            best = lin.copy(), loss
        if np.linalg.norm(g) < tol:
            break
        lin = lin - adam(g)
    x.unpersist()
    return spread, best[0], means, best[1]


def refine(df, k, rounds=5, vector="embedding", label="label"):
    """(df with refined labels, rounds run, why it ended): projection by the labels, then a mixture in the projection, until labels stay, the loss rises, a part empties, or the rounds are over."""
    cur, last, why = df, np.inf, "rounds"
    done = 0
    for _ in range(rounds):
        spread, lin, _, loss = discriminant(cur, k, steps=30, vector=vector, label=label)
        if loss > last:
            why = "loss"
            break
        low = apply_linear(cur, np.zeros(len(spread)), np.diag(1 / spread) @ lin, vector, "_low")
        new = assign(low, diagonal_mixture(low, k, tries=1, vector="_low"), "_low", "_new")
        if new.select("_new").distinct().count() < k:
            why = "collapse"
            break
        done, last = done + 1, loss
        same = nmi(new.select(F.col(label).alias("a"), F.col("_new").alias("b"))).first()[0]
        cur = new.withColumn(label, F.col("_new")).drop("_new", "_low")
        if same > 1 - 1e-9:
            why = "fixed"
            break
    return cur, done, why
