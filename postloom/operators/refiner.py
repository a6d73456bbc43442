"""Refined clusters of embeddings as a model that can be kept: whitening, projection and mixture, fitted together, applied to any table."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import unit
from ..session import materialise
from . import models
from .blocks import finite

#: Arrays that make a model.
PARTS = ("mean", "whiten", "spread", "project", "weights", "means", "variances")


class Refiner:
    """Arrays by name: mean and whiten (d, d x d; soft ZCA), spread and project (scale by class, projection), weights, means and variances of a diagonal mixture in the projection."""

    def __init__(self, **arrays):
        self.arrays = {n: np.asarray(arrays[n], float) for n in PARTS}

    def prepared(self, df, vector="embedding", out="_unit"):
        """df with whitened vectors of norm 1, as at fitting."""
        a = self.arrays
        x = models.apply_linear(df, a["mean"], a["whiten"], vector, out)
        return x.withColumn(out, unit(F.col(out)))

    def transform(self, df, vector="embedding", out="low"):
        """df with the projection of its vectors; null for a vector that is null, empty, of another length, or holds null or non-finite numbers."""
        a = self.arrays
        usable = finite(vector) & (F.size(vector) == len(a["mean"]))
        x = df.withColumn("_safe", F.when(usable, F.col(vector).cast("array<double>")).otherwise(F.array(*[F.lit(0.0)] * len(a["mean"]))))
        x = models.apply_linear(self.prepared(x, "_safe"), np.zeros(len(a["spread"])), np.diag(1 / a["spread"]) @ a["project"], "_unit", out)
        return x.withColumn(out, F.when(usable, F.col(out))).drop("_safe", "_unit")

    def predict_proba(self, df, vector="embedding", out="probabilities"):
        """df with the probability of each cluster, in order of its number; null where transform gives null."""
        w, mu, var = (self.arrays[n] for n in ("weights", "means", "variances"))

        @F.pandas_udf("array<double>")
        def run(v: pd.Series) -> pd.Series:
            some = [i for i, x in enumerate(v) if x is not None]
            done = [None] * len(v)
            if some:
                z = np.stack([v.iloc[i] for i in some])
                p = models.softmax(np.log(w) - 0.5 * (np.log(var).sum(1) + ((z[:, None] - mu) ** 2 / var).sum(2)))
                for i, row in zip(some, p):
                    done[i] = row.tolist()
            return pd.Series(done, dtype=object)

        return self.transform(df, vector, "_low").withColumn(out, run("_low")).drop("_low")

    def predict(self, df, vector="embedding", out="label"):
        """df with the number of the likeliest cluster, of equals the first; null where transform gives null."""
        p = F.col("_p")
        return self.predict_proba(df, vector, "_p").withColumn(out, F.array_position(p, F.array_max(p)).cast("int") - 1).drop("_p")

    def save(self, spark, path):
        """Keep the arrays as a small table, a row each, in place of what is there."""
        rows = [(n, list(a.shape), a.ravel().tolist()) for n, a in self.arrays.items()]
        spark.createDataFrame(rows, "part string, shape array<long>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path):
        return cls(**{r.part: np.array(r.numbers).reshape(r.shape) for r in spark.read.parquet(path).collect()})


def fit(df, k, seeds=None, eps=1e-3, rounds=5, vector="embedding", seed=42):
    """(Refiner, df with label, rounds run, why it ended): vectors whitened and brought to norm 1, labelled by `seeds` (a column of k unlike numbers, one a row) or else by a diagonal mixture of their first principal components, then refined (models.refine), and the projection and mixture of the last labels kept.

    Rows whose vector cannot take part (see Refiner.transform) get a null label. Seeds that do not fit are not used. An empty table is an error.
    """
    rows = df.where(finite(vector))
    if rows.isEmpty():
        raise ValueError("no vector to fit to")
    mean, whiten = models.whitening(rows, eps, vector)
    x = models.apply_linear(rows, mean, whiten, vector, "_unit").withColumn("_unit", unit(F.col("_unit")))
    if seeds is not None and models.valid_seeds(x.withColumn("label", F.col(seeds)), x.count(), k):
        x = x.withColumn("_label", F.col(seeds).cast("int"))
    else:
        low = models.project(x, min(5, len(mean)), "_unit", "_start")
        x = models.assign(low, models.diagonal_mixture(low, k, seed=seed, vector="_start"), "_start", "_label").drop("_start")
    x = materialise(x, "seeded")
    x, done, why = models.refine(x, k, rounds, "_unit", "_label")
    x = materialise(x, "refined")
    spread, project, _, _ = models.discriminant(x, k, steps=30, vector="_unit", label="_label")
    low = models.apply_linear(x, np.zeros(len(spread)), np.diag(1 / spread) @ project, "_unit", "_low")
    weights, means, variances, _ = models.diagonal_mixture(low, k, tries=1, seed=seed, vector="_low")
    model = Refiner(mean=mean, whiten=whiten, spread=spread, project=project, weights=weights, means=means, variances=variances)
    return model, model.predict(df, vector), done, why
