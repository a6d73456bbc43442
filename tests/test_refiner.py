import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.operators import models, refiner


def test_a_model_is_fitted_kept_and_applied(spark, tmp_path):
    r = np.random.default_rng(7)
    centres = r.normal(size=(3, 6)) * 4
    rows = [(i, (centres[i % 3] + r.normal(size=6)).tolist(), i % 3) for i in range(150)]
    df = spark.createDataFrame([*rows, (900, None, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], None)], "id long, embedding array<double>, truth int")
    model, labelled, done, why = refiner.fit(df, 3, rounds=2)
    assert done >= 0 and why in ("fixed", "loss", "collapse", "rounds")
    assert labelled.where("id >= 900").where("label is not null").isEmpty()
    same = models.nmi(labelled.where("id < 900").select(F.col("truth").alias("a"), F.col("label").alias("b"))).first()[0]
    assert same > 0.9
    p = model.predict_proba(df)
    assert all(abs(sum(x.probabilities) - 1) < 1e-9 and len(x.probabilities) == 3 for x in p.where("id < 900").collect())
    assert p.where("id >= 900").where("probabilities is not null").isEmpty()
    model.save(spark, str(tmp_path / "model"))
    again = refiner.Refiner.load(spark, str(tmp_path / "model"))
    assert all(np.array_equal(again.arrays[n], model.arrays[n]) for n in refiner.PARTS)
    other = spark.createDataFrame([(1, [1.0, 2.0], None), (2, rows[0][1], 0)], "id long, embedding array<double>, truth int")
    assert {x.id: x.low is None for x in again.transform(other).collect()} == {1: True, 2: False}
    with pytest.raises(ValueError):
        refiner.fit(df.where("id = 900"), 3)
