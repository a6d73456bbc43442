import shutil

import corpus_pipeline as pipeline
from test_jaccard import shingles

DIR = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, tmp_path):
    shutil.copytree(DIR, tmp_path / "sf")
    d = str(tmp_path / "sf")
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "doc_id as ids", "text as bin")
    kept = [docs]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, kept[-1], d).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert k == len(pipeline.STAGES) - 1 or sorted(kept[-1].columns) == sorted(docs.columns), name
    was, now = kept[2].select("doc_id", "text").collect(), {r.doc_id for r in kept[3].select("doc_id").collect()}
    sets = {r.doc_id: shingles(r.text) for r in was}
    root = {i: i for i in sets}
    for a, x in sets.items():
        for b, y in sets.items():
            if x and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if v == hi else v for i, v in root.items()}
    assert now == set(root.values())
    assert {r.doc_id for r in kept[4].select("doc_id").collect()} == now
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id")
    ids = [{r.doc_id for r in k.select("doc_id").collect()} & set(labels.index) for k in kept]
    good, clean = set(labels.index[labels.quality == 1]), set(labels.index[labels.toxic == 0])
    assert len(ids[1] & good) >= 0.95 * len(good) and len(ids[1] - good) <= 0.1 * len(ids[0] - good)
    assert len(ids[2] & clean) >= 0.95 * len(ids[1] & clean)


def test_a_broken_run_goes_on(spark, tmp_path, monkeypatch):
    first = pipeline.run(spark, DIR, str(tmp_path / "run")).count()
    stages = list(pipeline.STAGES)

    def never(*a):
        raise AssertionError

    monkeypatch.setattr(pipeline, "STAGES", [(n, never) for n, _ in stages[:-1]] + stages[-1:])
    assert pipeline.run(spark, DIR, str(tmp_path / "run")).count() == first
