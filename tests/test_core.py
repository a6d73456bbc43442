import glob
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from postloom.operators import edges, posts
from postloom.operators.components import connected_components
from postloom.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    got, want = catalog.QUERIES[name](spark, DIR).toPandas(), con.execute(catalog.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda x: sorted(map(str, x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_components_of_a_path_and_rings(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_matching_equals_sequential_greedy(spark):
    r = random.Random(5)
    e = list({(r.randrange(8), r.randrange(8)): 0 for _ in range(40)})
    e = [(a, b, r.choice([0.1, 0.2, 0.3])) for a, b in e if a != b]
    out, inn, want = {i: 1 + i % 3 for i in range(8)}, {i: i % 3 for i in range(8)}, set()
    q = spark.createDataFrame([(i, out[i], inn[i]) for i in range(8)], "id long, cap_out int, cap_in int")
    got = {(x.source, x.target) for x in edges.match(spark.createDataFrame(e, "source long, target long, force double"), q).collect()}
    for a, b, _ in sorted(e, key=lambda x: (-x[2], x[0], x[1])):
        if out[a] and inn[b]:
            out[a] -= 1
            inn[b] -= 1
            want.add((a, b))
    assert got == want


def test_terms_are_pairs_of_words_without_stop_words(spark):
    rows = [(1, "a", "red and the house"), (2, "a", "red house"), (3, "b", "and"), (4, "b", None)]
    got = posts.class_terms(spark.createDataFrame(rows, "id long, cluster string, content string"), stop=posts.STOP, grams=2).collect()
    assert {(r.cluster, r.term, r.n) for r in got} == {("a", "red", 2), ("a", "house", 2), ("a", "red house", 2)}


def test_whole_mean_vector_and_constant_file(spark):
    x = spark.createDataFrame([(1, [1.0, 4.0]), (1, [3.0, 0.0]), (2, [5.0, 6.0]), (None, [9.0, 9.0])], "cluster_id long, embedding array<double>")
    assert {(r.cluster_id, r.size, *r.mean_vector) for r in posts.mean_vectors(x).select("cluster_id", F.col("size").alias("size"), "mean_vector").collect()} == {(1, 2, 2.0, 2.0), (2, 1, 5.0, 6.0)}
    f = spark.createDataFrame([("a", 3), ("a", 3), ("a", None), ("b", 1), ("b", 2)], "file string, engagement int")
    assert sorted((r.file, r.engagement or 0, r.rank) for r in posts.engagement_rank(f).collect()) == [("a", 0, None), ("a", 3, 10.0), ("a", 3, 10.0), ("b", 1, 5.5), ("b", 2, 10.0)]
