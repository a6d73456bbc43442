import duckdb
import pytest

from postloom.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLES[name]).df()
    cols, by = sorted(got.columns), [c for c in ("query_id", "lang", "source", "part", "rank", "doc_id") if c in got]
    assert cols == sorted(want.columns) and len(got) == len(want)
    got, want = got[cols].sort_values(by).reset_index(drop=True), want[cols].sort_values(by).reset_index(drop=True)
    for c in cols:
        assert ((got[c] == want[c]) if got[c].dtype == object or "str" in str(got[c].dtype) else abs(got[c] - want[c]) <= 1e-6).all(), c
