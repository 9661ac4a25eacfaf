import duckdb
import pytest

from fathomgrid.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SMALL).toPandas()[want.columns.tolist()]
    key = lambda f: sorted(map(tuple, f.to_numpy().tolist()))
    assert key(got) == key(want)
