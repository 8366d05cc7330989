import duckdb
import pytest

from ratewright.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    df = Q.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    got = sorted(map(tuple, df.select(*names).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str) and got
