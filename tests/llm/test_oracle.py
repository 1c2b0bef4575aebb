import duckdb
import pytest

from folioscan.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_queries_equal_their_twins(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(oracle.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in want.fetchall()) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())
