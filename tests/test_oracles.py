"""Every query with SQL gives the same rows in DuckDB."""

import duckdb
import pytest

from keyloom.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    got_columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in got_columns) for r in df.collect())
    want = duck.execute(queries.ORACLES[name])
    want = want.to_arrow_table() if hasattr(want, "to_arrow_table") else want.fetch_arrow_table()
    assert got_columns == sorted(want.column_names)
    assert got == sorted(tuple(r[c] for c in got_columns) for r in want.to_pylist())
    kinds = {n: str(t) for n, t in zip(want.column_names, want.schema.types)}
    same = {"bigint": "int64", "int": "int32", "string": "string", "boolean": "bool", "double": "double"}
    assert {n: same[k] for n, k in df.dtypes} == kinds
