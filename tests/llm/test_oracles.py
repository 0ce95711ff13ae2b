"""The SQL of the corpus operators gives their rows."""

import os

import duckdb
import pytest

from barloom.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    clean = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    want = sorted(clean(r) for r in cur.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert sorted(clean(r) for r in df.select(*names).collect()) == want
