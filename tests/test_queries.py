"""Every registered engine query runs; those with SQL give DuckDB's rows."""

import math
import os

import duckdb
import pytest

from barloom.operators.series import lineage
from barloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def plain(rows, names):
    """Rows by column name, ordered by what three digits show, then exactly; rounding may differ in its last digit."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else float(x) + 0.0 if number(x) else x
    rough = lambda r: str(tuple(round(x, 3) + 0.0 if number(x) and math.isfinite(x) else x for x in r))
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=lambda r: (rough(r), str(r)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    want = plain(cur.fetchall(), names)
    assert sorted(names) == sorted(df.columns) and len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if any(x != y and not (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-4 * max(1.0, abs(x))) for x, y in zip(a, b, strict=True))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    """Held against loops elsewhere; here they must give rows."""
    assert QUERIES[name](spark, SF).count() > 0


def test_lineage_of_a_long_chain(spark):
    ids = spark.range(1, 12_001)
    chain = ids.selectExpr("id", "CASE WHEN id > 1 THEN id - 1 END AS previous_id")
    others = spark.createDataFrame([(20_000, None), (20_001, 20_000), (20_002, 20_000), (30_001, 30_000), (40_000, 40_001), (40_001, 40_000)], "id long, previous_id long")
    got = sorted(tuple(r) for r in lineage(chain.union(others)).collect())
    assert got == [(i, 1, i - 1) for i in range(1, 12_001)] + [(20_000, 20_000, 0), (20_001, 20_000, 1), (20_002, 20_000, 1)]
