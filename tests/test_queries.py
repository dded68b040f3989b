"""Every query with SQL gives the SQL's rows on the smallest tables; the rest give rows."""

import math

import duckdb
import pytest

from evenkeel import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.5f}"
    return f"{x:.5f}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


#: Held by tests of their own, which run the registered queries.
SLOW = {"ml_leaf_fairness", "wf_oversample"}


@pytest.mark.parametrize("name", [n for n in plans.queries() if n not in SLOW])
def test_query(spark, sql, name):
    got = plans.queries()[name](spark, SF)
    rows = got.collect()
    oracle = plans.oracle_sql().get(name)
    if oracle is None:
        assert got.columns
        return
    found = sql.sql(oracle)
    assert sorted(found.columns) == sorted(got.columns)
    order = [found.columns.index(c) for c in got.columns]
    want = sorted(tuple(normal(r[i]) for i in order) for r in found.fetchall())
    assert sorted(tuple(normal(x) for x in r) for r in rows) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
