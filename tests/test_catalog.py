import os

import duckdb
import pytest

import __spark_entry__ as entry
from ragloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(norm(v) for v in r) for r in df.select(*columns).collect())
    if name not in catalog.ORACLE:
        assert rows
        return
    result = duck.execute(catalog.ORACLE[name])
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in result.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_texts_of_retrieval_summary_stay_where_they_are_read(spark):
    plan = catalog.QUERIES["retrieval_summary"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroups" not in plan


def test_texts_of_standard_retrieval_stay_where_they_are_read(spark):
    plan = catalog.QUERIES["standard_retrieval"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroups" not in plan
