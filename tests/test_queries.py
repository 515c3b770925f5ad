"""Every registered listing query against DuckDB on the same tables."""

import math

import duckdb
import pytest
from gable.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, data, name):
    df = catalog.queries()[name](spark, data)
    relation = duck.sql(ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    expected = [dict(zip(relation.columns, r)) for r in relation.fetchall()]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[c]) for c in cols) for r in expected)


def test_queries_without_sql(spark, data):
    for name in sorted(catalog.queries().keys() - ORACLE.keys()):
        assert catalog.queries()[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert catalog.queries().keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
