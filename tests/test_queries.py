"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from check import TABLES, compared

SF = "/root/testdata/sf0.001"
_OPS = tuple(f"op{digit}" for digit in range(1, 10))  # corpus operators are tested in tests/llm
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(name for name in QUERIES if not name.startswith(_OPS) and name != "pipeline"))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = compared(df.columns, [tuple(row) for row in df.collect()])
    assert got[1], "no rows"
    if name in ORACLE:
        result = db.execute(ORACLE[name])
        assert got == compared([c[0] for c in result.description], result.fetchall())


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
    # what a fitted model says has no SQL; the facts about it are queries of their own
    fitted = {"model_scores", "model_importances", "model_factors", "training_run"}
    own = {name for name in QUERIES if not name.startswith(_OPS) and name != "pipeline"}
    assert own - fitted == own & set(ORACLE)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "project_key" and df.count() == 5
