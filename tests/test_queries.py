"""Every table query against its SQL on the smallest tables, and its plan as for large ones: without products."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()
QUERIES = {n: q for n, q in entry.queries().items() if not n.startswith("op") and n != "pipeline"}
SQL = entry.oracle_sql()
#: It meets the few rows of the shapes themselves, by a constant.
MEETS_SHAPES = "s_shapes_graph"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture
def large(spark):
    """Plans as for large tables: nothing is small enough for a broadcast that isn't asked for."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, large, name):
    frame = QUERIES[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and ("BroadcastNestedLoopJoin" not in plan or name == MEETS_SHAPES)
    got = sorted(map(str, (tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect())))
    answer = duck.execute(SQL[name])
    names = [d[0] for d in answer.description]
    want = sorted(str(tuple(r[names.index(c)] for c in sorted(names))) for r in answer.fetchall())
    assert sorted(names) == sorted(frame.columns) and got == want


def test_all_queries_have_sql():
    assert set(QUERIES) <= set(SQL)
