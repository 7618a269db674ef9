import duckdb
import pytest

import __spark_entry__ as e
from featurekit.plans.catalogue import CASES, ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE:
        db = duckdb.connect()
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        want = db.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(CASES))
def test_case_equals_sql(spark, name):
    """What the driver does with documents alone: no table is read, so none of these is a registered query."""
    run, sql = CASES[name]
    got, want = run(spark, SF).toPandas(), duckdb.connect().sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    assert name not in QUERIES and name not in ORACLE


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(ORACLE) <= set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["rename_project"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in plan
