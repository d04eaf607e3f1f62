"""Every reconciliation query against its SQL, and the driver contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from snapweave.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    fix = lambda v: round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(fix(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_queries_agree_with_their_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = db.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canon(got.collect(), got.columns) == canon(want.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["manifest_wide", "library_tokens", "events_report", "validate_labels"])
def test_no_python_in_the_plans(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
