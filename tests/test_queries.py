import os

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans import queries as health

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(health.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    got = health.queries()[name](spark, DATA)
    result = db.execute(health.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(key(r[c] for c in columns) for r in got.collect()) == sorted(map(key, result.fetchall()))


def test_entry_and_report(spark):
    assert entry.entry(spark).count() == 25
    rows = health.queries()["report_json"](spark, DATA).collect()
    assert len(rows) == 25
    assert all('"gate":{"decision"' in r.report for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())
