"""Every registered query against its SQL on the smallest scale."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from plantledger.plans import JOBS
from tools.check_twins import rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in sorted(Path(FOLDER).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(JOBS))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of(names, result.fetchall())
    assert got - want == Counter() and want - got == Counter()


def test_every_query_has_sql():
    assert set(JOBS) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
