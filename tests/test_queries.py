"""Every registered query that has SQL, against DuckDB over the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    mine = entry.queries()[name](spark, SF)
    theirs = duck.sql(entry.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine.columns, mine.collect()) == rows(theirs.columns, theirs.fetchall())


def test_registry_needs_no_session():
    """Names and SQL can be read before a session is made."""
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > len(e.oracle_sql()) > 60)"], cwd=os.path.dirname(os.path.abspath(entry.__file__)), capture_output=True, text=True, timeout=120)
    assert told.stdout.strip().endswith("True"), told.stderr


def test_entry(spark):
    assert entry.entry(spark).count() > 0
