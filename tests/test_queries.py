"""Every query against its SQL in DuckDB, and the entry points' shape."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from clausewright.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    one = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted(repr(tuple(one(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf_dir, con, name):
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_imports_without_a_session_or_the_optional_part():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import sys; sys.modules['clausewright.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
