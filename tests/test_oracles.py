"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def views(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return db


def plain(rows, order):
    return sorted(tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, views, name):
    df = entry.queries()[name](spark, sf_dir)
    found = views.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), range(len(columns))) == plain(found.fetchall(), [columns.index(c) for c in df.columns])


def test_entry(spark):
    assert entry.entry(spark).first().pairs == 3
