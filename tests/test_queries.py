"""Every query that has SQL, against DuckDB on the small tables."""

import os

import duckdb
import pytest

from plumbmark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(con, sf=SF):
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")


def rows(frame, columns):
    frame = frame[sorted(columns)].astype(object)
    return sorted(map(str, (tuple(None if v is None or v != v else v for v in r) for r in frame.itertuples(index=False))))


def same(spark, query, sql, sf=SF):
    con = duckdb.connect()
    views(con, sf)
    got, want = query(spark, sf).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, got.columns) == rows(want, want.columns)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
