"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

from pagetrace import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(found):
    return sorted(tuple(repr(round(v, 6) if isinstance(v, float) else v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df, expected = catalog.QUERIES[name](spark, sf_dir), duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    assert rows(map(tuple, df.select(*columns).collect())) == rows(expected.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
