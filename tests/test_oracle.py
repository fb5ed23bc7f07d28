"""Every query that has SQL gives what DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from corpusloom import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    return str(x) if hasattr(x, "isoformat") else x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    found = table(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(catalog.SQL[name])
    assert found == table([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, DIR).count() > 0
