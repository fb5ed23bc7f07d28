"""Queries of the corpus operators that SQL can say, against DuckDB."""

import duckdb
import pytest

from corpusloom.llm import queries

DIR = "/root/testdata/sf0.001"


def plain(x):
    return round(x, 5) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    out = con.execute(queries.SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == sorted((tuple(map(plain, r)) for r in out.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_whole_table(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() == spark.read.parquet(f"{DIR}/documents.parquet").count()
