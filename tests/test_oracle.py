"""Every table query against its SQL."""

import datetime
import decimal
import math

import duckdb
import pytest

from tabloom import queries as table_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(table_queries.oracle_sql()))
def test_query(spark, sf, views, name):
    df = table_queries.queries()[name](spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    ran = views.execute(table_queries.oracle_sql()[name])
    columns = [d[0] for d in ran.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == table(columns, ran.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
