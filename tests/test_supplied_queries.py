import datetime
import math

import duckdb
import pytest

from rosterloom.plans import scenarios, supplied

QUERIES, ORACLE_SQL = supplied.QUERIES | scenarios.QUERIES, supplied.ORACLE_SQL | scenarios.ORACLE_SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views(medium):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{medium}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, views, medium, name):
    df = QUERIES[name](spark, medium)
    want = views.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got, expected = rows_of(df.columns, df.collect()), rows_of(columns, want.fetchall())
    assert len(got) == len(expected) > 0
    assert got == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and len(QUERIES) >= 44
