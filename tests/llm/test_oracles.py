"""The SQL of corpus queries gives their rows, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from rosterloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    got = registry.QUERIES[name](spark, small)
    assert sorted(got.columns) == columns
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(tuple(r[k] for k in order) for r in want.fetchall())
