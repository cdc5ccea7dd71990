"""Queries on tables that are larger or odder than the supplied ones, against their SQL."""

import duckdb
import pytest
from test_supplied_queries import rows_of

from rosterloom.operators import reconcile
from rosterloom.plans import scenarios, supplied

QUERIES, ORACLE_SQL = supplied.QUERIES | scenarios.QUERIES, supplied.ORACLE_SQL | scenarios.ORACLE_SQL


@pytest.fixture
def made(spark, tmp_path):
    """Writes a table given as rows, and compares a query on it with the SQL."""

    def check(name, table, columns, rows):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        df, want = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLE_SQL[name])
        got, expected = rows_of(df.columns, df.collect()), rows_of([c[0] for c in want.description], want.fetchall())
        assert got == expected and got

    return check


def test_names_that_hold_a_year_or_repeat_are_brands_of_their_own(made):
    made("process_commit", "supplier", "s_suppkey long, s_name string", [(k, f"Supplier#{n:09d}") for k, n in ((2030, 2030), (2031, 2031), (2032, 2031), (7, 120215), (20205, 120215), (5, 5))])


def _plans(spark):
    """The plans of the queries so far, as they ran, by number."""
    held = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {held.apply(k).executionId(): held.apply(k).physicalPlanDescription() for k in range(held.size())}


def test_gates_of_suppliers_with_one_name_run_without_broadcasts(spark, made):
    before = set(_plans(spark))
    made("process_gates", "supplier", "s_suppkey long, s_name string", [(k, f"Supplier#{2030 + k // 9:09d}") for k in range(18)])
    plans = [plan for k, plan in _plans(spark).items() if k not in before]
    assert len(plans) > 50 and not [plan for plan in plans if "BroadcastExchange" in plan]


@pytest.mark.parametrize("small", [1, 100])
def test_brands_without_candidates_stay(spark, small):
    rows = spark.createDataFrame([(k, "some" if k % 8 == 0 else "none") for k in (0, 2, 8, 10)], "k long, brand_key string")
    incoming, stored = scenarios._sides(rows)
    done = reconcile.reconcile_brands(incoming, stored, small=small).collect()
    assert {r.brand_key for r in done} == {"some"} and {r.existing_id for r in done} == {"0-1", "8-1"}
