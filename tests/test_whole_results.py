"""Queries whose results hold all rows, not a page or a share of them."""

from rosterloom.plans import supplied


def test_document_list_holds_all_orders_in_order(spark, small):
    got = [(r.o_orderdate, r.o_orderkey, r.location_count) for r in supplied.QUERIES["document_list"](spark, small).collect()]
    orders = spark.read.parquet(f"{small}/orders.parquet").collect()
    assert len(got) == len(orders) > 50
    assert [g[:2] for g in got] == sorted(((r.o_orderdate, r.o_orderkey) for r in sorted(orders, key=lambda r: r.o_orderkey)), key=lambda x: (-x[0].toordinal(), x[1]))
    assert sum(g[2] for g in got) == spark.read.parquet(f"{small}/lineitem.parquet").join(spark.createDataFrame([(r.o_orderkey,) for r in orders], "l_orderkey long"), "l_orderkey", "left_semi").count()


def test_every_event_starts_a_range(spark, small):
    got = sorted(map(tuple, supplied.QUERIES["range_join_all_pages"](spark, small).collect()))
    ids = sorted(r.event_id for r in spark.read.parquet(f"{small}/events.parquet").select("event_id").collect())
    known = set(ids)
    assert got == [(k, page) for k in ids for page in range(k, k + 2 + k % 3) if page in known] and len({g[0] for g in got}) == len(ids) > 50
