"""Buckets, changes of different brands, conflicts, compaction, and claims that were left behind."""

import threading

import pytest
from pyspark.sql import functions as F

from rosterloom.schema import LOCATION_TEXT
from rosterloom.sources import store as stores
from rosterloom.sources.store import ConcurrentChange, SnapshotStore


def place(spark, rows):
    """Locations of (id, franchisor, city)."""
    df = spark.createDataFrame(rows, "id string, franchisor string, city string")
    blank = {c: F.lit(None).cast("string") for c in LOCATION_TEXT if c not in ("franchisor", "city")}
    return df.withColumns({**blank, "source_page": F.lit(None).cast("int"), "confidence": F.lit(None).cast("double"), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})


def cities(store, *at):
    return {r.id: r.city for r in store.read("locations", *at).collect()}


def scope(store, spark, brand):
    return [f"brand/{store.touched(spark.createDataFrame([(brand,)], 'b string'), 'b')[0]}"]


@pytest.fixture
def store(spark, tmp_path):
    out = SnapshotStore(spark, str(tmp_path / "store"))
    out.commit(locations=place(spark, [(f"{b}{k}", b, "Reno") for b in ("Mill", "Kite", "Gill") for k in range(3)]))
    return out


def test_a_change_of_a_row_writes_one_bucket(spark, store):
    base = store.version()
    before = store.manifest(base)["tables"]["locations"]
    store.change(base, scope(store, spark, "Mill"), locations=place(spark, [("Mill1", "MILL", "Waco")]))
    after = store.manifest(store.version())["tables"]["locations"]
    assert [b for b in after if after[b] != before.get(b)] == [str(store.touched(spark.createDataFrame([("mill",)], "b string"), "b")[0])]
    assert cities(store)["Mill1"] == "Waco" and len(cities(store)) == 9
    assert cities(store, base)["Mill1"] == "Reno"  # what a reader of the older version sees
    gone = place(spark, [("Mill2", "Mill", None)]).withColumn("_deleted", F.lit(True))
    store.change(store.version(), scope(store, spark, "Mill"), locations=gone)
    assert "Mill2" not in cities(store) and len(cities(store)) == 8
    assert SnapshotStore(spark, store.root, buckets=7).buckets == stores.BUCKETS  # a stored number of buckets holds


def test_two_brands_commit_at_once_and_one_brand_does_not(spark, store):
    base = store.version()
    store.change(base, scope(store, spark, "Mill"), locations=place(spark, [("Mill0", "Mill", "Waco")]))
    store.change(base, scope(store, spark, "Kite"), locations=place(spark, [("Kite0", "Kite", "Austin")]))
    assert (cities(store)["Mill0"], cities(store)["Kite0"], store.version()) == ("Waco", "Austin", base + 2)
    with pytest.raises(ConcurrentChange):
        store.change(base, scope(store, spark, "Mill"), locations=place(spark, [("Mill1", "Mill", "Lost")]))
    with pytest.raises(ConcurrentChange):
        store.commit(base, locations=place(spark, []))
    assert cities(store)["Mill1"] == "Reno"


def test_threads_of_two_brands_and_of_one(spark, store):
    """Every brand's change is made once; those of one brand follow each other."""
    turns = []

    def add(brand, k):
        def change(base):
            turns.append(brand)
            n = sum(r.franchisor == brand for r in store.read("locations", base).collect())
            store.change(base, scope(store, spark, brand), locations=place(spark, [(f"{brand}-new{n}", brand, f"after {n}")]))

        store.attempt(change)

    threads = [threading.Thread(target=add, args=(b, k)) for k, b in enumerate(("Mill", "Kite", "Mill", "Gill"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = cities(store)
    assert {k for k in got if "new" in k} == {"Mill-new3", "Mill-new4", "Kite-new3", "Gill-new3"}
    assert turns.count("Kite") == turns.count("Gill") == 1


def test_rows_that_move_between_buckets(spark, store):
    moved = place(spark, [("Kite0", "Gill", "Waco")]).withColumn("_deleted", F.lit(False)).unionByName(place(spark, [("Kite0", "Kite", None)]).withColumn("_deleted", F.lit(True)))
    store.change(store.version(), ["brand/x"], locations=moved)
    assert [(r.franchisor, r.city) for r in store.read("locations").filter("id = 'Kite0'").collect()] == [("Gill", "Waco")]


def test_compaction_keeps_rows_and_changes_that_come_meanwhile(spark, store, monkeypatch):
    for k in range(4):
        store.change(store.version(), scope(store, spark, "Mill"), locations=place(spark, [("Mill0", "Mill", f"v{k}")]))
    gone = place(spark, [(f"Kite{k}", "Kite", None) for k in range(3)]).withColumn("_deleted", F.lit(True))
    store.change(store.version(), scope(store, spark, "Kite"), locations=gone)
    want, publish = cities(store), store._publish

    def meanwhile(base, scopes, change, added):
        monkeypatch.setattr(store, "_publish", publish)
        store.change(base, scope(store, spark, "Mill"), locations=place(spark, [("Mill0", "Mill", "late")]))
        return publish(base, scopes, change, added)

    monkeypatch.setattr(store, "_publish", meanwhile)
    store.compact(2)
    assert cities(store) == want | {"Mill0": "late"}
    store.compact(2)
    held = store.manifest(store.version())["tables"]["locations"]
    assert all(len(x) == 1 for x in held.values()) and cities(store) == want | {"Mill0": "late"}
    assert len(held) == 2  # the bucket without rows is gone
    version = store.version()
    assert store.compact(2) == version
    store.vacuum(1)
    assert cities(store) == want | {"Mill0": "late"}


def test_claims_left_behind_are_taken_over(spark, store, monkeypatch):
    base = store.version()
    store._put(store._path(f"{store.root}/pointers/claim-{base + 1}"), "change-of-a-lost-driver")
    monkeypatch.setattr(stores, "CLAIMS", 3)
    with pytest.raises(ConcurrentChange):
        store.change(base, [], locations=place(spark, [("Mill0", "Mill", "Waco")]))
    monkeypatch.setattr(stores, "CLAIM_SECONDS", 0)
    store.change(base, [], locations=place(spark, [("Mill0", "Mill", "Waco")]))
    assert cities(store)["Mill0"] == "Waco" and store.version() == base + 1


def test_contacts_lie_with_their_locations(spark, store):
    people = spark.createDataFrame([(f"{k}/0", k, None, None, None, None, None, None, f"{k}@x.example.com", None) for k in ("Mill0", "Kite0")], stores.EMPTY_TABLES["contacts"])
    store.commit(contacts=people)
    for brand in ("Mill", "Kite"):
        bucket = store.touched(spark.createDataFrame([(brand,)], "b string"), "b")
        assert [r.location_id for r in store.read("contacts", buckets=bucket).collect()] == [f"{brand}0"]


def counts_by_scan(store):
    return {tuple(r) for r in store.read("locations").groupBy("document_id", "status", "review_status").count().collect()}


def test_tallies_follow_every_change(spark, store):
    """After rows are added, changed, deleted, moved and compacted, the sums are what a scan counts."""
    with_status = lambda rows, status, review="Approved", doc="d": place(spark, rows).withColumns({"status": F.lit(status), "review_status": F.lit(review), "document_id": F.lit(doc)})
    held = lambda: {tuple(r) for r in store.tallies().collect()}
    assert held() == counts_by_scan(store) == {(None, None, None, 9)}
    steps = [
        with_status([("Mill0", "Mill", "Reno"), ("Mill7", "Mill", "Waco")], "Current"), with_status([("Mill7", "Mill", "Waco")], "Former"), with_status([("Mill7", "Mill", "Waco"), ("Mill8", "Mill", "X")], "Former", "Needs review", "e"),
        place(spark, [("Mill1", "Mill", None), ("none", "Mill", None)]).withColumn("_deleted", F.lit(True)),
        with_status([("Kite0", "Gill", "Waco")], "Current").withColumn("_deleted", F.lit(False)).unionByName(place(spark, [("Kite0", "Kite", None)]).withColumn("_deleted", F.lit(True))),
    ]
    for step in steps:
        store.change(store.version(), ["brand/x"], locations=step)
        assert held() == counts_by_scan(store)
    want = held()
    store.compact(1)
    assert held() == want == counts_by_scan(store)
    store.commit(locations=with_status([("a", "Mill", "Reno")], "Planning"))
    assert held() == {("d", "Planning", "Approved", 1)}
