"""Brands that are split into groups give what one pass over the whole brand gives."""

import random
from collections import Counter

import pytest

from rosterloom.operators import reconcile as rec
from rosterloom.operators.contract import group_nodes
from rosterloom.schema import CONTACT
from rosterloom.session import Aside

FIELDS = ", ".join(f"{c} {'int' if c == 'source_page' else 'double' if c == 'confidence' else 'string'}" for c in rec.LOCATION_FIELDS)


def row(**values):
    base = {"document_id": "new", "franchise_name": "Quiet Mill", "franchisor": "Quiet Mill", "status": "Current", "country": "United States", "confidence": 0.9, "review_status": "Needs review", "review_reason": "r", "source_page": 3, "raw_source_text": "raw"}
    return dict.fromkeys(rec.LOCATION_FIELDS) | base | values


def random_row(rng, stored, words):
    pick = lambda *xs: rng.choice(xs)
    return row(
        document_id=pick("new", "old") if stored else "new", location_code=pick(None, None, None, "N/A", f"X{rng.randrange(words):03d}"), address=pick(None, "not disclosed", f"{rng.randrange(words)} Oak Street", f"{rng.randrange(words)} Oak St."),
        city=pick(None, "Reno", "Waco", f"City{rng.randrange(words)}"), state=pick("TX", "TX", "NV", None), franchisee_entity=pick(None, "Kite Works LLC", f"Mill {rng.randrange(words)} Group", "abc"), zip=pick(None, "89501"),
        phone=pick(None, "775-555-0100"), raw_source_text=pick(f"text {rng.randrange(words)}", f"Store No. 44{rng.randrange(words):02d} in town", None), confidence=pick(0.5, 0.9, None), review_status=pick("Needs review", "Approved") if stored else "Needs review",
        status=pick("Current", "Former"),
    )


def frames(spark, incoming, stored):
    ddl = f"{FIELDS}, contacts array<{CONTACT}>"
    tail = lambda r: (*(r[c] for c in rec.LOCATION_FIELDS), [])
    new = spark.createDataFrame([(b, k, *tail(r)) for b, rows in incoming.items() for k, r in enumerate(rows)], f"brand_key string, ordinal long, {ddl}")
    old = spark.createDataFrame([(b, k, *tail(r)) for b, rows in stored.items() for k, r in rows], f"brand_key string, id string, {ddl}")
    return new, old


def outcome(rows):
    return Counter((r["brand_key"], r["action"], r["existing_id"], r["changed"], r["updated"], *(r[c] for c in rec.LOCATION_FIELDS)) for r in rows)


def whole(incoming, stored):
    """One pass over each brand."""
    rows, counts = [], {}
    for brand, new in incoming.items():
        if not new:
            continue
        result = rec.reconcile([(r, []) for r in new], [(k, r, []) for k, r in sorted(stored[brand], key=lambda x: x[0])])
        blank = dict.fromkeys(("changed", "updated", *rec.LOCATION_FIELDS))
        rows += [r.row | {"brand_key": brand, "action": "added" if r.stored_id is None else "matched", "existing_id": r.stored_id, "changed": r.changed, "updated": r.updated} for r in result.records]
        rows += [blank | {"brand_key": brand, "action": "deleted", "existing_id": k} for k in result.deleted]
        if result.records or result.deleted:
            counts[brand] = result.counts
    return outcome(rows), counts


@pytest.mark.parametrize("seed", range(4))
def test_split_brands_equal_whole_ones(spark, seed):
    rng = random.Random(seed)
    sizes = {"a": (60, 60, 40), "b": (150, 150, 300), "c": (20, 0, 9), "d": (0, 20, 9)}
    incoming = {b: [random_row(rng, False, words) for _ in range(n)] for b, (n, _, words) in sizes.items()}
    stored = {b: [(f"{b}{k:03d}", random_row(rng, True, words)) for k in range(n)] for b, (_, n, words) in sizes.items()}
    want, counts = whole(incoming, stored)
    result = rec.reconcile_brands(*frames(spark, incoming, stored), small=10)
    assert outcome(r.asDict() for r in result.collect()) == want
    assert {r.brand_key: r.counted.asDict() for r in rec.brand_counts(result).collect()} == counts


def test_keys_that_only_a_merge_creates(spark):
    """A match by code takes the city of one row and the street of another; a third row has both."""
    a = row(location_code="X100", city="Reno", state="NV", raw_source_text="a", document_id="old")
    b = row(location_code="X100", address="9 Elm St", raw_source_text="b")
    c = row(address="9 Elm Street", city="Reno", state="NV", phone="775-555-0100", raw_source_text="c")
    far = row(address="1 Far Rd", city="Waco", state="TX", raw_source_text="far")
    incoming, stored = {"x": [b, c, far]}, {"x": [("a", a)]}
    want, counts = whole(incoming, stored)
    assert counts["x"]["added"] == 1
    result = rec.reconcile_brands(*frames(spark, incoming, stored), small=0)
    assert outcome(r.asDict() for r in result.collect()) == want


def test_too_many_created_keys_take_the_brand_whole(spark, monkeypatch):
    monkeypatch.setattr(rec, "LISTED_KEYS", 2)
    rng = random.Random(9)
    incoming, stored = {"x": [random_row(rng, False, 30) for _ in range(60)]}, {"x": [(f"{k:03d}", random_row(rng, True, 30)) for k in range(60)]}
    assert outcome(r.asDict() for r in rec.reconcile_brands(*frames(spark, incoming, stored), small=0).collect()) == whole(incoming, stored)[0]


def test_groups_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1090)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(150)] + [(7, 7)]
    nodes = sorted({x for e in edges for x in e} | {1, 2})
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {r.node: r.group for r in group_nodes(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"), Aside(spark)).collect()}
    sets = lambda root: {frozenset(m for m in nodes if root(m) == root(n)) for n in nodes}
    assert sets(got.get) == sets(find)


def test_only_shared_keys_are_contracted(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(rec, "group_nodes", lambda nodes, edges, aside: counted.append(edges.count()) or group_nodes(nodes, edges, aside))
    rows = [row(raw_source_text=f"text {k}", address=f"{k if k > 1 else 0} Oak St", city="Reno", state="NV") for k in range(12)]
    df = spark.createDataFrame([(k, "b", *(r[c] for c in rec.LOCATION_FIELDS)) for k, r in enumerate(rows)], f"node long, brand_key string, {FIELDS}")
    groups = {r.node: r.group for r in rec.split_brands(df, Aside(spark)).collect()}
    assert groups[0] == groups[1] and counted == [1]
