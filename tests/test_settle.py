"""Groups of one step, reconciled in columns, give what the pass over rows gives."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_reconcile_groups import FIELDS, row

from rosterloom.functions import text
from rosterloom.operators import people, settle
from rosterloom.operators import reconcile as rec
from rosterloom.schema import CONTACT, CONTACT_FIELDS

DDL = f"{FIELDS}, contacts array<{CONTACT}>"
ADDRESSES = (None, "9 Elm Street", "9 Elm St.", "Elm", "n/a", " not listed　", "12 North Avenue, Suite 2")


def random_person(rng):
    pick = lambda *xs: rng.choice(xs)
    values = {
        "raw_name": pick(None, None, "Ann Gill", "ann  gill", "Bo Hu", ""), "first_name": pick(None, "Ann", "n/a", ""), "last_name": pick(None, "Gill"), "title": pick(None, "Owner"),
        "email": pick(None, None, "a@x.example.com", "A@X.example.com"), "phone": pick(None, None, "775-555-0100", "+1 (775) 555.0100", "n/a"),
    }
    return dict.fromkeys(CONTACT_FIELDS) | values


def random_member(rng, g, stored, common):
    pick = lambda *xs: rng.choice(xs)
    r = row(
        document_id=pick("new", "old") if stored else "new", location_code=pick(None, None, f"HW-{g}", f"hw {g}"), address=pick(*ADDRESSES), city=pick(f"City{g}", f"CITY{g}"), state=pick("TX", "TX", "tx", "none"),
        franchisee_entity=pick("Kite Works LLC", "Kite Works LLC", "Café & Söhne", "abc", None), zip=pick(None, "89501", "89501-0001", "x"), phone=pick(None, "775-555-0100", "555"), email=pick(None, "a@x.example.com", "a"),
        raw_source_text=pick(f"text {g}", f"Text, {g}", f"Store No. 4{g:05d}", None), confidence=pick(0.5, 0.53, 0.9, None), status=pick("Current", "Former", "", None), exit_reason=pick(None, "sold"), printed_page=pick("3", "4", None),
        review_status=pick("Needs review", "Approved", "Rejected", None) if stored else pick("Needs review", "Auto-verified"),
    )
    return r | {c: v for c, v in common.items() if rng.random() < 0.8}, [random_person(rng) for _ in range(pick(0, 0, 1, 2, 3))]


def outcome(rows):
    plain = lambda c: tuple(tuple(p[k] for k in CONTACT_FIELDS) for p in c) if c is not None else None
    return Counter((r["action"], r["existing_id"], r["changed"], r["updated"], r["contacts_changed"], plain(r["contacts"]), *(r[c] for c in rec.LOCATION_FIELDS)) for r in rows)


@pytest.mark.parametrize("seed", range(2))
def test_one_step_groups_need_no_pass_over_rows(spark, monkeypatch, seed):
    rng, incoming, stored = random.Random(seed), [], []
    for g in range(400):
        n_stored, n_new = rng.choice(((1, 1), (2, 1), (3, 1), (4, 1), (0, 1), (0, 2), (2, 0)))
        # most members of a group are alike in part, so that all kinds of matches occur
        common = {c: v for c, v in random_member(rng, g, False, {})[0].items() if c in ("address", "franchisee_entity", "raw_source_text", "zip", "status", "state", "city")}
        stored += [(f"{g}-{k}", *random_member(rng, g, True, common)) for k in range(n_stored)]
        incoming += [random_member(rng, g, False, common) for _ in range(n_new)]
    want = rec.reconcile(incoming, stored)
    blank = dict.fromkeys(("changed", "updated", "contacts_changed", "contacts", *rec.LOCATION_FIELDS))
    kept = [r.row | {"action": "added" if r.stored_id is None else "matched", "existing_id": r.stored_id, "changed": r.changed, "updated": r.updated, "contacts_changed": r.contacts_changed, "contacts": r.contacts} for r in want.records]
    assert {r["review_reason"] for r in kept} > {rec.P.AMBIGUOUS_CODE, rec.P.AMBIGUOUS_ADDRESS, rec.P.AMBIGUOUS_ENTITY, rec.P.CONFLICTING_IDENTITY}
    tail = lambda r, people: (*(r[c] for c in rec.LOCATION_FIELDS), [tuple(p[k] for k in CONTACT_FIELDS) for p in people] or None)
    new = spark.createDataFrame([("b", k, *tail(*r)) for k, r in enumerate(incoming)], f"brand_key string, ordinal long, {DDL}")
    old = spark.createDataFrame([("b", k, *tail(r, c)) for k, r, c in stored], f"brand_key string, id string, {DDL}")
    monkeypatch.setattr(rec, "map_groups", lambda *a: pytest.fail("rows of one step went through Python"))
    result = rec.reconcile_brands(new, old, small=0)
    rows = [r.asDict(recursive=True) for r in result.collect()]
    assert outcome(rows) == outcome(kept + [blank | {"action": "deleted", "existing_id": k} for k in want.deleted])
    assert sum(r["ambiguous"] for r in rows) == want.counts["ambiguous"] > 20


def test_merged_contacts_in_both_forms(spark):
    rng = random.Random(5)
    lists = [tuple([random_person(rng) for _ in range(rng.randrange(4))] for _ in range(2)) for _ in range(400)]
    plain = lambda c: [tuple(p[k] for k in CONTACT_FIELDS) for p in c]
    df = spark.createDataFrame([(k, plain(a), plain(b)) for k, (a, b) in enumerate(lists)], f"k int, a array<{CONTACT}>, b array<{CONTACT}>")
    got = {r.k: [tuple(p) for p in r.m] for r in df.select("k", settle.merged_contacts(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {k: plain(people.merge_contacts(a, b)[0]) for k, (a, b) in enumerate(lists)}


def test_values_and_address_words_in_both_forms(spark):
    texts = [None, "", " ", " 　", "n/a", " N/A\t", "﻿not  listed", "not listed ", "Not listed.", "none", "Nonesuch", "-", "- -", "—", "unknown", "nа", "na", "1", "Xn/a", "x ", "North Street", "12 str ste suite", "streets east west n", "éast Ave"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select(text.meaningful(F.col("t")).alias("m"), text.trim_col(F.col("t")).alias("w"), text.abbreviate_col(text.identity_col(F.col("t"))).alias("a")).collect()
    assert [tuple(r) for r in got] == [(text.is_meaningful(t), None if t is None else text.trimmed(t), text.address_identity(t)) for t in texts]
