"""Reconciliation in column form, for groups of rows in which one candidate meets what is there.

Candidates are taken in order, so that a group of several needs ``reconcile``, row by row.  Where a
group has one candidate only, or two and no stored row (the first of which is added as it is), there
is one step: ``settle`` finds the keys that the last row shares with the others by windows over
the group, decides as ``Ledger.take`` does, and merges.  No row passes through Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import abbreviate_col, group, identity_col, meaningful
from ..schema import CONTACT, CONTACT_FIELDS
from .matching import takes_incoming

KINDS = ("code", "address", "exact", "entity")


def _bare(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def _words(rows: DataFrame, within: str = "") -> DataFrame:
    """Rows with the identity texts of what keys are made of, each found once; ``within`` goes before the names of the fields."""
    get = lambda c: F.col(f"{within}{c}")
    plain = {"status": "status", "zip": "zip", "own": "location_code", "street": "address", "name": "franchisee_entity", "town": "city", "region": "state", "text": "raw_source_text"}
    words = {f"_{k}": identity_col(get(c)) for k, c in plain.items()}
    words |= {"_own": _bare(words["_own"]), "_told": _bare(identity_col(group(get("raw_source_text"), P.LOCATION_CODE))), "_street": abbreviate_col(words["_street"])}
    return rows.withColumns(words | {f"_has_{c}": meaningful(get(c)) for c in ("address", "city", "state")})


def _placed(head: str) -> Column:
    return F.concat_ws("|", head, "_town", "_region")


def row_keys(rows: DataFrame) -> DataFrame:
    """(node, brand_key, keys, codes, street, town, region, entity) of rows: hashes of what a row can be found by, ``codes`` among them, and the values that a merge can combine with those of others.

    The exact key stands for its source text alone, which every merge takes over whole.  Hashes
    that fall together only make groups larger.
    """
    there = lambda *names: reduce(lambda x, y: x | y, (F.col(c) != "" for c in names))
    hashed = lambda kind, value, when: F.when(when, F.xxhash64("brand_key", F.lit(kind), value))
    long_name = F.length("_name") >= 5
    codes = hashed("code", F.col("_own"), there("_own")), hashed("code", F.col("_told"), there("_told") & (F.col("_told") != F.col("_own")))
    found = hashed("text", F.col("_text"), there("_text")), hashed("address", _placed("_street"), there("_street", "_town", "_region")), hashed("entity", _placed("_name"), long_name)
    return _words(rows).select(
        "node", "brand_key", F.array_compact(F.array(*codes, *found)).alias("keys"), F.array_compact(F.array(*codes)).alias("codes"),
        # also where a part is a placeholder: a row of the same words may fill it
        F.when(F.col("_has_address"), F.col("_street")).alias("street"), F.when(F.col("_has_city"), F.col("_town")).alias("town"), F.when(F.col("_has_state"), F.col("_region")).alias("region"),
        F.when(long_name, F.col("_name")).alias("entity"),
    )


def _with_keys(rows: DataFrame) -> DataFrame:
    """Rows (whose fields are in the struct ``row``) with the four keys of ``reconcile.identity_keys``, null where a row has none."""
    c, placed = F.col, F.col("_has_city") & F.col("_has_state")
    keys = {
        "code": F.when(c("_own") != "", c("_own")).when(c("_told") != "", c("_told")), "address": F.when(placed & c("_has_address"), _placed("_street")), "entity": F.when(placed & (F.length("_name") >= 5), _placed("_name")),
        "exact": F.when((c("_text") != "") & (c("_name") != ""), F.concat_ws("|", "_status", "_name", "_street", "_town", "_region", "_zip", "_text")),
    }
    return _words(rows, "row.").select(*rows.columns, *(v.alias(f"key_{k}") for k, v in keys.items()))


# ------------------------------------------------------------------ contacts


def _contact_identity(c: Column) -> tuple[Column, Column, Column]:
    """Comparable email, phone and name, as ``people.contact_identity`` gives them."""
    parts = F.concat_ws(" ", *(F.nullif(c[k], F.lit("")) for k in ("first_name", "middle_name", "last_name", "suffix")))
    digits = F.regexp_replace(F.coalesce(c["phone"], F.lit("")), "[^0-9]", "")
    return _bare(identity_col(c["email"])), F.right(digits, F.lit(10)), identity_col(F.coalesce(c["raw_name"], parts))


def _known(c: Column) -> Column:
    return F.struct(c.alias("contact"), *(v.alias(k) for k, v in zip(("email", "phone", "name"), _contact_identity(c), strict=True)))


def _same_contact(a: Column, b: Column) -> Column:
    none = lambda *texts: reduce(lambda x, y: x & y, (t == "" for t in texts))
    return (
        F.when((a["email"] != "") & (a["email"] == b["email"]), True)
        .when((a["name"] != "") & (b["name"] != "") & (a["phone"] != "") & (b["phone"] != ""), (a["name"] == b["name"]) & (a["phone"] == b["phone"]))
        .when((a["phone"] != "") & (a["phone"] == b["phone"]), none(a["name"], b["name"], a["email"], b["email"]))
        .otherwise((a["name"] != "") & (a["name"] == b["name"]) & none(a["email"], b["email"], a["phone"], b["phone"]))
    )


def merged_contacts(stored: Column, incoming: Column) -> Column:
    """Both lists with like contacts joined and missing fields filled, as ``people.merge_contacts`` gives them."""
    fill = lambda m, x: F.struct(*(F.when(~meaningful(m[k]) & meaningful(x[k]), x[k]).otherwise(m[k]).alias(k) for k in CONTACT_FIELDS))

    def take(held: Column, x: Column) -> Column:
        like = F.array_position(F.transform(held, lambda m: _same_contact(m, x)), F.lit(True))
        filled = lambda m: F.when(fill(m["contact"], x["contact"]) == m["contact"], m).otherwise(_known(fill(m["contact"], x["contact"])))
        return F.when(like == 0, F.concat(held, F.array(x))).otherwise(F.transform(held, lambda m, i: F.when(i + 1 == like, filled(m)).otherwise(m)))

    none = F.array().cast(f"array<struct<contact:{CONTACT},email:string,phone:string,name:string>>")
    folded = F.aggregate(F.transform(F.concat(stored, incoming), _known), none, take, lambda held: held["contact"])
    return F.when(F.size(stored) + F.size(incoming) > 1, folded).otherwise(F.concat(stored, incoming))


# ------------------------------------------------------------------ the step


def settle(rows: DataFrame, merged: tuple[str, ...], source: tuple[str, ...], judged: tuple[str, ...], reviewed: tuple[str, ...]) -> DataFrame:
    """Results of groups (group, brand_key) with at most one candidate, or two and no stored row.

    ``rows`` has brand_document, which stored rows must have to be deleted, besides side, ordinal, id, contacts and the
    fields: those to be merged, those of the source, those of the review, and status.
    """
    fields, ordered = ("status", *merged, *source, *judged), Window.partitionBy("group", "brand_key").orderBy("side", "ordinal", "id")
    # the fields of a row move as one value
    packed = F.struct(*fields, F.coalesce("contacts", F.array().cast(f"array<{CONTACT}>")).alias("contacts")).alias("row")
    rows = _with_keys(rows.select("group", "brand_key", "side", "ordinal", "id", "brand_document", packed).repartition("group", "brand_key"))
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the row taken is the last one; all others are there before it
    last = F.struct("side", *(f"key_{k}" for k in KINDS))
    rows = rows.withColumns({"place": F.row_number().over(ordered), "n": F.count(F.lit(1)).over(every), "last": F.last(last).over(every)})
    taken, before = (F.col("side") == 1) & (F.col("place") == F.col("n")), (F.col("last.side") == 1) & (F.col("place") < F.col("n"))
    same = {f"is_{k}": before & F.coalesce(F.col(f"key_{k}") == F.col(f"last.key_{k}"), F.lit(False)) for k in KINDS}
    rows = rows.withColumns(same | {"taken": taken}).drop("last", *(f"key_{k}" for k in KINDS))
    row, new, taken, (code, address, exact, entity) = F.col("row"), F.col("new"), F.col("taken"), (F.col(f"is_{k}") for k in KINDS)
    counts = {f"n_{k}": F.count_if(F.col(f"is_{k}")).over(every) for k in KINDS} | {"apart": F.count_if(address & ~code).over(every), "first": F.min(F.when(exact, F.col("place"))).over(every)}
    rows = rows.withColumns(counts | {"new": F.last("row").over(every)})
    n_code, n_address, n_exact, n_entity = (F.col(f"n_{k}") for k in KINDS)
    reason = (
        F.when(n_code > 1, P.AMBIGUOUS_CODE).when((n_code == 0) & (n_address > 1), P.AMBIGUOUS_ADDRESS).when((n_code == 0) & (n_address == 0) & (n_entity > 1) & (n_exact != 1), P.AMBIGUOUS_ENTITY)
        .when((n_code > 0) & (F.col("apart") > 0), P.CONFLICTING_IDENTITY)
    )
    rows = rows.withColumn("reason", reason)
    doubted = F.col("reason").isNotNull()
    first = F.coalesce(F.col("place") == F.col("first"), F.lit(False))
    match = F.when(doubted, exact & (n_exact == 1)).when(n_code > 0, code).when(n_address > 0, address).when(n_exact > 0, first).otherwise(entity & (n_entity == 1))
    alone = F.when(doubted, n_exact == 0).otherwise((n_code == 0) & (n_address == 0) & (n_exact == 0) & (n_entity != 1))
    kept = F.coalesce(row["review_status"].isin(*reviewed), F.lit(False))
    gone = (F.col("side") == 0) & F.coalesce((F.col("brand_document") != "") & (row["document_id"] == F.col("brand_document")), F.lit(False))
    rows = rows.withColumns({"match": match, "flagged": doubted & (n_exact > 1) & exact, "kept": kept})
    match, flagged, kept = F.col("match"), F.col("flagged"), F.col("kept")
    how = F.when(taken, F.when(alone, "added")).when(F.col("side") == 1, "added").when(match | flagged, "matched").when(gone, "deleted")
    rows = rows.withColumn("action", how).filter("action IS NOT NULL")

    flag = (match & doubted & ~kept) | flagged & ~kept | F.col("taken") & doubted
    sure = lambda c: F.coalesce(c, F.lit(0.8))
    takes = lambda c: match & ~row[c].eqNullSafe(new[c]) & takes_incoming(c, row[c], new[c], sure(row["confidence"]), sure(new["confidence"]), kept)
    values = {c: F.when(takes(c), new[c]).otherwise(row[c]) for c in merged}
    values["status"] = F.when(match & ~kept & F.coalesce(new["status"] != "", F.lit(False)), new["status"]).otherwise(row["status"])
    values |= {c: F.when(match, new[c]).otherwise(row[c]) for c in source}
    values |= {c: F.when(match & ~kept, new[c]).otherwise(row[c]) for c in judged}
    values["review_status"] = F.when(flag, "Needs review").otherwise(values["review_status"])
    values["review_reason"] = F.when(flag, F.col("reason")).otherwise(values["review_reason"])
    people = F.when(match, merged_contacts(row["contacts"], new["contacts"])).otherwise(row["contacts"])
    # as structs, which are compared at once, and are null where a row goes
    parts, held = {"business": ("status", *merged), "origin": source, "verdict": judged}, F.col("action") != "deleted"
    now = {f"{k}_now": F.when(held, F.struct(*(values[c].alias(c) for c in names))) for k, names in parts.items()}
    was = {f"{k}_was": F.struct(*(row[c].alias(c) for c in names)) for k, names in parts.items()}
    kept_as = ("brand_key", "action", "id", "side", "taken", "match", "flagged", row["contacts"].alias("contacts"))
    done = rows.select(*kept_as, doubted.alias("doubted"), first.alias("at_first"), *(v.alias(k) for k, v in (now | was).items()), F.when(held, people).alias("people"))
    business, origin, verdict = (F.col(f"{k}_now") != F.col(f"{k}_was") for k in parts)
    met, fresh, flagged = F.col("people") != F.col("contacts"), F.col("side") == 1, F.col("flagged")
    one = F.when(F.col("taken") | F.col("match"), F.col("doubted")).otherwise(flagged & F.col("at_first"))
    return done.select(
        "brand_key", "action", F.when(~fresh, F.col("id")).alias("existing_id"), F.when(held, fresh | met | business | origin | verdict).alias("changed"),
        # a flag is a change of a row that isn't matched, too
        F.when(held, (F.col("match") & (met | business)) | (flagged & verdict)).alias("updated"), F.when(held, (fresh & (F.size("contacts") > 0)) | met).alias("contacts_changed"),
        F.when(held & one, 1).otherwise(0).alias("ambiguous"), *(F.col(f"{k}_now")[c].alias(c) for k, names in parts.items() for c in names), F.col("people").alias("contacts"),
    )
