"""Set forms of matching: key counts, the match cascade, field merges and coverage gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field_quality
from ..functions.text import identity_col, meaningful

KEYS = ("code", "address", "entity")
#: With equality of the whole row, which settles a shared entity.
ALL_KEYS = ("code", "address", "exact", "entity")


def cascade(incoming: DataFrame, stored: DataFrame, row_id: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Outcome and matched id of each incoming row against stored rows, without order among incoming ones.

    Stored rows are counted by key before the joins, so that a hot key is one row.
    """
    out = incoming
    for key in keys:
        counted = stored.filter(F.coalesce(F.col(key) != "", F.lit(False))).groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{key}"), F.min(row_id).alias(f"id_{key}"))
        out = out.join(counted, key, "left").withColumn(f"n_{key}", F.coalesce(f"n_{key}", F.lit(0)))
    c, a, e = (F.col(f"n_{k}") for k in KEYS)
    x = F.col("n_exact") if "exact" in keys else F.lit(0)
    shared = (c > 1) | ((c == 0) & (a > 1)) | ((c == 0) & (a == 0) & (e > 1) & (x != 1))
    conflict = (c == 1) & ((a > 1) | ((a == 1) & (F.col("id_address") != F.col("id_code"))))
    steps = [(k, {"code": c == 1, "address": a == 1, "exact": x > 0, "entity": e == 1}[k]) for k in keys]
    outcome, matched = F.when(shared, "ambiguous").when(conflict, "conflict"), F.when(shared | conflict, None)
    for k, test in steps:
        outcome, matched = outcome.when(test, k), matched.when(test, F.col(f"id_{k}"))
    outcome = outcome.otherwise("new")
    return out.withColumn("outcome", outcome).withColumn("matched", matched)


def takes_incoming(field: str, current: Column, new: Column, current_confidence: Column, new_confidence: Column, preserve: Column) -> Column:
    """Whether the incoming value of a field replaces the stored one."""
    q_new, q_old = field_quality(field, new), field_quality(field, current)
    better = (q_new > q_old) | ((q_new == q_old) & (identity_col(new) != identity_col(current)) & (new_confidence > current_confidence + 0.05))
    return F.when(~meaningful(current), meaningful(new)).otherwise(meaningful(new) & ~preserve & better)


def merge_fields(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str], preserve: Column | None = None) -> DataFrame:
    """Stored rows matched by key with the better value of each column."""
    new = incoming.select(key, *(F.col(c).alias(f"_new_{c}") for c in (*columns, "confidence")))
    joined = stored.join(new, key)
    keep = F.lit(False) if preserve is None else preserve
    values = {c: F.when(takes_incoming(c, F.col(c), F.col(f"_new_{c}"), F.col("confidence"), F.col("_new_confidence"), keep), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(values).select(*stored.columns)


def coverage_complete(accepted: str, rejected: str, missing_address: str, missing_contact: str) -> Column:
    """Whether few enough rows lack an address or a contact, and few enough were rejected."""
    rows = F.col(accepted)
    tests = [F.col(missing_address) / rows < 0.25, F.col(missing_contact) / rows < 0.25, F.col(rejected) / (rows + F.col(rejected)) <= 0.4]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))
