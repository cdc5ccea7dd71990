"""Interaction audit of quality filters by inclusion-exclusion.

For every part of the corpus, one aggregation sums the products of failure flags
over all intersections of filters (32 for five filters), for all rows and for
the rows whose loss counts.  From these joint-failure counts follow, by Moebius
inversion over subsets,

* survivors of every set of filters, and with them what each step of each order removes,
* failures of one filter alone, by inversion over supersets,
* Harsanyi dividends of the game "rows that a set of filters removes", whose shares
  ``dividend / members`` add up to the Shapley value; times the number of orders it is
  the filter's removed rows summed over all orders, a whole number.

No row is tested against an order: the orders only read 32 numbers a part.

Defined results: a null text is empty, a null source is the empty part; a row
with a null id is never a copy of another one and has no labels, and its text
makes no other row a copy; rows that repeat an id and a text are copies only of
smaller ids; of several labels of an id, a 1 counts; a text of any length is
tested whole; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

#: The limits of filters A to D.
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITAL_PERCENT = 2
SYMBOLS = "[#$%&*|]"
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Orders are listed one by one, so that their number bounds that of filters.
MOST_FILTERS = 6


def text_flags(text: Column) -> dict[str, Column]:
    """Failures of the filters that need the text alone, as 0 or 1."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    n = F.size(words)
    failures = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }
    return {name: failed.cast("int") for name, failed in failures.items()}


def flagged_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, the flags A to E, and good and toxic (0 or 1) of every row of ``docs`` (doc_id, source, text).

    Texts are compared by SHA-256.  Only flags and digests are written and shuffled.
    The least id of a text is an aggregate that combines before the shuffle, and it is
    joined back by text and id, so that a text of very many rows is no hot key.
    """
    text = F.col("text")
    whole = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_or_empty().alias("text"))
    rows = scratch.save(whole.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), *(f.alias(k) for k, f in text_flags(text).items())), "flags")
    named = rows.filter("doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = named.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    known = named.select("part", "A", "B", "C", "D", F.col("_first").isNull().cast("int").alias("E"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    unnamed = rows.filter("doc_id IS NULL").select("part", "A", "B", "C", "D", *(F.lit(0).alias(c) for c in ("E", "good", "toxic")))
    return known.unionByName(unnamed)


def joint_failures(rows: DataFrame, part: str, filters: str, losses: list[str]) -> DataFrame:
    """For each part, arrays ``all`` and one for each loss: entry m counts the rows that fail every filter of the bit set m."""

    def product(subset: int, loss: str | None) -> str:
        return " * ".join([loss or "1", *(name for bit, name in enumerate(filters) if subset >> bit & 1)])

    subsets, kinds = range(1 << len(filters)), [None, *losses]
    sums = [F.expr(f"sum({product(m, kind)}) AS _{k}_{m}") for k, kind in enumerate(kinds) for m in subsets]
    counted = rows.groupBy(part).agg(*sums)
    return counted.select(part, *(F.array(*(f"_{k}_{m}" for m in subsets)).alias(kind or "all") for k, kind in enumerate(kinds)))


def _inverted(counts: str, bits: int, upward: bool) -> Column:
    """Moebius inversion: over subsets (survivors of a set of filters), or upward over supersets (rows that fail exactly a set)."""
    every = range(1 << bits)

    def entry(m: int) -> str:
        reached = [s for s in every if (s & m == m if upward else s | m == m)]
        return "".join(f" {'-' if ((s ^ m) if upward else s).bit_count() % 2 else '+'} {counts}[{s}]" for s in reached)

    return F.expr(f"array({','.join(map(entry, every))})")


def interaction_audit(rows: DataFrame, part: str, filters: str, losses: list[str]) -> DataFrame:
    """One row for each part, order of filters and step, from rows with flags (0 or 1).

    ``filters`` names flag columns of one letter each and ``losses`` flag columns of rows
    whose loss is counted.  Columns: part, filter_order, step, kept, removed, redundant,
    unique_fails, ``<loss>_lost`` for each loss, and shapley.
    """
    bits = len(filters)
    if not 1 <= bits <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters can be audited")
    counted = joint_failures(rows, part, filters, losses)
    survivors = {kind: _inverted(kind, bits, upward=False) for kind in ("all", *losses)}
    tables = counted.select(part, F.col("all").alias("joint"), _inverted("all", bits, upward=True).alias("exact"), *(v.alias(f"left_{kind}") for kind, v in survivors.items()))

    def shapley(alone: int) -> str:
        sets = [m for m in range(1 << bits) if m & alone == alone != 0]
        return "0L" + "".join(f" + joint[{m}] * {(-1) ** (m.bit_count() + 1) * factorial(bits) // m.bit_count()}" for m in sets)

    tables = tables.withColumn("shares", F.expr(f"array({','.join(shapley(m if m.bit_count() == 1 else 0) for m in range(1 << bits))})"))
    steps = tables.withColumn("filter_order", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(filters)))))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(bits))))
    where = [F.instr("filter_order", name) for name in filters]
    mask = lambda test: sum((F.when(test(w), 1 << b).otherwise(0) for b, w in enumerate(where)), F.lit(0))
    steps = steps.withColumns({"before": mask(lambda w: w < F.col("step")), "after": mask(lambda w: w <= F.col("step")), "alone": mask(lambda w: w == F.col("step"))})
    at = lambda column, m: F.get(column, F.col(m))
    removed = at("left_all", "before") - at("left_all", "after")
    return steps.select(
        part, "filter_order", "step", at("left_all", "after").alias("kept"), removed.alias("removed"), (at("joint", "alone") - removed).alias("redundant"), at("exact", "alone").alias("unique_fails"),
        *((at(f"left_{c}", "before") - at(f"left_{c}", "after")).alias(f"{c}_lost") for c in losses), at("shares", "alone").alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The audit of filters A to E over documents, by source."""
    scratch = scratch or Scratch(docs.sparkSession, "audit")
    return interaction_audit(flagged_documents(docs, labels, scratch), "part", "ABCDE", ["good", "toxic"])
