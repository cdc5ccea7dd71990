"""Text search and joins by wildcard patterns over postings of three letters.

A value is padded with a mark of its start and two of its end and posted under each run of
three letters.  A pattern's literal pieces name postings that every match must have:
all runs of three letters of a longer piece, and a shorter piece as the beginning of a run.
Candidates are found by equality (or by a range, for short terms) and then tested by ILIKE,
so that results are exact; a backslash is a letter like any other.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Aside

START, END = "\x02", "\x03"
WILD = "[%_]"


def padded(value: Column) -> Column:
    return F.concat(F.lit(START), F.lower(value), F.lit(END + END))


def runs(text: Column) -> Column:
    """The distinct runs of three letters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda k: F.substring(text, k, F.lit(3))))


def literal(pattern: Column) -> Column:
    """A pattern for ILIKE in which a backslash stands for itself."""
    return F.replace(pattern, F.lit("\\"), F.lit("\\\\"))


# ------------------------------------------------------------------ one term


def term_grams(term: str) -> tuple[list[str], str]:
    """Runs of three letters that a match of ``%term%`` must have, and, if there are none, its longest shorter piece."""
    pieces = [x for x in re.split(WILD, term.lower()) if x]
    grams = sorted({x[k : k + 3] for x in pieces for k in range(len(x) - 2)})
    return grams, "" if grams else max(pieces, key=len, default="")


def postings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(gram, key) of each row and each run of three letters in any of the columns."""
    found = F.flatten(F.array(*(F.when(F.col(c).isNotNull(), runs(padded(F.col(c)))).otherwise(F.array().cast("array<string>")) for c in columns)))
    return rows.select(key, F.explode(F.array_distinct(found)).alias("gram")).select("gram", key)


def candidates(posted: DataFrame, key: str, term: str) -> DataFrame | None:
    """Keys that can match ``%term%``: those under all its runs, or under a run that a short term begins; None if all can."""
    grams, short = term_grams(term)
    if grams:
        return posted.filter(F.col("gram").isin(grams)).groupBy(key).agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select(key)
    return posted.filter(F.col("gram").startswith(short)).select(key).distinct() if short else None


def matches_any(term: str, columns: list[str]) -> Column:
    """Whether any column holds a term, letters of either case alike; ``%`` and ``_`` in it are wildcards."""
    pattern = "%" + term.replace("\\", "\\\\") + "%"
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in columns])


# ------------------------------------------------------------------ many patterns


#: Lengths of the runs under which values are posted for patterns, and the number of values up to which a key is rare enough.
LENGTHS = (3, 5, 7, 14, 28)
FEW = 32
#: Most keys by which postings are filtered where they are made.
SENT_KEYS = 10_000


def _cut(rows: DataFrame, text: str, n: int, keep: str) -> DataFrame:
    """(keep, gram): the runs of n letters of a column, each once; it is without lambdas, which Spark would interpret row by row."""
    at = rows.filter(F.length(text) >= n).withColumn("_p", F.explode(F.sequence(F.lit(1), F.length(text) - (n - 1)))).withColumn("gram", F.expr(f"substring({text}, _p, {n})"))
    return at.filter(F.expr(f"instr({text}, gram) = _p")).select(keep, "gram")


def _value_keys(values: DataFrame, n: int) -> DataFrame:
    """(value, key): hashes of a value's runs of n letters; with those of three also shorter ones and the empty one, under which a pattern without letters looks."""
    rows = values.withColumn("_text", padded(F.col("value")))
    grams = _cut(rows, "_text", n, "value")
    if n == LENGTHS[0]:
        grams = grams.unionByName(_cut(rows, "_text", 2, "value")).unionByName(_cut(rows, "_text", 1, "value")).unionByName(values.select("value", F.lit("").alias("gram")))
    return grams.select("value", F.xxhash64("gram").alias("key"))


def _pattern_keys(patterns: DataFrame, n: int) -> DataFrame:
    """(pattern, key) that every match must have: runs of n letters, and where n is three shorter pieces."""
    pieces = patterns.select("pattern", F.explode(F.split(F.concat(F.lit(START), F.lower("pattern"), F.lit(END)), WILD)).alias("piece")).filter(~F.col("piece").isin("", START, END))
    grams = _cut(pieces, "piece", n, "pattern")
    if n == LENGTHS[0]:
        bare = patterns.filter(~F.col("pattern").rlike("[^%_]")).select("pattern", F.lit("").alias("gram"))
        grams = grams.unionByName(pieces.filter(F.length("piece") < n).select("pattern", F.col("piece").alias("gram"))).unionByName(bare)
    return grams.select("pattern", F.xxhash64("gram").alias("key")).distinct()


def ilike_join(values: DataFrame, patterns: DataFrame, aside: Aside | None = None) -> DataFrame:
    """(value, pattern) of every distinct value (column ``value``) that is ILIKE a distinct pattern (column ``pattern``).

    Patterns without wildcards are joined by equality.  Each other pattern looks up the
    postings of the rarest of its keys and tests what it finds there, so that nothing is
    compared with everything unless a pattern has no letter at all.  Keys are runs of three letters;
    a pattern all of whose keys have over ``FEW`` values goes on to longer runs, which don't become frequent as values
    become many.  Keys are hashes, and two that fall together only add tests.  Null matches nothing.
    No side is broadcast.
    """
    aside = aside or Aside(values.sparkSession)
    # a number of its own: adaptive execution would merge partitions by bytes, and the work is not in the bytes
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = aside.save(values.select("value").filter("value IS NOT NULL").distinct(), "values")
    patterns = aside.save(patterns.select("pattern").filter("pattern IS NOT NULL").distinct(), "patterns")
    equal = values.withColumn("_k", F.lower("value")).hint("merge").join(patterns.filter(~F.col("pattern").rlike(WILD)).withColumn("_k", F.lower("pattern")), "_k").select("value", "pattern")
    posted = lambda n: _value_keys(values.repartition(parts, "value"), n)
    rarest = patterns.filter(F.col("pattern").rlike(WILD)).select("pattern", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("n"), F.lit(0).alias("length"))
    for length in LENGTHS:
        going_on = rarest.filter(F.coalesce(F.col("n") > FEW, F.lit(True)))
        wanted = _pattern_keys(going_on.select("pattern").repartition(parts, "pattern"), length)
        if length > LENGTHS[0] and wanted.isEmpty():
            break
        sizes = posted(length).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        # a key that no value has is the rarest: the pattern matches nothing
        found = wanted.hint("merge").join(sizes, "key", "left").select("pattern", "key", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(length).alias("length"))
        best = F.min_by(F.struct("key", "n", "length"), F.struct("n", "length", "key")).alias("best")
        rarest = aside.save(rarest.filter("key IS NOT NULL").unionByName(found).groupBy("pattern").agg(best).select("pattern", "best.*"), f"rarest-{length}")
    out = equal
    for length in LENGTHS:
        asked = rarest.filter((F.col("length") == length) & (F.col("n") > 0)).select("pattern", "key")
        keys = asked.select("key").distinct()
        rows = posted(length)
        n_keys = keys.limit(SENT_KEYS + 1).count()
        if not n_keys:
            continue
        if n_keys <= SENT_KEYS:
            rows = rows.join(F.broadcast(keys), "key", "left_semi")
        out = out.unionByName(rows.hint("merge").join(asked, "key").filter(F.ilike("value", literal(F.col("pattern")))).select("value", "pattern"))
    return out
