"""Queries and changes over stored rows: counts, filters, pages, nesting, upserts and patches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Groups in which rows are numbered apart.
NUMBER_GROUPS = 1024


def workspace_counts(parents: DataFrame, children: DataFrame, parent_key: Column, child_key: Column, visible: Column, counts: dict[str, Column]) -> DataFrame:
    """Distinct parents, and children of visible parents by condition, in one pass over a left join."""
    joined = parents.join(children, parent_key == child_key, "left")
    return joined.agg(F.count_distinct(parent_key).alias("documents"), *(F.count(F.when(visible & test, child_key)).alias(name) for name, test in counts.items()))


def contains_any(term: str, columns: list[str]) -> Column:
    """The same for a literal term."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(term.lower()), F.lit(False)) for c in columns])


def restrict(df: DataFrame, equals: dict[str, object], visible: DataFrame | None, key: str = "document_id") -> DataFrame:
    """Rows equal in all given values, of visible parents only unless ``visible`` is None."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df if visible is None else df.join(visible.select(key), key, "left_semi")


def page(df: DataFrame, order: list[str], tie: str, limit: int, offset: int) -> DataFrame:
    """One page of a total order, missing values last."""
    return df.orderBy(*(F.asc_nulls_last(c) for c in order), tie).offset(offset).limit(limit)


def facet(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("facet")).filter("facet <> ''").distinct().orderBy("facet")


def with_children(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with an array of their children, empty without any; children are grouped before the join."""
    grouped = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*(c for c in children.columns if c != key)))).alias(name))
    joined = parents.join(grouped, key, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(grouped.schema[name].dataType)))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; an aggregate, so that rows combine before the shuffle."""
    last = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(F.col(key).alias("_key")).agg(last).select("_row.*")


def backfill(df: DataFrame, value: str, source: str, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.nullif(F.col(value), F.lit("")), F.col(source)))


def patch_rows(stored: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored rows with the columns that each patch lists in ``present`` overwritten, by null too."""
    new = patches.select(key, "present", *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = stored.join(new, key, "left")
    changed = {c: F.when(F.coalesce(F.array_contains("present", c), F.lit(False)), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(changed).select(*stored.columns)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A merge by natural key with the action taken on each row."""
    new = incoming.select(F.col(key).alias("_new_key"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = stored.join(new, stored[key] == new["_new_key"], "full")
    action = F.when(F.col(key).isNull(), "inserted").when(F.col("_new_key").isNull(), "kept").otherwise("updated")
    return joined.select(F.coalesce("_new_key", key).alias(key), *(F.when(F.col("_new_key").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns), action.alias("action"))


def supersede(df: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """All but the newest row of a key marked as superseded."""
    newest = W.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn(status, F.when(F.row_number().over(newest) == 1, F.col(status)).otherwise("Superseded"))


def number_rows(df: DataFrame, key: str, start: int, name: str = "id") -> DataFrame:
    """Adds numbers without gaps after ``start``; rows with the same key go by all their columns.

    Rows are numbered within hash groups of the key and moved up by the sizes of the groups
    before, so that only a table of ``NUMBER_GROUPS`` counts passes through one task.
    """
    grouped = df.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(NUMBER_GROUPS)))
    sizes = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_group", (F.sum("_n").over(W.orderBy("_group").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_offset"))
    place = F.row_number().over(W.partitionBy("_group").orderBy(key, *(c for c in df.columns if c != key)))
    return grouped.withColumn("_place", place).join(offsets, "_group").withColumn(name, F.lit(start) + F.col("_offset") + F.col("_place")).drop("_group", "_place", "_offset")
