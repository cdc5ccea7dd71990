"""From positioned words to rows, cells and column lines, by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import squash_col

#: Fixed value: a gap wider than this starts a new cell.
CELL_GAP = 18
BEFORE = (W.unboundedPreceding, -1)
UPTO = (W.unboundedPreceding, W.currentRow)


def baseline(y: Column) -> Column:
    """The row of a word: its height in steps of two, halves up."""
    return (F.floor(y / 2 + 0.5) * 2).cast("long")


def merge_cells(items: DataFrame, row: list[str], ordinal: str, x: str = "x", width: str = "width", word: str = "word", gap: float = CELL_GAP) -> DataFrame:
    """Row, cell (from 0), text: items in order of x, apart where a gap is wider than ``gap``."""
    order = W.partitionBy(*row).orderBy(x, ordinal)
    fresh = F.coalesce(F.col(x) - F.max(F.col(x) + F.col(width)).over(order.rowsBetween(*BEFORE)) > gap, F.lit(False))
    celled = items.withColumn("_fresh", fresh).withColumn("cell", F.sum(F.col("_fresh").cast("long")).over(order.rowsBetween(*UPTO)))
    words = F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(ordinal).alias("o"), F.col(word).alias("w"))))
    return celled.groupBy(*row, "cell").agg(F.array_join(F.transform(words, lambda i: i["w"]), " ").alias("text"))


def page_rows(glyphs: DataFrame) -> DataFrame:
    """document_id, pdf_page, y and the cells of each row of positioned words, blank ones left out."""
    words = glyphs.withColumn("word", squash_col(F.col("text"))).filter("word <> ''").withColumn("y", baseline(F.col("y")))
    cells = merge_cells(words, ["document_id", "pdf_page", "y"], "ordinal")
    ordered = F.sort_array(F.collect_list(F.struct("cell", "text")))
    return cells.groupBy("document_id", "pdf_page", "y").agg(F.transform(ordered, lambda c: c["text"]).alias("cells"))


def split_columns(items: DataFrame, row: list[str], width: Column, order: list[str], x: str = "x", word: str = "word") -> DataFrame:
    """Row, side (1 from the middle on), words in order, and their number."""
    sided = items.withColumn("side", F.when(F.col(x) >= width / 2, 1).otherwise(0))
    words = F.sort_array(F.collect_list(F.struct(*order, F.col(word).alias("_w"))))
    return sided.groupBy(*row, "side").agg(F.array_join(F.transform(words, lambda i: i["_w"]), " ").alias("words"), F.count(F.lit(1)).alias("n"))


def column_lines(glyphs: DataFrame) -> DataFrame:
    """document_id, pdf_page, side, y and line of pages read as two columns."""
    words = glyphs.withColumn("word", squash_col(F.col("text"))).filter("word <> ''").withColumn("y", baseline(F.col("y")))
    sided = split_columns(words, ["document_id", "pdf_page", "y"], F.col("page_width"), ["x", "ordinal"])
    return sided.select("document_id", "pdf_page", "side", "y", squash_col(F.col("words")).alias("line"))


def page_text(glyphs: DataFrame) -> DataFrame:
    """document_id, pdf_page and text: rows from the top, cells joined by spaces."""
    lines = page_rows(glyphs).withColumn("line", F.array_join("cells", " "))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("k"), "line")))
    return lines.groupBy("document_id", "pdf_page").agg(F.array_join(F.transform(ordered, lambda i: i["line"]), "\n").alias("text"))


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, default: Column, name: str) -> DataFrame:
    """The last value set up to each row of its group, else the default."""
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(*UPTO)
    return df.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(upto), default))


def pages_in_ranges(ranges: DataFrame, pages: DataFrame, first: str, last: str, page: str) -> DataFrame:
    """An interval join as an equality join: each range lists its pages."""
    listed = ranges.filter(F.col(first) <= F.col(last)).withColumn(page, F.explode(F.sequence(first, last)))
    return listed.join(pages, page)


def next_different(df: DataFrame, keys: list[str], order: str, kind: str, name: str) -> DataFrame:
    """The order value of the next row whose kind differs: where the run of equal kinds ends."""
    window = W.partitionBy(*keys).orderBy(order)
    later = W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(*BEFORE)  # a running frame: linear in the group
    starts = F.when(~F.col(kind).eqNullSafe(F.lag(kind).over(window)), F.col(order))
    return df.withColumn("_start", starts).withColumn(name, F.last("_start", ignorenulls=True).over(later)).drop("_start")
