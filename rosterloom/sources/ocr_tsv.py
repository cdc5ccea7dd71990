"""Words from a text recogniser's TSV output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import SHUFFLED

#: Fields of a TSV line, and the level of the line that gives the page's size.
FIELDS = 12
PAGE_LEVEL = "1"
MIN_CONFIDENCE = 0


def with_words(pages: DataFrame) -> DataFrame:
    """Pages with ``lines``, structs of line_no (0 is the header) and line in order, and their ``words`` as structs instead.

    Lines with fewer than twelve fields, blank text, or figures that are missing or
    negative in confidence are left out; the last page-level line gives the page's size.
    A page is read within its row, so that no line is shuffled or sorted with those of others.
    """
    parts = F.transform("lines", lambda i: F.struct(i["line_no"].alias("ordinal"), F.split(i["line"], "\t").alias("f")))
    parts = F.filter(parts, lambda p: (p["ordinal"] > 0) & (F.size(p["f"]) >= FIELDS))
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    # left, top, width, height and confidence
    figures = lambda f: F.transform(F.transform(F.slice(f, 7, 5), lambda x: x.try_cast("double")), finite)
    read = F.transform(parts, lambda p: F.struct(
        p["ordinal"].alias("ordinal"), F.get(p["f"], F.lit(0)).alias("level"), F.array_join(F.slice(p["f"], 2, 4), ":").alias("line_key"), figures(p["f"]).alias("n"),
        F.trim(F.array_join(F.slice(p["f"], FIELDS, F.size(p["f"]) - FIELDS + 1), "\t")).alias("text"),
    ))
    sizes = F.transform(F.filter("_read", lambda r: r["level"] == PAGE_LEVEL), lambda r: r["n"])
    kept = F.filter("_read", lambda r: (r["text"] != "") & ~F.exists(F.slice(r["n"], 1, 4), lambda x: x.isNull()) & (r["n"][4] >= MIN_CONFIDENCE))
    height = F.col("_size")[3]
    # recognisers count downwards from the top of the page
    words = F.transform(kept, lambda r: F.struct(
        r["ordinal"].alias("ordinal"), r["text"].alias("text"), r["n"][0].alias("x"), F.coalesce(height - r["n"][1], -r["n"][1]).alias("y"), r["n"][2].alias("width"), r["n"][4].alias("confidence"),
        F.col("_size")[2].alias("page_width"), height.alias("page_height"), r["line_key"].alias("line_key"),
    ))
    sized = pages.withColumn("_read", read).withColumn("_sizes", sizes).withColumn("_size", F.get("_sizes", F.size("_sizes") - 1))
    return sized.withColumn("words", words).drop("lines", "_read", "_sizes", "_size")


def read_words(lines: DataFrame) -> DataFrame:
    """Words of recognised pages: ``lines`` has document_id, pdf_page, line_no (0 is the header) and line."""
    pages = lines.groupBy("document_id", "pdf_page").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    return with_words(pages).select("document_id", "pdf_page", F.inline("words"))


def mean_confidence(words: str) -> Column:
    """The mean confidence of a column of word structs as a share; null without words."""
    total = F.aggregate(words, F.lit(0.0), lambda a, w: a + w["confidence"])
    return F.when(F.size(words) > 0, total / F.size(words) / 100)


def page_confidence(words: DataFrame) -> DataFrame:
    """Mean word confidence of each page as a share; pages without words have no row."""
    return words.groupBy("document_id", "pdf_page").agg((F.avg("confidence") / 100).alias("ocr_confidence"))


def text_of(words: str) -> Column:
    """The text of a page from a column of word structs in order of their ordinals; null without words."""
    line = lambda key: F.sort_array(F.transform(F.filter(words, lambda w: w["line_key"].eqNullSafe(key)), lambda w: F.struct(w["x"].alias("x"), w["ordinal"].alias("ordinal"), w["text"].alias("text"))))
    keys = F.array_distinct(F.transform(words, lambda w: w["line_key"]))
    lines = F.transform(keys, lambda key: F.array_join(F.transform(line(key), lambda w: w["text"]), " "))
    return F.when(F.size(words) > 0, F.array_join(lines, "\n"))


def page_text(words: DataFrame) -> DataFrame:
    """document_id, pdf_page and text: recognised lines in order of their first words, words from the left."""
    pages = words.groupBy("document_id", "pdf_page").agg(F.sort_array(F.collect_list(F.struct("ordinal", "x", "text", "line_key"))).alias("words"))
    return pages.select("document_id", "pdf_page", text_of("words").alias("text"))


def to_page(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """Words scaled from their image to the page.

    ``sizes`` has document_id, pdf_page, page_width and page_height of pages; a page without
    a size has that of its image, and an image without a size the scale 1.
    """
    image = words.withColumnsRenamed({"page_width": "_image_width", "page_height": "_image_height"})
    both = image.join(sizes.select("document_id", "pdf_page", "page_width", "page_height").hint(SHUFFLED), ["document_id", "pdf_page"], "left")
    ratio = lambda side: F.coalesce(F.col(f"page_{side}") / F.nullif(F.col(f"_image_{side}"), F.lit(0.0)), F.lit(1.0))
    # without an image height the words' heights count down from 0 at the top
    bottom = F.when(F.col("_image_height").isNull(), F.coalesce("page_height", F.lit(0.0))).otherwise(0.0)
    return both.select(
        "document_id", "pdf_page", "ordinal", "text", (F.col("x") * ratio("width")).alias("x"), (F.col("y") * ratio("height") + bottom).alias("y"), (F.col("width") * ratio("width")).alias("width"),
        F.coalesce("page_width", "_image_width").alias("page_width"), F.coalesce("page_height", "_image_height").alias("page_height"),
    )
