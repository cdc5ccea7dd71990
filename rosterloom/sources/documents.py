"""Documents on file: binaries, the words on their pages, scan budgets, and upload checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.patterns import SPACE
from ..schema import GLYPHS

#: The largest upload, and when and how often pages are recognised from images.
MAX_UPLOAD_BYTES = 104_857_600
FEW_CHARACTERS = 80
FEW_CHARACTERS_WITH_IMAGE = 400
MAX_SCANNED_PAGES = 400

#: Bytes of files in one Arrow batch, about; a larger file is a batch of its own.
BATCH_BYTES = 16 << 20

#: (document_id, content) to dictionaries of the glyph columns after document_id.
GlyphReader = Callable[[bytes], Iterator[dict]]


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """document_id (the file's path), filename and content of PDF files below a path that Spark can read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content", "length")


def message_of(error: Exception) -> str:
    return str(error) or type(error).__name__


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, so that many large files never share one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_glyphs(binaries: DataFrame, reader: GlyphReader, images: bool = False) -> DataFrame:
    """Positioned words of documents by an injected reader, which runs on the workers.

    A document whose reader fails has one row without a page, whose text is the error's message.
    With ``images`` the reader also says by ``has_image`` whether a word's page has an image.
    """
    schema = f"{GLYPHS}, has_image boolean" if images else GLYPHS

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for part in parts:
            for document_id, content in zip(part["document_id"], part["content"], strict=True):
                try:
                    rows = [{"document_id": document_id, **g} for g in reader(bytes(content))]
                except Exception as error:  # one unreadable document leaves the others alone
                    rows = [{"document_id": document_id, "text": message_of(error)}]
                yield pd.DataFrame(rows, columns=names).astype({"pdf_page": "Int32", "ordinal": "Int64"} | ({"has_image": "boolean"} if images else {}))

    bounded_batches(binaries.sparkSession)
    return binaries.select("document_id", "content").mapInPandas(parse, schema)


def characters(text: Column) -> Column:
    """Characters other than white space."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACE, ""))


def needs_scan(text: Column, has_image: Column) -> Column:
    """Whether a page has so little text that its image should be recognised."""
    n = characters(text)
    return (n < FEW_CHARACTERS) | (F.coalesce(has_image, F.lit(False)) & (n < FEW_CHARACTERS_WITH_IMAGE))


def scan_plan(pages: DataFrame, limit: int = MAX_SCANNED_PAGES) -> DataFrame:
    """Pages to recognise: the first ``limit`` of each document that need it; the rest are marked incomplete."""
    needed = pages.filter(needs_scan(F.col("text"), F.col("has_image")))
    order = W.partitionBy("document_id").orderBy("pdf_page")
    return needed.select("document_id", "pdf_page", (F.row_number().over(order) <= limit).alias("within_budget"))


def has_enough_text(pages: DataFrame) -> DataFrame:
    """document_id, n_pages, chars and whether a document holds enough searchable text."""
    counted = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(characters(F.col("text"))).alias("chars"))
    return counted.withColumn("enough", F.col("chars") >= F.least(F.lit(500), 20 * F.col("n_pages")))


def valid_upload(name: Column, size: Column, content_type: Column) -> Column:
    """PDF files by type or name, not empty and not over the limit."""
    pdf = (content_type == "application/pdf") | F.lower(name).endswith(".pdf")
    return F.coalesce(pdf & (size >= 1) & (size <= MAX_UPLOAD_BYTES), F.lit(False))


def disposition(filename: Column) -> Column:
    """The content-disposition header of a document's download, in ASCII and in RFC 5987 form."""
    plain = F.regexp_replace(F.regexp_replace(filename, r"[^\x20-\x7E]", "_"), r'["\\]', "_")
    coded = filename
    coded = F.url_encode(coded)
    for sign, code in (("+", "%20"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(sign), F.lit(code))
    return F.concat(F.lit('inline; filename="'), plain, F.lit("\"; filename*=UTF-8''"), coded)
