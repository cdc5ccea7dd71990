"""Recognition of page images within a document's budget of pages and time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ocr_tsv
from .documents import MAX_SCANNED_PAGES, bounded_batches, message_of

#: Fixed value: seconds after which no further page of a document is recognised.
MAX_SECONDS = 600
#: Lines of an Arrow batch, about.
LINES_AT_ONCE = 2_000
#: What scans give as the problem of a page that was over the budget, or that had no text; other values are error messages.
BUDGET = "budget"
EMPTY = "empty"

#: (content, page) to the recogniser's TSV output.
Recogniser = Callable[[bytes, int], str]

_PAGES = "document_id string, pdf_page int, lines array<string>, problem string"
_BATCH = pa.schema([("document_id", pa.string()), ("pdf_page", pa.int32()), ("lines", pa.list_(pa.string())), ("problem", pa.string())])


def recognise(binaries: DataFrame, needed: DataFrame, recogniser: Recogniser, clock: Callable[[], float] = time.monotonic, limit: int = MAX_SCANNED_PAGES, seconds: float = MAX_SECONDS) -> DataFrame:
    """document_id, pdf_page, lines and problem of the pages ``needed`` (document_id, pdf_page) of ``binaries`` (document_id, content).

    A document's pages are taken in order by an injected recogniser, which runs on the
    workers.  Before each page the pages tried so far and the seconds since the first are
    held against the budget; pages that are left over, and pages whose recogniser fails, have
    no lines, and their row names the problem.  About ``LINES_AT_ONCE`` lines are in memory at once.
    Files are neither broadcast nor sorted: they stream past the numbers of their pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                started, tried = clock(), 0
                for page in row["pages"]:
                    problem, lines = None, []
                    if tried >= limit or clock() - started >= seconds:
                        problem = BUDGET
                    else:
                        tried += 1
                        try:
                            lines = recogniser(row["content"], page).splitlines()
                        except Exception as error:  # one page's error leaves the others alone
                            problem = message_of(error)
                    held.append({"document_id": row["document_id"], "pdf_page": page, "lines": lines, "problem": problem})
                    size += 1 + len(lines)
                    if size >= LINES_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(held, _BATCH)
                        held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, _BATCH)

    spark = binaries.sparkSession
    bounded_batches(spark)
    pages = needed.groupBy("document_id").agg(F.sort_array(F.collect_set("pdf_page")).alias("pages"))
    # a number of its own: adaptive execution would merge partitions by bytes, and the work is not in the bytes
    dealt = binaries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "document_id")
    return dealt.join(pages.hint("shuffle_hash"), "document_id").select("document_id", "content", "pages").mapInArrow(run, _PAGES)


def read_pages(recognised: DataFrame) -> DataFrame:
    """document_id, pdf_page, ocr_confidence, problem and words of what ``recognise`` gave; a page without words is empty."""
    lines = F.transform("lines", lambda line, n: F.struct(n.alias("line_no"), line.alias("line")))
    pages = ocr_tsv.with_words(recognised.withColumn("lines", lines))
    mean = ocr_tsv.mean_confidence("words")
    return pages.select("document_id", "pdf_page", mean.alias("ocr_confidence"), F.coalesce("problem", F.when(F.size("words") == 0, EMPTY)).alias("problem"), "words")


def scans_and_words(recognised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same as scans (document_id, pdf_page, ocr_confidence, problem) and words."""
    pages = read_pages(recognised)
    return pages.drop("words"), pages.select("document_id", "pdf_page", F.inline("words"))
