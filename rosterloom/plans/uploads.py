"""From uploaded files to committed locations, in one function."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout
from ..sources.documents import GlyphReader, message_of, needs_scan, read_glyphs
from ..sources.recognition import Recogniser, recognise, scans_and_words
from ..sources.store import SnapshotStore
from .process import process_documents, run_failed

#: The error of a document without a file.
NO_FILE = "The uploaded file could not be read"


def process_uploads(store: SnapshotStore, binaries: DataFrame, reader: GlyphReader, recogniser: Recogniser | None = None, ids: list[str] | None = None, clock: Callable[[], float] = time.monotonic) -> None:
    """Reads the files of registered documents, recognises pages with too little text, and processes and commits them.

    ``binaries`` has object_path and content, as ``read_binaries`` gives them by path.  ``reader``
    gives the words of a file and ``recogniser`` the TSV of a page; both run on the workers.  A
    page is recognised if its words are few, or not many where the reader says that it has an
    image (``has_image``), within the document's budget of pages and seconds.  Documents are
    those that are being processed, or ``ids``; one whose file is missing or unreadable fails
    alone, and one whose file is replaced from now on is skipped.
    """
    place = f"uploads-{uuid.uuid4().hex}"
    documents = store.read("documents")
    documents = documents.filter(F.col("processing_status") == "Processing") if ids is None else documents.filter(F.col("id").isin(ids))
    chosen = store.aside(documents.select(F.col("id").alias("document_id"), "filename", "object_path"), f"{place}/chosen")
    try:
        try:
            files = chosen.join(binaries.select("object_path", "content"), "object_path", "left").select("document_id", "content")
            words = store.aside(read_glyphs(files.filter("content IS NOT NULL"), reader, images=True), f"{place}/words")
            missing = files.filter("content IS NULL").select("document_id", F.lit(NO_FILE).alias("text"))
            scans = recognised = None
            if recogniser is not None:
                read = words.filter("pdf_page IS NOT NULL")
                images = read.groupBy("document_id", "pdf_page").agg(F.max("has_image").alias("has_image"))
                pages = images.join(layout.page_text(read), ["document_id", "pdf_page"], "left")
                needed = pages.filter(needs_scan(F.col("text"), F.col("has_image"))).select("document_id", "pdf_page")
                lines = store.aside(recognise(files.filter("content IS NOT NULL"), needed, recogniser, clock), f"{place}/lines")
                scans, recognised = scans_and_words(lines)
        except Exception as error:
            run_failed(store, chosen, message_of(error).split("\n")[0])
            raise
        process_documents(store, words.drop("has_image").unionByName(missing, allowMissingColumns=True), scans=scans, recognised=recognised, chosen=chosen)
    finally:
        store.drop(place)
