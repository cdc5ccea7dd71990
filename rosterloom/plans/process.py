"""Document processing: pages to candidates, gates, reconciliation and one commit.

Pages and layout are windowed plans, extraction is a group per document, cleaning
and scoring are column expressions, reconciliation is a group of rows that can meet, and the
commit is one change of a ``SnapshotStore``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fields
from ..functions import patterns as P
from ..functions.text import rx
from ..operators import brand, directory, grammars, grams, layout, sections
from ..operators.grouped import map_groups
from ..operators.people import contacts_of
from ..operators.reconcile import brand_counts, reconcile_brands
from ..schema import CONTACT, CONTACT_FIELDS, LOCATION_TEXT
from ..session import SHUFFLED, Aside
from ..sources import ocr_tsv
from ..sources.documents import has_enough_text, message_of
from ..sources.recognition import BUDGET, EMPTY
from ..sources.store import ALL, SnapshotStore

#: The least recognition confidence to replace stored rows, and the one below which a warning is added.
REPLACING_CONFIDENCE = 0.60
LOW_CONFIDENCE = 0.72
#: Documents whose rows are visible.
VISIBLE = ("Ready", "Needs review", "Completed")
#: Documents that keep older ones of their brand from being committed.
VERIFIED = ("Ready", "Needs review")
#: The stage of a document's processing, and the one of an error before it could start.
STAGE = "Text and table extraction"
ERROR_STAGE = "Processing error"
#: Counts of a brand's reconciliation.
RECONCILED = ("added", "matched", "updated", "unchanged", "ambiguous", "collapsed", "removed")
#: The scope of changes that number new stages.
NUMBERS = "stage-numbers"

RAW_SCHEMA = (
    "document_id string, ordinal long, status string, franchisee_entity string, address string, city string, state string, zip string, phone string, email string, source_page int, raw_source_text string, "
    "printed_page string, source_exhibit string, source_section string, rejected long, n_sections long, pages_examined array<int>, from_toc boolean, ranges array<struct<section:string,status:string,exhibit:string,printedStart:string,pdfStart:int,pdfEnd:int>>, error string"
)

#: A page: number, text, rows of cells, and lines of the left and the right column.
Page = tuple[int, str, list[list[str]], tuple[list[str], list[str]]]


def extract_document(pages: Iterable[Page]) -> tuple[sections.Discovery, list[dict], int, list[int]]:
    """Sections, candidates in order of emission, rejected rows and pages examined of one document.

    A section's rows come first, page by page; then its columns' blocks, where
    territories, if there are any, stand for unit and address blocks.
    """
    pages = {p[0]: p for p in pages}
    found = sections.discover_sections((n, p[1]) for n, p in pages.items())
    out, rejected, examined = [], 0, []
    for section in found.sections:
        marked: tuple[list, list] = ([], [])
        cite = {"source_exhibit": section.exhibit, "source_section": section.heading}
        numbers = list(range(section.pdf_start, min(section.pdf_end, max(pages)) + 1))
        examined += numbers
        for n in (n for n in numbers if n in pages):
            status = section.status
            for cells in pages[n][2]:
                joined = " ".join(cells)
                status = sections.heading_status(joined) or status
                row = grammars.table_row(cells, n, status)
                if row:
                    out.append(row | cite | {"printed_page": found.printed_page(n, section)})
                elif rx(P.REJECTED_ROW).search(joined):
                    rejected += 1
            for side in (0, 1):
                marked[side].append((n, status, section.heading, pages[n][3][side]))
        columns = [grammars.marked_lines(m) for m in marked]
        blocks = [b for lines in columns for b in grammars.territory_blocks(lines, section.pdf_start)]
        if not blocks:
            addresses = [b for lines in columns for b in grammars.address_blocks(lines, section.pdf_start)]
            # every column is followed by all addresses; repeats count as duplicate rows
            blocks = [b for lines in columns for b in (*grammars.unit_blocks(lines, section.pdf_start), *addresses)]
        out += [b | cite | {"printed_page": found.printed_page(b["source_page"], section)} for b in blocks]
    return found, out, rejected, examined


def _as_rows(document_id: str, found: sections.Discovery, candidates: list[dict], rejected: int, examined: list[int], error: str | None = None) -> list[dict]:
    """Candidate rows, and a first row (ordinal -1) with what holds for the document."""
    label = lambda n: str(n) if n else None
    ranges = [{"section": s.heading, "status": s.status, "exhibit": s.exhibit, "printedStart": label(s.printed_start), "pdfStart": s.pdf_start or 1, "pdfEnd": s.pdf_end or s.pdf_start or 1} for s in found.sections]
    head = {"document_id": document_id, "ordinal": -1, "rejected": rejected, "n_sections": len(found.sections), "pages_examined": sorted(set(examined)), "from_toc": any(t.kind for t in found.toc), "ranges": ranges, "error": error}
    return [head, *(c | {"document_id": document_id, "ordinal": k, "printed_page": label(c["printed_page"])} for k, c in enumerate(candidates))]


def page_payloads(pages: DataFrame, rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Pages with their rows of cells and column lines, from the top down; recognised ones (part 1) after native ones."""
    down = lambda *c: F.sort_array(F.collect_list(F.struct("part", (-F.col("y")).alias("k"), *c)))
    by_page = ["document_id", "pdf_page"]
    cells = rows.groupBy(*by_page).agg(F.transform(down("cells"), lambda r: r["cells"]).alias("rows"))
    side = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.struct("part", (-F.col("y")).alias("k"), "line")))), lambda r: r["line"])
    columns = lines.filter("line <> ''").groupBy(*by_page).agg(side(0).alias("left"), side(1).alias("right"))
    return pages.join(cells.hint(SHUFFLED), by_page, "left").join(columns.hint(SHUFFLED), by_page, "left").select(*by_page, "text", "rows", "left", "right")


def _candidates_of(rows: list[dict]) -> list[dict]:
    document_id = rows[0]["document_id"]
    try:
        pages = [(r["pdf_page"], r["text"] or "", r["rows"] or [], (r["left"] or [], r["right"] or [])) for r in rows]
        return _as_rows(document_id, *extract_document(pages))
    except Exception as error:  # one document's error leaves the others of the run alone
        return _as_rows(document_id, sections.Discovery(), [], 0, [], message_of(error))


def extract(payloads: DataFrame) -> DataFrame:
    """Raw candidates of every document; a document that fails has its first row only, with the error."""
    return map_groups(payloads.select("document_id", "pdf_page", "text", "rows", "left", "right"), ["document_id"], ["pdf_page"], _candidates_of, RAW_SCHEMA)


def _contacts(entity: Column, raw: Column, phone: Column, email: Column) -> Column:
    def derive(entities: pd.Series, raws: pd.Series, phones: pd.Series, emails: pd.Series) -> pd.Series:
        rows = [contacts_of(*(None if x is None or x != x else x for x in r)) for r in zip(entities, raws, phones, emails, strict=True)]
        return pd.Series(rows, dtype=object)

    return F.pandas_udf(derive, f"array<{CONTACT}>")(entity, raw, phone, email)


def accept(raw: DataFrame, pages: DataFrame, brands: DataFrame) -> DataFrame:
    """Clean, scored and reviewed candidates with contacts; ``duplicate`` marks repeats of an earlier one."""
    scanned = pages.select("document_id", F.col("pdf_page").alias("source_page"), F.col("ocr").alias("page_ocr"), F.col("ocr_confidence").alias("page_ocr_confidence"))
    rows = raw.filter("ordinal >= 0").drop("rejected", "n_sections", "pages_examined", "from_toc", "ranges", "error").join(scanned, ["document_id", "source_page"], "left").join(brands, "document_id", "left")
    rows = fields.review(fields.sanitize(rows))
    name = fields.brand_value(F.col("brand"))
    name = F.when(name == "", F.trim("brand")).otherwise(name)
    first = W.partitionBy("document_id", "dedup_key").orderBy("ordinal")
    rows = rows.withColumns({"franchise_name": name, "franchisor": name, "country": F.lit("United States"), "location_code": F.lit(None).cast("string"), "exit_reason": F.lit(None).cast("string"), "dedup_key": fields.dedup_key()})
    rows = rows.withColumn("duplicate", F.row_number().over(first) > 1)
    return rows.withColumn("contacts", _contacts(F.col("franchisee_entity"), F.col("raw_source_text"), F.col("phone"), F.col("email")))


def summarize(documents: DataFrame, raw: DataFrame, accepted: DataFrame, pages: DataFrame, previous: DataFrame) -> DataFrame:
    """A row a document with its counts, recognised pages, outcome and message.

    ``previous`` has document_id and previous_rows, the stored rows that a commit would replace.
    """
    head = raw.filter("ordinal < 0").select("document_id", "rejected", "n_sections", "pages_examined", "from_toc", "ranges", "error")
    fresh = accepted.filter("not duplicate")
    missing_address = F.coalesce(F.col("address") == "", F.lit(True)) | F.coalesce(F.col("address").rlike("(?i)not (?:listed|disclosed)"), F.lit(False))
    missing_contact = F.col("franchisee_entity").isNull() & (F.size("contacts") == 0)
    counts = fresh.groupBy("document_id").agg(F.count(F.lit(1)).alias("accepted"), F.count_if(missing_address).alias("missing_address"), F.count_if(missing_contact).alias("missing_contact"))
    repeats = accepted.groupBy("document_id").agg(F.count_if("duplicate").alias("duplicates"))
    scans = pages.filter("ocr").groupBy("document_id").agg(F.array_sort(F.collect_set("pdf_page")).alias("ocr_pages"), F.avg("ocr_confidence").alias("ocr_mean"))
    weak = F.col("ocr") & (F.col("ocr_confidence").isNull() | (F.col("ocr_confidence") < REPLACING_CONFIDENCE))
    marked = pages.filter(weak | F.col("problem").isNotNull()).withColumn("weak", weak).join(head.select("document_id", F.explode("pages_examined").alias("pdf_page")), ["document_id", "pdf_page"], "left_semi")
    sources = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("pdf_page"))))
    doubtful = marked.groupBy("document_id").agg(F.count_if("weak").alias("low_pages"), sources(F.col("weak")).alias("low_sources"), sources(F.col("problem").isNotNull()).alias("incomplete_sources"))
    unread = F.col("unread") if "unread" in documents.columns else F.lit(None).cast("string")
    out = documents.select("document_id", unread.alias("unread"))
    for part in (has_enough_text(pages), head, counts, repeats, scans, doubtful, recognition_notes(pages), previous):
        out = out.join(part.hint(SHUFFLED), "document_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("rejected", "n_sections", "accepted", "missing_address", "missing_contact", "duplicates", "low_pages", "previous_rows")}
    out = out.withColumn("error", F.coalesce("unread", "error")).drop("unread")
    return with_outcome(out.withColumns(zero | {"enough": F.coalesce("enough", F.lit(False))}))


def recognition_notes(pages: DataFrame) -> DataFrame:
    """document_id and ocr_notes: a warning for each page that was not recognised, in order, and one for the budget."""
    tried = F.count_if(F.col("ocr") | (F.col("problem") != BUDGET))
    problems = F.sort_array(F.collect_list(F.when(F.col("problem").isNotNull(), F.struct("pdf_page", "problem"))))
    found = pages.groupBy("document_id").agg(tried.cast("string").alias("tried"), problems.alias("problems")).filter(F.size("problems") > 0)

    def note(p: Column) -> Column:
        page = p["pdf_page"].cast("string")
        return (
            F.when(p["problem"] == BUDGET, F.concat(F.lit("OCR work budget was exhausted after "), "tried", F.lit(" pages")))
            .when(p["problem"] == EMPTY, F.concat(F.lit("OCR returned no searchable text on page "), page)).otherwise(F.concat(F.lit("OCR failed on page "), page, F.lit(": "), p["problem"]))
        )

    return found.select("document_id", F.array_distinct(F.transform("problems", note)).alias("ocr_notes"))


def with_outcome(counts: DataFrame) -> DataFrame:
    """Adds complete, warnings, and the outcome: Failed with a message, else Ready or Needs review.

    Without the columns error, low_sources, incomplete_sources and ocr_notes there was no error
    and no page was left out.
    """
    lists = {"low_sources": "array<int>", "incomplete_sources": "array<int>", "ocr_notes": "array<string>"}
    given = {c: F.coalesce(c, F.array().cast(t)) if c in counts.columns else F.array().cast(t) for c, t in lists.items()}
    counts = counts.withColumns(given | {"error": F.col("error") if "error" in counts.columns else F.lit(None).cast("string")})
    named = lambda c: F.concat(F.when(F.size(c) == 1, " ").otherwise("s "), F.array_join(F.col(c).cast("array<string>"), ", "))
    a, r, before = F.col("accepted"), F.col("rejected"), F.col("previous_rows")
    ratio = F.when(a + r > 0, r / (a + r)).otherwise(1.0)
    complete = (a > 0) & (F.col("missing_address") / F.greatest(a, F.lit(1)) < 0.25) & (F.col("missing_contact") / F.greatest(a, F.lit(1)) < 0.25) & (ratio <= 0.4)
    floor = F.when(before >= 20, F.floor(before * 0.55)).otherwise(0)
    strict = F.when(before >= 20, floor).when(before > 0, F.ceil(before * 0.8)).otherwise(0)
    kept = "; existing location data was preserved"
    message = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("enough"), f"The PDF has too little searchable text after OCR{kept}")
        .when(F.col("n_sections") == 0, f"No validated Item 20 franchisee list or franchisee exhibit was found{kept}")
        .when((before > 0) & (F.size("incomplete_sources") > 0), F.concat(F.lit("OCR did not complete on source page"), named("incomplete_sources"), F.lit(kept)))
        .when((before > 0) & (F.col("low_pages") > 0), F.concat(F.lit("OCR quality was too low on source page"), named("low_sources"), F.lit(f" to replace the previously stored location data{kept}")))
        .when(a == 0, f"The franchisee section was found, but no valid location rows were extracted{kept}")
        .when((ratio > 0.4) & ((strict == 0) | (a < strict)), F.concat(F.lit("Extraction rejected "), F.floor(ratio * 100 + 0.5).cast("string"), F.lit("% of candidate rows ("), r.cast("string"), F.lit(" rejected, "), a.cast("string"), F.lit(f" accepted){kept}")))
        .when((floor > 0) & (a < floor), F.concat(F.lit("Extraction produced "), a.cast("string"), F.lit(" rows versus "), before.cast("string"), F.lit(f" previously stored rows{kept}")))
    )
    n_scans = F.size(F.coalesce("ocr_pages", F.array().cast("array<int>")))
    note = lambda test, text: F.when(test, text if isinstance(text, Column) else F.lit(text))
    counted = lambda c, text: note(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    percent = F.floor(F.col("ocr_mean") * 100 + 0.5).cast("string")
    warnings = F.concat("ocr_notes", F.array_compact(F.array(
        note(n_scans > 0, F.concat(F.lit("OCR used on "), n_scans.cast("string"), F.when(n_scans == 1, " page").otherwise(" pages"))),
        note((n_scans > 0) & F.col("ocr_mean").isNotNull(), F.concat(F.lit("Average OCR confidence was "), percent, F.lit("%; extracted rows require review"))),
        note((n_scans > 0) & (F.col("ocr_mean") < LOW_CONFIDENCE), "OCR quality is low; verify extracted rows against the source document"),
        note((n_scans > 0) & F.col("ocr_mean").isNull(), "OCR returned no confidence scores; extracted rows require review"),
        counted("rejected", " address-like rows could not be normalized"),
        counted("missing_address", " locations do not include a disclosed street address"),
        counted("missing_contact", " locations do not include a franchisee or contact"),
        note(~complete, "Extraction coverage is below the automatic-approval threshold"),
    )))
    status = F.when(F.col("message").isNotNull(), "Failed").when(F.col("complete"), "Ready").otherwise("Needs review")
    return counts.withColumns({"complete": complete, "message": message, "warnings": warnings}).withColumn("outcome", status)


def manifest() -> Column:
    """The extraction manifest of a summary row."""
    empty = F.array().cast("array<int>")
    return F.struct(
        F.when(F.col("from_toc"), "toc").otherwise("heading-scan").alias("discoveryMethod"), F.col("ranges").alias("sourceRanges"), F.coalesce("pages_examined", empty).alias("pagesExamined"),
        F.coalesce("ocr_pages", empty).alias("ocrPages"), F.round("ocr_mean", 3).alias("ocrConfidence"), F.col("accepted").alias("acceptedRows"), F.col("rejected").alias("rejectedRows"),
        F.col("duplicates").alias("duplicateRows"), F.col("missing_address").alias("missingAddressRows"), F.col("missing_contact").alias("missingContactRows"), "warnings", "complete", *(F.col(f"counted.{c}").alias(f"{c}Rows") for c in RECONCILED),
    )


def assemble_pages(glyphs: DataFrame, scans: DataFrame | None, recognised: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, rows of cells and column lines; recognised text, rows and lines come after native ones.

    A page is there if it has a word, even a blank one, or a scan.  Scans without a problem
    mark recognised pages; where only recognised words are given, their pages are the scans.
    """
    by_page = ["document_id", "pdf_page"]
    if scans is None and recognised is not None:
        scans = ocr_tsv.page_confidence(recognised)
    if scans is None:
        scans = glyphs.select(*by_page, F.lit(None).cast("double").alias("ocr_confidence")).limit(0)
    if "problem" not in scans.columns:
        scans = scans.withColumn("problem", F.lit(None).cast("string"))
    scans = scans.groupBy(*by_page).agg(F.max("ocr_confidence").alias("ocr_confidence"), F.max("problem").alias("problem"))
    rows, lines = (part(glyphs).withColumn("part", F.lit(0)) for part in (layout.page_rows, layout.column_lines))
    text = layout.page_text(glyphs)
    sizes = glyphs.groupBy(*by_page).agg(F.max("page_width").alias("page_width"), F.max("page_height").alias("page_height"))
    keys = sizes.select(*by_page).union(scans.select(*by_page))
    if recognised is not None:
        words = recognised.join(scans.filter("problem IS NULL").select(*by_page).hint(SHUFFLED), by_page, "left_semi")
        # a page without native words has the size of its document's others
        general = sizes.groupBy("document_id").agg(F.max("page_width").alias("_w"), F.max("page_height").alias("_h"))
        sized = keys.distinct().join(sizes.hint(SHUFFLED), by_page, "left").join(general.hint(SHUFFLED), "document_id", "left").select(*by_page, F.coalesce("page_width", "_w").alias("page_width"), F.coalesce("page_height", "_h").alias("page_height"))
        placed = ocr_tsv.to_page(words, sized)
        rows, lines = (old.unionByName(part(placed).withColumn("part", F.lit(1))) for old, part in ((rows, layout.page_rows), (lines, layout.column_lines)))
        text = text.join(ocr_tsv.page_text(words).withColumnRenamed("text", "_recognised"), by_page, "full").select(*by_page, F.concat_ws("\n", F.nullif("text", F.lit("")), F.nullif("_recognised", F.lit(""))).alias("text"))
    marks = scans.withColumn("_scan", F.lit(True))
    pages = keys.distinct().join(text.hint(SHUFFLED), by_page, "left").join(marks.hint(SHUFFLED), by_page, "left")
    ocr = F.col("_scan").isNotNull() & F.col("problem").isNull()
    return pages.select(*by_page, F.coalesce("text", F.lit("")).alias("text"), ocr.alias("ocr"), F.when(ocr, F.col("ocr_confidence")).alias("ocr_confidence"), "problem"), rows, lines


def process_documents(store: SnapshotStore, glyphs: DataFrame, ids: list[str] | None = None, scans: DataFrame | None = None, recognised: DataFrame | None = None, chosen: DataFrame | None = None) -> None:
    """Processes registered documents and commits the result as one change.

    ``glyphs`` are the positioned words of their pages; a row without a page gives the error of a
    document that could not be read.  ``scans`` (document_id, pdf_page, ocr_confidence, and problem,
    if there are any) says which pages were recognised from images and why others were not, and
    ``recognised`` has their words as ``ocr_tsv.read_words`` gives them.  Of several documents of
    one brand the newest is committed; older ones are superseded.  A document that fails a gate,
    or whose extraction fails, keeps the stored rows and gets a failed stage; one whose object
    was replaced meanwhile is skipped.  Stages are running until then; if the run itself fails,
    so do they, and if it can't start, failed stages say so.  Intermediate tables are written below the store's root.
    ``chosen`` (document_id, filename, object_path) stands for ``ids`` where files were read before.
    """
    base, place = store.version(), f"work-{uuid.uuid4().hex}"
    if chosen is None:
        documents = store.read("documents", base)
        documents = documents.filter(F.col("processing_status") == "Processing") if ids is None else documents.filter(F.col("id").isin(ids))
        chosen = documents.select(F.col("id").alias("document_id"), "filename", "object_path")
    chosen = store.aside(chosen, f"{place}/chosen")
    try:
        try:
            started = store.attempt(lambda version: _start(store, chosen, version, place))
        except Exception as error:
            run_failed(store, chosen, message_of(error).split("\n")[0])
            raise
        try:
            summary, accepted = _read_documents(store, chosen, glyphs, scans, recognised, store.read("locations", base), place)
            store.attempt(lambda version: _commit(store, summary, accepted, started, version, place))
            store.compact()
        except Exception as error:
            message = message_of(error).split("\n")[0]
            store.attempt(lambda version: _fail(store, started, version, message))
            raise
    finally:
        store.drop(place)


def _new_stages(stages: DataFrame, chosen: DataFrame, stage: str, status: str, message: str | None = None) -> DataFrame:
    """A stage for each document, numbered after the stored ones; finished unless it is running."""
    first = stages.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    now = F.current_timestamp()
    ended = F.lit(None).cast("timestamp") if status == "Running" else now
    rows = directory.number_rows(chosen.select("document_id"), "document_id", first)
    return rows.select("id", "document_id", F.lit(stage).alias("stage"), F.lit(status).alias("status"), F.lit(message).cast("string").alias("message"), now.alias("started_at"), ended.alias("finished_at"))


def document_scopes(store: SnapshotStore, documents: DataFrame) -> set[str]:
    """What a change of documents (id, franchise_name) touches: their own buckets and those of their brands."""
    return {f"document/{b}" for b in store.touched(documents, "id")} | {f"brand/{b}" for b in store.touched(documents, "franchise_name")}


def _start(store: SnapshotStore, chosen: DataFrame, base: int, place: str) -> DataFrame:
    """Adds a running stage for each document; returns their numbers."""
    started = store.aside(_new_stages(store.read("stages", base), chosen, STAGE, "Running"), f"{place}/started-{base}")
    store.change(base, [NUMBERS], stages=started)
    return started.select("id", "document_id")


def _failed(store: SnapshotStore, chosen: DataFrame, base: int) -> DataFrame:
    """The rows of the documents, failed."""
    return store.read("documents", base).join(chosen.select(F.col("document_id").alias("id")), "id", "left_semi").withColumn("processing_status", F.lit("Failed"))


def run_failed(store: SnapshotStore, chosen: DataFrame, message: str) -> None:
    """Says of documents that their run could not start."""
    store.attempt(lambda version: _not_started(store, chosen, version, message))


def _not_started(store: SnapshotStore, chosen: DataFrame, base: int, message: str) -> None:
    """Adds a failed stage for each document of a run that could not start."""
    failed = _failed(store, chosen, base)
    store.change(base, {NUMBERS} | document_scopes(store, failed), stages=_new_stages(store.read("stages", base), chosen, ERROR_STAGE, "Failed", message), documents=failed)


def _finish(stages: DataFrame, ends: DataFrame) -> DataFrame:
    """The stages of ``ends`` (id, new_status, new_message) with their status and message."""
    return stages.join(ends, "id").withColumns({"status": F.col("new_status"), "message": F.col("new_message"), "finished_at": F.current_timestamp()}).drop("new_status", "new_message")


def _fail(store: SnapshotStore, started: DataFrame, base: int, message: str) -> None:
    """Ends the stages and documents of a run that failed as a whole."""
    ends, failed = started.select("id", F.lit("Failed").alias("new_status"), F.lit(message).alias("new_message")), _failed(store, started, base)
    store.change(base, document_scopes(store, failed), stages=_finish(store.read("stages", base), ends), documents=failed)


def _read_documents(store: SnapshotStore, chosen: DataFrame, glyphs: DataFrame, scans: DataFrame | None, recognised: DataFrame | None, locations: DataFrame, place: str) -> tuple[DataFrame, DataFrame]:
    """The summary of each document, with its brand, and the accepted candidates."""
    mine = lambda df: None if df is None else df.join(chosen.select("document_id"), "document_id", "left_semi")
    glyphs, scans, recognised = mine(glyphs), mine(scans), mine(recognised)
    unread = glyphs.filter("pdf_page IS NULL").groupBy("document_id").agg(F.max("text").alias("unread"))
    pages, rows, lines = assemble_pages(glyphs.filter("pdf_page IS NOT NULL"), scans, recognised)
    pages = store.aside(pages, f"{place}/pages")
    raw = store.aside(extract(page_payloads(pages, rows, lines)), f"{place}/raw")
    brands = store.aside(brand.document_brands(pages, chosen), f"{place}/brands")
    accepted = store.aside(accept(raw, pages, brands), f"{place}/accepted")
    previous = locations.groupBy("document_id").agg(F.count(F.lit(1)).alias("previous_rows"))
    known = chosen.join(unread, "document_id", "left")
    summary = summarize(known, raw, accepted, pages, previous).join(brands, "document_id", "left").join(chosen.select("document_id", "object_path"), "document_id")
    return store.aside(summary.withColumn("brand_key", F.lower(F.coalesce("brand", F.lit("")))), f"{place}/summary"), accepted


def brand_names(keys: DataFrame, names: DataFrame, aside: Aside | None = None) -> DataFrame:
    """(brand_key, name): the stored names (lower case) that each brand stands for.

    A brand is a pattern: ``%`` and ``_`` in it are wildcards, letters of either case alike.  A name
    that several brands stand for goes to the one that equals it, or else to the least.
    """
    pairs = grams.ilike_join(names.select(F.lower("name").alias("value")), keys.select(F.col("brand_key").alias("pattern")), aside)
    first = F.min_by("pattern", F.struct(F.col("pattern") != F.col("value"), "pattern"))
    return pairs.groupBy("value").agg(first.alias("brand_key")).select("brand_key", F.col("value").alias("name"))


def _decide(summary: DataFrame, documents: DataFrame, known: DataFrame) -> DataFrame:
    """Summaries with stale, wins, upload_date and the file name of a newer document of the brand."""
    current = documents.select(F.col("id").alias("document_id"), "upload_date", F.col("object_path").alias("_path"))
    out = summary.join(current, "document_id").withColumn("stale", F.col("_path").isNotNull() & ~F.col("_path").eqNullSafe(F.col("object_path"))).drop("_path")
    names = documents.select(F.col("id").alias("document_id"), "filename")
    verified = documents.filter(F.col("processing_status").isin(*VERIFIED) & F.col("last_processed_at").isNotNull())
    stored = verified.withColumn("name", F.lower("franchise_name")).join(known, "name").groupBy("brand_key").agg(F.max_by(F.struct("upload_date", "filename"), F.struct("upload_date", "id")).alias("stored"))
    passed = W.partitionBy("brand_key").orderBy(F.desc_nulls_last("upload_date"), F.desc("document_id"))
    ranked = out.filter("outcome <> 'Failed' AND NOT stale").join(names, "document_id").withColumns({"rank": F.row_number().over(passed), "first": F.first("filename").over(passed)}).join(stored.hint(SHUFFLED), "brand_key", "left")
    behind = F.coalesce(F.col("stored.upload_date") > F.col("upload_date"), F.lit(False))
    newer = F.when(behind, F.col("stored.filename")).when(F.col("rank") > 1, F.col("first"))
    return out.join(ranked.select("document_id", newer.alias("newer"), newer.isNull().alias("wins")).hint(SHUFFLED), "document_id", "left").withColumn("wins", F.coalesce("wins", F.lit(False)))


def _commit(store: SnapshotStore, summary: DataFrame, accepted: DataFrame, started: DataFrame, base: int, place: str) -> None:
    """Reconciles the winners with the rows stored in a version and commits all tables."""
    now = F.current_timestamp()
    documents, stages = (store.read(t, base) for t in ("documents", "stages"))
    # a pattern can stand for names that come at any time, so that its change meets all others
    wild = not summary.filter(F.col("brand_key").rlike(grams.WILD)).isEmpty()
    known = summary.select("brand_key", F.col("brand_key").alias("name")).distinct()
    if wild:
        names = known.select("name").union(documents.select("franchise_name")).union(store.read("locations", base).select("franchisor"))
        known = store.aside(brand_names(known, names, Aside(store.spark, f"{store.root}/{place}")), f"{place}/names-{base}")
    summary = store.aside(_decide(summary, documents, known), f"{place}/decided-{base}")
    winners = summary.filter("wins").select("document_id", "brand_key")
    known = known.join(winners.select("brand_key"), "brand_key", "left_semi")
    brands = store.touched(known, "name")
    locations, contacts = (store.read(t, base, brands) for t in ("locations", "contacts"))
    incoming = accepted.filter("not duplicate").drop("brand").join(winners, "document_id")
    nested = contacts.groupBy("location_id").agg(F.collect_list(F.struct(*CONTACT_FIELDS)).alias("contacts"))
    stored = locations.withColumn("name", F.lower("franchisor")).join(known, "name").drop("name").join(nested, locations["id"] == nested["location_id"], "left").drop("location_id")
    result = store.aside(reconcile_brands(incoming, stored, Aside(store.spark, f"{store.root}/{place}")), f"{place}/result-{base}")

    # ids follow from content, so that a task that runs again mints the same ones
    parts = [F.coalesce(c, F.lit("\x1e")) for c in ("brand_key", *LOCATION_TEXT, F.col("source_page").cast("string"))]
    minted = result.withColumn("new_id", F.coalesce("existing_id", F.sha2(F.concat_ws("\x1f", *parts), 256)))
    kept, gone = minted.filter("action <> 'deleted'"), minted.filter("action = 'deleted'").select("existing_id")
    old = locations.select(F.col("id").alias("new_id"), "created_at")
    rows = kept.filter("changed").join(old, "new_id", "left").select(F.col("new_id").alias("id"), *LOCATION_TEXT, "source_page", "confidence", F.coalesce("created_at", now).alias("created_at"), now.alias("updated_at"))
    deleted = lambda df: df.withColumn("_deleted", F.lit(True))
    rows = rows.withColumn("_deleted", F.lit(False)).unionByName(deleted(locations.join(gone, locations["id"] == gone["existing_id"], "left_semi")))
    new = kept.filter("contacts_changed").select(F.col("new_id").alias("location_id"), F.posexplode("contacts").alias("k", "c"), "franchisor").select(F.concat_ws("/", "location_id", "k").alias("id"), "location_id", "c.*", "franchisor", F.lit(False).alias("_deleted"))
    left = minted.filter("action = 'deleted' OR contacts_changed").select(F.col("existing_id").alias("location_id"), F.coalesce("franchisor", "brand_key").alias("franchisor")).filter("location_id IS NOT NULL")
    people = new.unionByName(deleted(contacts.join(left, "location_id").join(new.select("id"), "id", "left_anti")))

    counted = brand_counts(result)
    late = ((c, text) for c, text in (("ambiguous", " possible duplicate matches require review"), ("collapsed", " existing duplicate records were safely consolidated"), ("removed", " stale rows from the replaced extraction were removed")))
    notes = F.array_compact(F.array(*(F.when(F.col(f"counted.{c}") > 0, F.concat(F.col(f"counted.{c}").cast("string"), F.lit(text))) for c, text in late)))
    summary = summary.join(counted.join(winners.hint(SHUFFLED), "brand_key").drop("brand_key"), "document_id", "left").withColumn("warnings", F.concat("warnings", notes))

    done = summary.select(F.col("document_id").alias("id"), "outcome", "stale", "wins", "brand", manifest().alias("new_manifest"), F.col("n_pages").cast("int").alias("new_pages"), "ranges")
    superseded = summary.filter("wins").join(known.hint(SHUFFLED), "brand_key").select("name", F.col("document_id").alias("winner"), F.col("upload_date").alias("winner_date"))
    joined = documents.join(done.hint(SHUFFLED), "id", "left").join(superseded.hint(SHUFFLED), F.lower(F.coalesce("brand", "franchise_name")) == superseded["name"], "left")
    status = (
        F.when(F.col("wins"), F.col("outcome")).when(F.col("outcome") == "Failed", "Failed").when(F.col("stale"), F.col("processing_status")).when(F.col("outcome").isNotNull(), "Superseded")
        .when(F.col("winner").isNotNull() & (F.col("winner_date") >= F.col("upload_date")), "Superseded").otherwise(F.col("processing_status"))
    )
    exhibits = F.array_join(F.array_distinct(F.array_compact(F.col("ranges.exhibit"))), ", ")
    won = lambda new, c: F.when(F.col("wins"), new).otherwise(F.col(c))
    status_before = F.col("_before")
    changed = joined.withColumn("_before", F.col("processing_status")).withColumns({
        "processing_status": status, "franchise_name": won(F.col("brand"), "franchise_name"), "page_count": won(F.col("new_pages"), "page_count"), "extraction_manifest": won(F.col("new_manifest"), "extraction_manifest"),
        "source_exhibit": won(F.nullif(exhibits, F.lit("")), "source_exhibit"), "last_processed_at": won(now, "last_processed_at"),
    })
    changed = changed.filter((F.col("processing_status") != status_before) | F.col("outcome").isNotNull())
    text = lambda *parts: F.concat(*(F.lit(x) if i % 2 else x.cast("string") for i, x in enumerate(parts)))
    n = lambda c: F.col(f"counted.{c}")
    report = text(
        F.col("accepted"), " locations normalized from ", F.size("pages_examined"), " verified source pages. ", n("added"), " added, ", n("updated"), " updated, ", n("unchanged"), " unchanged. ",
        F.col("duplicates") + n("collapsed"), " duplicates removed. ", F.when(F.size("warnings") > 0, F.array_join("warnings", "; ")).otherwise("coverage checks passed"),
    )
    ends = summary.join(started, "document_id").select(
        "id", F.when(F.col("outcome") == "Failed", "Failed").when(F.col("wins"), "Complete").otherwise("Skipped").alias("new_status"),
        F.when(F.col("outcome") == "Failed", F.col("message")).when(F.col("stale"), "A newer replacement of this document is already processing").when(F.col("wins"), report)
        .otherwise(text(F.lit("A newer verified FDD ("), "", F.col("newer"), ") already supplies this franchisor's evidence")).alias("new_message"),
    )
    changed = store.aside(changed, f"{place}/changed-{base}")
    scopes = {ALL} if wild else document_scopes(store, changed) | {f"brand/{b}" for b in store.touched(summary, "brand_key")}
    store.change(base, scopes, documents=changed, stages=_finish(stages, ends), locations=rows, contacts=people)
