"""Whole documents: positioned words to stored rows, and the workspace over them."""

import datetime

import pytest
from pyspark.sql import functions as F

from rosterloom.operators import layout
from rosterloom.plans import process
from rosterloom.plans.workspace import Search, Workspace
from rosterloom.schema import GLYPHS
from rosterloom.sources import documents as docs
from rosterloom.sources import ocr_tsv
from rosterloom.sources.store import SnapshotStore
from rosterloom.streaming import landing

DATE = datetime.datetime(2024, 1, 1)


def glyphs(spark, books):
    """Lines with cells parted by " | ", set as a typesetter would on a letter page."""
    rows = []
    for name, pages in books.items():
        for n, text in enumerate(pages, 1):
            k = 0
            for i, line in enumerate(text.split("\n")):
                for j, cell in enumerate(line.split(" | ")):
                    rows.append((name, n, k, cell, 36.0 + 125 * j, 760.0 - 24 * i, float(min(7 * len(cell), 100)), 612.0, 792.0))
                    k += 1
    return spark.createDataFrame(rows, GLYPHS)


def book(rows, brand="Quiet Mill, LLC"):
    prose = "\n".join(f"This is line {k} of the disclosure, long enough to count as text." for k in range(9))
    return [f"FRANCHISOR: {brand}\n{prose}\n1", "EXHIBIT F-1\nLIST OF CURRENT FRANCHISEES\n" + "\n".join(rows) + "\n2"]


ROWS = ["Kite Works LLC | 12 Elm St | Reno | NV | 89501 775-555-0100", "Mill Group Inc | 9 Oak Ave | Austin | TX | 78701 512-555-0100"]


@pytest.fixture
def workspace(spark, tmp_path):
    return Workspace(SnapshotStore(spark, str(tmp_path / "store")))


def register(workspace, *names):
    workspace.register(workspace.store.spark.createDataFrame([(n, f"/objects/{n}") for n in names], "filename string, object_path string"))
    return {r.filename: r.id for r in workspace.store.read("documents").collect()}


def states(workspace):
    return {r.filename: r.processing_status for r in workspace.store.read("documents").collect()}


def test_layout_makes_rows_columns_and_text(spark):
    g = glyphs(spark, {"d": ["a | b\nlong words here | c"]})
    rows = {r.y: r.cells for r in layout.page_rows(g).collect()}
    assert rows == {760: ["a", "b"], 736: ["long words here", "c"]}
    close = spark.createDataFrame([("d", 1, 0, "one", 10.0, 5.0, 20.0, 612.0, 792.0), ("d", 1, 1, " two ", 48.0, 5.9, 5.0, 612.0, 792.0), ("d", 1, 2, "three", 72.0, 5.2, 5.0, 612.0, 792.0), ("d", 1, 3, " ", 400.0, 5.0, 5.0, 612.0, 792.0), ("d", 1, 4, "right", 306.0, 5.0, 5.0, 612.0, 792.0)], GLYPHS)
    assert [r.cells for r in layout.page_rows(close).collect()] == [["one two", "three", "right"]]
    assert sorted((r.side, r.line) for r in layout.column_lines(close).collect()) == [(0, "one two three"), (1, "right")]


def test_a_document_end_to_end_and_again(spark, workspace):
    ids = register(workspace, "Quiet-Mill_2023.pdf")
    pages = glyphs(spark, {ids["Quiet-Mill_2023.pdf"]: book(ROWS)})
    process.process_documents(workspace.store, pages)
    rows = workspace.store.read("locations").orderBy("city").collect()
    assert [(r.franchisor, r.franchisee_entity, r.address, r.city, r.state, r.zip, r.review_status, r.source_page, r.printed_page) for r in rows] == [
        ("Quiet Mill", "Mill Group Inc", "9 Oak Ave", "Austin", "TX", "78701", "Auto-verified", 2, "2"), ("Quiet Mill", "Kite Works LLC", "12 Elm St", "Reno", "NV", "89501", "Auto-verified", 2, "2"),
    ]
    assert states(workspace) == {"Quiet-Mill_2023.pdf": "Ready"}
    m = workspace.store.read("documents").first().extraction_manifest
    assert (m.acceptedRows, m.rejectedRows, m.complete, m.discoveryMethod, m.pagesExamined) == (2, 0, True, "toc", [2])
    before = {r.id: r.updated_at for r in rows}
    register(workspace, "Quiet-Mill_2023.pdf")
    process.process_documents(workspace.store, pages)
    assert {r.id: r.updated_at for r in workspace.store.read("locations").collect()} == before
    assert workspace.store.read("contacts").count() == 2


def test_failures_keep_stored_rows(spark, workspace):
    ids = register(workspace, "Quiet-Mill_2023.pdf")
    key = ids["Quiet-Mill_2023.pdf"]
    process.process_documents(workspace.store, glyphs(spark, {key: book(ROWS)}))
    stored = sorted(map(tuple, workspace.store.read("locations").collect()))
    for bad, scans, words in (([""], None, "too little searchable text"), (["plain prose without lists " * 20], None, "No validated"), (book(ROWS), 0.41, "OCR quality was too low"), (book(["call 775-555-0100"]), None, "no valid location rows")):
        register(workspace, "Quiet-Mill_2023.pdf")
        marks = None if scans is None else spark.createDataFrame([(key, 2, scans)], "document_id string, pdf_page int, ocr_confidence double")
        process.process_documents(workspace.store, glyphs(spark, {key: bad}), scans=marks)
        assert states(workspace)["Quiet-Mill_2023.pdf"] == "Failed"
        assert words in workspace.latest_stages().first().message
        assert sorted(map(tuple, workspace.store.read("locations").collect())) == stored


def test_scanned_rows_need_review(spark, workspace):
    ids = register(workspace, "Quiet-Mill_2023.pdf")
    key = ids["Quiet-Mill_2023.pdf"]
    marks = spark.createDataFrame([(key, 2, 0.88)], "document_id string, pdf_page int, ocr_confidence double")
    process.process_documents(workspace.store, glyphs(spark, {key: book(ROWS)}), scans=marks)
    assert {(r.review_status, round(r.confidence, 3)) for r in workspace.store.read("locations").collect()} == {("Needs review", 0.836)}
    assert states(workspace)["Quiet-Mill_2023.pdf"] == "Ready"


def test_the_newest_document_of_a_brand_wins(spark, workspace):
    ids = register(workspace, "old_2022.pdf", "new_2023.pdf")
    documents = workspace.store.read("documents").withColumn("upload_date", F.when(F.col("filename") == "old_2022.pdf", F.lit(DATE)).otherwise(F.col("upload_date")))
    workspace.store.commit(documents=documents)
    brand = "HOTWORX"
    process.process_documents(workspace.store, glyphs(spark, {ids["old_2022.pdf"]: book(ROWS[:1], brand), ids["new_2023.pdf"]: book(ROWS[1:], brand)}))
    assert states(workspace) == {"old_2022.pdf": "Superseded", "new_2023.pdf": "Ready"}
    assert [r.city for r in workspace.store.read("locations").collect()] == ["Austin"]


def test_gates(spark):
    ddl = "document_id string, enough boolean, n_sections long, accepted long, rejected long, missing_address long, missing_contact long, previous_rows long, low_pages long, ocr_pages array<int>, ocr_mean double, duplicates long"
    cases = [(10, 0, 0, 0, 0, "Ready"), (10, 0, 3, 0, 0, "Needs review"), (10, 0, 2, 2, 0, "Ready"), (10, 7, 0, 0, 0, "Failed"), (9, 7, 0, 0, 10, "Needs review"), (7, 7, 0, 0, 10, "Failed"), (10, 0, 0, 0, 20, "Failed"), (11, 0, 0, 0, 20, "Ready"), (12, 9, 0, 0, 20, "Needs review")]
    df = spark.createDataFrame([(str(k), True, 1, a, r, ma, mc, p, 0, None, None, 0) for k, (a, r, ma, mc, p, _) in enumerate(cases)], ddl)
    got = {r.document_id: (r.outcome, r.message) for r in process.with_outcome(df).collect()}
    assert [got[str(k)][0] for k in range(len(cases))] == [c[-1] for c in cases]
    assert got["3"][1].startswith("Extraction rejected 41% of candidate rows (7 rejected, 10 accepted)")


# ------------------------------------------------------------------ workspace


@pytest.fixture
def filled(spark, workspace):
    ids = register(workspace, "Quiet-Mill_2023.pdf")
    process.process_documents(workspace.store, glyphs(spark, {ids["Quiet-Mill_2023.pdf"]: book(ROWS)}))
    return workspace


def test_stats_search_and_detail(filled):
    s = filled.stats().first()
    assert (s.documents, s.total_locations, s.current_locations, s.former_locations, s.needs_review) == (1, 2, 2, 0, 0)
    found = filled.search(Search(q="mill g")).collect()
    assert [r.city for r in found] == ["Austin"] and found[0].contacts == [] and found[0].source_document_filename is None
    assert [r.state for r in filled.search(Search()).collect()] == ["NV", "TX"]
    assert [r.state for r in filled.search(Search(limit="1", offset="1")).collect()] == ["TX"]
    detail = filled.location(found[0].id).first()
    assert detail.source_document_filename == "Quiet-Mill_2023.pdf" and detail.contacts[0].phone == "512-555-0100"
    assert filled.location("none").count() == 0
    assert [r.facet for r in filled.franchisors().collect()] == ["Quiet Mill"]
    d = filled.documents().first()
    assert (d.location_count, d.record_counts, [x.stage for x in d.stages]) == (2, {"Current": 2}, ["Upload", "Text and table extraction"]) and d.upload_date.endswith("Z")
    shown = filled.display_rows(filled.store.read("locations")).first()
    assert shown.display_name == "Quiet Mill" and shown.confidence_percent == 95 and shown.source_link.endswith("#page=2")
    assert filled.filter_documents("MILL_2023").count() == 1 and filled.filter_documents("%").count() == 0
    for bad in ({"limit": 0}, {"limit": 501}, {"offset": -1}, {"status": "Open"}):
        with pytest.raises(ValueError):
            Search(**bad)


def test_hidden_documents_show_only_when_pinned(filled):
    key = filled.store.read("documents").first().id
    filled.store.commit(documents=filled.store.read("documents").withColumn("processing_status", F.lit("Failed")))
    assert filled.search(Search()).count() == 0 and filled.search(Search(document_id=key)).count() == 2
    assert filled.stats().first().total_locations == 0 and filled.stats().first().documents == 1


def test_patches(filled):
    key = filled.search(Search(state="NV")).first().id
    got = filled.patch(key, {"phone": None, "review_status": "Approved", "id": "x", "unknown": "y"}).first()
    assert (got.phone, got.review_status, got.city) == (None, "Approved", "Reno")
    with pytest.raises(KeyError):
        filled.patch("none", {"phone": "1"})
    for bad in ({}, {"unknown": "y"}, {"status": "Open"}):
        with pytest.raises(ValueError):
            filled.patch(key, bad)


def test_reruns_and_stages(spark, filled):
    key = filled.store.read("documents").first().id
    ask = spark.createDataFrame([(key,), ("none",)], "id string")
    assert {r.id: r.code for r in filled.rerun(ask).collect()} == {key: 202, "none": 404}
    assert {r.id: r.code for r in filled.rerun(ask).collect()} == {key: 409, "none": 404}
    filled.finish_stage(1, "Failed", "why")
    assert filled.store.read("stages").filter("id = 1").first().message == "why"


def test_backfill_and_headers(filled):
    filled.store.commit(locations=filled.store.read("locations").withColumn("franchisor", F.lit("")))
    filled.backfill_franchisors()
    assert {r.franchisor for r in filled.store.read("locations").collect()} == {"Quiet Mill"}
    assert filled.download_headers().first().content_disposition == "inline; filename=\"Quiet-Mill_2023.pdf\"; filename*=UTF-8''Quiet-Mill_2023.pdf"


# ------------------------------------------------------------------ sources and streaming


def test_tsv_words(spark):
    header = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    lines = [header, "1\t1\t0\t0\t0\t0\t0\t0\t1200\t1600\t-1\t", "5\t1\t1\t1\t1\t1\t36\t60\t70\t20\t90\tKite", "5\t1\t1\t1\t1\t2\t120\t60\t70\t20\t80\tWorks\tLLC", "5\t1\t1\t1\t2\t1\t36\t92\t70\t20\t70\tReno", "5\t1\t1\t1\t2\t2\t36\t92\t70\t20\t-1\tx", "5\t1\t1\t1\t2\t3\tNaN\t92\t70\t20\t50\ty", "5\t1\t1\t1\t2\t3\t1\t92\t70\t20\t50\t  ", "short\tline"]
    df = spark.createDataFrame([("d", 1, k, x) for k, x in enumerate(lines)], "document_id string, pdf_page int, line_no int, line string")
    words = ocr_tsv.read_words(df)
    assert [(r.text, r.x, r.y, r.page_width) for r in words.orderBy("ordinal").collect()] == [("Kite", 36.0, 1540.0, 1200.0), ("Works\tLLC", 120.0, 1540.0, 1200.0), ("Reno", 36.0, 1508.0, 1200.0)]
    assert round(ocr_tsv.page_confidence(words).first().ocr_confidence, 6) == 0.8


def test_uploads_and_scan_budgets(spark):
    rows = spark.createDataFrame([("a.pdf", 1, "x"), ("a", 5, "application/pdf"), ("a.txt", 5, "text/plain"), ("A.PDF", 104857601, None), ("b.pdf", 0, None), ("B.PDF", 104857600, "")], "name string, size long, kind string")
    assert [r[0] for r in rows.select(docs.valid_upload(F.col("name"), F.col("size"), F.col("kind"))).collect()] == [True, True, False, False, False, True]
    pages = spark.createDataFrame([("d", k, "x " * n, img) for k, (n, img) in enumerate([(79, False), (80, False), (399, True), (400, True), (0, None)])], "document_id string, pdf_page int, text string, has_image boolean")
    assert [(r.pdf_page, r.within_budget) for r in docs.scan_plan(pages, 2).orderBy("pdf_page").collect()] == [(0, True), (2, True), (4, False)]


def test_glyphs_come_from_an_injected_reader(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one two")
    (tmp_path / "b.txt").write_bytes(b"no")

    def reader(content):
        for k, word in enumerate(content.split()):
            yield {"pdf_page": 1, "ordinal": k, "text": word.decode(), "x": 1.0, "y": 2.0, "width": 3.0, "page_width": 612.0, "page_height": 792.0}

    got = docs.read_glyphs(docs.read_binaries(spark, str(tmp_path)), reader).collect()
    assert [(r.text, r.ordinal) for r in got] == [("one", 0), ("two", 1)]


def test_landing_registers_each_file_once(spark, workspace, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "Quiet-Mill_2023.pdf").write_bytes(b"x")
    (folder / "empty.pdf").write_bytes(b"")
    for _ in range(2):
        landing.register_landed(workspace, str(folder), str(tmp_path / "check")).awaitTermination()
        assert [(r.filename, r.fdd_year, r.franchise_name) for r in workspace.store.read("documents").collect()] == [("Quiet-Mill_2023.pdf", 2023, "Quiet Mill")]
    assert workspace.store.read("stages").count() == 1
