"""Outcomes of processing besides success: errors, incomplete pages, replaced uploads, newer documents, concurrent changes."""

import threading

import pytest
from pyspark.sql import functions as F
from test_process import DATE, ROWS, book, glyphs, register, states

from rosterloom.operators import directory
from rosterloom.plans import process
from rosterloom.plans.workspace import Workspace
from rosterloom.sources import documents as docs
from rosterloom.sources.store import ConcurrentChange, SnapshotStore

NAME = "Quiet-Mill_2023.pdf"


@pytest.fixture
def workspace(spark, tmp_path):
    return Workspace(SnapshotStore(spark, str(tmp_path / "store")))


def stage_of(workspace, name):
    key = {r.filename: r.id for r in workspace.store.read("documents").collect()}[name]
    return workspace.latest_stages().filter(F.col("document_id") == key).first()


def test_an_unreadable_document_leaves_the_other_alone(spark, workspace):
    ids = register(workspace, NAME, "Broken_2023.pdf")

    def reader(content):
        raise ValueError(f"no page tree in {len(content)} bytes")

    broken = docs.read_glyphs(spark.createDataFrame([(ids["Broken_2023.pdf"], bytearray(b"xyz"))], "document_id string, content binary"), reader)
    process.process_documents(workspace.store, glyphs(spark, {ids[NAME]: book(ROWS)}).unionByName(broken))
    assert states(workspace) == {NAME: "Ready", "Broken_2023.pdf": "Failed"}
    failed, done = stage_of(workspace, "Broken_2023.pdf"), stage_of(workspace, NAME)
    assert (failed.status, failed.message) == ("Failed", "no page tree in 3 bytes")
    assert done.status == "Complete" and done.message == "2 locations normalized from 1 verified source pages. 2 added, 0 updated, 0 unchanged. 0 duplicates removed. coverage checks passed"
    assert workspace.store.read("locations").count() == 2
    assert workspace.store.read("documents").filter("last_processed_at IS NOT NULL").count() == 1


def test_an_error_in_extraction_stays_with_its_document(spark):
    pages = book(ROWS)
    cells = [["EXHIBIT F-1"], ["LIST OF CURRENT FRANCHISEES"], *(r.split(" | ") for r in ROWS)]
    ddl = "document_id string, pdf_page int, text string, rows array<array<string>>, left array<string>, right array<string>"
    rows = [(d, n, t, c, [], []) for d, table in (("good", cells), ("bad", [*cells, [None]])) for n, t, c in ((1, pages[0], []), (2, pages[1], table))]
    out = process.extract(spark.createDataFrame(rows, ddl)).collect()
    assert sum(r.document_id == "good" and r.ordinal >= 0 for r in out) == 2
    assert [(r.ordinal, "NoneType" in r.error) for r in out if r.document_id == "bad"] == [(-1, True)]


def test_incomplete_recognition_keeps_stored_rows_and_warns(spark, workspace):
    key = register(workspace, NAME)[NAME]
    words = glyphs(spark, {key: book(ROWS)})
    problems = spark.createDataFrame([(key, 2, None, "render timed out"), (key, 3, None, "empty"), (key, 4, None, "budget"), (key, 5, None, "budget")], "document_id string, pdf_page int, ocr_confidence double, problem string")
    process.process_documents(workspace.store, words, scans=problems)
    m = workspace.store.read("documents").first().extraction_manifest
    assert m.warnings[:3] == ["OCR failed on page 2: render timed out", "OCR returned no searchable text on page 3", "OCR work budget was exhausted after 2 pages"]
    assert (m.ocrPages, m.addedRows, m.removedRows) == ([], 2, 0) and workspace.store.read("documents").first().page_count == 5
    register(workspace, NAME)
    process.process_documents(workspace.store, words, scans=problems)
    assert stage_of(workspace, NAME).message == "OCR did not complete on source pages 2, 3, 4, 5; existing location data was preserved"
    assert states(workspace) == {NAME: "Failed"} and workspace.store.read("locations").count() == 2


def test_recognised_words_are_scaled_and_follow_native_ones(spark):
    native = glyphs(spark, {"d": ["one | two", "three"]})
    ddl = "document_id string, pdf_page int, ordinal long, text string, x double, y double, width double, confidence double, page_width double, page_height double, line_key string"
    words = [("d", 2, 1, "Kite", 72.0, 1520.0, 60.0, 90.0, 1224.0, 1584.0, "1:1:1:1"), ("d", 2, 2, "Works", 140.0, 1520.0, 60.0, 80.0, 1224.0, 1584.0, "1:1:1:1"), ("d", 2, 3, "Reno", 800.0, 1520.0, 60.0, 80.0, 1224.0, 1584.0, "1:2:1:1"), ("d", 3, 1, "alone", 72.0, 100.0, 60.0, 80.0, 1224.0, 1584.0, "1:1:1:1")]
    pages, rows, lines = process.assemble_pages(native, None, spark.createDataFrame(words, ddl))
    got = {r.pdf_page: r for r in process.page_payloads(pages, rows, lines).collect()}
    assert got[2].text == "three\nKite Works\nReno" and got[2].rows == [["three"], ["Kite Works", "Reno"]]
    assert got[2].left == ["three", "Kite Works"] and got[2].right == ["Reno"]
    assert (got[1].text, got[3].text, got[3].rows) == ("one two", "alone", [["alone"]])
    assert {r.pdf_page: (r.ocr, r.ocr_confidence and round(r.ocr_confidence, 4)) for r in pages.collect()} == {1: (False, None), 2: (True, 0.8333), 3: (True, 0.8)}


def test_a_replaced_upload_is_skipped_and_a_concurrent_change_is_kept(spark, workspace, monkeypatch):
    key = register(workspace, NAME)[NAME]
    read = process._read_documents

    def replaced_meanwhile(*args):
        workspace.register(spark.createDataFrame([(NAME, "/objects/second")], "filename string, object_path string"))
        return read(*args)

    monkeypatch.setattr(process, "_read_documents", replaced_meanwhile)
    process.process_documents(workspace.store, glyphs(spark, {key: book(ROWS)}))
    assert states(workspace) == {NAME: "Processing"} and workspace.store.read("locations").count() == 0
    assert {(r.stage, r.status, r.message) for r in workspace.store.read("stages").collect()} == {("Upload", "Complete", None), ("Text and table extraction", "Skipped", "A newer replacement of this document is already processing")}
    assert sorted(r.id for r in workspace.store.read("stages").collect()) == [1, 2, 3]


def test_a_run_that_fails_as_a_whole_ends_its_stages(spark, workspace, monkeypatch):
    key = register(workspace, NAME)[NAME]

    def fails(*args):
        raise RuntimeError("disk full\nat some place")

    monkeypatch.setattr(process, "_read_documents", fails)
    with pytest.raises(RuntimeError):
        process.process_documents(workspace.store, glyphs(spark, {key: book(ROWS)}))
    assert states(workspace) == {NAME: "Failed"} and stage_of(workspace, NAME).message == "disk full"


def test_a_newer_verified_document_keeps_an_older_one_out(spark, workspace):
    ids = register(workspace, "new_2023.pdf", "old_2022.pdf", "other_2021.pdf")
    stored = workspace.store.read("documents")
    older = F.col("filename") != "new_2023.pdf"
    workspace.store.commit(documents=stored.withColumns({
        "upload_date": F.when(older, F.lit(DATE)).otherwise(F.col("upload_date")), "franchise_name": F.when(older, F.col("franchise_name")).otherwise("HOTWORX"),
        "processing_status": F.when(F.col("filename") == "new_2023.pdf", "Ready").when(F.col("filename") == "other_2021.pdf", "Failed").otherwise("Processing"),
    }))
    text = {ids["old_2022.pdf"]: book(ROWS, "HOTWORX")}
    # not processed yet, the newer one does not count
    process.process_documents(workspace.store, glyphs(spark, text))
    assert states(workspace)["old_2022.pdf"] == "Ready"
    workspace.store.commit(documents=workspace.store.read("documents").withColumn("last_processed_at", F.current_timestamp()))
    process.process_documents(workspace.store, glyphs(spark, text), ids=[ids["old_2022.pdf"]])
    assert states(workspace) == {"old_2022.pdf": "Superseded", "new_2023.pdf": "Ready", "other_2021.pdf": "Failed"}
    assert stage_of(workspace, "old_2022.pdf").message == "A newer verified FDD (new_2023.pdf) already supplies this franchisor's evidence"


def test_versions_refuse_a_change_of_what_has_changed(spark, workspace):
    store = workspace.store
    register(workspace, NAME)
    base = store.version()
    register(workspace, NAME)
    with pytest.raises(ConcurrentChange):
        store.commit(base, documents=store.read("documents", base))
    assert store.read("stages").count() == 2 and store.read("stages", base).count() == 1
    store.vacuum(1)
    assert store.read("documents").count() == 1


def test_rows_are_numbered_without_gaps(spark):
    rows = spark.range(3000).select((F.col("id") % 700).cast("string").alias("k"), F.col("id").alias("v"))
    assert sorted(r.id for r in directory.number_rows(rows, "k", 10).select("id").collect()) == list(range(11, 3011))


def test_a_run_that_cannot_start_leaves_failed_stages(spark, workspace, monkeypatch):
    key = register(workspace, NAME)[NAME]

    def fails(*args):
        raise RuntimeError("no room for stages")

    monkeypatch.setattr(process, "_start", fails)
    with pytest.raises(RuntimeError):
        process.process_documents(workspace.store, glyphs(spark, {key: book(ROWS)}))
    assert states(workspace) == {NAME: "Failed"}
    last = stage_of(workspace, NAME)
    assert (last.stage, last.status, last.message) == ("Processing error", "Failed", "no room for stages") and last.finished_at is not None


def test_runs_of_two_brands_commit_at_once(spark, tmp_path, monkeypatch):
    """Both runs read the same version; neither makes its commit anew.  With many buckets the two share none."""
    workspace = Workspace(SnapshotStore(spark, str(tmp_path / "store"), buckets=4096))
    first, second = "Quiet-Mill_2023.pdf", "Kite-Works_2023.pdf"
    keys = {n: register(workspace, n)[n] for n in (first, second)}
    commits, together, commit = [], threading.Barrier(2, timeout=120), process._commit

    def counted(store, summary, accepted, started, base, place):
        commits.append(base)
        if len(commits) <= 2:
            together.wait()
        return commit(store, summary, accepted, started, base, place)

    monkeypatch.setattr(process, "_commit", counted)
    runs = [threading.Thread(target=process.process_documents, args=(workspace.store, glyphs(spark, {k: book(ROWS)}), [k])) for k in keys.values()]
    for run in runs:
        run.start()
    for run in runs:
        run.join()
    assert states(workspace) == {first: "Ready", second: "Ready"} and len(commits) == 2
    assert workspace.store.read("locations").count() == 4 and workspace.stats().first().total_locations == 4
