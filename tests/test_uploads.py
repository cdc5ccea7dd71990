"""From uploaded bytes to committed rows in one call."""

import pytest

from rosterloom.plans import uploads
from rosterloom.plans.workspace import Workspace
from rosterloom.sources import recognition
from rosterloom.sources.store import SnapshotStore

ROWS = ["Kite Works LLC | 12 Elm St | Reno | NV | 89501 775-555-0100", "Mill Group Inc | 9 Oak Ave | Austin | TX | 78701 512-555-0100"]
PROSE = [f"This is line {k} of the disclosure, long enough to count as text." for k in range(9)]
LIST = ["EXHIBIT F-1", "LIST OF CURRENT FRANCHISEES", *ROWS, "2"]


def _injected():
    """Functions of this call, so that workers need not import the tests."""

    def reader(content):
        """Pages are parted by form feeds, cells by bars; a page of an image has a blank word."""
        if content == b"xyz":
            raise ValueError("no page tree")
        for n, page in enumerate(content.decode().split("\f"), 1):
            image = page.startswith("IMAGE")
            for i, line in enumerate([" "] if image else page.split("\n")):
                for j, cell in enumerate(line.split(" | ")):
                    yield {"pdf_page": n, "ordinal": 16 * i + j, "text": cell, "x": 36.0 + 125 * j, "y": 760.0 - 24 * i, "width": min(7.0 * len(cell), 100.0), "page_width": 612.0, "page_height": 792.0, "has_image": image}

    def recogniser(content, page):
        """What stands on an image, word by word, at twice the page's size."""
        lines = content.decode().split("\f")[page - 1].removeprefix("IMAGE\n").split("\n")
        if lines == ["torn"]:
            raise ValueError("render timed out")
        out = ["level\tpage", "1\t1\t0\t0\t0\t0\t0\t0\t1224\t1584\t-1\t"]
        for i, line in enumerate(lines):
            for j, cell in enumerate(line.split(" | ")):
                out.append(f"5\t1\t1\t1\t{i}\t{j}\t{72 + 250 * j}\t{64 + 48 * i}\t{min(14 * len(cell), 200)}\t20\t90\t{cell}")
        return "\n".join(out)

    return reader, recogniser


reader, recogniser = _injected()


def book(*pages):
    return "\f".join("\n".join(p) for p in pages).encode()


@pytest.fixture
def workspace(spark, tmp_path):
    return Workspace(SnapshotStore(spark, str(tmp_path / "store")))


def test_files_to_locations(spark, workspace):
    files = {"Quiet-Mill_2023.pdf": book(PROSE, LIST), "Kite-Works_2023.pdf": book(PROSE, ["IMAGE", *LIST]), "Broken_2023.pdf": b"xyz", "Gone_2023.pdf": None, "Torn-Mill_2023.pdf": book(PROSE, ["IMAGE", "torn"])}
    workspace.register(spark.createDataFrame([(n, f"/objects/{n}") for n in files], "filename string, object_path string"))
    stored = spark.createDataFrame([(f"/objects/{n}", bytearray(c)) for n, c in files.items() if c is not None], "object_path string, content binary")
    uploads.process_uploads(workspace.store, stored, reader, recogniser)
    documents = {r.filename: r for r in workspace.store.read("documents").collect()}
    assert {n: r.processing_status for n, r in documents.items()} == {"Quiet-Mill_2023.pdf": "Ready", "Kite-Works_2023.pdf": "Ready", "Broken_2023.pdf": "Failed", "Gone_2023.pdf": "Failed", "Torn-Mill_2023.pdf": "Failed"}
    messages = {r.document_id: r.message for r in workspace.latest_stages().collect()}
    assert messages[documents["Broken_2023.pdf"].id] == "no page tree" and messages[documents["Gone_2023.pdf"].id] == uploads.NO_FILE
    assert messages[documents["Torn-Mill_2023.pdf"].id].startswith("No validated")
    rows = {(r.document_id, r.city): r.review_status for r in workspace.store.read("locations").collect()}
    assert rows == {(documents[n].id, c): s for n, s in (("Quiet-Mill_2023.pdf", "Auto-verified"), ("Kite-Works_2023.pdf", "Needs review")) for c in ("Reno", "Austin")}
    assert list(documents["Kite-Works_2023.pdf"].extraction_manifest.ocrPages) == [2]


def test_budgets_of_pages_and_time(spark):
    files = spark.createDataFrame([("a", bytearray(book(*[["IMAGE", f"word {n}"] for n in range(6)]))), ("b", bytearray(b"IMAGE\ntorn"))], "document_id string, content binary")
    needed = spark.createDataFrame([("a", n) for n in (6, 1, 3, 2, 3)] + [("b", 1)], "document_id string, pdf_page int")

    def problems(**limits):
        scans, words = recognition.scans_and_words(recognition.recognise(files, needed, recogniser, **limits))
        assert {r.text for r in words.collect()} <= {f"word {n}" for n in range(6)}
        return {(r.document_id, r.pdf_page): r.problem for r in scans.collect()}

    whole = {("a", n): None for n in (1, 2, 3, 6)} | {("b", 1): "render timed out"}
    assert problems() == whole
    assert problems(limit=2) == whole | {("a", 3): recognition.BUDGET, ("a", 6): recognition.BUDGET}
    assert problems(seconds=0) == {k: recognition.BUDGET for k in whole}


def test_a_run_that_cannot_read_says_so(spark, workspace):
    workspace.register(spark.createDataFrame([("Quiet-Mill_2023.pdf", "/objects/x")], "filename string, object_path string"))
    broken = spark.createDataFrame([("/objects/x", bytearray(b"x"))], "object_path string, content binary")

    def failing(content):
        import os

        os._exit(3)

    with pytest.raises(Exception):
        uploads.process_uploads(workspace.store, broken, failing)
    assert workspace.store.read("documents").first().processing_status == "Failed"
    assert workspace.latest_stages().first().stage == "Processing error"
