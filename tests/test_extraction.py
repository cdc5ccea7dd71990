"""Sections, brands and record grammars on invented documents."""

import pytest
from pyspark.sql import functions as F

from rosterloom.functions import fields
from rosterloom.operators import brand, grammars, sections


def test_toc_ranges():
    toc = "\n".join([
        "ITEM 20 OUTLETS AND FRANCHISEE INFORMATION ........ 61", "EXHIBIT F-1 LIST OF CURRENT FRANCHISEES ........ 201-204", "EXHIBIT F-2 FRANCHISEES SIGNED BUT NOT OPEN .... 205",
        "EXHIBIT F-3 FORMER FRANCHISEES .... 206 to 207", "EXHIBIT G FINANCIAL STATEMENTS ........ 210",
    ])
    got = sections.toc_entries(toc)
    assert [(t.item, t.exhibit, t.first, t.last, t.spans, t.kind) for t in got] == [
        (20, None, 61, 61, False, None), (None, "F-1", 201, 204, True, "current"), (None, "F-2", 205, 205, False, "signed-but-not-open"), (None, "F-3", 206, 207, True, "former"),
    ]
    assert got[1].title == "EXHIBIT F-1 LIST OF CURRENT FRANCHISEES ........"
    assert sections.toc_entries("EX. B FORMER FRANCHISEES....12")[0].title == "EX. B FORMER FRANCHISEES"


HEADINGS = [
    ("LIST OF CURRENT FRANCHISEES", "current"), ("EXHIBIT F-1 - LIST OF CURRENT FRANCHISEES", "current"), ("F-3: Former Franchisees", "former"), ("FRANCHISEES WHO HAVE LEFT THE SYSTEM", None),
    ("Former  Franchisees", "former"), ("the list of current franchisees", None), ("12 Current franchisees", None), ("CURRENT FRANCHISEES ....... 12", None), ("Table of contents: current franchisees", None),
    ("ITEM 20", None), ("", None), ("CEASED OPERATIONS", "former"), ("Franchisees with outlets open as of December 31", "current"), ("SIGNED BUT NOT OPEN", "signed-but-not-open"), ("LIST OF FRANCHISES SOLD BUT NOT YET OPENED", "signed-but-not-open"),
    ("CURRENT AND FORMER FRANCHISEES", None), ("Open Studios " * 20, None), ("Sales of current franchisees rose", None),
]


def test_heading_rules_in_python_and_in_columns(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(HEADINGS)], "k int, t string")
    got = rows.select("t", fields.heading_kind(F.col("t")).alias("kind"), fields.heading_status(F.col("t")).alias("status"), fields.list_kind(F.col("t")).alias("any")).collect()
    for r in got:
        assert r.kind == sections.heading_kind(r.t), r.t
        assert r.status == sections.heading_status(r.t), r.t
        assert r.any == sections.list_kind(r.t), r.t
    assert [sections.heading_kind(t) for t, _ in HEADINGS][:3] == ["current", "current", "former"]
    assert sections.heading_kind("Former  Franchisees") == "former" and sections.heading_kind("CURRENT FRANCHISEES ....... 12") is None


def test_status_of_lines():
    assert sections.final_status("Current Franchisees\nx\nCEASED OPERATIONS\ny") == "Former"
    assert sections.final_status("nothing here", "Planning") == "Planning"


def filler(n):
    return "Prose without any list.\n" * 3 + f"Page {n}"


def test_repeated_headings_continue_a_list():
    pages = [(1, filler(1)), (30, "EXHIBIT F-1\nLIST OF CURRENT FRANCHISEES\nrow\n101"), (31, "LIST OF CURRENT FRANCHISEES\nrow\n102"), (32, "FORMER FRANCHISEES\nrow\n103"), (33, "more\n104"), (34, "EXHIBIT G\nOther\n105"), (35, "tail\n106")]
    got = sections.discover_sections(pages).sections
    assert [(s.kind, s.exhibit, s.pdf_start, s.pdf_end, s.printed_start, s.printed_end) for s in got] == [("current", "F-1", 30, 31, 101, 102), ("former", "F-1", 32, 33, 103, 104)]


def test_toc_range_wins_when_its_end_is_readable():
    toc = "EXHIBIT F-1 LIST OF CURRENT FRANCHISEES .... 101-103"
    pages = [(1, toc), (30, "EXHIBIT F-1\nLIST OF CURRENT FRANCHISEES\nx\n101"), (31, "x\n102"), (32, "x\n103"), (33, "EXHIBIT G\nx\n104")]
    assert [(s.pdf_start, s.pdf_end, s.printed_end) for s in sections.discover_sections(pages).sections] == [(30, 32, 103)]
    pages[3] = (32, "an unreadable footer")
    assert [(s.pdf_start, s.pdf_end, s.printed_end) for s in sections.discover_sections(pages).sections] == [(30, 32, 103)]


def test_split_headings_and_shorthand_exhibits():
    pages = [(40, "F-3: Former\nFranchisees\nAda Lo, Reno, NV 89501"), (41, "x")]
    got = sections.discover_sections(pages).sections
    assert [(s.kind, s.exhibit, s.heading) for s in got] == [("former", "F-3", "F-3: Former Franchisees")]


def test_early_headings_need_evidence():
    assert not sections.discover_sections([(3, "LIST OF CURRENT FRANCHISEES\nnothing")]).sections
    assert sections.discover_sections([(3, "LIST OF CURRENT FRANCHISEES\n5 Oak Rd, Reno, NV 89501")]).sections


def test_footer_labels(spark):
    texts = ["a\nb\nPage 12", "x 5\n" * 7, "no digits", "Dallas, TX 75201", "lines\n\n\n\n\n\n\n7\nq", "F - 33 ", "123456", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fields.footer_label(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in got] == [(t, sections.footer_label(t)) for t in texts]
    assert sections.footer_label("Dallas, TX 75201") == 5201  # a label may be the tail of a longer number


# ------------------------------------------------------------------ brands


@pytest.mark.parametrize(
    ("page", "fallback", "want"),
    [
        ("FRANCHISOR: Blue Kiln Studios, LLC a Delaware limited liability company", "Uploaded FDD", "Blue Kiln Studios, LLC"),
        ("The franchisor is Nimbus Bread. It bakes.", "document", "Nimbus Bread"),
        ("The franchisor means we", "FDD", "FDD"),
        ("welcome to pure  barre", "Other Name", "Pure Barre"),
        ("nothing", "Gold's gym", "Gold’s Gym"),
        ("nothing", "Quiet Mill.", "Quiet Mill"),
    ],
)
def test_brand_detection(page, fallback, want):
    assert brand.detect_brand(page, fallback) == want


def test_brand_of_a_file_name(spark):
    names = ["Quiet-Mill_2023_FDD.pdf", "massage_envy-2021.PDF", "2024.pdf", "Plain.pdf", "unknown 2020.pdf"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(fields.brand_from_filename(F.col("n"))).collect()]
    assert got == ["Quiet Mill", "Massage Envy", "2024", "Plain", "Uploaded FDD"]


def test_brand_folds_over_first_pages(spark):
    docs = spark.createDataFrame([("d", "FDD_2023.pdf"), ("e", "x.pdf")], "document_id string, filename string")
    pages = spark.createDataFrame([("d", 2, "Franchisor: Late Name, Inc."), ("d", 1, "Franchisor: Early Name, Inc."), ("d", 6, "HOTWORX")], "document_id string, pdf_page int, text string")
    got = {r.document_id: r.brand for r in brand.document_brands(pages, docs).collect()}
    assert got == {"d": "Early Name, Inc", "e": "x"}


# ------------------------------------------------------------------ rows


def pick(c, *names):
    return tuple(c[n] for n in names)


def test_full_state_names_and_packed_cells():
    row = grammars.table_row(["Kite Works LLC", "12 Elm St", "Mobile", "Alabama", "36602", "251-555-0100"], 7, "Current")
    assert pick(row, "franchisee_entity", "address", "city", "state", "zip", "phone", "source_page") == ("Kite Works LLC", "12 Elm St", "Mobile", "AL", "36602", "251-555-0100", 7)
    row = grammars.table_row(["12 Elm St", "Mobile", "AL", "36602 (251) 555-0100 Kite Works, Inc. Jo Ray"], 7, "Former")
    assert pick(row, "franchisee_entity", "zip", "phone", "status") == ("Kite Works, Inc", "36602", "(251) 555-0100", "Former")
    row = grammars.table_row(["3.", "Ray Co", "9 Oak Ave", "Reno, NV 89501-1234", "not yet opened"], 2, "Current")
    assert pick(row, "address", "city", "state", "zip", "status") == ("9 Oak Ave", "Reno", "NV", "89501-1234", "Planning")


def test_rows_without_a_street():
    row = grammars.table_row(["North Side", "TX", "Gill Partners", "Ann Gill", "ann@gill.example.com"], 3, "Current")
    assert pick(row, "franchisee_entity", "city", "email") == ("Gill Partners", "North Side", "ann@gill.example.com")
    row = grammars.table_row(["Gill Partners", "North Side", "TX", "Ann Gill", "512-555-0100"], 3, "Current")
    assert pick(row, "franchisee_entity", "city", "state", "zip", "address") == ("Gill Partners", "North Side", "TX", "", "Address not disclosed")
    assert grammars.table_row(["TX", "Franchisee", "Phone", "512-555-0100"], 3, "Current") is None
    assert grammars.table_row(["TX", "Gill Partners", "no contact"], 3, "Current") is None
    assert grammars.table_row([], 3, "Current") is None


# ------------------------------------------------------------------ blocks


def test_units_take_the_last_territories():
    lines = ["[[PAGE:4]]", "Austin, TX", "Waco, TX (North)", "Temple, TX - East", "Mill Group", "77 Main St", "Austin, TX 78701", "# of units: 2", "stray"]
    got = grammars.unit_blocks(lines, 1)
    assert [pick(c, "city", "state", "zip", "franchisee_entity", "address", "source_page") for c in got] == [("Waco", "TX", "78701", "Mill Group", "77 Main St", 4), ("Temple", "TX", "78701", "Mill Group", "77 Main St", 4)]
    assert len(grammars.unit_blocks([x.replace("units: 2", "units: 0") for x in lines], 1)) == 3  # none counted takes all
    assert [c["city"] for c in grammars.unit_blocks(["Mill Group", "77 Main St", "Austin, TX 78701", "# of units: 1"], 1)] == ["Austin"]
    assert grammars.unit_blocks(["no address", "# of units: 3"], 1) == []


def test_addresses_only_inside_a_list():
    lines = [
        "1 Out St, Reno, NV 89501", "LIST OF CURRENT FRANCHISEES", "Ada Lo*", "5 Oak Rd", "Reno, NV 89501", "775-555-0100", "ada@lo.example.com", "Waco, TX", "Bo Hu", "254-555-0111", "EXHIBIT G", "9 Elm St, Reno, NV 89501",
    ]
    got = grammars.address_blocks(lines, 6)
    assert [pick(c, "franchisee_entity", "address", "city", "zip", "phone", "email") for c in got] == [("Ada Lo", "5 Oak Rd", "Reno", "89501", "254-555-0111", "ada@lo.example.com")]
    assert got[0]["raw_source_text"] == "Ada Lo* | 5 Oak Rd | Reno, NV 89501 | 775-555-0100 | ada@lo.example.com | 254-555-0111"  # later details join the last row of the page


def test_territory_without_a_street():
    got = grammars.address_blocks(["FORMER FRANCHISEES", "Waco, TX", "Bo Hu*", "254-555-0111"], 6)
    assert [pick(c, "franchisee_entity", "address", "city", "state", "phone", "status") for c in got] == [("Bo Hu", "Address not disclosed", "Waco", "TX", "254-555-0111", "Former")]


def test_a_row_for_each_agreement_code():
    lines = ["[[PAGE:9]]", "[[STATUS:Current]]", "Texas", "Kite Works LLC", "Dallas DMA North", "kite @works.example.co m", "TX1234 and TX1235", "FORMER FRANCHISEES", "Oklahoma", "Ann Gill", "OK0001"]
    got = grammars.territory_blocks(lines, 1)
    assert [pick(c, "state", "city", "franchisee_entity", "status", "source_page") for c in got] == [("TX", "Dallas", "Kite Works LLC", "Current", 9), ("TX", "Dallas", "Kite Works LLC", "Current", 9), ("OK", "Territory not disclosed", "Ann Gill", "Former", 9)]
    assert got[1]["raw_source_text"].endswith("Location code: TX1235")
    assert grammars.territory_blocks(["TX1234"], 1) == []
