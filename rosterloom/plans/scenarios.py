"""Queries that run the steps of document processing on documents made from whole supplied tables.

Each customer or supplier gives one invented document, or its share of a brand, and its key
decides the case.  The SQL states the results of every case by themselves, so it holds at any size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import brand, matching, reconcile, sections
from ..session import SHUFFLED, Aside, shared_folder, table
from ..sources import ocr_tsv, recognition
from ..sources.store import SnapshotStore
from . import process
from .catalog import catalog
from .workspace import Workspace

QUERIES, ORACLE_SQL, query = catalog()


def _rows(spark, d, **columns):
    """Customers with their key ``k`` and columns given as Spark SQL, which may use earlier ones."""
    out = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    for name, sql in columns.items():
        out = out.withColumn(name, F.expr(sql))
    return out


# ------------------------------------------------------------------ sections and brands


@query("""
    WITH c AS (SELECT c_custkey AS k, 1 + c_custkey % 3 AS n FROM customer),
         s AS (SELECT k, 0 AS ordinal, 'LIST OF CURRENT FRANCHISEES' AS heading, 'current' AS kind, 'Current' AS status, 30 AS pdf_start, 29 + n AS pdf_end FROM c
               UNION ALL SELECT k, 1, 'FORMER FRANCHISEES', 'former', 'Former', 30 + n, CASE WHEN k % 2 = 0 THEN 31 + n ELSE 32 + n END FROM c)
    SELECT k, CAST(ordinal AS BIGINT) AS ordinal, heading, kind, status, 'F-1' AS exhibit, CAST(300 + pdf_start AS BIGINT) AS printed_start, CAST(300 + pdf_end AS BIGINT) AS printed_end,
           CAST(pdf_start AS BIGINT) AS pdf_start, CAST(pdf_end AS BIGINT) AS pdf_end, k % 5 = 0 AS from_toc FROM s
""")
def section_discovery(spark, d):
    """Lists with their page ranges: repeated headings continue a list, the next heading or exhibit ends it, and a table of contents may name it."""
    pages = _rows(
        spark, d, n="cast(1 + k % 3 as int)", page="explode(concat(array(1), sequence(30, 32 + n)))", label="concat('\\n', 300 + page)",
        text="""case when page = 1 then if(k % 5 = 0, concat('EXHIBIT F-1 LIST OF CURRENT FRANCHISEES .... 330-', 329 + n), 'Contents')
                when page = 30 then concat('EXHIBIT F-1\\nLIST OF CURRENT FRANCHISEES\\nrow of ', c_name, label)
                when page < 30 + n then concat('LIST OF CURRENT FRANCHISEES\\nmore', label) when page = 30 + n then concat('FORMER FRANCHISEES\\nrow', label)
                when page = 31 + n then concat('more', label) when k % 2 = 0 then concat('EXHIBIT G\\nOther', label) else concat('tail', label) end""",
    )
    found = sections.discover(pages.select(F.col("k").cast("string").alias("document_id"), F.col("page").alias("pdf_page"), "text"))
    numbers = ("printed_start", "printed_end", "pdf_start", "pdf_end")
    return found.select(F.col("document_id").cast("long").alias("k"), "ordinal", "heading", "kind", "status", "exhibit", *(F.col(c).cast("long").alias(c) for c in numbers), "from_toc")


@query("""
    SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 2 THEN 'Massage Envy' WHEN c_custkey % 3 = 2 THEN 'Pure Barre' WHEN c_custkey % 4 = 1 THEN c_mktsegment || ' Mill'
                                WHEN c_custkey % 3 = 1 THEN c_name || ' Works, LLC' ELSE 'Late Name, Inc' END AS brand FROM customer
""")
def brand_detect(spark, d):
    """The brand from a file name and the first five pages: known names first, then telling file names, then labelled names."""
    rows = _rows(
        spark, d, filename="case k % 4 when 0 then 'FDD_2023.pdf' when 1 then concat(c_mktsegment, '-Mill_2022_FDD.pdf') when 2 then 'massage_envy-2021.PDF' else 'unknown 2020.pdf' end",
        opening="case k % 3 when 0 then 'Prose only' when 1 then concat('FRANCHISOR: ', c_name, ' Works, LLC a Delaware limited liability company') else 'welcome to pure  barre' end",
    ).withColumn("document_id", F.col("k").cast("string"))
    page = lambda n, text: F.struct(F.lit(n).alias("pdf_page"), text.alias("text"))
    texts = F.explode(F.array(page(2, F.lit("Franchisor: Late Name, Inc.")), page(1, F.col("opening")), page(6, F.lit("HOTWORX"))))
    pages = rows.select("document_id", texts.alias("p")).select("document_id", "p.*")
    return brand.document_brands(pages, rows).select(F.col("document_id").cast("long").alias("k"), "brand")


_EVIDENCE_SQL = P.EVIDENCE.replace(P.EDGE, r"\b")


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_EVIDENCE_SQL}')) AS BIGINT) AS evidence, regexp_matches(text, '{_EVIDENCE_SQL}') AS credible FROM documents")
def evidence_marks(spark, d):
    """Marks of list rows in each text: states with ZIP codes, telephone numbers, agreement codes and e-mail addresses."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.regexp_count("text", F.lit(P.EVIDENCE)).cast("long").alias("evidence")).withColumn("credible", F.col("evidence") > 0)


# ------------------------------------------------------------------ grammars

_CITE = "CAST(30 AS BIGINT) AS source_page, '40' AS printed_page, 'F-1' AS source_exhibit, 'LIST OF CURRENT FRANCHISEES' AS source_section"
_ADA = "'Ada Lo' AS franchisee_entity, k || ' Oak Rd' AS address, 'Reno' AS city, 'NV' AS state, '89501' AS zip, '775-555-0100' AS phone, 'ada' || k || '@lo.example.com' AS email, 'Ada Lo* | ' || k || ' Oak Rd | Reno, NV 89501 | 775-555-0100 | ada' || k || '@lo.example.com' AS raw_source_text"
_BO = f"'Bo Hu' AS franchisee_entity, '{P.NO_ADDRESS}' AS address, 'Waco' AS city, 'TX' AS state, '' AS zip, '254-555-0111' AS phone, NULL AS email, 'Waco, TX | Bo Hu* | 254-555-0111' AS raw_source_text"
_MAIN = "'Mill Group' AS franchisee_entity, k || ' Main St' AS address, 'Austin' AS city, 'TX' AS state, '78701' AS zip, NULL AS phone, NULL AS email, 'Mill Group | ' || k || ' Main St | Austin, TX 78701' AS raw_source_text"
_UNIT = "'LIST OF CURRENT FRANCHISEES | Austin, TX | Waco, TX (North) | Temple, TX - East | Mill Group | ' || k || ' Main St | Austin, TX 78701 | # of units: ' || n || ' | Territory: ' || t"


@query(f"""
    WITH c AS (SELECT c_custkey AS k, 1 + c_custkey % 3 AS n, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS code FROM customer),
         e AS (
            SELECT k, 0 AS ordinal, 'Current' AS status, 'Kite ' || k || ' LLC' AS franchisee_entity, k || ' Elm St' AS address, 'Reno' AS city, 'NV' AS state, '89501' AS zip, '775-555-0100' AS phone, NULL AS email,
                   'Kite ' || k || ' LLC | ' || k || ' Elm St | Reno | NV | 89501 775-555-0100' AS raw_source_text FROM c WHERE k % 4 = 0
            UNION ALL SELECT k, 1, 'Planning', 'Oak Inc', k || ' Oak Ave', 'Mobile', 'AL', '36602', NULL, NULL, 'Oak Inc | ' || k || ' Oak Ave | Mobile | Alabama | 36602 | not yet opened' FROM c WHERE k % 4 = 0
            UNION ALL SELECT k, 2, 'Current', 'Gill Partners', '{P.NO_ADDRESS}', 'North Side', 'TX', '', NULL, 'ann' || k || '@gill.example.com', 'North Side | TX | Gill Partners | Ann Gill | ann' || k || '@gill.example.com' FROM c WHERE k % 4 = 0
            UNION ALL SELECT k, o, 'Current', 'Kite ' || k || ' LLC', '{P.NO_ADDRESS}', 'Dallas', 'TX', '', NULL, 'kite@works.example.com',
                   'Kite ' || k || ' LLC | Dallas DMA North | kite@works.example.com | TX' || code || ' and OK' || code || ' | Location code: ' || p || code FROM c CROSS JOIN (VALUES (0, 'TX'), (1, 'OK')) v(o, p) WHERE k % 4 = 1
            UNION ALL SELECT k, o + n - 3, 'Current', 'Mill Group', k || ' Main St', city, 'TX', '78701', NULL, NULL, {_UNIT}
                   FROM c CROSS JOIN (VALUES (0, 'Austin', 'Austin, TX'), (1, 'Waco', 'Waco, TX (North)'), (2, 'Temple', 'Temple, TX - East')) v(o, city, t) WHERE k % 4 = 2 AND o >= 3 - n
            UNION ALL SELECT k, n + o, 'Current', * EXCLUDE (o, k, n) FROM (SELECT o, k, n, {_MAIN} FROM c CROSS JOIN (VALUES (0), (1)) v(o) WHERE k % 4 = 2)
            UNION ALL SELECT k, o, 'Current', * EXCLUDE (o, k) FROM (SELECT o, k, {_ADA} FROM c CROSS JOIN (VALUES (0), (2)) v(o) WHERE k % 4 = 3)
            UNION ALL SELECT k, o, 'Current', * EXCLUDE (o, k) FROM (SELECT o, k, {_BO} FROM c CROSS JOIN (VALUES (1), (3)) v(o) WHERE k % 4 = 3))
    SELECT * REPLACE (CAST(ordinal AS BIGINT) AS ordinal), {_CITE} FROM e
""")
def block_grammars(spark, d):
    """Candidates of table rows and directories, territory codes, counted units, and addresses over several lines, as processing extracts them."""
    rows = _rows(
        spark, d, n="1 + k % 3", code="lpad(k % 10000, 4, '0')",
        rows="""if(k % 4 = 0, array(array(concat('Kite ', k, ' LLC'), concat(k, ' Elm St'), 'Reno', 'NV', '89501 775-555-0100'), array('Oak Inc', concat(k, ' Oak Ave'), 'Mobile', 'Alabama', '36602', 'not yet opened'),
                                    array('North Side', 'TX', 'Gill Partners', 'Ann Gill', concat('ann', k, '@gill.example.com'))), null)""",
        left="""case k % 4 when 1 then array('Texas', concat('Kite ', k, ' LLC'), 'Dallas DMA North', 'kite@works.example.com', concat('TX', code, ' and OK', code))
                when 2 then array('Austin, TX', 'Waco, TX (North)', 'Temple, TX - East', 'Mill Group', concat(k, ' Main St'), 'Austin, TX 78701', concat('# of units: ', n))
                when 3 then array('Ada Lo*', concat(k, ' Oak Rd'), 'Reno, NV 89501', '775-555-0100', concat('ada', k, '@lo.example.com')) end""",
        right="if(k % 4 = 3, array('Waco, TX', 'Bo Hu*', '254-555-0111'), null)",
    )
    payloads = rows.select(F.col("k").cast("string").alias("document_id"), F.lit(30).alias("pdf_page"), F.lit("EXHIBIT F-1\nLIST OF CURRENT FRANCHISEES\n40").alias("text"), "rows", "left", "right")
    names = ("status", "franchisee_entity", "address", "city", "state", "zip", "phone", "email", "raw_source_text", "printed_page", "source_exhibit", "source_section")
    return process.extract(payloads).filter("ordinal >= 0").select(F.col("document_id").cast("long").alias("k"), "ordinal", *names, F.col("source_page").cast("long").alias("source_page"))


# ------------------------------------------------------------------ reconciliation

_PERSON = ("raw_name", "first_name", "middle_name", "last_name", "suffix", "title", "email", "phone")


def _person(name="null", phone="null", email="null"):
    values = {"raw_name": name, "phone": phone, "email": email}
    return "named_struct(" + ", ".join(f"'{c}', cast({values.get(c, 'null')} as string)" for c in _PERSON) + ")"


_NONE = f"cast(array() as array<struct<{','.join(f'{c}:string' for c in _PERSON)}>>)"
#: Which stored and incoming rows a customer's case has.
_STORED, _INCOMING = "case k % 8 when 4 then 0 when 5 then 2 when 6 then 2 else 1 end", "case k % 8 when 2 then 0 when 3 then 0 when 4 then 2 else 1 end"


def _sides(rows):
    """Incoming candidates and stored locations of rows (k, brand_key); the rows of a key share a city of their own."""
    people = f"""case when k % 8 = 0 then array({_person(phone="if(stored, '775-555-0100', '+1 (775) 555.0100')")})
                      when k % 8 = 7 and stored then array({_person("'Ann Gill'", "'775-555-0100'")})
                      when k % 8 = 7 then array({_person("'Bo Hu'", "'775-555-0100'")}, {_person("'Ann Gill'", email="'ann@x.example.com'")}) else {_NONE} end"""
    both = rows.withColumn("stored", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("row", F.expr(f"explode_outer(if(if(stored, {_STORED}, {_INCOMING}) = 0, null, sequence(1, if(stored, {_STORED}, {_INCOMING}))))")).filter("row is not null")
    values = {
        "document_id": "if(stored and k % 8 not in (1, 2), 'old', concat('new-', brand_key))", "franchise_name": "brand_key", "franchisor": "brand_key", "status": "if(k % 8 = 7 and not stored, 'Former', 'Current')",
        "franchisee_entity": "case when k % 8 = 0 or (k % 8 = 6 and stored and row = 1) then null else 'Kite Works LLC' end",
        "address": """case when k % 8 = 0 or (k % 8 = 6 and stored and row = 1) then null when k % 8 = 1 then concat(k, if(stored, ' Main Street', ' Main St.')) when k % 8 = 5 then concat(if(stored, row, 3), ' Oak Rd') else concat(k, ' Elm St') end""",
        "city": "concat('City', k)", "state": "'TX'", "zip": "'75001'", "country": "'United States'", "phone": "if(not stored and (k % 8 in (0, 7) or row = 2), '775-555-0100', null)", "email": "cast(null as string)",
        "location_code": "case when k % 8 = 0 then if(stored, concat('HW-', k), concat('hw ', k)) when k % 8 = 6 and (not stored or row = 1) then concat('X', k) end",
        "exit_reason": "cast(null as string)", "source_page": "3", "printed_page": "'3'", "source_exhibit": "'F-1'", "source_section": "'List'", "raw_source_text": "concat(if(stored, 'old', 'new'), ' text ', k, ' ', row)",
        "confidence": "if(k % 8 = 7 and stored, 0.4D, 0.9D)", "review_status": "if(k % 8 = 7 and stored, 'Approved', 'Needs review')", "review_reason": "'given'", "contacts": people, "id": "concat(k, '-', row)", "ordinal": "k * 2 + row",
    }
    both = both.withColumns({c: F.expr(v) for c, v in values.items()})
    return both.filter("not stored"), both.filter("stored")


def _reconciled_sql(cases):
    return f"""
    WITH c AS ({cases}),
         n AS (SELECT brand_key, count(*) FILTER (WHERE s IN (4, 5, 6)) AS n_added, count(*) FILTER (WHERE s IN (0, 1, 7)) AS n_matched, count(*) FILTER (WHERE s IN (0, 7)) AS n_updated, count(*) FILTER (WHERE s = 1) AS n_unchanged,
                      count(*) FILTER (WHERE s IN (5, 6)) AS n_ambiguous, count(*) FILTER (WHERE s = 2) AS n_removed FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE s NOT IN (2, 3)) > 0)
    SELECT brand_key, CASE WHEN s = 2 THEN 'deleted' WHEN s IN (0, 1, 7) THEN 'matched' ELSE 'added' END AS action, CASE WHEN s IN (0, 1, 2, 7) THEN k || '-1' END AS existing_id, CASE WHEN s <> 2 THEN s IN (0, 4, 7) END AS updated,
           CASE WHEN s <> 2 THEN 'Current' END AS status, CASE WHEN s = 1 THEN k || ' Main Street' WHEN s IN (4, 6, 7) THEN k || ' Elm St' WHEN s = 5 THEN '3 Oak Rd' END AS address, CASE WHEN s <> 2 THEN 'City' || k END AS city,
           CASE WHEN s IN (0, 4, 7) THEN '775-555-0100' END AS phone, CASE WHEN s = 0 THEN 'HW-' || k WHEN s = 6 THEN 'X' || k END AS location_code,
           CASE WHEN s <> 2 THEN 'new text ' || k || CASE WHEN s = 4 THEN ' 2' ELSE ' 1' END END AS raw_source_text, CASE WHEN s = 7 THEN 'Approved' WHEN s <> 2 THEN 'Needs review' END AS review_status,
           CASE s WHEN 2 THEN NULL WHEN 5 THEN '{P.AMBIGUOUS_ENTITY}' WHEN 6 THEN '{P.CONFLICTING_IDENTITY}' ELSE 'given' END AS review_reason, CAST(CASE WHEN s = 7 THEN 0.4 WHEN s <> 2 THEN 0.9 END AS DOUBLE) AS confidence,
           CASE WHEN s = 0 THEN '-/775-555-0100/-' WHEN s = 7 THEN 'Ann Gill/775-555-0100/-, Bo Hu/775-555-0100/-, Ann Gill/-/ann@x.example.com' WHEN s <> 2 THEN '' END AS people, n_added, n_matched, n_updated, n_unchanged, n_ambiguous, n_removed
    FROM c JOIN n USING (brand_key) WHERE s <> 3
"""


def _reconciled(rows, told=lambda counted: counted):
    """Results with the counts of their brand, which ``told`` may hint at how to join."""
    aside = Aside(rows.sparkSession)
    done = aside.save(reconcile.reconcile_brands(*_sides(rows), aside), "reconciled")
    counts = reconcile.brand_counts(done)
    people = F.array_join(F.transform("contacts", lambda p: F.concat_ws("/", *(F.coalesce(p[c], F.lit("-")) for c in ("raw_name", "phone", "email")))), ", ")
    columns = ("brand_key", "action", "existing_id", "updated", "status", "address", "city", "phone", "location_code", "raw_source_text", "review_status", "review_reason", "confidence")
    counted = counts.select("brand_key", *(F.col(f"counted.{c}").alias(f"n_{c}") for c in process.RECONCILED if c != "collapsed"))
    return done.withColumn("people", people).select(*columns, "people").join(told(counted), "brand_key")


@query(_reconciled_sql("SELECT c_custkey AS k, 'b' || (c_custkey // 20) AS brand_key, c_custkey % 8 AS s FROM customer"))
def reconcile_full(spark, d):
    """Candidates of each brand against its stored rows and contacts: filled by code, kept by address, repeated in a batch, shared entities, conflicts, reviewed rows, and rows that go."""
    return _reconciled(_rows(spark, d, brand_key="concat('b', k div 20)"))


@query(_reconciled_sql("SELECT o_orderkey AS k, 'all' AS brand_key, o_orderkey % 8 AS s FROM orders"))
def reconcile_one_brand(spark, d):
    """The same cases as one brand of all orders, which is split into groups that can't meet; its counts are one row."""
    return _reconciled(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("all").alias("brand_key")), F.broadcast)


_EXACT_SQL = """
    WITH k AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS incoming, CASE WHEN c_custkey % 12 < 2 THEN 'hw' || (c_custkey // 12) END AS code, CASE WHEN c_custkey % 5 < 3 THEN (c_custkey // 8) || ' main st|' || c_nationkey END AS address,
                      c_mktsegment || '|' || c_nationkey AS entity, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment || '|' || c_nationkey || '|' || (c_custkey // 100) END AS exact FROM customer),
         i AS (SELECT * FROM k WHERE incoming), s AS (SELECT * FROM k WHERE NOT incoming),
         n AS (SELECT i.id, (SELECT count(*) FROM s WHERE s.code = i.code) AS c, (SELECT min(id) FROM s WHERE s.code = i.code) AS ci, (SELECT count(*) FROM s WHERE s.address = i.address) AS a, (SELECT min(id) FROM s WHERE s.address = i.address) AS ai,
                      (SELECT count(*) FROM s WHERE s.exact = i.exact) AS x, (SELECT min(id) FROM s WHERE s.exact = i.exact) AS xi, (SELECT count(*) FROM s WHERE s.entity = i.entity) AS e, (SELECT min(id) FROM s WHERE s.entity = i.entity) AS ei FROM i),
         o AS (SELECT *, CASE WHEN c > 1 OR (c = 0 AND a > 1) OR (c = 0 AND a = 0 AND e > 1 AND x <> 1) THEN 'ambiguous' WHEN c = 1 AND (a > 1 OR (a = 1 AND ai <> ci)) THEN 'conflict'
                              WHEN c = 1 THEN 'code' WHEN a = 1 THEN 'address' WHEN x > 0 THEN 'exact' WHEN e = 1 THEN 'entity' ELSE 'new' END AS outcome FROM n)
    SELECT id, outcome, CASE outcome WHEN 'code' THEN ci WHEN 'address' THEN ai WHEN 'exact' THEN xi WHEN 'entity' THEN ei END AS matched FROM o
"""


@query(_EXACT_SQL)
def identity_match_exact(spark, d):
    """The cascade with all four keys: an equal row settles a shared entity."""
    rows = _rows(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey"), "k")
    whole = {
        "id": "k", "code": "if(k % 12 < 2, concat('hw', k div 12), null)", "address": "if(k % 5 < 3, concat(k div 8, ' main st|', c_nationkey), null)", "entity": "concat(c_mktsegment, '|', c_nationkey)",
        "exact": "if(k % 3 > 0, concat(c_mktsegment, '|', c_nationkey, '|', k div 100), null)",
    }
    keyed = rows.select("k", *(F.expr(v).alias(c) for c, v in whole.items()))
    return matching.cascade(keyed.filter("k % 2 = 0"), keyed.filter("k % 2 = 1"), "id", matching.ALL_KEYS).select("id", "outcome", "matched")


# ------------------------------------------------------------------ whole documents


def _store(spark) -> SnapshotStore:
    """A new store in the shared folder."""
    return SnapshotStore(spark, f"{shared_folder(spark)}/directory-{uuid.uuid4().hex}")


def _own():
    """A brand for each supplier: a file name gives its brand up to the first run of digits like a year, so letters stand for digits; with the key, no two share a brand."""
    return F.translate(F.concat("s_name", F.lit(" "), F.col("s_suppkey").cast("string")), "0123456789", "abcdefghij")


_PROSE = "transform(sequence(1, 9), i -> concat('This is line ', i, ' of the disclosure, long enough to count as text.'))"


def _glyphs(pages):
    """The words of pages (document_id, page, lines) at places in rows and columns; cells are parted by bars."""
    lines = pages.select("document_id", "page", F.posexplode("lines").alias("i", "line"))
    cells = lines.select("document_id", "page", "i", F.posexplode(F.split("line", " [|] ")).alias("j", "text"))
    return cells.select(
        "document_id", F.col("page").alias("pdf_page"), (F.col("i") * 16 + F.col("j")).cast("long").alias("ordinal"), "text", (36.0 + 125 * F.col("j")).alias("x"), (760.0 - 24 * F.col("i")).alias("y"),
        F.least(7 * F.length("text"), F.lit(100)).cast("double").alias("width"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
    )


@query(f"""
    WITH s AS (SELECT s_suppkey, s_name AS brand, s_suppkey % 5 > 0 AS ok, 1 + s_suppkey % 3 AS n FROM supplier)
    SELECT s_suppkey, brand, CASE WHEN ok THEN 'Ready' ELSE 'Failed' END AS processing_status, CASE WHEN ok THEN n END AS accepted, CASE WHEN ok THEN 'F-1' END AS source_exhibit, CASE WHEN ok THEN 'Complete' ELSE 'Failed' END AS stage,
           CASE WHEN ok THEN n || ' locations normalized from 1 verified source pages. ' || n || ' added, 0 updated, 0 unchanged. 0 duplicates removed. coverage checks passed'
                ELSE 'No validated Item 20 franchisee list or franchisee exhibit was found; existing location data was preserved' END AS message, CASE WHEN ok THEN n ELSE 0 END AS locations,
           CASE WHEN ok THEN n ELSE 0 END AS contacts, CASE WHEN ok THEN '2' END AS pages, CASE WHEN ok THEN 'Auto-verified' END AS reviews FROM s
""")
def process_commit(spark, d):
    """Uploads registered, laid out, extracted, gated, reconciled and committed; a document without lists fails and leaves the others alone."""
    store = _store(spark)
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_name", _own().alias("own")).withColumn("filename", F.concat("own", F.lit("_2023.pdf")))
    Workspace(store).register(suppliers.select("filename", F.concat(F.lit("/objects/"), "filename").alias("object_path")))
    ids = store.read("documents").select("filename", F.col("id").alias("document_id"))
    rows = "transform(sequence(1, cast(1 + s_suppkey % 3 as int)), i -> concat('Kite ', i, ' LLC | ', i, ' Elm St | Reno | NV | 89501 775-555-010', i))"
    text = f"if(page = 1, concat({_PROSE}, array('1')), if(s_suppkey % 5 = 0, array('Nothing is listed', '2'), concat(array('EXHIBIT F-1', 'LIST OF CURRENT FRANCHISEES'), {rows}, array('2'))))"
    lines = suppliers.join(ids, "filename").withColumn("page", F.explode(F.array(F.lit(1), F.lit(2)))).select("document_id", "page", F.expr(text).alias("lines"))
    process.process_documents(store, _glyphs(lines))
    documents, stages, locations, contacts = (store.read(t) for t in ("documents", "stages", "locations", "contacts"))
    rows = locations.groupBy("document_id").agg(F.count(F.lit(1)).alias("locations"), F.array_join(F.array_sort(F.collect_set("printed_page")), ",").alias("pages"), F.array_join(F.array_sort(F.collect_set("review_status")), ",").alias("reviews"))
    people = contacts.join(locations.select(F.col("id").alias("location_id"), "document_id"), "location_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("contacts"))
    ends = stages.filter(F.col("stage") == process.STAGE).select("document_id", F.col("status").alias("stage"), "message")
    whole = suppliers.join(documents, "filename").withColumnRenamed("id", "document_id")
    for part in (rows, people, ends):
        whole = whole.join(part.hint(SHUFFLED), "document_id", "left")
    none = F.lit(0).cast("long")
    named = F.when(F.col("franchise_name") == F.col("own"), F.col("s_name")).otherwise(F.col("franchise_name"))
    return whole.select("s_suppkey", named.alias("brand"), "processing_status", F.col("extraction_manifest.acceptedRows").alias("accepted"), "source_exhibit", "stage", "message", F.coalesce("locations", none).alias("locations"), F.coalesce("contacts", none).alias("contacts"), "pages", "reviews")


@query("""
    WITH p AS (SELECT c_custkey AS k, page FROM customer, range(1, 7) r(page) WHERE page <= 1 + c_custkey % 6)
    SELECT k, page, CASE WHEN page > 4 THEN 'budget' WHEN page = 1 + k % 5 AND k % 2 = 0 THEN 'page ' || page || ' of ' || k || ' is torn' WHEN page = 1 + k % 5 THEN 'empty' END AS problem,
           CASE WHEN page <= 4 AND page <> 1 + k % 5 THEN round((k % 50 + 50) / 100.0, 6) END AS confidence, CASE WHEN page <= 4 AND page <> 1 + k % 5 THEN k || ' Elm St' END AS text FROM p
""")
def recognition_budget(spark, d):
    """Pages recognised within a document's time: a deadline after four pages, pages that fail, and pages without words."""
    rows = _rows(spark, d).select(F.col("k").cast("string").alias("document_id"), F.encode(F.col("k").cast("string"), "UTF-8").alias("content"), F.col("k"))
    needed = rows.select("document_id", F.explode(F.expr("sequence(1, cast(1 + k % 6 as int))")).alias("pdf_page"))
    ticks = [0]

    def clock():
        ticks[0] += 125
        return ticks[0]

    def recogniser(content, page):
        k = int(content)
        if page == 1 + k % 5:
            if k % 2 == 0:
                raise ValueError(f"page {page} of {k} is torn")
            return "level\tpage"
        word = lambda n, text: f"5\t1\t1\t1\t1\t{n}\t{36 * n}\t60\t30\t20\t{k % 50 + 50}\t{text}"
        return "\n".join(["level\tpage", "1\t1\t0\t0\t0\t0\t0\t0\t1200\t1600\t-1\t", word(1, k), word(2, "Elm"), word(3, "St")])

    found = recognition.read_pages(recognition.recognise(rows, needed, recogniser, clock))
    return found.select(F.col("document_id").cast("long").alias("k"), F.col("pdf_page").cast("long").alias("page"), "problem", F.round("ocr_confidence", 6).alias("confidence"), ocr_tsv.text_of("words").alias("text"))


_KEPT = "; existing location data was preserved"
_NORMALIZED = "' locations normalized from 1 verified source pages. '"


@query(f"""
    WITH s AS (SELECT s_suppkey AS k, s_name AS brand, s_suppkey % 8 AS c FROM supplier),
         d AS (SELECT k, c, brand || '_2022.pdf' AS filename, c IN (2, 3, 4, 6) AS failed, CASE WHEN c = 4 THEN 20 ELSE 3 END AS locations FROM s
               UNION ALL SELECT k, 8, brand || '_2021.pdf', false, 0 FROM s WHERE c = 5)
    SELECT k AS s_suppkey, filename, CASE WHEN failed THEN 'Failed' WHEN c = 8 THEN 'Superseded' ELSE 'Ready' END AS processing_status, CASE WHEN failed THEN 'Failed' WHEN c = 8 THEN 'Skipped' ELSE 'Complete' END AS stage,
           CASE c WHEN 0 THEN '3' || {_NORMALIZED} || '0 added, 0 updated, 3 unchanged. 0 duplicates removed. coverage checks passed'
                  WHEN 1 THEN '3' || {_NORMALIZED} || '1 added, 0 updated, 2 unchanged. 0 duplicates removed. 1 stale rows from the replaced extraction were removed'
                  WHEN 2 THEN 'OCR quality was too low on source page 2 to replace the previously stored location data{_KEPT}' WHEN 3 THEN 'OCR did not complete on source page 2{_KEPT}'
                  WHEN 4 THEN 'Extraction produced 10 rows versus 20 previously stored rows{_KEPT}' WHEN 5 THEN '3' || {_NORMALIZED} || '3 added, 0 updated, 0 unchanged. 0 duplicates removed. coverage checks passed' WHEN 6 THEN 'no page tree'
                  WHEN 7 THEN '3' || {_NORMALIZED} || '0 added, 0 updated, 3 unchanged. 0 duplicates removed. OCR used on 1 page; Average OCR confidence was 65%; extracted rows require review; OCR quality is low; verify extracted rows against the source document'
                  ELSE 'A newer verified FDD (' || replace(filename, '_2021', '_2022') || ') already supplies this franchisor''s evidence' END AS message,
           CAST(locations AS BIGINT) AS locations, CASE WHEN c = 8 THEN NULL WHEN c = 7 THEN 'Needs review' ELSE 'Auto-verified' END AS reviews,
           CASE WHEN c = 8 THEN NULL WHEN c = 1 THEN '2,3,4' WHEN c = 4 THEN '1,10,11,12,13,14,15,16,17,18,19,2,20,3,4,5,6,7,8,9' ELSE '1,2,3' END AS streets FROM d
""")
def process_gates(spark, d):
    """A second run over stored rows: unchanged and replaced rows, weak and incomplete recognition, too few rows, a newer document of the brand, an unreadable file, and warnings in order."""
    store = _store(spark)
    workspace = Workspace(store)
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 8).alias("c"), "s_name", _own().alias("own"))
    files = suppliers.withColumn("year", F.explode(F.expr("if(c = 5, array('2021', '2022'), array('2022'))"))).withColumn("filename", F.concat("own", F.lit("_"), "year", F.lit(".pdf")))
    path = lambda turn: F.concat(F.lit(f"/objects/{turn}/"), "filename").alias("object_path")
    for year in ("2021", "2022"):
        workspace.register(files.filter(F.col("year") == year).select("filename", path(1)))
    known = store.aside(files.join(store.read("documents").select("filename", F.col("id").alias("document_id")), "filename"), f"known-{uuid.uuid4().hex}")
    row = "concat('Kite ', i, ' LLC | ', i, ' Elm St | Reno | NV | 89501 775-555-01', lpad(i, 2, '0'))"

    def pages(documents, first, last):
        listed = f"concat(array('EXHIBIT F-1', 'LIST OF CURRENT FRANCHISEES'), transform(sequence({first}, {last}), i -> {row}), array('2'))"
        both = documents.withColumn("page", F.explode(F.array(F.lit(1), F.lit(2))))
        return _glyphs(both.select("document_id", "page", F.expr(f"if(page = 1, concat({_PROSE}, array('1')), {listed})").alias("lines")))

    process.process_documents(store, pages(known.filter("year = '2022'"), "1", "if(c = 4, 20, 3)"))
    workspace.register(known.filter("c <> 5").select("filename", path(2)))
    workspace.rerun(known.filter("year = '2021'").select(F.col("document_id").alias("id")))
    again = pages(known.filter("c <> 6 AND (c <> 5 OR year = '2021')"), "if(c = 1, 2, 1)", "case c when 1 then 4 when 4 then 10 else 3 end")
    blank = (F.lit(None).cast(again.schema[c].dataType).alias(c) for c in again.columns if c not in ("document_id", "text"))
    unread = known.filter("c = 6").select("document_id", F.lit("no page tree").alias("text"), *blank)
    scans = known.filter("c IN (2, 3, 7)").select("document_id", F.lit(2).alias("pdf_page"), F.expr("case c when 2 then 0.41D when 7 then 0.65D end").alias("ocr_confidence"), F.expr("if(c = 3, 'render timed out', null)").alias("problem"))
    process.process_documents(store, again.unionByName(unread), scans=scans)

    ends = workspace.latest_stages().select("document_id", F.col("status").alias("stage"), "message")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    rows = store.read("locations").groupBy("document_id").agg(F.count(F.lit(1)).alias("locations"), joined(F.col("review_status")).alias("reviews"), joined(F.split("address", " ")[0]).alias("streets"))
    whole = known.join(store.read("documents").select(F.col("id").alias("document_id"), "processing_status"), "document_id").join(ends, "document_id").join(rows, "document_id", "left")
    # the supplier's name stands only where the message holds the file name that was given
    newer, named = (F.concat(F.lit("("), name, F.lit("_2022.pdf)")) for name in ("own", "s_name"))
    message = F.when(F.contains("message", newer), F.replace("message", newer, named)).otherwise(F.col("message"))
    filename = F.concat("s_name", F.lit("_"), "year", F.lit(".pdf"))
    return whole.select(F.col("k").alias("s_suppkey"), filename.alias("filename"), "processing_status", "stage", message.alias("message"), F.coalesce("locations", F.lit(0).cast("long")).alias("locations"), "reviews", "streets")
