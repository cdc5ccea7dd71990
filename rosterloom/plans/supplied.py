"""Each operator as a query over the supplied tables, with DuckDB SQL of the same result.

The supplied tables stand in for the directory's own: customers for locations,
orders for documents, events for stages, and so on.  Every column is named, every
count is a long, and every limited sort is total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fields, text
from ..functions import patterns as P
from ..operators import directory, grams, layout, matching
from ..session import Aside, table
from ..sources.documents import characters
from .catalog import catalog

QUERIES, ORACLE_SQL, query = catalog()


def _customers(spark, d):
    """Customers as stored locations."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations, a fixed table


# ------------------------------------------------------------------ aggregates and lists


@query("""
    SELECT count(DISTINCT o_orderkey) AS documents, count(l_orderkey) FILTER (WHERE v) AS total, count(l_orderkey) FILTER (WHERE v AND l_returnflag = 'N') AS current_rows,
           count(l_orderkey) FILTER (WHERE v AND l_returnflag = 'R') AS former_rows, count(l_orderkey) FILTER (WHERE v AND l_returnflag = 'A') AS planning_rows,
           count(l_orderkey) FILTER (WHERE v AND l_linestatus = 'O') AS needs_review
    FROM (SELECT *, o_orderstatus IN ('F', 'O') AS v FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)
""")
def workspace_stats(spark, d):
    """Distinct parents and filtered counts of children of visible parents, over a left join."""
    o, li = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return directory.workspace_counts(
        o, li, o.o_orderkey, li.l_orderkey, o.o_orderstatus.isin("F", "O"),
        {"total": F.lit(True), "current_rows": F.col("l_returnflag") == "N", "former_rows": F.col("l_returnflag") == "R", "planning_rows": F.col("l_returnflag") == "A", "needs_review": F.col("l_linestatus") == "O"},
    )


@query("SELECT c_custkey, o_orderstatus AS status, count(*) AS n_rows FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def status_counts_by_parent(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    counts = o.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))
    return c.join(counts, c.c_custkey == counts.o_custkey).select("c_custkey", F.col("o_orderstatus").alias("status"), "n_rows")


@query("""
    SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%re%' OR p_brand ILIKE '%re%' OR p_type ILIKE '%re%'
    ORDER BY p_brand ASC NULLS LAST, p_type ASC NULLS LAST, p_name ASC NULLS LAST, p_partkey LIMIT 100 OFFSET 20
""")
def search_ilike_any(spark, d):
    """Free text over several columns, one page of a total order."""
    found = table(spark, d, "part").filter(grams.matches_any("re", ["p_name", "p_brand", "p_type"]))
    return directory.page(found, ["p_brand", "p_type", "p_name"], "p_partkey", 100, 20).select("p_partkey", "p_name", "p_brand", "p_type")


_SOUGHT = ("red w", "ZE", "g%t", "l_e", "#2", "%", "_", "nothing like it")


@query(f"""
    SELECT q.term, p_partkey, p_name, p_brand FROM part JOIN (VALUES {", ".join(f"('{x}')" for x in _SOUGHT)}) q(term) ON p_name ILIKE '%' || q.term || '%' OR p_brand ILIKE '%' || q.term || '%'
""")
def search_postings(spark, d):
    """Free text by postings of three letters: terms of one letter to many, with wildcards, of wildcards only, and without a match."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    posted = Aside(spark).save(grams.postings(part, "p_partkey", ["p_name", "p_brand"]).sort("gram"), "postings")

    def found(term):
        keys = grams.candidates(posted, "p_partkey", term)
        rows = part if keys is None else part.join(keys, "p_partkey", "left_semi")
        return rows.filter(grams.matches_any(term, ["p_name", "p_brand"])).select(F.lit(term).alias("term"), *part.columns)

    return reduce(lambda a, b: a.unionByName(b), map(found, _SOUGHT))


_PATTERNS = """CASE p_partkey % 8 WHEN 0 THEN upper(p_name) || ' ' || p_partkey WHEN 1 THEN '_' || substr(p_name, 2) || ' ' || p_partkey WHEN 2 THEN substr(p_name, 1, 2) || '%' || p_partkey WHEN 3 THEN '% ' || p_partkey
               WHEN 4 THEN p_name || ' ' || p_partkey || '_' WHEN 5 THEN '%g_%' || p_partkey || '%' WHEN 6 THEN p_name || ' ' || p_partkey || '%' ELSE '%Z% ' || p_partkey END"""


@query(f"SELECT k.p_partkey AS key_of, k.pattern, n.p_partkey AS name_of, n.name FROM (SELECT p_partkey, {_PATTERNS} AS pattern FROM part) k JOIN (SELECT p_partkey, p_name || ' ' || p_partkey AS name FROM part) n ON n.name ILIKE k.pattern")
def wildcard_keys(spark, d):
    """Names found by keys that hold ``%`` and ``_``, through postings of their rarest letters."""
    part = table(spark, d, "part").select("p_partkey", "p_name")
    keys = part.select(F.col("p_partkey").alias("key_of"), F.expr(_PATTERNS).alias("pattern"))
    names = part.select(F.col("p_partkey").alias("name_of"), F.expr("p_name || ' ' || p_partkey").alias("name"))
    pairs = grams.ilike_join(names.select(F.col("name").alias("value")), keys).withColumnRenamed("value", "name")
    # no broadcast: repeated names make small files, so that whole tables would pass through the driver
    return keys.hint("merge").join(pairs, "pattern").hint("merge").join(names, "name").select("key_of", "pattern", "name_of", "name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def search_visible_only(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return li.filter("l_returnflag = 'R'").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)")
def search_pinned_parent(spark, d):
    """A pinned parent skips the visibility test."""
    li = table(spark, d, "lineitem")
    pinned = li.agg(F.min("l_orderkey")).first()[0]
    return directory.restrict(li, {"l_orderkey": pinned}, visible=None).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
    SELECT o_orderkey, o_orderdate, o_orderstatus, count(l_orderkey) AS location_count, coalesce(sum(l_quantity), 0) AS quantity
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3 ORDER BY o_orderdate DESC, o_orderkey
""")
def document_list_recent(spark, d):
    """All parents, the most recent first, with counts of their children."""
    return document_list(spark, d)


@query("""
    SELECT o_orderkey, o_orderdate, o_orderstatus, count(l_orderkey) AS location_count, coalesce(sum(l_quantity), 0) AS quantity
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3 ORDER BY o_orderdate DESC, o_orderkey
""")
def document_list(spark, d):
    """All parents, newest first, with counts of their children."""
    o, li = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), table(spark, d, "lineitem")
    counts = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    counted = o.join(counts, "o_orderkey", "left").select("o_orderkey", "o_orderdate", "o_orderstatus", F.coalesce("n", F.lit(0)).cast("long").alias("location_count"), F.coalesce("q", F.lit(0.0)).alias("quantity"))
    return counted.orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("SELECT DISTINCT p_brand AS facet FROM part WHERE p_brand <> '' ORDER BY facet")
def facet_distinct_sorted(spark, d):
    return directory.facet(table(spark, d, "part"), "p_brand")


@query("""
    SELECT c_custkey, c_name, n_name AS source_document, count(o_orderkey) AS n_children, min(o_orderkey) AS first_child, max(o_orderkey) AS last_child
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3
""")
def detail_with_children(spark, d):
    """A row with its source and its children nested; flattened here for comparison."""
    children = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    nested = directory.with_children(_customers(spark, d), children, "c_custkey", "children")
    return nested.select("c_custkey", "c_name", F.col("n_name").alias("source_document"), F.size("children").cast("long").alias("n_children"), F.array_min(F.col("children.o_orderkey")).alias("first_child"), F.array_max(F.col("children.o_orderkey")).alias("last_child"))


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_stage(spark, d):
    return directory.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "ts")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), lower('The')) OR contains(lower(source), lower('SRC1'))")
def client_substring_filter(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(directory.contains_any("The", ["text"]) | directory.contains_any("SRC1", ["source"])).select("doc_id", "source")


# ------------------------------------------------------------------ changes to stored rows


@query("""
    SELECT c_custkey, coalesce(nullif(CASE WHEN c_mktsegment = 'BUILDING' THEN '' WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END, ''), n_name) AS franchisor
    FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def backfill_update_from(spark, d):
    """Empty or missing values filled from a joined parent."""
    stored = _customers(spark, d).withColumn("value", F.when(F.col("c_mktsegment") == "BUILDING", "").when(F.col("c_mktsegment") == "MACHINERY", None).otherwise(F.col("c_mktsegment")))
    return directory.backfill(stored, "value", "n_name", "franchisor").select("c_custkey", "franchisor")


@query("""
    SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'patched' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier
""")
def sparse_patch(spark, d):
    """Only present fields overwrite, an explicit null included."""
    s = table(spark, d, "supplier")
    patches = s.filter("s_suppkey % 5 = 0 or s_suppkey % 7 = 0").select(
        "s_suppkey",
        F.expr("filter(array(if(s_suppkey % 5 = 0, 's_name', null), if(s_suppkey % 7 = 0, 's_acctbal', null)), x -> x is not null)").alias("present"),
        F.lit("patched").alias("s_name"), F.lit(None).cast("double").alias("s_acctbal"),
    )
    return directory.patch_rows(s, patches, "s_suppkey", ["s_name", "s_acctbal"]).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def stale_rows_anti(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti")


@query("""
    WITH old AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1), new AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY 1)
    SELECT coalesce(new.user_id, old.user_id) AS user_id, coalesce(new.event_id, old.event_id) AS event_id,
           CASE WHEN old.user_id IS NULL THEN 'inserted' WHEN new.user_id IS NULL THEN 'kept' ELSE 'updated' END AS action
    FROM old FULL JOIN new ON old.user_id = new.user_id
""")
def upsert_latest_wins(spark, d):
    """A merge by natural key: incoming rows replace stored ones, others are inserted."""
    newest = lambda df: df.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    e = table(spark, d, "events")
    return directory.upsert(newest(e.filter("event_id % 2 = 0")), newest(e.filter("event_id % 2 = 1")), "user_id", ["event_id"])


@query("SELECT o_orderkey, o_custkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN o_orderstatus ELSE 'Superseded' END AS status FROM orders")
def supersede_older(spark, d):
    o = table(spark, d, "orders")
    return directory.supersede(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))


# ------------------------------------------------------------------ text


@query("""
    SELECT doc_id, CAST(i AS BIGINT) AS line_no, l[i] AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l, unnest(generate_series(1, len(regexp_split_to_array(text, '\\r?\\n')))) AS i FROM documents)
""")
def line_explode(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    return lines.select("doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), "line")


@query("""
    SELECT lang, CAST(sum(len(regexp_extract_all(text, '(?i)[0-9]{3}[-.)\\s]+[0-9]{3}[-.\\s]+[0-9]{4}|@[A-Z0-9.-]+\\.[A-Z]{2,}'))) AS BIGINT) AS evidence FROM documents GROUP BY 1
""")
def evidence_count(spark, d):
    """Contact marks in texts, without overlap."""
    marks = F.regexp_count("text", F.lit(rf"(?i)[0-9]{{3}}[-.){P.SPACE}]+[0-9]{{3}}[-.{P.SPACE}]+[0-9]{{4}}|@[A-Z0-9.-]+\.[A-Z]{{2,}}"))
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(marks).alias("evidence"))


@query("""
    SELECT source, CAST(count(*) AS BIGINT) AS n_pages, CAST(sum(length(regexp_replace(text, '\\s', '', 'g'))) AS BIGINT) AS chars,
           sum(length(regexp_replace(text, '\\s', '', 'g'))) >= least(500, 20 * count(*)) AS enough FROM documents GROUP BY 1
""")
def text_density_gate(spark, d):
    """Whether a document's pages hold enough text."""
    chars = F.sum(characters(F.col("text")))
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), chars.alias("chars")).withColumn("enough", F.col("chars") >= F.least(F.lit(500), 20 * F.col("n_pages")))


_TEXTS_SQL = "(SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '/' || turn, text FROM conversations)"


def _texts(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return docs.unionByName(table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("id"), "text"))


@query(f"""
    SELECT * FROM (SELECT id, nullif(regexp_extract(text, '(^|[^0-9])((?:\\+?1[-.\\s]?)?\\(?[0-9]{{3}}\\)?[-.\\s][0-9]{{3}}[-.\\s][0-9]{{4}})([^0-9]|$)', 2), '') AS phone FROM {_TEXTS_SQL}) WHERE phone IS NOT NULL
""")
def phone_extract(spark, d):
    return _texts(spark, d).select("id", text.find(F.col("text"), P.PHONE).alias("phone")).filter("phone is not null")


@query(f"""
    SELECT * FROM (SELECT id, nullif(regexp_extract(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}\\b', 0), '') AS email FROM {_TEXTS_SQL}) WHERE email IS NOT NULL
""")
def email_extract(spark, d):
    return _texts(spark, d).select("id", F.when(F.contains("text", F.lit("@")), text.find(F.col("text"), P.EMAIL)).alias("email")).filter("email is not null")


@query("""
    SELECT doc_id, TRY_CAST(list_last(regexp_extract_all(array_to_string(l[greatest(len(l) - 5, 1):len(l)], ' '), '([0-9]{1,4})\\b', 1)) AS INTEGER) AS label
    FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents)
""")
def footer_label(spark, d):
    """The last number in a page's last six lines."""
    return table(spark, d, "documents").select("doc_id", fields.footer_label(F.col("text")).alias("label"))


@query("""
    SELECT page_id, TRY_CAST(nullif(regexp_extract(name, '20[0-9]{2}', 0), '') AS INTEGER) AS year,
           CASE WHEN cut = '' THEN 'Uploaded FDD' ELSE cut END AS title
    FROM (SELECT page_id, name, trim(regexp_replace(regexp_replace(regexp_replace(name, '[-_]', ' ', 'g'), '(?s)20[0-9]{2}.*$', ''), '(?i)\\.pdf$', '')) AS cut
          FROM (SELECT page_id, regexp_extract(url, '[^/]*$', 0) || CASE WHEN page_id % 2 = 0 THEN '_2023-final.pdf' ELSE '.PDF' END AS name FROM pages))
""")
def filename_parse(spark, d):
    """Name and year of an upload from its file name."""
    name = F.concat(F.regexp_extract("url", r"[^/]*$", 0), F.when(F.col("page_id") % 2 == 0, "_2023-final.pdf").otherwise(".PDF"))
    return table(spark, d, "pages").select("page_id", fields.upload_year(name).alias("year"), fields.upload_name(name).alias("title"))


_IDENTITY_SQL = "trim(regexp_replace(replace(lower(strip_accents({0})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT key, min(doc_id) AS kept_id, count(*) - 1 AS duplicates FROM (SELECT doc_id, md5({_IDENTITY_SQL.format('text')}) AS key FROM documents) GROUP BY 1")
def identity_key_dedup(spark, d):
    """First row of each normalised text, and how many more there are."""
    keyed = table(spark, d, "documents").select("doc_id", F.md5(text.identity_col(F.col("text"))).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("kept_id"), (F.count(F.lit(1)) - 1).alias("duplicates"))


@query("""
    SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(p_name || ' Street, North Suite 4'), '[^a-z0-9]+', ' ', 'g')), '\\b(street|str)\\b', 'st', 'g'), '\\b(suite|ste)\\b', 'ste', 'g'), '\\bnorth\\b', 'n', 'g') AS address FROM part
""")
def address_abbrev(spark, d):
    name = F.concat("p_name", F.lit(" Street, North Suite 4"))
    return table(spark, d, "part").select("p_partkey", text.abbreviate_col(text.identity_col(name, accents=False)).alias("address"))


# ------------------------------------------------------------------ scores, reviews and merges

_CANDIDATE_SQL = """
    (SELECT *, regexp_matches(address, '^[0-9]+\\s+\\S+') AS f_address, regexp_matches(state, '^[A-Z]{2}$') AS f_geo, regexp_matches(zip, '^[0-9]{5}$') AS f_zip, coalesce(entity <> '' AND entity <> 'n/a', false) AS f_entity, phone IS NOT NULL AS f_contact
     FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Address not disclosed' ELSE c_custkey || ' Main St' END AS address, n_name AS city, CASE WHEN c_custkey % 5 = 0 THEN 'Texas' ELSE 'TX' END AS state,
                  CASE WHEN c_custkey % 7 = 0 THEN '123' ELSE '75001' END AS zip, CASE WHEN c_custkey % 4 = 0 THEN 'n/a' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS entity,
                  CASE WHEN c_custkey % 2 = 0 THEN '214-555-0100' END AS phone, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey))
"""
_SCORE_SQL = """
    round(greatest(0.05, least(0.95, least(CASE WHEN f_address THEN 1.0 ELSE 0.58 END, CASE WHEN f_entity THEN 1.0 ELSE 0.68 END,
        CAST(0.15 AS DOUBLE) + CASE WHEN f_address THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN f_geo THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN f_zip THEN CAST(0.1 AS DOUBLE) ELSE 0 END
        + CASE WHEN f_entity THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN f_contact THEN CAST(0.05 AS DOUBLE) ELSE 0 END + CAST(0.05 AS DOUBLE)))), 3)
"""


def _candidates(spark, d):
    k = F.col("c_custkey")
    return _customers(spark, d).select(
        k,
        F.when(k % 3 == 0, P.NO_ADDRESS).otherwise(F.concat(k.cast("string"), F.lit(" Main St"))).alias("address"), F.col("n_name").alias("city"), F.when(k % 5 == 0, "Texas").otherwise("TX").alias("state"),
        F.when(k % 7 == 0, "123").otherwise("75001").alias("zip"), F.when(k % 4 == 0, "n/a").when(k % 11 == 0, None).otherwise(F.col("c_name")).alias("franchisee_entity"),
        F.when(k % 2 == 0, "214-555-0100").alias("phone"), F.lit(None).cast("string").alias("email"), F.lit("List").alias("source_section"), F.lit(None).cast("string").alias("source_exhibit"), "c_acctbal",
    )


@query(f"SELECT c_custkey, CAST({_SCORE_SQL} AS DOUBLE) AS confidence FROM {_CANDIDATE_SQL}")
def score_ladder(spark, d):
    return _candidates(spark, d).select("c_custkey", fields.score(fields.evidence()).alias("confidence"))


@query(f"""
    SELECT c_custkey, CASE WHEN notes = '' AND NOT scanned THEN 'Auto-verified' ELSE 'Needs review' END AS review_status,
           CASE WHEN notes <> '' THEN notes WHEN scanned THEN '{P.NOTE_OCR}' ELSE '{P.NOTE_VERIFIED}' END || CASE WHEN scanned THEN '; OCR confidence 88%' ELSE '' END AS review_reason,
           CAST(CASE WHEN scanned THEN round({_SCORE_SQL} * 0.88, 3) ELSE {_SCORE_SQL} END AS DOUBLE) AS confidence
    FROM (SELECT *, c_acctbal < 0 AS scanned, concat_ws('; ', CASE WHEN NOT f_address THEN '{P.ISSUE_ADDRESS}' END, CASE WHEN NOT f_geo THEN '{P.ISSUE_GEO}' END, CASE WHEN NOT f_entity THEN '{P.ISSUE_ENTITY}' END,
                  CASE WHEN NOT f_zip AND f_address THEN '{P.ISSUE_ZIP}' END) AS notes FROM {_CANDIDATE_SQL})
""")
def review_decision(spark, d):
    rows = _candidates(spark, d).withColumn("page_ocr", F.col("c_acctbal") < 0).withColumn("page_ocr_confidence", F.when(F.col("page_ocr"), F.lit(0.88)))
    return fields.review(rows).select("c_custkey", "review_status", "review_reason", "confidence")


@query("""
    WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN '555-0100' ELSE '214-555-0100' END AS phone, s_name AS entity FROM supplier),
         c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '972-555-0199' ELSE 'n/a' END AS phone, c_name || ' LLC' AS entity FROM customer)
    SELECT s.k, CASE WHEN s.phone = '' THEN CASE WHEN c.phone <> 'n/a' THEN c.phone ELSE s.phone END WHEN s.phone = '555-0100' AND c.phone <> 'n/a' THEN c.phone ELSE s.phone END AS phone, c.entity AS entity FROM s JOIN c ON s.k = c.k
""")
def field_quality_merge(spark, d):
    """The better formed value of each field of matched rows."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.expr("case s_suppkey % 3 when 0 then '' when 1 then '555-0100' else '214-555-0100' end").alias("phone"), F.col("s_name").alias("franchisee_entity"), F.lit(0.8).alias("confidence"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr("if(c_custkey % 2 = 0, '972-555-0199', 'n/a')").alias("phone"), F.concat("c_name", F.lit(" LLC")).alias("franchisee_entity"), F.lit(0.8).alias("confidence"))
    return matching.merge_fields(s, c, "k", ["phone", "franchisee_entity"]).select("k", "phone", F.col("franchisee_entity").alias("entity"))


_CASCADE_SQL = """
    WITH k AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS incoming, CASE WHEN c_custkey % 6 < 2 THEN 'hw' || (c_custkey // 6) END AS code, (c_custkey // 8) || ' main st|' || c_nationkey AS address, c_mktsegment || '|' || c_nationkey AS entity FROM customer),
    i AS (SELECT * FROM k WHERE incoming), s AS (SELECT * FROM k WHERE NOT incoming),
    n AS (SELECT i.id, (SELECT count(*) FROM s WHERE s.code = i.code) AS c, (SELECT min(id) FROM s WHERE s.code = i.code) AS ci, (SELECT count(*) FROM s WHERE s.address = i.address) AS a, (SELECT min(id) FROM s WHERE s.address = i.address) AS ai,
                 (SELECT count(*) FROM s WHERE s.entity = i.entity) AS e, (SELECT min(id) FROM s WHERE s.entity = i.entity) AS ei FROM i)
    SELECT id, CASE WHEN c > 1 THEN 'ambiguous' WHEN c = 0 AND a > 1 THEN 'ambiguous' WHEN c = 0 AND a = 0 AND e > 1 THEN 'ambiguous' WHEN c = 1 AND (a > 1 OR (a = 1 AND ai <> ci)) THEN 'conflict'
                    WHEN c = 1 THEN 'code' WHEN a = 1 THEN 'address' WHEN e = 1 THEN 'entity' ELSE 'new' END AS outcome,
               CASE WHEN c > 1 OR (c = 0 AND a > 1) OR (c = 0 AND a = 0 AND e > 1) OR (c = 1 AND (a > 1 OR (a = 1 AND ai <> ci))) THEN NULL WHEN c = 1 THEN ci WHEN a = 1 THEN ai WHEN e = 1 THEN ei END AS matched FROM n
"""


@query(_CASCADE_SQL)
def identity_match_cascade(spark, d):
    """Matches by code, then address, then entity, with ambiguities, in set form."""
    k = F.col("c_custkey")
    keyed = table(spark, d, "customer").select(
        k.alias("id"), (k % 2 == 0).alias("incoming"), F.when(k % 6 < 2, F.concat(F.lit("hw"), F.floor(k / 6).cast("string"))).alias("code"),
        F.concat(F.floor(k / 8).cast("string"), F.lit(" main st|"), F.col("c_nationkey").cast("string")).alias("address"), F.concat("c_mktsegment", F.lit("|"), F.col("c_nationkey").cast("string")).alias("entity"),
    )
    return matching.cascade(keyed.filter("incoming"), keyed.filter("not incoming"), "id").select("id", "outcome", "matched")


# ------------------------------------------------------------------ windows


@query("""
    WITH e AS (SELECT user_id, event_id, epoch_ms(ts) / 1000.0 AS x, value AS w FROM events),
         g AS (SELECT *, x - max(x + w) OVER (PARTITION BY user_id ORDER BY x, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 18 AS fresh FROM e),
         c AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY x, event_id) AS cell FROM g)
    SELECT user_id, CAST(cell AS BIGINT) AS cell, string_agg(event_id, ' ' ORDER BY x, event_id) AS words FROM c GROUP BY 1, 2
""")
def gap_cell_merge(spark, d):
    """Items of a row merged into cells at gaps beyond the right edge so far."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0).alias("x"), F.col("value").alias("width"), F.col("event_id").cast("string").alias("word"))
    return layout.merge_cells(e, ["user_id"], "event_id").select("user_id", "cell", F.col("text").alias("words"))


@query("""
    SELECT event_id, user_id, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Current') AS status
    FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'Former' WHEN 'signup' THEN 'Planning' END AS s FROM events)
""")
def carry_forward_status(spark, d):
    e = table(spark, d, "events").withColumn("set_status", F.when(F.col("event_type") == "purchase", "Former").when(F.col("event_type") == "signup", "Planning"))
    return layout.carry_forward(e, ["user_id"], ["ts", "event_id"], "set_status", F.lit("Current"), "status").select("event_id", "user_id", "status")


@query("""
    SELECT r.section, e.event_id FROM (SELECT event_id AS section, event_id AS first_page, event_id + 1 + event_id % 3 AS last_page FROM events) r JOIN events e ON e.event_id BETWEEN r.first_page AND r.last_page
""")
def range_join_pages(spark, d):
    """Pages in section ranges: ranges become page lists, and the join an equality."""
    e = table(spark, d, "events").select("event_id")
    ranges = e.select(F.col("event_id").alias("section"), F.col("event_id").alias("first_page"), (F.col("event_id") + 1 + F.col("event_id") % 3).alias("last_page"))
    return layout.pages_in_ranges(ranges, e, "first_page", "last_page", "event_id").select("section", "event_id")


@query("""
    SELECT r.section, e.event_id FROM (SELECT event_id AS section, event_id AS first_page, event_id + 1 + event_id % 3 AS last_page FROM events) r JOIN events e ON e.event_id BETWEEN r.first_page AND r.last_page
""")
def range_join_all_pages(spark, d):
    """The same ranges, one from every event, so that they overlap."""
    return range_join_pages(spark, d)


@query("""
    SELECT event_id, user_id, (SELECT min(n.event_id) FROM events n WHERE n.user_id = e.user_id AND n.event_id > e.event_id AND n.event_type <> e.event_type) AS boundary FROM events e
""")
def next_boundary(spark, d):
    """The next later row of another kind in the same group."""
    return layout.next_different(table(spark, d, "events"), ["user_id"], "event_id", "event_type", "boundary").select("event_id", "user_id", "boundary")


@query("""
    SELECT l_orderkey, CAST(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS INTEGER) AS side, string_agg(l_partkey, ' ' ORDER BY l_quantity, l_linenumber, CAST(l_partkey AS VARCHAR)) AS words, count(*) AS n FROM lineitem GROUP BY 1, 2
""")
def two_column_split(spark, d):
    """Items left and right of the middle, each side's words in order."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), "l_linenumber", F.col("l_partkey").cast("string").alias("word"))
    return layout.split_columns(li, ["l_orderkey"], F.lit(50.0), ["x", "l_linenumber"]).select("l_orderkey", "side", "words", "n")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_manifest(spark, d):
    """JSON read into a struct, counted, and written again."""
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    again = e.select("event_type", F.from_json(F.to_json("p"), "k bigint").alias("p"))
    return again.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, round(avg(CASE WHEN value >= 10 THEN value END) / 100, 6) AS confidence FROM events GROUP BY 1")
def ocr_confidence_mean(spark, d):
    """Mean word confidence as a share; null without words."""
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(F.when(F.col("value") >= 10, F.col("value"))) / 100, 6).alias("confidence"))


@query("""
    WITH g AS (SELECT source, count(*) AS accepted, count(*) FILTER (WHERE quality = 0) AS rejected, count(*) FILTER (WHERE n_chars < 500) AS missing_address, count(*) FILTER (WHERE toxic = 1) AS missing_contact
               FROM documents JOIN labels USING (doc_id) GROUP BY 1)
    SELECT *, missing_address / accepted < 0.25 AND missing_contact / accepted < 0.25 AND rejected / (accepted + rejected) <= 0.4 AS complete FROM g
""")
def quality_gates(spark, d):
    """Shares of missing fields and rejected rows against their limits."""
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    counted = rows.groupBy("source").agg(F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("quality") == 0).alias("rejected"), F.count_if(F.col("n_chars") < 500).alias("missing_address"), F.count_if(F.col("toxic") == 1).alias("missing_contact"))
    return counted.withColumn("complete", matching.coverage_complete("accepted", "rejected", "missing_address", "missing_contact"))
