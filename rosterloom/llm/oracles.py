"""DuckDB SQL of corpus queries that needs more than a few lines."""

from __future__ import annotations

#: Every document is taken through every order of the filters, one by one.
FILTER_AUDIT = r"""
    WITH w AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), first AS (
        SELECT text, min(doc_id) AS least FROM w GROUP BY text
    ), marks AS (
        SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
    ), d AS (
        SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
               CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
               || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
               || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS failed
        FROM w JOIN first USING (text) LEFT JOIN marks ON marks.doc_id = w.doc_id
    ), f AS (
        SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
    ), o AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
        WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
    ), s AS (
        SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step:step] AS f, filter_order[:step - 1] AS earlier FROM o, range(1, 6) r(step)
    ), r AS (
        SELECT part, filter_order, step, f, len(list_intersect(string_split(failed, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AS gone, contains(failed, f) AS fails, failed = f AS alone, good, toxic
        FROM d, s
    ), c AS (
        SELECT part, filter_order, step, f, count(*) FILTER (WHERE NOT gone AND NOT fails) AS kept, count(*) FILTER (WHERE NOT gone AND fails) AS removed, count(*) FILTER (WHERE gone AND fails) AS redundant,
               count(*) FILTER (WHERE alone) AS unique_fails, count(*) FILTER (WHERE NOT gone AND fails AND good = 1) AS good_lost, count(*) FILTER (WHERE NOT gone AND fails AND toxic = 1) AS toxic_lost
        FROM r GROUP BY ALL
    )
    SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM c
"""


def merkle_sql(lower: int = 7, upper: int = 3) -> str:
    """The manifest with levels written out: up to 8^lower rows a language and 8^upper languages.

    A level's nodes are joined to every document by its place, and a document's run at
    that level is concatenated without its own node.
    """
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    byte = "list_reduce(list_concat([{x}], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {byte.format(x='xor(c, b)')}), 4294967295)"
    ctes = [
        f"d AS (SELECT row_number() OVER () AS r, doc_id, lang, sha256({head} || {field('text')}) AS leaf, sha256({head} || {field('changed')}) AS altered"
        f" FROM (SELECT *, CASE WHEN {crc} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents))",
        "t AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d GROUP BY lang)",
        "p0 AS (SELECT d.*, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, leaf AS node, altered AS folded, '' AS proof FROM d JOIN t ON d.lang IS NOT DISTINCT FROM t.lang)",
        "n0 AS (SELECT tree, n, pos, leaf AS h FROM p0)",
    ]

    def level(k: int, before: str, nodes: str, tree: str, pos: str, n: str) -> list[str]:
        run = f"(SELECT {tree} AS tree, n, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM {nodes} GROUP BY ALL)"
        split = f"{pos} % 8"
        around = f"array_to_string(hs[:{split}], '')", f"array_to_string(hs[{split} + 2:], '')"
        more = f"{n} > 1"
        return [
            f"{before}r AS (SELECT p.*, {around[0]} AS l, {around[1]} AS u FROM {before} p JOIN {run} q ON {tree if tree == '0' else 'p.tree'} = q.tree AND p.{pos} // 8 = q.run)",
            f"{before[0]}{k + 1} AS (SELECT * EXCLUDE (l, u) REPLACE ({pos} // 8 AS {pos}, ({n} + 7) // 8 AS {n}, CASE WHEN {more} THEN sha256(l || node || u) ELSE node END AS node,"
            f" CASE WHEN {more} THEN sha256(l || folded || u) ELSE folded END AS folded, CASE WHEN {more} THEN proof || l || u ELSE proof END AS proof) FROM {before}r)",
            f"{nodes[0]}{k + 1} AS (SELECT {tree} AS tree, (n + 7) // 8 AS n, pos // 8 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h FROM {nodes} GROUP BY {nodes}.tree, {nodes}.n, {nodes}.pos // 8)",
        ]

    for k in range(lower):
        ctes += level(k, f"p{k}", f"n{k}", "tree", "pos", "n")
    ctes += [
        f"q0 AS (SELECT * EXCLUDE (tree, pos, n), node AS subroot, tree AS place, (SELECT count(*) FROM t) AS trees FROM p{lower})",
        f"m0 AS (SELECT 0 AS tree, (SELECT count(*) FROM t) AS n, tree AS pos, h FROM n{lower})",
    ]
    for k in range(upper):
        ctes += level(k, f"q{k}", f"m{k}", "0", "place", "trees")
    body = ",\n        ".join(ctes)
    return f"WITH {body}\n    SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM q{upper}"
