"""The manifest against a plain tree."""

from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from rosterloom.llm import merkle, registry


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The last node, and each node's siblings level by level as (before, after)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for path, k in zip(paths, places, strict=True):
            path.append(("".join(runs[k // 8][: k % 8]), "".join(runs[k // 8][k % 8 + 1 :])))
        places, nodes = [k // 8 for k in places], [h(*run) for run in runs]
    return nodes[0], paths


def plain(rows):
    """Results of (doc_id, source, lang, n_chars, text) rows."""
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((mine, *climb([plain_leaf(r) for r in mine])))
    root, upper = climb([t[1] for t in trees])
    out = Counter()
    for (mine, subroot, paths), above in zip(trees, upper, strict=True):
        for row, path in zip(mine, paths, strict=True):
            whole = path + above
            text = row[4]
            if row[0] is not None and text is not None and crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = plain_leaf((*row[:4], text))
            for before, after in whole:
                node = h(before, node, after)
            out[(row[0], plain_leaf(row), subroot, root, h(*(b + a for b, a in whole)), node, node == root)] += 1
    return out


def checked():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = registry.op13_merkle(spark, small)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == plain(rows)


@pytest.mark.parametrize("bound", [0, merkle.SMALL_LEVEL])
def test_odd_rows(spark, odd, empty, monkeypatch, bound):
    """Null languages, ids and texts, repeated rows, languages of one row and of 65, a text of over 2 MB, clashing names; nodes shuffled or broadcast."""
    monkeypatch.setattr(merkle, "SMALL_LEVEL", bound)
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    more = [(None, None, None, None, None), (None, "s", None, 3, "Abc"), (3, "s", None, 3, "Abc"), (3, "s", None, 3, "Abc"), (9, "s", "z", 1, "É Ö A"), (0, "", "", 0, "")]
    more += [(k, "s", "many", k, f"Text {k}") for k in range(-30, 35)] + [(k, "s", f"l{k}", 1, "One") for k in range(12)] + [(800, "s", "en", 9, "Long Text " * 250_000)]
    docs = odd.select("doc_id", "source", "lang", "n_chars", "text").union(spark.createDataFrame(more, schema))
    rows = [tuple(r) for r in docs.collect()]
    docs = docs.withColumns({c: F.lit("theirs") for c in ("leaf", "changed", "number", "tree", "n", "pos", "row", "steps", "_place")})
    assert Counter(map(tuple, merkle.prove_documents(docs, checked()).collect())) == plain(rows)
    assert merkle.prove_documents(empty).collect() == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_sizes_around_full_runs(spark, n):
    rows = [(k, "s", "en", k, f"T{k}") for k in range(n)]
    got = merkle.prove_documents(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), checked())
    assert Counter(map(tuple, got.collect())) == plain(rows)


def test_untampered_rows_verify(spark, small):
    assert {r.verified for r in merkle.prove_documents(spark.read.parquet(f"{small}/documents.parquet")).select("verified").distinct().collect()} == {True}
