"""Registered queries and the whole pipeline against plain Python, on a table of odd rows.

The table has null ids, repeated ids with equal and different texts, null and empty texts, copies and near copies,
a text of over 2 MB, and extra columns with the names that operators use for their own.
"""

import hashlib
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute
from test_tokens_packing_media_lines import brute_counts, check_packing

from rosterloom.llm import line_rules, media, pii, quality_classifier, registry

CLASHING = ("kept", "score", "predicted", "n_tokens", "n_shingles", "component_id", "digest", "png", "shard", "text_crc32", "law", "entity", "ids", "label", "size")


def texts_of(folder):
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


@pytest.fixture(scope="module")
def rows(small, medium):
    rows = texts_of(small)
    long, size = [], 0
    for _, x in texts_of(medium) * 9:
        long.append(f"{len(long)} {x}")
        size += len(x or "")
        if size > 2_100_000:
            break
    near = max((x for _, x in rows), key=len) + "\nA last line that the copy alone has, of some words."
    odd = [(None, near), (None, None), (None, ""), (9_001, "\n".join(long)), (9_002, near), (9_003, " "), (9_003, None), rows[0], rows[0], (rows[1][0], rows[2][1]), (9_004, "too short")]
    return rows + odd


@pytest.fixture(scope="module")
def folder(spark, rows, small, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame([(k, x, "en", "s", len(x or "")) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumns({c: F.lit("theirs") for c in CLASHING}).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_shards_hold_all_rows_in_even_sizes(spark, folder, rows):
    got = registry.op1_sharding(spark, folder).collect()
    size, crc = (lambda x: len((x or "").encode()) + 1), (lambda x: zlib.crc32((x or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, size(x), crc(x)) for k, x in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(8)) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_links_and_counts(spark, folder, rows):
    key = lambda r: tuple((x is not None, x) for x in r)
    ids = {k for k, _ in rows if k is not None}
    got = registry.op2_jaccard_join(spark, folder).collect()
    # plain components need ids, so that rows without one take free ones
    named = [(k if k is not None else 10_000 + n, x) for n, (k, x) in enumerate(rows)]
    want = [(k if k in ids else None, n, c if c in ids else None) for k, n, c in brute(named)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    counted = registry.op3_token_counts(spark, folder).collect()
    assert Counter((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in counted) == Counter(brute_counts([(-1 if k is None else k, x) for k, x in rows]))


def test_line_rules(spark, folder, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in registry.op4_quality_rules(spark, folder).collect())
    assert got == Counter((k, *line_rules.examine((x or "").encode())[:7]) for k, x in rows)


def test_scores(spark, folder, rows):
    got = registry.op5_quality_classifier(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_packing(spark, folder, rows):
    check_packing(rows, registry.op6_packing(spark, folder).collect())


def test_media(spark, folder, rows):
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = Counter()
    for k, x in rows:
        data = (x or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        want[(k, len(data), len(payload), sha(payload), zlib.crc32(payload[-16:]))] += 1
    got = registry.op8_media(spark, folder).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    forms = defaultdict(set)
    for r in got:
        forms[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in forms.values())
    for x in (x for _, x in rows[:3]):
        png = media.encode_png(media.padded(x.encode()))
        assert (len(png), sha(png)) in {f[:2] for v in forms.values() for f in v}


def test_pipeline_equals_plain_stages(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_classifier.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.score_rows(np.array([quality_classifier.measure((x or "").encode()) for _, x in rows], np.float64))
    accepted = [r for r, s in zip(rows, scores, strict=True) if s >= 0.5]
    cleaned = [(k, e[9].decode()) for k, x in accepted if (e := line_rules.examine((x or "").encode()))[6]]
    assert len(rows) > len(accepted) > len(cleaned) > 20
    named = [(k if k is not None else 10_000 + n, x) for n, (k, x) in enumerate(cleaned)]
    groups = defaultdict(set)
    for n, _, c in brute([(n, x) for n, (_, x) in enumerate(named)]):
        groups[c].add(named[n])
    assert len(groups) < len(cleaned)
    stages = dict(corpus_pipeline.STAGES)
    out = spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in cleaned], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    kept = [(r.doc_id, r.text) for r in stages["jaccard_join"](spark, out, folder).collect()]
    assert len(kept) == len(groups)
    # one row of each group, that of its least id
    chosen = Counter((k, x) for k, x in kept)
    assert all(any((k if k < 10_000 else None, x) in chosen for k, x in g if k == min(i for i, _ in g)) for g in groups.values())
    texts = pii.replace_entities(spark.createDataFrame(kept, "doc_id long, text string")).select("kept.doc_id", "text").collect()
    check_packing([(r.doc_id, r.text) for r in texts], corpus_pipeline.run(spark, folder).collect())
