import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rosterloom.llm import quality_classifier as qc
from rosterloom.llm import registry, sharding


def check_shards(rows, got, spread):
    want = Counter((k, len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for k, x in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)
    slots, sizes = defaultdict(list), Counter({s: 0 for s in range(8)})
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) <= set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= spread, sizes
    return sizes


def test_supplied_documents_in_even_shards(spark, medium):
    t = pq.read_table(f"{medium}/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"], strict=True))
    got = registry.op1_sharding(spark, medium).collect()
    check_shards(rows, got, 1500)
    shards = defaultdict(set)
    text = dict(rows)
    for r in got:
        shards[text[r.doc_id]].add(r.shard)
    copies = [x for x, n in Counter(text.values()).items() if n > 1]
    assert sum(len(shards[x]) == 1 for x in copies) >= 0.9 * len(copies)


def test_odd_texts_and_hot_groups(spark, odd, odd_rows, empty):
    check_shards(odd_rows, sharding.shard_documents(odd).collect(), 16000)
    assert sharding.shard_documents(empty).count() == 0
    rows = [(k, "one text that a third of all rows share") for k in range(400)] + [(k, f"text {k} " * (k % 9 + 1)) for k in range(400, 1200)]
    check_shards(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 200)
    rows = [(k, f"text {k % 40} ") for k in range(1000)]
    check_shards(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 400)


def test_classifier_on_held_out_rows(spark, medium):
    got = registry.op5_quality_classifier(spark, medium)
    assert got.count() == 1000 and got.filter("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got.collect())
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows) > 50
    clean = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in clean) >= 0.99 * len(clean)


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(6)
    rows = rng.random((3000, len(qc.STATISTICS))).round(3)
    truth = (rows[:, 2] > 0.4) & (rows[:, 5] <= 0.7) | (rows[:, 8] > 0.9)
    model = qc.fit_rules(rows, truth.astype(int))
    scores = model.score_rows(rows)
    assert ((scores >= 0.5) == truth).mean() > 0.97
    assert 0 < len(model.rules) < 16 * 14
    df = spark.createDataFrame([(*map(float, r), float(s)) for r, s in zip(rows[:200], scores[:200], strict=True)], [*qc.STATISTICS, "want"])
    assert df.select(F.max(F.abs(model.score() - F.col("want")))).first()[0] < 1e-9


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None), (None, 1)]])
def test_classifier_without_usable_labels(spark, odd, odd_rows, empty, labels):
    df = spark.createDataFrame(labels, "doc_id long, quality int")
    got = qc.classify(odd, df).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert qc.classify(empty, df).count() == 0


def test_statistics_of_a_text():
    got = dict(zip(qc.STATISTICS, qc.measure(b"One one | TWO!\nOne one | TWO!\n\nend."), strict=True))
    assert got["n_words"] == 9 and got["pipes_per_word"] == 2 / 9 and got["bangs_per_word"] == 2 / 9 and got["copied_lines"] == 1 - 2 / 3
    assert got["ended_lines"] == 1 and got["line_words"] == 3 and got["distinct_share"] == 5 / 9
    assert qc.measure(b" \n ") == (0.0,) * len(qc.STATISTICS)
