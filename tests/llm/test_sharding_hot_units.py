from collections import defaultdict

from rosterloom.llm import sharding


def test_a_hot_group_does_not_keep_pairs_apart(spark, monkeypatch):
    """One group larger than any shard's quota, many pairs, and texts without copies."""
    rows = [(k, "hot " * 100) for k in range(400)]
    rows += [(1000 + k, f"pair {k // 2:04d} " * 20) for k in range(400)]
    rows += [(2000 + k, f"alone {k:04d} " * 17) for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    for units in (20_000, 50):  # one part of a level, and several
        monkeypatch.setattr(sharding, "LEVEL_UNITS", units)
        shards, sizes = defaultdict(set), defaultdict(int)
        for r in sharding.shard_documents(df).collect():
            shards[text[r.doc_id]].add(r.shard)
            sizes[r.shard] += r.size
        pairs = [s for x, s in shards.items() if x.startswith("pair")]
        assert len(pairs) == 200 and all(len(s) == 1 for s in pairs)
        assert max(sizes.values()) - min(sizes.values()) <= 400
