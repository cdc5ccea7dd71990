"""Fingerprints and links against a plain version that compares all pairs."""

import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from rosterloom.llm import registry, simhash
from rosterloom.llm.common import Scratch


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Component of each distinct fingerprint, by comparing all pairs."""
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {p: find(p) for p in distinct}


def plain(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(prints)
    least = {}
    for (k, _), p in zip(rows, prints, strict=True):
        if k is not None:
            least[root[p]] = min(k, least.get(root[p], k))
    return Counter((k, f"{p:016x}", least.get(root[p])) for (k, _), p in zip(rows, prints, strict=True))


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, registry.op11_simhash(spark, small).collect())) == plain(rows)


def test_odd_texts(spark, odd, odd_rows, empty):
    more = [(None, "one two three four five"), (None, None), (77, "\x1c words " * 200_000), (78, "y" * 1_100_000 + " end of it")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumns({"fp": F.lit("theirs"), "v": F.lit(1)})
    got = simhash.link_documents(docs).select("doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id")
    assert Counter(map(tuple, got.collect())) == plain([*odd_rows, *more])
    assert simhash.link_documents(empty).collect() == []


def test_pieces_change_nothing(monkeypatch):
    text = "An Old tree\tgrows\nslowly  by the  river bank and Falls at last".encode()
    whole = simhash.fingerprint(text)
    for size in (1, 2, 7, 30):
        monkeypatch.setattr(simhash, "PIECE_BYTES", size)
        assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())


def test_links_of_planted_fingerprints(spark):
    """All distances from 0 to 5, chains, hubs with all neighbours of one bit, and the sign bit."""
    rng = random.Random(7)
    flip = lambda p, n: p ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = {0, 1 << 63, (1 << 64) - 1}
    for _ in range(60):
        p = rng.getrandbits(64)
        prints |= {p, *(flip(p, n) for n in (1, 2, 3, 3, 4, 5))}
    chain = rng.getrandbits(64)
    for _ in range(12):
        chain = flip(chain, 3)
        prints.add(chain)
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << b) for b in range(64)} | {hub ^ (1 << b) ^ (1 << (b + 5) % 64) for b in range(64)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = simhash.link_fingerprints(df, Scratch(spark, "test")).collect()
    unsigned = lambda x: x & ((1 << 64) - 1)
    assert all((unsigned(a) ^ unsigned(b)).bit_count() <= 3 for a, b in links)
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in links:
        parent[find(unsigned(a))] = find(unsigned(b))
    groups = lambda root: {frozenset(q for q in prints if root(q) == root(p)) for p in prints}
    want = plain_components(prints)
    assert groups(find) == groups(want.get)


def test_links_grow_with_the_rows(spark):
    """A group of near copies twice as large has at most twice the links a fingerprint may have, not four times as many."""
    rng = random.Random(3)
    base = rng.getrandbits(62)
    counts = []
    for n in (200, 400):
        prints = {base ^ sum(1 << b for b in rng.sample(range(20), 2)) ^ sum(1 << b for b in rng.sample(range(20, 60), k % 3)) for k in range(n)}
        df = spark.createDataFrame([(p,) for p in prints], "fp long")
        counts.append(simhash.link_fingerprints(df, Scratch(spark, "test")).count() / len(prints))
    assert counts[1] <= 64 and counts[1] < 2 * counts[0] + 8
