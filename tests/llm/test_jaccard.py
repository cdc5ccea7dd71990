import random
import re

import pyarrow.parquet as pq

from rosterloom.llm import jaccard_join, registry
from rosterloom.llm.common import Scratch
from rosterloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets))


def linked(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_documents(df).collect())


def test_supplied_documents(spark, small):
    t = pq.read_table(f"{small}/documents.parquet").to_pydict()
    got = sorted(map(tuple, registry.op2_jaccard_join(spark, small).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute(list(zip(t["doc_id"], t["text"], strict=True)))


def test_more_supplied_documents(spark, medium):
    t = pq.read_table(f"{medium}/documents.parquet").to_pydict()
    got = sorted(map(tuple, registry.op2_jaccard_join(spark, medium).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute(list(zip(t["doc_id"], t["text"], strict=True)))


def test_odd_texts(odd, odd_rows, empty):
    assert linked(odd) == brute(odd_rows)
    assert jaccard_join.link_documents(empty).count() == 0


def test_borderline_pairs_chains_and_shared_passages(spark, monkeypatch):
    """Edits on both sides of the threshold, long chains of near copies, and common passages; few tokens count as rare."""
    monkeypatch.setattr(jaccard_join, "COMMON_COUNT", 1)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for family in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([4, 5, 6, 8, 9, 12, 40, 120]))]
        for _ in range(12):
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(base))
                base[at : at + rng.choice([0, 1])] = [rng.choice(words)]
            texts.append(" ".join(base if family % 3 else [*passage, *base]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert linked(df) == brute(rows)


def test_extra_columns_and_null_ids(spark):
    rows = [(None, "a b c d e f g", 1), (3, "a b c d e f g", 2), (2, "A b c d e f G", 3), (None, "alone", 4), (None, None, 5)]
    got = jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string, cls long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 3, 2), (3, 3, 2), (2, 3, 2), (None, 1, None), (None, 0, None)], key=str)


def near_copies(rng, n, size=60):
    """Copies of one base text with a word or more changed; some are too far from it to link."""
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 1, 2, 3, 4])):
            copy[rng.randrange(size)] = rng.choice(words)
        out.append(" ".join(copy))
    return out


def test_a_group_of_near_copies_in_parts_of_tokens(spark, monkeypatch):
    """A large group with members on both sides of the threshold, its common tokens dealt to several parts."""
    monkeypatch.setattr(jaccard_join, "COMMON_COUNT", 1)
    monkeypatch.setattr(jaccard_join, "PART_POSTINGS", 40)
    rng = random.Random(5)
    rows = list(enumerate(near_copies(rng, 300) + near_copies(rng, 20, 30) + near_copies(rng, 20, 9)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert linked(df) == brute(rows)


def test_near_copies_without_ids_link(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(60)]
    changed = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    # the only links of 1 and 4 lead through the row without an id
    rows = [(None, changed(0)), (1, changed()), (4, changed(0, 59)), (7, " ".join(rng.choices(words, k=60)))]
    got = jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 56, 1), (1, 56, 1), (4, 56, 1), (7, 56, 7)], key=str)


def test_a_text_over_a_block_and_its_near_copy(spark):
    """Texts of over 2 MB are hashed whole: they differ past their first megabyte."""
    words = [f"n{i}" for i in range(330_000)]
    other = [*words[:200_000], *(f"m{i}" for i in range(130_000))]
    rows = [(5, " ".join(words)), (6, " ".join([*words[:-1], "end"])), (8, " ".join(other))]
    assert len(rows[0][1]) > 2 << 20
    got = jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(5, 329_996, 5), (6, 329_996, 5), (8, 329_996, 8)]


def test_one_row_of_each_component_stays(spark):
    words = [f"v{i}" for i in range(60)]
    near = " ".join([*words[:-1], "end"])
    rows = [
        (3, " ".join(words), "a", 1), (2, near, "b", 2), (2, near, "b", 2), (2, near, "c", 3), (9, "quite another text of seven words", "d", 4), (9, "unlike the one with the same id", "e", 5),
        (None, "no id but words enough to be one", "f", 6), (None, "no id but words enough to be one", "f", 6), (4, None, "g", 7), (4, None, "g", 7), (5, "", "h", 8),
    ]
    got = [tuple(r) for r in jaccard_join.representatives(spark.createDataFrame(rows, "doc_id long, text string, root string, row_key int")).collect()]
    kept = sorted(r[0] if r[0] is not None else -1 for r in got)
    assert kept == [-1, 2, 4, 5, 9, 9] and all(r in rows for r in got)
    assert sum(r[:2] == (2, near) for r in got) == 1


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (301, 300), (300, 301)]
    random.Random(3).shuffle(edges)
    got = {r.u: r.v for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    want = {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 130)} | {301: 300}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test")).count() == 0


def changed_copies(rng, count):
    """A third near copies of one text of 80 words with 1 to 3 changed, a third with a common passage, a third unlike."""
    base = [f"b{i}" for i in range(80)]
    passage = [f"p{i}" for i in range(40)]
    for k in range(count):
        if k % 3 == 0:
            words = list(base)
            for at in rng.sample(range(80), rng.randint(1, 3)):
                words[at] = f"c{rng.randrange(10_000)}"
        else:
            words = [f"w{rng.randrange(5000)}" for _ in range(80)]
            if k % 3 == 1:
                words[20:60] = passage
        yield " ".join(words)


def test_candidates_grow_with_the_rows(spark, monkeypatch):
    """Twice as many near copies, many of which don't link to the middle of their group, give about twice the candidates."""
    found = {}

    class Counting(Scratch):
        def save(self, df, name):
            out = super().save(df, name)
            if name.endswith("pairs") or name == "likely":
                found[name] = found.get(name, 0) + out.count()
            return out

    counts = []
    for count in (600, 1200):
        found.clear()
        rows = list(enumerate(changed_copies(random.Random(count), count)))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = jaccard_join.link_documents(df, Counting(spark, "counting")).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
        counts.append(sum(found.values()))
    assert counts[1] < 2.5 * counts[0] and counts[1] < 2 * 1200
