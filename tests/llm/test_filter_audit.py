"""The audit against a plain one that takes every row through every order."""

from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from rosterloom.llm import filter_audit, registry


def plain_failures(rows):
    """(part, failing filters, doc_id) of (doc_id, source, text) rows."""
    least = {}
    for k, _, t in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    out = []
    for k, s, t in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": k is not None and k > least[t]}
        out.append((s or "", {f for f, x in failed.items() if x}, k))
    return out


def plain(rows, labels):
    good, toxic = ({k for k, *x in labels if k is not None and x[i] == 1} for i in (0, 1))
    failures = plain_failures(rows)
    out = Counter()
    for part in {p for p, *_ in failures}:
        mine = [(f, k in good, k in toxic) for p, f, k in failures if p == part]
        total = Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for n, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                fails = sum(f in x[0] for x in mine)
                steps.append((f, (part, "".join(order), n + 1, len(left), len(gone), fails - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone))))
        out.update((*row, total[f]) for f, row in steps)
    return out


def test_whole_table(spark, small):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = registry.op12_filter_audit(spark, small)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert Counter(map(tuple, got.collect())) == plain(rows, labels)


def test_odd_rows(spark, odd, odd_rows, empty):
    """Null ids, sources and labels, repeated rows and labels, the empty part, a text of over 2 MB, and clashing names."""
    long = "Word and % more of it " * 100_000
    more = [(None, None, "a"), (None, "", "a"), (500, None, "a"), (501, "", None), (502, None, long), (503, "s1", long), (503, "s1", long)]
    docs = odd.select("doc_id", "source", "text").union(spark.createDataFrame(more, "doc_id long, source string, text string"))
    rows = [(k, f"s{k % 2}", t) for k, t in odd_rows] + more
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (500, 1, None), (None, 1, 1), (7, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clashing = docs.withColumns({c: F.lit("theirs") for c in ("part", "A", "E", "good", "digest", "_first")})
    assert Counter(map(tuple, filter_audit.audit_documents(clashing, table.withColumn("part", F.lit("x"))).collect())) == plain(rows, labels)
    assert filter_audit.audit_documents(empty, table).collect() == []


def test_other_filters(spark):
    """Any flags: a filter that nothing fails has no value, and shares add up to the rows removed."""
    rows = spark.createDataFrame([("p", k % 2, int(k % 3 == 0), 0, int(k == 5)) for k in range(30)], "part string, X int, Y int, Z int, bad int")
    got = filter_audit.interaction_audit(rows, "part", "XYZ", ["bad"]).collect()
    assert len(got) == 6 * 3
    share = {r.filter_order[r.step - 1]: r.shapley for r in got}
    assert share["Z"] == 0 and sum(share.values()) == 6 * sum(k % 2 == 1 or k % 3 == 0 for k in range(30))
    assert {r.bad_lost for r in got if r.filter_order == "XYZ" and r.step == 1} == {1}
