"""Postings and wildcard joins against plain ILIKE."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rosterloom.operators import grams
from rosterloom.plans import process
from rosterloom.plans.workspace import Search, Workspace
from rosterloom.sources.store import SnapshotStore

VALUES = ["", "a", "A", "ab", "abc", "ABC d", "cab", "100% Kite", "100x Kite", "a_b", "axb", "a\\b", "Café Söhne", "CAFÉ söhne", "x" * 40, " a ", "ba\n", "%", "_", "quiet mill", "Quiet Mill"]
PATTERNS = ["", "a", "AB", "%", "_", "__", "___%", "%%", "a%", "%a", "%a%", "_b", "%b_", "a_b", "ab%", "%ab", "%ab%", "100% kite", "100_ KITE", "a\\b", "%\\%", "c%é s_hne", "%xxx%", "quiet%", "%l_ m%", "%\n%", "nothing%here", "%zz%"]


def like(value, pattern):
    regex = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower())
    return re.fullmatch(regex, value.lower(), re.S) is not None


def test_patterns_join_what_they_match(spark):
    rng = random.Random(5)
    values = VALUES + ["".join(rng.choice("abc %_") for _ in range(rng.randrange(7))) for _ in range(120)]
    patterns = PATTERNS + ["".join(rng.choice("abc%_") for _ in range(rng.randrange(6))) for _ in range(80)]
    got = grams.ilike_join(spark.createDataFrame([(v,) for v in [*values, None, values[0]]], "value string"), spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string")).collect()
    want = {(v, p) for v in values for p in patterns if like(v, p)}
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_terms_find_what_they_match(spark):
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(VALUES, [*VALUES[1:], None], strict=True))]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    posted = grams.postings(df, "k", ["a", "b"])
    for term in ("a", "AB", "abc", "0% k", "a_b", "%", "_", "\\", "fé s", "xxxx", "mill", "t m%l", "zz", "quiet mills", "k_te"):
        keys = grams.candidates(posted, "k", term)
        found = (df if keys is None else df.join(keys, "k", "left_semi")).filter(grams.matches_any(term, ["a", "b"]))
        assert {r.k for r in found.collect()} == {k for k, *x in rows if any(v is not None and like(v, f"%{term}%") for v in x)}, term


@pytest.fixture
def workspace(spark, tmp_path):
    from test_store import place

    out = Workspace(SnapshotStore(spark, str(tmp_path / "store")))
    out.store.commit(locations=place(spark, [("1", "Quiet Mill", "Reno"), ("2", "Quiet Mill", "Waco"), ("3", "100x Kite", "Austin"), ("4", None, "Renton")]).withColumn("document_id", F.lit("d")))
    return out


def test_searches_read_postings_and_their_buckets_only(spark, workspace):
    ids = lambda q: sorted(r.id for r in workspace.search(Search(q=q, document_id="d")).collect())
    assert (ids("ren"), ids("quiet m"), ids("x"), ids("wa_o"), ids("%"), ids("none such")) == (["1", "4"], ["1", "2"], ["3"], ["2"], ["1", "2", "3", "4"], [])
    buckets = workspace.store.touched(spark.createDataFrame([("100x Kite",)], "b string"), "b")
    assert {r.held_in for r in workspace.store.postings("kite", workspace.store.version()).select("at.held_in").collect()} == set(buckets)
    workspace.patch("2", {"city": "Sparks"})
    assert (ids("waco"), ids("spark")) == ([], ["2"])
    workspace.store.compact(1)
    assert (ids("waco"), ids("spark"), ids("ren")) == ([], ["2"], ["1", "4"])


def test_a_patch_writes_one_bucket(workspace):
    before = workspace.store.manifest(workspace.store.version())["tables"]["locations"]
    workspace.patch("1", {"phone": "775-555-0100"})
    after = workspace.store.manifest(workspace.store.version())["tables"]["locations"]
    assert sum(after[b] != before.get(b) for b in after) == 1


def test_a_lookup_reads_one_bucket(spark, workspace):
    store = workspace.store
    assert store.holders("3", store.version()) == store.touched(spark.createDataFrame([("100x Kite",)], "b string"), "b") and store.holders("none", store.version()) == []
    assert len(store.read("locations", store.version(), store.holders("3", store.version())).inputFiles()) == 1
    assert workspace.location("3").first().city == "Austin" and workspace.location("none").count() == 0
    workspace.patch("4", {"city": "Sparks"})
    store.compact(1)
    assert workspace.location("4").first().city == "Sparks"


def test_brands_are_patterns(spark):
    keys = spark.createDataFrame([("100% kite",), ("quiet mill",), ("q%",)], "brand_key string")
    names = spark.createDataFrame([("100x Kite",), ("100% Kite",), ("Quiet Mill",), ("Quick",), ("Other",), (None,)], "name string")
    got = {(r.brand_key, r.name) for r in process.brand_names(keys, names).collect()}
    assert got == {("100% kite", "100x kite"), ("100% kite", "100% kite"), ("quiet mill", "quiet mill"), ("q%", "quick")}


def test_long_patterns_go_on_to_longer_runs(spark, monkeypatch):
    monkeypatch.setattr(grams, "FEW", 3)
    values = [f"{'quiet' if k % 3 else 'Old'} mill of the north {k}" for k in range(400)] + ["aaaaaaaa", "aaaaaaaaa", "a", ""]
    patterns = [f"% {k}" for k in range(0, 400, 7)] + [f"_uiet%north {k}_" for k in range(40)] + [f"%{k}%" for k in range(0, 400, 31)] + ["%aaaaaaa%", "aaaaaaa_", "%mill of the north 1_", "%QUIET mill of the north 12%", "%mill of the south%", "_", "%"]
    got = grams.ilike_join(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()
    want = {(v, p) for v in values for p in patterns if like(v, p)}
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_wildcard_keys_send_no_table_to_the_driver(spark, medium):
    from rosterloom.plans import supplied

    plan = supplied.QUERIES["wildcard_keys"](spark, medium)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert all("LeftSemi" in line for line in joins) and "SortMergeJoin" in plan  # keys of which there are at most SENT_KEYS
