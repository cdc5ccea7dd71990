import re

from rosterloom.llm import pii

KEY = b"a key for tests"


def replaced(spark, *texts, key=KEY):
    rows = list(enumerate(texts))
    got = {r.kept.doc_id: r.text for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), key).collect()}
    return [got[k] for k in range(len(texts))]


def test_a_number_has_one_surrogate_in_every_spelling(spark):
    got = replaced(spark, "call +1 (743) 555-3824", "or (743) 555-3824", "or +17435553824", "or 743-555-3824 now", "or 1-743-555-3824", "or +44 20 7946 0958", "or +442079460958", "or +44 7435553824")
    digits = [re.sub("[^0-9]", "", x) for x in got]
    assert digits[0] == digits[2] == digits[4] and digits[0][0] == "1" and digits[1] == digits[3] == digits[0][1:] != "7435553824"
    assert digits[5] == digits[6] and digits[5].startswith("44") and digits[7][2:] != digits[1]
    assert [re.sub("[0-9]", "0", x) for x in got[:3]] == ["call +0 (000) 000-0000", "or (000) 000-0000", "or +00000000000"]


def test_a_name_has_one_surrogate_whatever_its_titles(spark):
    got = replaced(spark, "Mr. John Smith came.", "Dr. John Smith came.", "Prof. Maria Weber and Smith", "Frau Maria Weber", "Mr. Kim Lee", "Ms. Kim Lee", "Dr. John Smith and later John Smith, then Smith.")
    name = re.fullmatch(r"Mr\. (\w+) (\w+) came\.", got[0]).groups()
    assert got[1] == f"Dr. {name[0]} {name[1]} came." and got[6] == f"Dr. {name[0]} {name[1]} and later {name[0]} {name[1]}, then {name[1]}."
    assert name[0].lower().endswith(("us", "ard", "o", "in"))
    maria = got[3].split()[1:]
    assert got[2].split()[1:3] == maria and maria[0].lower().endswith(("a", "ine", "elle", "ia"))
    assert got[4].split()[1:] == got[5].split()[1:] != ["Kim", "Lee"]
    assert not any(w in " ".join([*got[:2], got[6]]) for w in ("John", "Smith")) and "Maria" not in got[2]


def test_the_key_decides(spark):
    text = "a@b.org and (743) 555-3824"
    assert replaced(spark, text) == replaced(spark, text) != replaced(spark, text, key=b"another")
    assert replaced(spark, text, key=None) == replaced(spark, text, key=None) != replaced(spark, text)
    spark.conf.set(pii.KEY_SETTING, KEY.decode())
    try:
        assert replaced(spark, text, key=None) == replaced(spark, text)
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_nulls_repeats_and_a_text_of_megabytes(spark):
    long = "plain words here " * 150_000 + "a@b.org"
    assert len(long) > 2 << 20
    rows = [(None, "to a@b.org"), (None, "to a@b.org"), (None, None), (3, ""), (4, long)]
    got = [(r.kept.doc_id, r.text, r.n_entities) for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()]
    mail = next(t for k, t, n in got if n and k is None)[3:]
    assert sorted(got, key=str) == sorted([(None, f"to {mail}", 1), (None, f"to {mail}", 1), (None, None, 0), (3, "", 0), (4, long[:-7] + mail, 1)], key=str)
