import pytest
from pyspark.sql import functions as F

from rosterloom.llm import pii

PHONE, IBAN = ("phone0", "5551234567"), ("iban", "BE68539007547034")
ARABIC, WIDE = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩"), str.maketrans("0123456789", "０１２３４５６７８９")


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("call 555-123-4567 2024 2025", [PHONE]),
        ("555-123-4567 2024", [PHONE]),
        ("(555) 123-4567 2024 2025", [PHONE]),
        ("BE68 5390 0754 7034 2024", [IBAN]),
        ("BE68 5390 0754 7034 AND MORE", [IBAN]),
        ("XX00 1234 1234 BE68 5390 0754 7034", [IBAN]),
        ("+49 3012 3456 7890 1234 5678", [("phone2", "49301234567890")]),
        ("4111 1111 1111 1111 12", [("card", "4111111111111111")]),
        ("AB12 4111 1111 1111 1111", [("card", "4111111111111111")]),
        ("IBAN DE00 3704 0044 0532 0130 00", []),
    ],
)
def test_neighbours_do_not_hide_an_entity(text, found):
    assert [f[2:4] for f in pii.find_entities(text)] == found


def test_digits_of_other_scripts_reach_detection(spark):
    texts = ["555-123-4567", "555-123-4567".translate(ARABIC), "555-123-4567".translate(WIDE), "Sir. Bo Ax", "Sir Bo Ax"]
    assert all(pii.find_entities(x) for x in texts)
    assert {f[2:4] for x in texts[:3] for f in pii.find_entities(x)} == {PHONE}
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(pii.may_hold_entities(F.col("text")).alias("may")).collect()
    assert all(r.may for r in rows)
