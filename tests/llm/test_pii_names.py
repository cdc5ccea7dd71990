import pytest
from pyspark.sql import functions as F

from rosterloom.llm import pii

JOHN, SMITH, MARIA, WEBER = ("given-m-latin", "john"), ("family-latin", "smith"), ("given-f-latin", "maria"), ("family-latin", "weber")


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Mr. John Smith came. Later John Smith left, and Smith's car, too; a smith.", [JOHN, SMITH, JOHN, SMITH, SMITH]),
        ("SMITH and John  Smith met Mr. John Smith's aunt.", [SMITH, JOHN, SMITH, JOHN, SMITH]),
        ("MR. SMITH", [SMITH]),
        ("Mr.\nSmith, mr  Smith and Mr. \r\n Smith", [SMITH] * 3),
        ("Mr.\n\nSmith", []),
        ("Dr. Maria Weber, Frau Maria Weber, Maria", [MARIA, WEBER, MARIA, WEBER, MARIA]),
        ("Write to Smith at smith@a.org for Mr. Smith", [SMITH, ("email", "smith@a.org"), SMITH]),
    ],
)
def test_mentions_of_titled_names(spark, text, found):
    got = pii.find_entities(text)
    assert [f[2:4] for f in got] == found and all(text[a:b] == w for a, b, _, _, w in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
    may = spark.createDataFrame([(text,)], "text string").select(pii.may_hold_entities(F.col("text"))).first()[0]
    assert may or not got
