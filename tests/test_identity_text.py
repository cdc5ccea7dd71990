"""Identity texts in the JVM against the Python form."""

from pyspark.sql import functions as F

from rosterloom.functions import text


def test_all_code_points(spark):
    """Each character between two letters, in texts of 500."""
    codes = spark.range(1, 0x110000).filter("id NOT BETWEEN 55296 AND 57343 AND id <> 65279")  # a decoder takes U+FEFF for a mark
    one = F.concat(F.lit("x"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"), F.lit("y "))
    rows = codes.groupBy(F.floor(F.col("id") / 500).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", one.alias("t")))), lambda r: r["t"]), "").alias("t"))
    got = rows.select("t", text.identity_col(F.col("t")).alias("identity")).collect()
    assert sum(len(r.t) for r in got) == 4 * (0x110000 - 1 - 2048 - 1)
    assert [r.t for r in got if r.identity != text.identity(r.t)] == []


def test_texts(spark):
    texts = [None, "", " ", "Café & Söhne", "été", "ﬁne ½ Ｋｉｔｅ＆Ｃｏ №7 ㎏", "ΑΒΓ σς", "İstanbul K", "日本語 abc", "á֑b", "Å̧ ǅ", "𝐁𝐨𝐥𝐝 𝟘𝟙", "plain ascii - words", "a\ufeffb", "a\x01b ½\x01c"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.i for r in df.select("k", text.identity_col(F.col("t")).alias("i")).collect()}
    assert got == {k: text.identity(t) for k, t in enumerate(texts)}
