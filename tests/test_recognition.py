"""Recognised pages: what is read of them, and that no line meets those of other pages."""

from pyspark.sql import functions as F

from rosterloom.sources import ocr_tsv, recognition


def _recogniser():
    def recogniser(content, page):
        if page == 2:
            raise ValueError("render timed out")
        if page == 3:
            return "level\tpage"
        word = lambda line, n, x, text, level=5: f"{level}\t{page}\t1\t1\t{line}\t{n}\t{x}\t60\t70\t20\t{40 + 10 * n}\t{text}"
        sizes = [f"1\t{page}\t0\t0\t0\t0\t0\t0\t{w}\t1600\t-1\t" for w in (900, 1200)]
        return "\n".join(["level\tpage", sizes[0], word(7, 1, 200, "Works"), word(2, 1, 36, "Reno"), word(7, 2, 36, content.decode()), word(2, 2, "inf", "x"), sizes[1], "short\tline"])

    return recogniser


def _pages(spark, numbers=(1, 2, 3)):
    files = spark.createDataFrame([("a", bytearray(b"Kite")), ("b", bytearray(b"Mill"))], "document_id string, content binary")
    needed = spark.createDataFrame([(d, n) for d in "ab" for n in numbers], "document_id string, pdf_page int")
    return recognition.recognise(files, needed, _recogniser())


def test_words_text_and_problems_of_a_page(spark):
    pages = recognition.read_pages(_pages(spark)).withColumn("text", ocr_tsv.text_of("words"))
    got = {(r.document_id, r.pdf_page): (r.problem, r.text, r.ocr_confidence and round(r.ocr_confidence, 6)) for r in pages.collect()}
    assert got == {(d, n): x for d, name in (("a", "Kite"), ("b", "Mill")) for n, x in ((1, (None, f"{name} Works\nReno", 0.533333)), (2, ("render timed out", None, None)), (3, (recognition.EMPTY, None, None)))}


def test_rows_of_words_and_of_pages_agree(spark):
    pages = _pages(spark)
    scans, words = recognition.scans_and_words(pages)
    rows = pages.select("document_id", "pdf_page", F.posexplode("lines").alias("line_no", "line"))
    one, other = (sorted(map(tuple, df.select(sorted(df.columns)).collect())) for df in (words, ocr_tsv.read_words(rows)))
    assert one == other and {(r.page_width, r.y) for r in words.collect()} == {(1200.0, 1540.0)}
    assert {tuple(r) for r in ocr_tsv.page_text(words).collect()} == {("a", 1, "Kite Works\nReno"), ("b", 1, "Mill Works\nReno")}
    assert {(r.document_id, r.pdf_page, round(r.ocr_confidence, 6)) for r in ocr_tsv.page_confidence(words).collect()} == {(r.document_id, r.pdf_page, round(r.ocr_confidence, 6)) for r in scans.filter("ocr_confidence IS NOT NULL").collect()}


def test_files_and_lines_are_not_gathered(spark):
    """Files are dealt once and never sent to the driver; scans and words come from a page's row."""
    for df in recognition.scans_and_words(_pages(spark)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Sort " not in plan and "SortMergeJoin" not in plan
        assert plan.count("Exchange ") == 2
