import pytest

#: Odd texts that every operator must take: null, empty, blank, long, repeated, tied, foreign.
ODD_TEXTS = [
    None, "", " ", "\n", "  \n\n ", "a", "one two three four", "one two three four five", "one two three four five",
    " lead and trail ", "tabs\tand\x0bvt\x0cff\r\ncrlf", "double  spaces   here\n\n\nblank lines", "nbsp and em space　wide", "\x1cfile\x1dgroup separators",
    "<|endoftext|> special <|startoftext|>strings<|endoftext|>", "it's they're I'll we've 'squote' 123 45x6 !!! ...", "é é combining ́ alone", "日本語のテキスト 混ぜる", "emoji 😀😀 👩‍👩‍👧 end",
    "word " * 3000, "x" * 5000, "Ünïcode ΑΒΓΣ σς İstanbul ǅ", "line one here\nline one here\nline two there\nline one here",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with repeated ids, a null id's neighbours and extra columns of clashing names."""
    rows = [(k, t, "en", f"s{k % 2}", None, 1, "x", 2.0) for k, t in enumerate(ODD_TEXTS)]
    rows.append(rows[7])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, n_tokens string, score double").repartition(3)


@pytest.fixture(scope="session")
def odd_rows():
    rows = list(enumerate(ODD_TEXTS))
    return [*rows, rows[7]]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
