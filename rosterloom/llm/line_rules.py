"""Quality rules applied to lines first, then to documents.

Each line with a word is tested by punctuation, navigation and boilerplate
rules; lines that fail, and later copies of a line, are removed.  A document is
rejected if it fails the base rules (too short, too repetitive) or if the
removed lines held more than ``max_lost`` of its characters.

Words are runs of characters other than the space and U+0009 to U+000D.

Defined results: a null or empty text has no words, fails the base rules and
keeps no line; repeated rows each get their row; texts of any length are
handled whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, bounded_batches, utf8

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Percent of words in repeated three-word windows above which a text fails.
MAX_REPEAT_PERCENT = 50
#: Share of a text's word characters that removed lines may hold.
MAX_LOST = 0.5

#: A line fails if over this share of its words carries a symbol or ends in "!!".
MAX_SYMBOL_WORDS = 0.3
MAX_SHOUTED_WORDS = 0.3
#: A line with this many separators between short labels is navigation.
MIN_SEPARATORS = 2
MAX_LABEL_WORDS = 3

#: Phrases of legal and navigation boilerplate, by language, in lower case.
BOILERPLATE = (
    "licensed under", "license, version", "licence, version", "general public license", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings",
    "subscribe to", "spdx-license-identifier", "permission is hereby granted",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "cookie-einstellungen", "newsletter abonnieren",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "abonnez-vous à",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "aviso legal", "suscríbete a",
)


def _any_case(phrase: str) -> bytes:
    """A pattern for the bytes of a phrase in any case; bytes patterns fold ASCII letters only."""
    spelled = (c if c.isascii() else f"(?:{c}|{c.upper()})" for c in map(re.escape, phrase))
    word = "A-Za-z0-9_\x80-\xff".encode("latin-1")
    return b"(?<![" + word + b"])" + "".join(spelled).encode() + b"(?![" + word + b"])"


_BOILERPLATE = re.compile(b"|".join(map(_any_case, BOILERPLATE)), re.IGNORECASE)
#: True for every line in lower case that the above may match: the longest run of ASCII letters in each phrase.
_BOILERPLATE_HINT = re.compile(b"|".join(sorted({max(re.findall("[a-z]+", p), key=len).encode() for p in BOILERPLATE})))
_SEPARATOR = re.compile(rb"\s(?:\||>|\xc2\xbb|\xe2\x80\xba|\xc2\xb7|/)(?=\s|$)")

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, lost double, cleaned string"


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a three-word window occurring at least twice; exact for any vocabulary."""
    n = len(codes) - 2
    if n < 2:
        return 0
    if codes.max() < 1 << 21:
        windows = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    else:
        pairs = np.unique((codes[:-1] << 31) | codes[1:], return_inverse=True)[1]
        windows = (pairs[:-1] << 31) | codes[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def line_fault(line: bytes, words: list[bytes]) -> str | None:
    """The first rule that a line with words fails, or None."""
    n = len(words)
    bare = line.translate(None, SYMBOLS)
    if len(bare) != len(line):
        marked = sum(w not in (b"|", b">") and len(w.translate(None, SYMBOLS)) != len(w) for w in words)
        if marked > MAX_SYMBOL_WORDS * n:
            return "punctuation"
    if b"!!" in line and line.count(b"!!") > MAX_SHOUTED_WORDS * n:
        return "punctuation"
    if b" | " in line or b" > " in line or line.endswith(b" |") or b"\xc2\xbb" in line or b"\xe2\x80\xba" in line or b"\xc2\xb7" in line or b" / " in line:
        cuts = len(_SEPARATOR.findall(line))
        if cuts >= MIN_SEPARATORS and n - cuts <= MAX_LABEL_WORDS * (cuts + 1):
            return "navigation"
        if cuts and n - cuts <= 2 * (cuts + 1):
            return "navigation"
    if _BOILERPLATE_HINT.search(line.lower()) and _BOILERPLATE.search(line):
        return "boilerplate"
    return None


def _characters(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def examine(text: bytes) -> tuple:
    """The columns of ``SCHEMA`` after doc_id, for one text."""
    words = text.split()
    n_words = len(words)
    word_chars = _characters(b"".join(words))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    codes: dict = defaultdict()
    codes.default_factory = codes.__len__
    n_repeat = repeated_words(np.fromiter(map(codes.__getitem__, words), np.int64, n_words))
    seen: set[bytes] = set()
    kept_lines, n_dup, removed, lost = [], 0, 0, 0
    for line in text.split(b"\n"):
        line_words = line.split()
        if not line_words:
            kept_lines.append(line)
            continue
        fault = "copy" if line in seen else line_fault(line, line_words)
        n_dup += line in seen
        seen.add(line)
        if fault:
            removed += 1
            lost += _characters(b"".join(line_words))
        else:
            kept_lines.append(line)
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    share = lost / word_chars if word_chars else 0.0
    return n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, not base_failed and share <= MAX_LOST, removed, share, b"\n".join(kept_lines)


def _examine_batches(batches: Iterable[pa.RecordBatch], cleaned: bool) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        columns = list(zip(*map(examine, utf8(block.column("text"))), strict=True))
        out = [block.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in columns[:5])]
        out += [pa.array(columns[5], pa.bool_()), pa.array(columns[6], pa.bool_()), pa.array(columns[7], pa.int64()), pa.array(columns[8], pa.float64())]
        out.append(pa.array(columns[9], pa.binary()).cast(pa.string()) if cleaned else pa.nulls(block.num_rows, pa.string()))
        yield pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in SCHEMA.split(", ")])


def apply_line_rules(docs: DataFrame, cleaned: bool = True) -> DataFrame:
    """Figures, verdict and cleaned text of each row of ``docs`` (doc_id, text).

    ``cleaned`` false leaves the text null, for callers that want verdicts only.
    One narrow pass without a shuffle.
    """
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _examine_batches(it, cleaned), SCHEMA)


def _clean_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        results = [examine(x) for x in utf8(block.column("text"))]
        keep = pa.array([r[6] for r in results], pa.bool_())
        texts = pa.array([r[9] if r[7] else x for r, x in zip(results, utf8(block.column("text")), strict=True)], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([block.column("kept"), texts], names=["kept", "text"]).filter(keep)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The rows that pass, with all their columns, without the lines that fail; ``n_chars`` is counted anew."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("kept"), "text")
    clean = rows.mapInArrow(_clean_batches, T.StructType([rows.schema["kept"], T.StructField("text", T.StringType())]))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*(new.get(c, F.col("kept").getField(c)).alias(c) for c in docs.columns))
