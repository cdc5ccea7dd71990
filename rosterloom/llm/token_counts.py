"""Token counts of whole texts, by batch encoding in Arrow functions.

``count_tokens`` returns only lengths.  Arrow batches are bounded by bytes and
re-cut into slices of equal bytes, so no slice holds many long texts.  Inside a
slice every text is split at safe boundaries (see ``safe_segments``), distinct
segments are encoded in one batch, and the lengths are summed back per text.
A text of any length is thus encoded in small segments, exactly.

Defined results: a null or empty text has 0 tokens; repeated rows each get
their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SegmentCache, blocks, bounded_batches, strings, text_bytes

#: White space beyond the space and the line feed.
_OTHER_SPACE = re.compile(r"[^\S \n]")
_DOUBLE_SPACE = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def safe_segments(text: str) -> list[str]:
    """Pieces whose encodings join to the encoding of the whole text.

    A cut lies before a single space or line feed that stands between two
    characters other than white space.  The byte-level pattern always ends a
    match there: the space opens the next match, and the line feed is a match of
    its own.  No added token holds white space, so none is cut.
    """
    return _SAFE.split(text) if text else []


def _is_plain(text: str) -> bool:
    """Whether every space and line feed is a safe boundary."""
    return not (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        or (_OTHER_SPACE.search(text) is not None and _DOUBLE_SPACE.search(text) is not None)
    )


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class LengthCounter:
    """Token counts of texts with one tokenizer, remembering recent segments."""

    def __init__(self, path: str) -> None:
        self.path = path
        encode = lambda parts: [len(e) for e in _tokenizer(path).encode_batch_fast(parts, add_special_tokens=False)]
        #: Segments as they are, and words that follow a space.
        self.raw = SegmentCache(encode)
        self.spaced = SegmentCache(lambda words: encode([" " + w for w in words]))
        self.feed = encode(["\n"])[0]

    def count(self, texts: list[str]) -> list[int]:
        split: list[tuple[list, list, int]] = []
        for text in texts:
            if not text:
                split.append(([], [], 0))
            elif _is_plain(text):
                lines = text.split("\n")
                words = [line.split(" ") for line in lines]
                split.append(([w[0] for w in words], [w for line in words for w in line[1:]], len(lines) - 1))
            else:
                split.append((safe_segments(text), [], 0))
        raw = self.raw.lookup(set().union(*(a for a, _, _ in split)))
        spaced = self.spaced.lookup(set().union(*(b for _, b, _ in split)))
        return [sum(map(raw.__getitem__, a)) + sum(map(spaced.__getitem__, b)) + n * self.feed for a, b, n in split]


@cache
def _counter(path: str) -> LengthCounter:
    return LengthCounter(path)


def _count_batches(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = _counter(path)
    for block in blocks(batches, "text"):
        texts = block.column("text")
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id").cast(pa.int64()), pa.array(text_bytes(texts)), pa.array(np.array(counter.count(strings(texts)), np.int64))],
            names=["doc_id", "n_bytes", "n_tokens"],
        )


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row of ``docs`` (doc_id, text).

    ``tokenizer_path`` names a tokenizers JSON file present on every worker; its
    pre-tokenizer must be byte-level without a prefix space.  One narrow pass:
    no shuffle, and the scan reads two columns.
    """
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _count_batches(it, tokenizer_path), SCHEMA)
