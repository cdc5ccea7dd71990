"""Packing of tokenised texts into fixed sequences: first-fit decreasing by tournament tree.

Texts become token ids and one end id.  A text longer than a sequence is cut:
all full-length pieces fill a sequence alone, and what remains is packed.
Documents are dealt at random (by a keyed hash) into groups of about
``group_rows``; each group is packed on its own by first-fit decreasing, where a
tournament tree over bin capacities finds the first bin that fits in
logarithmic time.  Groups bound the memory of a task whatever the input's size,
and a hash of the id deals a hot source out evenly.

Defined results: a null or empty text is its end id alone; repeated rows are
packed each on their own; ties go in order of (length, doc_id, start); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SegmentCache, blocks, bounded_batches, strings
from .token_counts import _tokenizer

SEQUENCE_TOKENS = 2048
END_ID = 1
GROUP_ROWS = 8192
#: Words whose ids a worker remembers, and at most as many older ones.
WORDS_KEPT = 250_000
#: Sequences of one group are numbered from the group's number times this.
GROUP_STRIDE = 1 << 32

#: Letters below this are Latin, with one code point each in composed form.
_LATIN_END = "\u0250"


def _byte_letters() -> dict[int, int]:
    """The usual printable stand-ins of byte-level tokenizers: printable Latin-1 as it is, other bytes from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PIECES_SCHEMA = _PIECE + ", doc_crc32 long"
PACKED_SCHEMA = _PIECE + ", sequence_id long, offset long"


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes, remembering recent words.

    For tokenizers that lower case, drop white space and merge within words of
    letters or of other signs only: texts are cut at spaces and line feeds, and
    the ids of the pieces join to the text's.  Texts of Latin letters are first
    put in lower case, and full stops and commas that end a word are set apart:
    the tokenizer always starts a new word at such a sign.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.words = SegmentCache(self._encode_words, WORDS_KEPT)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words of lower-case Latin letters go to the merges directly, as nothing else would change them."""
        out, rest = [], []
        tokenize = self.model.tokenize
        for k, word in enumerate(words):
            if word.isalpha() and word.islower() and (word.isascii() or max(word) < _LATIN_END):
                text = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                out.append(array("I", [token.id for token in tokenize(text)]).tobytes())
            else:
                out.append(b"")
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = array("I", e.ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_words(text) for text in texts]
        known = self.words.lookup(set().union(*split))
        return [b"".join(map(known.__getitem__, words)) for words in split]


_BEYOND_LATIN = re.compile("[^\0-\u024f]")
_END_SIGN = re.compile("(?<=[a-z\u00df-\u00f6\u00f8-\u00ff])([.,])(?=[ \n]|$)")


def _words(text: str) -> list[str]:
    """Pieces whose ids join to the text's."""
    if text.isascii() or _BEYOND_LATIN.search(text) is None:
        text = _END_SIGN.sub(r" \1", text.lower())
    return text.replace("\n", " ").split(" ")


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _cut(batches: Iterable[pa.RecordBatch], path: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, end = _encoder(path), int(end_id).to_bytes(4, "little")
    for block in blocks(batches, "text"):
        rows: list[list] = [[], [], [], [], [], []]
        for doc_id, ids in zip(block.column("doc_id").to_pylist(), encoder.encode(strings(block.column("text"))), strict=True):
            ids += end
            total, key = len(ids) // 4, zlib.crc32(ids)
            for start in range(0, total, size):
                piece = ids[4 * start : 4 * (start + size)]
                for column, value in zip(rows, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total, key), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc32"])


def tokenize_and_cut(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``size`` ids: doc_id, start, length, ids_crc32, doc_tokens, and the checksum of all ids of the document."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _cut(it, tokenizer_path, size, end_id), PIECES_SCHEMA)


class CapacityTree:
    """Bins in order of opening; the first one with room is found in O(log n).

    A complete binary tree holds in each node the largest free capacity below
    it.  Bins that are not open yet have the full capacity, so opening a bin is
    the same step as filling one.
    """

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """The first bin with room for ``need``, and its free capacity before."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < need:
                node += 1
        free = best[node]
        best[node] = free - need
        chosen = node - self.leaves
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return chosen, free


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, which must come in descending order."""
    tree = CapacityTree(max(1, len(lengths)), capacity)
    bins, offsets = [], []
    for need in lengths:
        chosen, free = tree.place(need)
        bins.append(chosen)
        offsets.append(capacity - free)
    return bins, offsets


def _pack(table: pa.Table, capacity: int) -> pa.Table:
    group = table.column("pack_group")[0].as_py()
    table = table.drop_columns(["pack_group", "doc_crc32"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), capacity)
    sequence = pa.array(np.array(bins, np.int64) + group * GROUP_STRIDE)
    return table.append_column("sequence_id", sequence).append_column("offset", pa.array(offsets, pa.int64()))


def pack(pieces: DataFrame, groups: int, capacity: int = SEQUENCE_TOKENS, seed: int = 7) -> DataFrame:
    """Adds sequence_id and offset to pieces, packing ``groups`` random groups apart.

    A group takes whole documents, by a seeded hash of id and checksum, so different
    texts with one id spread too.  Shuffled rows are a few integers per piece.
    """
    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_crc32"), F.lit(max(1, groups)))
    return pieces.withColumn("pack_group", group).groupBy("pack_group").applyInArrow(lambda t: _pack(t, capacity), PACKED_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer_path: str, rows: int | None = None, group_rows: int = GROUP_ROWS, size: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Tokenises, cuts and packs ``docs``; ``rows`` is their number, counted if not given."""
    if rows is None:
        rows = docs.count()
    return pack(tokenize_and_cut(docs, tokenizer_path, size, end_id), -(-max(1, rows) // group_rows), size)
