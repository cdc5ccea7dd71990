"""Byte-level BPE by Spark higher-order functions over the distinct words of text blocks.

1. ``shared_words``: the words that occur in most blocks, counted in a hashed
   quarter of the documents and bounded by ``SHARED_BYTES`` whatever the size of
   the input, are folded once (by step 3) and broadcast.
2. ``index_words`` (Arrow): the pattern's matches of each text become codes into
   the block's dictionary of distinct words; a word is a shared one, or the array
   of its bytes' ranks, or its own rank if it is a token.
3. ``encode_words`` (Spark columns): each distinct word is folded by ranked
   merges.  The state holds the pieces' ids and the ranks of neighbouring pairs;
   a step joins the leftmost pair of the least rank.  Ranks come from a literal
   map of pairs, dealt into small maps so that a look-up is of constant cost.
   Decoding concatenates the binary pieces of the ids.
4. ``assemble`` (Arrow): each text's ids and decoded bytes, by its codes.

Blocks hold about 8 MB of text.  Which words are shared decides how often a word
is folded, never its ids: a word that is not shared is folded once in each block
that holds it.  No text is shuffled or collected.

Defined results: a null or empty text has no ids; repeated rows each get their
row, also with a null or repeated doc_id; special strings are ordinary text; a
text longer than a block is a block of its own; an empty table gives no rows;
other columns, whatever their names, are ignored.  A word over ``LONG_WORD``
bytes (a match without any break) is merged with a heap instead, as each step of
the column fold costs the length of the word.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, give_back

VOCABULARY_BLOCK_BYTES = 8 << 20
#: Bytes of all shared words at most, with 8 bytes more for each.
SHARED_BYTES = 16 << 20
#: One document in this many is counted to choose the shared words, which lie in at least so many of its blocks.
SAMPLE, LEAST_FOUND = 4, 2
#: Words folded in one row, and rows of words in one task, about.
FOLD_WORDS, FOLD_ROWS = 1024, 8
OUTPUT_BLOCK_BYTES = 1 << 20
#: Bytes of text that Spark hands to a worker at once; the block is what a worker holds.
INPUT_BATCH_BYTES = 1 << 20
#: A prime, so that pairs spread evenly.
RANK_BUCKETS = 32_749
LONG_WORD = 1000
#: Rank of pairs that are no token.
NO_RANK = 2**31 - 1

#: Pairs of ids as one number: the left one times this, plus the right one.
PAIR_BASE = 1 << 17
#: Pieces of a word at most: over ``LONG_WORD``.
PLACES = 1 << 12

INDEXED_SCHEMA = "doc_ids array<long>, matches array<int>, codes binary, known binary, words array<array<int>>, long_words array<struct<code:int,word:binary>>"
WORDS_SCHEMA = "words array<array<int>>, spelled array<binary>"
ENCODED_SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


# ------------------------------------------------------------------ 1. and 2. words


#: Letters and numbers below U+0250, and what is beyond (or white space to Python alone).
_LATIN_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LATIN_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_NOT_LATIN = re.compile("[^\0-\x1b\x20-\u024f]")


@cache
def matcher(pattern: str):
    """All matches of the pattern in a text.

    Texts of Latin letters go through Python's own engine with the classes spelled
    out, which is twice as fast and gives the same matches.
    """
    import regex

    full = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LATIN_LETTERS}{_LATIN_NUMBERS}]").replace(r"\p{L}", f"[{_LATIN_LETTERS}]").replace(r"\p{N}", f"[{_LATIN_NUMBERS}]")
    if r"\p" in plain:
        return full
    latin = re.compile(plain).findall
    return lambda text: latin(text) if _NOT_LATIN.search(text) is None else full(text)


class _Block:
    """Texts of one block as codes into its dictionary of matches."""

    def __init__(self, pattern: str) -> None:
        self.find = matcher(pattern)
        self.words: dict = defaultdict()
        self.words.default_factory = self.words.__len__
        self.doc_ids: list = []
        self.matches: list[int] = []
        self.codes = array("I")
        self.held = 0

    def add(self, doc_id: int | None, text: str) -> None:
        found = self.find(text)
        self.codes.extend(map(self.words.__getitem__, found))
        self.doc_ids.append(doc_id)
        self.matches.append(len(found))
        self.held += len(text)

    def batch(self, ranks: dict[bytes, int], shared: pa.Array) -> pa.RecordBatch:
        data = [w.encode() for w in self.words]
        known = pc.fill_null(pc.index_in(pa.array(data, pa.binary()), value_set=shared), -1).to_numpy(zero_copy_only=False).astype("<i4")
        longs = [{"code": k, "word": w} for k, w in enumerate(data) if len(w) > LONG_WORD]
        words = _as_ids([data[k] for k in np.flatnonzero(known < 0)], ranks)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.doc_ids], pa.list_(pa.int64())),
                pa.array([self.matches], pa.list_(pa.int32())),
                pa.array([self.codes.tobytes()], pa.binary()),
                pa.array([known.tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                pa.array([longs], pa.list_(pa.struct([("code", pa.int32()), ("word", pa.binary())]))),
            ],
            names=["doc_ids", "matches", "codes", "known", "words", "long_words"],
        )


def _as_ids(words: list[bytes], ranks: dict[bytes, int]) -> pa.ListArray:
    """What is folded: the ranks of a word's bytes, or its own rank; nothing for a long word."""
    own = [ranks.get(w) for w in words]
    parts = [b"" if r is not None or len(w) > LONG_WORD else w for w, r in zip(words, own, strict=True)]
    of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    # tokens stand for themselves: one id each, between the bytes of other words
    lengths = np.fromiter((len(w) + (r is not None) for w, r in zip(parts, own, strict=True)), np.int64, len(parts))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.empty(int(offsets[-1]), np.int32)
    single = np.zeros(len(flat), bool)
    single[offsets[np.fromiter((k for k, r in enumerate(own) if r is not None), np.int64)]] = True
    flat[single] = [r for r in own if r is not None]
    flat[~single] = of_byte[np.frombuffer(b"".join(parts), np.uint8)]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def _index(batches: Iterable[pa.RecordBatch], pattern: str, path: str, limit: int, shared) -> Iterator[pa.RecordBatch]:
    pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between blocks
    ranks, block = load_ranks(path), _Block(pattern)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            block.add(doc_id, text or "")
            if block.held >= limit:
                yield block.batch(ranks, shared.value)
                block = _Block(pattern)
                give_back()
    if block.doc_ids:
        yield block.batch(ranks, shared.value)
        block = None
    give_back()


def index_words(docs: DataFrame, pattern: str, rank_path: str, shared, limit: int = VOCABULARY_BLOCK_BYTES) -> DataFrame:
    """A row for each block of texts: ids, matches of each text, codes, places among the shared words, and all other distinct words."""
    bounded_batches(docs.sparkSession, INPUT_BATCH_BYTES)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _index(it, pattern, rank_path, limit, shared), INDEXED_SCHEMA)


def _distinct(batches: Iterable[pa.RecordBatch], pattern: str, path: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The distinct words of each block that are no tokens."""
    find, ranks, words, held = matcher(pattern), load_ranks(path), set(), 0

    def out() -> pa.RecordBatch:
        data = [w for w in map(str.encode, words) if w not in ranks and len(w) <= LONG_WORD]
        return pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["word"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            words.update(find(text or ""))
            held += len(text or "")
            if held >= limit:
                yield out()
                words, held = set(), 0
    yield out()


def _spelled(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    ranks = load_ranks(path)
    for batch in batches:
        for at in range(0, batch.num_rows, FOLD_WORDS):
            words = batch.column("word")[at : at + FOLD_WORDS]
            ends = pa.array([0, len(words)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, _as_ids(words.to_pylist(), ranks)), pa.ListArray.from_arrays(ends, words)], names=["words", "spelled"])


def shared_words(docs: DataFrame, pattern: str, rank_path: str, limit: int, scratch: Scratch) -> pa.Table:
    """word, ids and decoded of the words found in most blocks, within ``SHARED_BYTES``."""
    bounded_batches(docs.sparkSession, INPUT_BATCH_BYTES)
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0).select("text")
    found = scratch.save(some.mapInArrow(lambda it: _distinct(it, pattern, rank_path, limit), "word binary").groupBy("word").agg(F.count(F.lit(1)).alias("found")), "words")
    # a word is found once a block at most, so the blocks bound the rows of this sum
    sums = found.groupBy("found").agg(F.sum(F.octet_length("word") + 8).alias("bytes"), F.count(F.lit(1)).alias("words")).filter(F.col("found") >= LEAST_FOUND).orderBy(F.desc("found"))
    least, held, words = None, 0, 0
    for row in sums.toLocalIterator():
        if held + row["bytes"] > SHARED_BYTES:
            break
        least, held, words = row["found"], held + row["bytes"], words + row["words"]
    chosen = found.filter(F.lit(False) if least is None else F.col("found") >= least).select("word")
    tasks = -(-words // (FOLD_WORDS * FOLD_ROWS)) or 1
    folded = encode_words(chosen.repartition(tasks).mapInArrow(lambda it: _spelled(it, rank_path), WORDS_SCHEMA), load_ranks(rank_path))
    rows = folded.select(F.explode(F.arrays_zip("spelled", "word_ids", "word_bytes")).alias("x"))
    table = rows.select(F.col("x.spelled").alias("word"), F.col("x.word_ids").alias("ids"), F.col("x.word_bytes").alias("decoded")).toArrow()
    scratch.drop(found)
    return table


# ------------------------------------------------------------------ 3. merges


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of each pair of tokens that joins to a token."""
    out = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
            if left is not None and right is not None:
                out[left * PAIR_BASE + right] = rank
    return out


def rank_literal(ranks: dict[bytes, int], buckets: int = RANK_BUCKETS) -> Column:
    """The rank map of pairs as a constant: an array, by the pair modulo ``buckets``, of small maps."""
    parts: list[dict[str, list[int]]] = [{"k": [], "v": []} for _ in range(buckets)]
    for pair, rank in pair_ranks(ranks).items():
        parts[pair % buckets]["k"].append(pair)
        parts[pair % buckets]["v"].append(rank)
    read = F.from_json(F.lit(json.dumps(parts, separators=(",", ":"))), "array<struct<k:array<bigint>,v:array<int>>>")
    return F.transform(read, lambda part: F.map_from_arrays(part["k"], part["v"]))


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """The pieces by id as a constant array of binaries."""
    by_rank = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        by_rank[rank] = piece
    return F.transform(F.from_json(F.lit(json.dumps([base64.b64encode(p).decode() for p in by_rank])), "array<string>"), F.unbase64)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_word(word: Column, pairs: Column, buckets: int = RANK_BUCKETS) -> Column:
    """Ids of one word (an array of ids) after all ranked merges."""

    def rank(left: Column, right: Column) -> Column:
        look_up = lambda pair: F.coalesce(F.element_at(F.element_at(pairs, (pair % buckets + 1).cast("int")), pair), F.lit(NO_RANK))
        return _let(left.cast("long") * PAIR_BASE + right, look_up)

    n = F.size(word)
    none = F.array().cast("array<int>")
    start = F.struct(word.alias("ids"), F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.element_at(word, i), F.element_at(word, i + 1))).alias("ranks"))

    def joined(*parts: Column) -> Column:
        return F.flatten(F.array(*parts))  # many times as fast as concat, which goes through lazy lists

    def merge(state: Column, least: Column, p: Column) -> Column:
        ids, ranks = state["ids"], state["ranks"]
        k = F.size(ids)
        return F.struct(
            joined(F.slice(ids, F.lit(1), p - 1), F.array(least), F.slice(ids, p + 2, k)).alias("ids"),
            joined(
                F.when(p > 2, F.slice(ranks, F.lit(1), p - 2)).otherwise(none),
                F.when(p > 1, F.array(rank(F.element_at(ids, F.greatest(p - 1, F.lit(1))), least))).otherwise(none),
                F.when(p + 1 < k, F.array(rank(least, F.element_at(ids, F.least(p + 2, k))))).otherwise(none),
                F.slice(ranks, p + 2, k),
            ).alias("ranks"),
        )

    def step(state: Column, _: Column) -> Column:
        # rank and place in one number: array_position would leave its loop by an exception, which costs more than all else
        placed = F.array_min(F.transform(state["ranks"], lambda rank, i: rank.cast("long") * PLACES + i))

        def join(least: Column) -> Column:
            merged = _let((least % PLACES + 1).cast("int"), lambda p: merge(state, F.element_at(state["ranks"], p), p))
            return F.when(F.coalesce(least, F.lit(NO_RANK * PLACES)) >= NO_RANK * PLACES, state).otherwise(merged)

        return _let(placed, join)

    return F.when(n < 2, word).otherwise(F.aggregate(F.sequence(F.lit(1), n - 1), start, step, lambda state: state["ids"]))


def decode_ids(ids: Column, pieces: Column) -> Column:
    """The bytes of ids: their pieces, concatenated."""
    return F.aggregate(ids, F.lit(b""), lambda done, i: F.concat(done, F.element_at(pieces, i + 1)))


def encode_words(indexed: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Ids of every distinct word, and what they decode to, in place of the words."""
    # each constant stands in the plan once: inside, it is a lambda variable
    with_ids = indexed.withColumn("word_ids", _let(rank_literal(ranks), lambda pairs: F.transform("words", lambda w: fold_word(w, pairs)))).drop("words")
    return with_ids.withColumn("word_bytes", _let(piece_literal(ranks), lambda pieces: F.transform("word_ids", lambda ids: decode_ids(ids, pieces))))


# ------------------------------------------------------------------ 4. texts


def merge_long_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, for words of any length."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end, alive = list(range(1, n + 1)), [True] * n
    queue: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(queue, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        alive[j] = False
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


@cache
def _pieces(path: str) -> dict[int, bytes]:
    return {rank: piece for piece, rank in load_ranks(path).items()}


def _slices(values: bytes, offsets: np.ndarray, width: int) -> list[bytes]:
    at = ((offsets - offsets[0]) * width).tolist()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _fill(shared: tuple[pa.Array, pa.Array], known: np.ndarray, ids_of: list, bytes_of: list) -> None:
    """Puts ids and decoded bytes of the words with a place into the lists by code."""
    codes = np.flatnonzero(known >= 0)
    ids, decoded = (values.take(pa.array(known[codes])) for values in shared)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    for code, own, spelled in zip(codes.tolist(), _slices(flat, ids.offsets.to_numpy(), 4), decoded.to_pylist(), strict=True):
        ids_of[code], bytes_of[code] = own, spelled


def _assemble(batches: Iterable[pa.RecordBatch], path: str, shared) -> Iterator[pa.RecordBatch]:
    pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between blocks
    for batch in batches:
        for row in range(batch.num_rows):
            column = lambda name, row=row, batch=batch: batch.column(name)[row].values
            known = np.frombuffer(batch.column("known")[row].as_py(), "<i4")
            ids_of, bytes_of = [b""] * len(known), [b""] * len(known)
            _fill(shared.value, known, ids_of, bytes_of)
            word_ids = column("word_ids")
            flat = word_ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            for code, ids, decoded in zip(np.flatnonzero(known < 0).tolist(), _slices(flat.tobytes(), word_ids.offsets.to_numpy(), 4), column("word_bytes").to_pylist(), strict=True):
                ids_of[code], bytes_of[code] = ids, decoded
            for x in column("long_words").to_pylist():
                ids = merge_long_word(x["word"], load_ranks(path))
                ids_of[x["code"]], bytes_of[x["code"]] = np.array(ids, "<u4").tobytes(), b"".join(map(_pieces(path).__getitem__, ids))
            codes = np.frombuffer(batch.column("codes")[row].as_py(), np.uint32)
            out: list[list] = [[], [], [], []]
            at, held = 0, 0
            for doc_id, n in zip(column("doc_ids").to_pylist(), column("matches").to_pylist(), strict=True):
                own = codes[at : at + n].tolist()
                at += n
                ids, decoded = b"".join(map(ids_of.__getitem__, own)), b"".join(map(bytes_of.__getitem__, own))
                for values, value in zip(out, (doc_id, len(ids) // 4, ids, decoded), strict=True):
                    values.append(value)
                held += len(decoded)
                if held >= OUTPUT_BLOCK_BYTES:
                    yield _rows(out)
                    out, held = [[], [], [], []], 0
            yield _rows(out)
            ids_of, bytes_of, codes, flat, word_ids, out = [], [], None, None, None, None
            give_back()


def _rows(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode_and_decode(docs: DataFrame, rank_path: str, pattern: str, limit: int = VOCABULARY_BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded bytes of every text.

    ``rank_path`` is a file of base64 pieces and ranks that every worker can
    read; each match of ``pattern`` is encoded by itself.
    """
    spark = docs.sparkSession
    table = shared_words(docs, pattern, rank_path, limit, scratch or Scratch(spark, "bpe")).combine_chunks()
    words, ids, decoded = (table[c].chunk(0) if table.num_rows else pa.array([], table[c].type) for c in ("word", "ids", "decoded"))
    ids = ids.cast(pa.list_(pa.uint16())) if not len(ids) or pc.max(ids.flatten()).as_py() < 1 << 16 else ids
    # workers that index hold the words alone, and workers that assemble what stands for them
    words, values = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast((ids, decoded))
    encoded = encode_words(index_words(docs, pattern, rank_path, words, limit), load_ranks(rank_path))
    return encoded.mapInArrow(lambda it: _assemble(it, rank_path, values), ENCODED_SCHEMA)
