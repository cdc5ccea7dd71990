"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has a bit where over half of the XXH64 hashes (seed 42) of
its three-word shingles have it.  Two fingerprints link at three or fewer
differing bits.  Each distinct fingerprint emits the variants at which it can
meet another one half way, and whatever meets at a variant is verified:

* Fingerprints of equal parity differ in 2 bits, if they link.  Each emits its 64
  variants with one bit flipped; two that differ in two bits share two of them.
* Fingerprints of different parity differ in 1 or 3 bits.  The odd one is found at
  its variants with one bit flipped, the even one emits variants with two bits
  flipped.  Of three differing bits, two lie in the same half of the 64, so that
  pairs of bits within a half are enough: 992 variants instead of 2016.

That is every fingerprint's ball of half the radius, less what can't decide
anything.  A variant is met by at most 64 distinct fingerprints at one flip, and
each links with the least of them, so there are never all pairs of a group, and no
variant is a hot key, however large a group of copies is: copies are one fingerprint.
Variants with two flips are emitted and met in ``ROUNDS`` jobs, whose shuffle files go
one after the other.

Defined results: texts without words (null, empty, blank) have fingerprint 0 and
link like any other; repeated rows and ties of ids give the same component; a
component's id is its least doc_id, null only if none of its rows has one; texts of
any length are hashed whole, a megabyte at a time; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, bounded_batches, join_unique, utf8
from .components import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
#: Jobs that emit variants with two flips.
ROUNDS = 2
#: Distinct fingerprints whose variants one task emits, about.
EMITTED_PRINTS = 1 << 14
#: Bytes of a text that are split into words at once.
PIECE_BYTES = 1 << 20

_HASH = partial(xxhash.xxh64_intdigest, seed=42)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end between words."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + PIECE_BYTES)
        stop = cut.start() if cut else len(text)
        yield text[start:stop]
        start = stop


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text, unsigned; bytes.split and lower know ASCII only, as the words here do."""
    bits, n, carried = np.zeros(64, np.int64), 0, []
    for piece in _pieces(text):
        words = carried + piece.lower().split()
        hashes = np.fromiter(map(_HASH, map(b" ".join, zip(*(words[k:] for k in range(SHINGLE_WORDS)), strict=False))), np.uint64)
        if len(hashes):
            bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
        carried = words[-(SHINGLE_WORDS - 1) :]
    if not n:
        return _HASH(b" ".join(carried)) if carried else 0
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        found = np.fromiter(map(fingerprint, utf8(block.column("text"))), np.uint64, block.num_rows)
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _variants(masks: list[int]) -> Column:
    """The fingerprint with each of the masks' bits flipped, a row each."""
    return F.explode(F.transform(F.array(*map(_signed, masks)), lambda mask: F.col("fp").bitwiseXOR(mask)))


def link_fingerprints(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): links whose components are those of all links of the distinct fingerprints ``prints`` (fp, long)."""
    near = lambda: F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    prints = prints.repartition(prints.count() // EMITTED_PRINTS + 1, "fp")
    even, odd = (prints.filter(F.bit_count("fp") % 2 == k) for k in (0, 1))
    singles = _variants([1 << k for k in range(64)]).alias("variant")
    once = prints.select(singles, "fp").repartition("variant")
    met = once.groupBy("variant").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n"))
    same = once.join(met.filter("n > 1").hint("shuffle_hash"), "variant").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    found = [scratch.save(same.filter("u <> v").filter(near()).distinct(), "met-once")]
    pairs = [1 << a | 1 << b for half in (range(32), range(32, 64)) for a, b in combinations(half, 2)]
    for k in range(ROUNDS):
        twice = even.select(_variants(pairs[k::ROUNDS]).alias("variant"), "fp")
        met = odd.select(singles, "fp").groupBy("variant").agg(F.min("fp").alias("least"))
        other = twice.join(met.hint("shuffle_hash"), "variant").select(F.col("fp").alias("u"), F.col("least").alias("v"))
        found.append(scratch.save(other.filter(near()).distinct(), f"met-twice-{k}"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def link_documents(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fp (long) and component_id of every row of ``docs`` (doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    bounded_batches(docs.sparkSession)
    hashed = scratch.save(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "hashed")
    prints = scratch.save(hashed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
    parents = connected_components(link_fingerprints(prints.select("fp"), scratch), scratch)
    named = scratch.save(prints.join(parents.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "least_id", F.coalesce("v", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    rooted = scratch.save(join_unique(named.select("fp", "root"), least, "root"), "rooted")
    return join_unique(hashed, rooted.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
