"""Similarity self-join of texts on word shingles, with filters from several token orders.

Two texts link when the Jaccard similarity of their sets (see ``shingles``) is
at least 0.75.  ``link_documents`` gives each text its set size and the least
doc_id that is reachable from it by links; ``representatives`` keeps one row of
each component.

1. *Classes.*  One pass hashes every text to its set; equal sets are one class,
   aggregated before they are shuffled, so copies cost a row each from then on.
2. *First order.*  A global order of tokens puts common tokens last.  Counts
   come from all classes: each occurrence enters with probability 1/16, decided
   by a hash.  The order only steers how much work is done: any order gives the
   same links.  Two linked sets share a token among their first
   ``n - ceil(3n/4) + 1`` ones; those prefixes are dealt out by token, and a very
   common token by token and part.
3. *Stars.*  The pivot of a token is the class whose own tokens are the most
   common ones, which in a group of near copies is the least changed.  A class
   that meets a pivot often is compared with the one that it meets most often;
   links found here make components, and a class that isn't too far from its pivot,
   linked or not, is near it from then on.
4. *Rings.*  What a class lost and gained against its pivot decides links among
   the classes near one pivot: those within 1/4 of it are in its component, and a
   link of a class beyond needs changes in common (``_near``).  Each class without a
   link is tested against the least changed ones that share its changes, in rounds
   until few gain a link; then classes of different components meet at their first
   common change, rare ones first, where bits of parity leave enough common ones possible.  The work grows with classes times changes, not
   with pairs of a group.
5. *Crossings* join classes that aren't near one pivot.  Of a class's prefix tokens,
   only those that lie in several components can be common ones of a new link; a
   posting carries its place in the order and how many of these are left from it on.
   The first common token of a link has as many of them left, in both sets, as the
   link needs, so postings meet only at such tokens.  A class that has just a few
   tokens in common with a large group is thus not paired with its members.
6. *Filters.*  The pairs must then share enough prefix tokens in the first order,
   and in a second and a third, random order.  All three are intersected before
   whole sets are read.
7. *Verification* counts the common elements of the whole sets.

A pair is left out only if it lies in one component already or if a filter
proves that it can't link, so the components are those of all links.

Defined results: a null or empty text, or one without words, has size 0 and is
its own component; repeated rows each get a row; rows with a null doc_id are
members like any other but never name a component (unless it has only such); a
text of any length is hashed whole; an empty table gives no rows; other columns,
whatever their names, are ignored by ``link_documents`` and kept by
``representatives``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, blocks, bounded_batches, join_unique, utf8
from .components import connected_components
from .shingles import mix, set_hash, shingle_sets

#: One occurrence in this many is counted for the order of tokens.
SAMPLE = 16
#: Sampled occurrences from which a token is put behind uncounted ones.
COMMON_COUNT = 4
#: Common tokens held by the order at most (12 bytes each); the rest count as rare.
COMMON_TOKENS = 1 << 20
#: Postings of one part of a token, about; a token with more is dealt to several parts.
PART_POSTINGS = 1 << 16

#: A class is near its pivot up to this many times the weight of changes at which they just link.
NEAR = 3
#: Least changed classes that a class without a link is tested against in one round.
ASKED = 8
#: Words of 64 bits that hold which of as many groups of changes are odd in a class.
PARITY_WORDS = 8
#: Rounds end with one that gives a link to less than one in this many of the classes that gained one.
GAIN = 20

#: Text hashed at once: each byte needs about 60 while its block is hashed.
HASH_BLOCK_BYTES = 1 << 19

_SALTS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_NO_TOKENS = np.empty(0, np.uint64)
_ORDERS = ("first", "second", "third")

SETS_SCHEMA = "row_key long, doc_id long, n_shingles long, cls long, sampled array<long>"
PREFIX_SCHEMA = "cls long, n long, prefix array<long>"
MEMBER_SCHEMA = "cls long, elements array<long>, first array<int>, second array<int>, third array<int>"


def prefix_size(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def _long_lists(parts: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    values = np.concatenate([*parts, _NO_TOKENS]).astype(np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if kind is np.int64 else (values >> np.uint64(32)).astype(np.uint32).view(np.int32)))


def _hash_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sampled_before: set[int] = set()
    for block in blocks(batches, "text", HASH_BLOCK_BYTES):
        sets = shingle_sets(utf8(block.column("text")))
        classes, samples = [], []
        for elements in sets:
            cls = set_hash(elements)
            new = cls not in sampled_before
            sampled_before.add(cls)
            classes.append(cls)
            samples.append(elements[mix(elements ^ np.uint64(cls & (2**64 - 1))) % np.uint64(SAMPLE) == 0] if new else _NO_TOKENS)
        yield pa.RecordBatch.from_arrays(
            [block.column("row_key"), block.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(classes, pa.int64()), _long_lists(samples)],
            names=["row_key", "doc_id", "n_shingles", "cls", "sampled"],
        )


class TokenOrder:
    """Common tokens by rising count, after all others in order of their hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    def prefix(self, elements: np.ndarray) -> np.ndarray:
        """The first tokens of a sorted set in this order, as many as a link needs."""
        size = prefix_size(len(elements))
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, elements), len(self.tokens) - 1)
            count = np.where(self.tokens[at] == elements, self.counts[at], 0)
            if count.any():
                return elements[np.argsort(count, kind="stable")[:size]]
        return elements[:size]


def _random_prefix(elements: np.ndarray, salt: np.uint64) -> np.ndarray:
    return np.sort(mix(elements ^ salt))[: prefix_size(len(elements))]


def _prefixes(batches: Iterable[pa.RecordBatch], order) -> Iterator[pa.RecordBatch]:
    """Prefixes of each class in the first order, once for each task."""
    seen: set[int] = set()
    for block in blocks(batches, "text", HASH_BLOCK_BYTES):
        classes, sizes, parts = [], [], []
        for elements in shingle_sets(utf8(block.column("text"))):
            if len(elements) and (cls := set_hash(elements)) not in seen:
                seen.add(cls)
                classes.append(cls)
                sizes.append(len(elements))
                parts.append(order.value.prefix(elements))
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), _long_lists(parts)], names=["cls", "n", "prefix"])


def _members(batches: Iterable[pa.RecordBatch], order) -> Iterator[pa.RecordBatch]:
    """Whole sets of the wanted classes, with their prefixes in three orders."""
    seen: set[int] = set()
    for block in blocks(batches, "text", HASH_BLOCK_BYTES):
        classes, parts = [], []
        for wanted, elements in zip(block.column("cls").to_pylist(), shingle_sets(utf8(block.column("text"))), strict=True):
            if wanted not in seen and set_hash(elements) == wanted:
                seen.add(wanted)
                classes.append(wanted)
                parts.append(elements)
        prefixes = [[order.value.prefix(x) for x in parts], *([_random_prefix(x, salt) for x in parts] for salt in _SALTS)]
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), _long_lists(parts), *(_long_lists(x, np.int32) for x in prefixes)], names=["cls", "elements", *_ORDERS])


def _sizes_allow(a: Column, b: Column) -> Column:
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def _needed_overlap(a: Column, b: Column) -> Column:
    """The least common size at which the similarity is 3/4: ceil(3 (a + b) / 7)."""
    return F.floor((3 * (a + b) + 6) / 7)


def _rest(a: Column, b: Column) -> Column:
    """Common tokens that two linked sets may have outside their common prefix tokens, at most.

    They lie past the prefix of the set whose prefix ends first.
    """
    return F.greatest(F.floor((3 * a + 3) / 4), F.floor((3 * b + 3) / 4)) - 1


def _prefix_needs(a: Column, b: Column) -> Column:
    """Common prefix tokens of two linked sets, at least."""
    return F.greatest(_needed_overlap(a, b) - _rest(a, b), F.lit(1))


def _least_need(n: Column, lo: Column, hi: Column) -> Column:
    """A bound of ``_prefix_needs`` for all sizes from ``lo`` to ``hi``; null where no such size can link.

    The need rises up to equal sizes and falls from there on, but for one by rounding.
    """
    lo, hi = F.greatest(lo, F.floor((3 * n + 3) / 4)), F.least(hi, F.floor(4 * n / 3))
    return F.when(lo <= hi, F.least(_prefix_needs(n, lo), _prefix_needs(n, hi)) - 1)


def _with_sets(pairs: DataFrame, members: DataFrame, *columns: str) -> DataFrame:
    """Pairs (u, v) with these columns of both members, named by ``_u`` and ``_v``."""
    side = lambda at: members.select(F.col("cls").alias(at), *(F.col(c).alias(f"{c}_{at}") for c in columns))
    return pairs.join(side("v"), "v").join(side("u"), "u")


def _passes() -> Column:
    """Whether a pair shares enough prefix tokens in all three orders."""
    # the prefixes hold halves of hashes, so that clashes can only let a pair pass
    size = lambda at: F.size(f"first_{at}").cast("long")
    shared = lambda name: F.size(F.array_intersect(f"{name}_u", f"{name}_v")) + _clashes(name)
    need = _prefix_needs(F.col("n_u"), F.col("n_v"))
    passed = F.lit(True)
    for name in reversed(_ORDERS):
        passed = F.when(F.least(size("u"), size("v")) < need, False).when(shared(name) < need, False).otherwise(passed)
    return passed


def _verified(pairs: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """Those pairs (u, v) whose whole sets link; only pairs that pass in all orders read them."""
    counted = _with_sets(pairs.select("u", "v", "n_u", "n_v"), members, *_ORDERS)
    likely = scratch.save(counted.filter(_passes()).select("u", "v", "n_u", "n_v"), "likely")
    whole = _with_sets(likely, members, "elements")
    links = scratch.save(whole.filter(F.size(F.array_intersect("elements_u", "elements_v")) >= _needed_overlap(F.col("n_u"), F.col("n_v"))).select("u", "v").distinct(), "links")
    scratch.drop(likely)
    return links


def _clashes(name: str) -> Column:
    """Tokens that fell together when halved, so that the count is never too low."""
    lost = lambda c: F.size(c) - F.size(F.array_distinct(c))
    return lost(f"{name}_u") + lost(f"{name}_v")


def _load_members(docs: DataFrame, pairs: DataFrame, classes: DataFrame, order, scratch: Scratch) -> DataFrame:
    """Whole sets and prefixes of the classes in pairs, each from one row of ``docs``."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct().join(classes, "cls").select("cls", "row_key")
    return scratch.save(docs.join(wanted, "row_key").select("cls", "text").mapInArrow(lambda it: _members(it, order), MEMBER_SCHEMA), "members")


def _posted(docs: DataFrame, order, hot: DataFrame | None) -> DataFrame:
    """token, part, cls, n, place and rows (of the token) of prefix tokens that may lie in several classes."""
    postings = docs.mapInArrow(lambda it: _prefixes(it, order), PREFIX_SCHEMA).select("cls", "n", F.posexplode("prefix").alias("place", "token"))
    postings = postings.withColumn("part", F.lit(0)) if hot is None else postings.join(F.broadcast(hot), "token", "left").withColumn("part", F.coalesce(F.pmod("cls", "parts"), F.lit(0)).cast("int"))
    whole = W.partitionBy("token", "part")
    several = F.min("cls").over(whole) != F.max("cls").over(whole)
    counted = postings.withColumn("several", several if hot is None else several | F.col("parts").isNotNull()).withColumn("rows", F.count(F.lit(1)).over(whole)).filter("several")
    return counted.groupBy("token", "part", "cls").agg(F.min("n").alias("n"), F.min("place").alias("place"), F.min("rows").alias("rows"))


def _stars(shared: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(u, v, n_u, n_v): each class v with the pivot u that it meets most often, in half the tokens of a link at least."""
    central = shared.groupBy("cls").agg(F.sum("rows").alias("weight"))
    weighed = shared.select("token", "part", "cls", "n").join(central, "cls")
    rank = F.struct("weight", "cls", "n")
    best = F.max(rank).over(W.partitionBy("token", "part"))
    if hot is None:
        met = weighed.withColumn("pivot", best)
    else:  # one pivot for all parts of a token
        tops = weighed.join(F.broadcast(hot.select("token")), "token", "left_semi").groupBy("token").agg(F.max(rank).alias("top"))
        met = weighed.withColumn("pivot", best).join(F.broadcast(tops), "token", "left").withColumn("pivot", F.coalesce("top", "pivot"))
    met = met.select("cls", "n", F.col("pivot.cls").alias("u"), F.col("pivot.n").alias("n_u")).filter("cls <> u").groupBy("cls", "n", "u", "n_u").count()
    met = met.filter(_sizes_allow(F.col("n"), F.col("n_u")) & (2 * F.col("count") >= _prefix_needs(F.col("n"), F.col("n_u"))))
    return met.groupBy("cls", "n").agg(F.max(F.struct("count", "u", "n_u")).alias("most")).select("most.u", F.col("cls").alias("v"), "most.n_u", F.col("n").alias("n_v"))


def _near(stars: DataFrame, members: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links of stars, and (hub, cls, h, weight, changes) of classes near their pivots.

    With l elements of the hub's h lost and m gained, the weight is 4l + 3m.  A class
    links to its hub if its weight is at most h, and two classes near one hub if 7 times
    the number of their common changes is at least the sum of their weights minus h:
    this is 7 |A and B| >= 3 (|A| + |B|) in these terms.
    """
    compared = _with_sets(stars.select("u", "v", "n_u", "n_v"), members, "elements", *_ORDERS)
    compared = compared.withColumn("shared", F.size(F.array_intersect("elements_u", "elements_v")).cast("long")).withColumn("weight", 4 * F.col("n_u") + 3 * F.col("n_v") - 7 * F.col("shared"))
    changes = F.concat(F.array_except("elements_u", "elements_v"), F.array_except("elements_v", "elements_u"))
    links = (F.col("weight") <= F.col("n_u")) & _passes()
    compared = compared.filter(links | (F.col("weight") <= NEAR * F.col("n_u")))
    near = scratch.save(compared.select(F.col("u").alias("hub"), F.col("v").alias("cls"), F.col("n_u").alias("h"), "weight", links.alias("links"), changes.alias("changes")), "near")
    return near.filter("links").select(F.col("hub").alias("u"), F.col("cls").alias("v")), near.drop("links")


def _shared_needs(x: str, v: str) -> Column:
    """Common changes of two classes near one hub that link, at least."""
    return F.ceil((F.col(f"{x}weight") + F.col(f"{v}weight") - F.col(f"{x}h")) / 7)


def _most_shared(x: str, v: str) -> Column:
    """Common changes of two classes at most: an odd group of one that is even in the other holds a change that only one of them has."""
    differ = sum((F.bit_count(F.col(f"{x}odd{k}").bitwiseXOR(F.col(f"{v}odd{k}"))) for k in range(PARITY_WORDS)), F.lit(0))
    return F.least(f"{x}size", f"{v}size", F.floor((F.col(f"{x}size") + F.col(f"{v}size") - differ) / 2))


def _tested(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """Those pairs (hub, x, v) of classes near one hub that link, as (u, v)."""
    side = lambda at: near.select("hub", F.col("cls").alias(at), F.col("h").alias(f"{at}h"), F.col("weight").alias(f"{at}weight"), F.col("changes").alias(f"{at}changes"))
    both = pairs.join(side("v"), ["hub", "v"]).join(side("x"), ["hub", "x"])
    return both.filter(F.size(F.array_intersect("xchanges", "vchanges")) >= _shared_needs("x", "v")).select(F.col("x").alias("u"), "v").distinct()


def _rings(near: DataFrame, links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Components of the links of stars and of all links among classes near one hub, and the links found.

    A link between two components has a class beyond its hub's links (weight over h), so it
    needs at least (weight + 1) / 7 common changes for the other one, and, as
    weights are at least 3 a change, (weight - h) / 4 for the class beyond.
    """
    far = near.filter("weight > h")
    found = connected_components(links, scratch)
    if far.isEmpty():
        return found, links
    posted = near.join(far.select("hub").distinct(), "hub", "left_semi").select("hub", "cls", "h", "weight", F.size("changes").cast("long").alias("size"), F.explode("changes").alias("change"))
    posted = scratch.save(posted.withColumn("key", F.xxhash64("hub", "change")).drop("change"), "changes")
    counted = join_unique(posted, posted.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "key")
    word, bit = F.pmod("key", F.lit(64 * PARITY_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("key", F.lit(64)).cast("int"))
    odd = {f"odd{k}": F.bit_xor(F.when(F.floor(word / 64) == k, bit).otherwise(0)).over(W.partitionBy("hub", "cls")) for k in range(PARITY_WORDS)}
    placed = counted.withColumns(odd).withColumn("place", F.row_number().over(W.partitionBy("hub", "cls").orderBy("rows", "key")) - 1)
    room = F.col("size") - F.col("place")  # changes at or behind this one
    placed = placed.withColumn("meets", room >= F.ceil((F.col("weight") + 1) / 7)).withColumn("asks", (F.col("weight") > F.col("h")) & (room >= F.ceil((F.col("weight") - F.col("h")) / 4)))
    placed = scratch.save(placed.filter("rows > 1 and (meets or asks)").drop("rows"), "placed")
    scratch.drop(posted)

    known = ["h", "weight", "size", *odd]
    turn, gained, total = 0, 1, 0
    while gained * GAIN > total:
        turn += 1
        linked = links.select(F.explode(F.array("u", "v")).alias("cls")).distinct()
        free = scratch.save(placed.filter("asks").join(linked, "cls", "left_anti"), "asking")
        least = placed.filter("meets").groupBy("key").agg(F.min(F.struct("weight", F.xxhash64("cls", F.lit(turn)).alias("turn"), "cls", "h", "size", *odd)).alias("least"))
        met = join_unique(free, least, "key").filter("least.cls <> cls").select("hub", F.col("cls").alias("x"), F.col("least.cls").alias("v"), *(F.col(c).alias(f"x{c}") for c in known), *(F.col(f"least.{c}").alias(f"v{c}") for c in known))
        met = met.filter(_most_shared("x", "v") >= _shared_needs("x", "v")).groupBy("hub", "x", "v").count()
        asked = met.withColumn("rank", F.row_number().over(W.partitionBy("x").orderBy(F.desc("count"), "v"))).filter(F.col("rank") <= ASKED).select("hub", "x", "v")
        more = scratch.save(_tested(asked, near), "ring-links")
        gained = more.select("u").distinct().count()
        total += gained
        scratch.drop(free)
        links = links.union(more)
    found = connected_components(links, scratch)

    rooted = placed.join(found.withColumnRenamed("u", "cls"), "cls", "left").withColumn("root", F.coalesce("v", "cls")).drop("v")
    side = lambda at, role: rooted.filter(role).select("key", "hub", *(F.col(c).alias(f"{at}{c}") for c in ("cls", "root", *known)), (F.col("size") - F.col("place")).alias(f"{at}room"))
    pairs = side("x", "asks").join(side("v", "meets"), ["key", "hub"]).filter("xroot <> vroot").filter(F.least("xroom", "vroom", _most_shared("x", "v")) >= _shared_needs("x", "v"))
    pairs = scratch.save(pairs.select("hub", F.col("xcls").alias("x"), F.col("vcls").alias("v")).distinct(), "ring-pairs")
    more = scratch.save(_tested(pairs, near), "ring-links")
    scratch.drop(placed, pairs)
    links = links.union(more)
    return connected_components(found.select("u", "v").union(more), scratch), links


def _homes(near: DataFrame) -> DataFrame:
    """(cls, home): the one hub that a class is near; a hub that is near no other is its own."""
    homes = near.select("cls", F.lit(1).alias("of"), F.col("hub").alias("home")).union(near.select("hub", F.lit(0), "hub").distinct())
    return homes.groupBy("cls").agg(F.max(F.struct("of", "home")).alias("home")).select("cls", "home.home")


def _crossings(shared: DataFrame, found: DataFrame, homes: DataFrame, hot: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(u, v, n_u, n_v): pairs from different components and hubs that the first common token allows to link."""
    rooted = shared.select("token", "part", "cls", "n", "place").join(found.withColumnRenamed("u", "cls"), "cls", "left").withColumn("root", F.coalesce("v", "cls")).drop("v").join(homes, "cls", "left")
    least_most = [side(c).alias(f"{at}_{c}") for c in ("root", "home") for at, side in (("first", F.min), ("last", F.max))]
    tokens = rooted.groupBy("token").agg(*least_most, F.bool_or(F.isnull("home")).alias("homeless"), F.min("n").alias("lo"), F.max("n").alias("hi")).filter("first_root <> last_root and (homeless or first_home <> last_home)")
    rooted = rooted.join(tokens.select("token", "lo", "hi"), "token")
    rooted = rooted.withColumn("left", F.count(F.lit(1)).over(W.partitionBy("cls").orderBy(F.desc("place"))))  # tokens at or behind this one
    rooted = scratch.save(rooted.filter(F.col("left") >= _least_need(F.col("n"), F.col("lo"), F.col("hi"))).drop("lo", "hi"), "rooted")
    a, b = rooted, rooted
    if hot is not None:  # each part of a token meets all its parts
        b = rooted.drop("part").join(F.broadcast(hot), "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    a, b = a.alias("a"), b.alias("b")
    n_u, n_v = F.col("a.n"), F.col("b.n")
    elements = F.least(n_u - F.col("a.place"), n_v - F.col("b.place"))  # of the whole sets, at or behind the token
    may_link = _sizes_allow(n_u, n_v) & (F.least("a.left", "b.left") >= _prefix_needs(n_u, n_v)) & (elements >= _needed_overlap(n_u, n_v))
    apart = (F.col("a.cls") < F.col("b.cls")) & (F.col("a.root") != F.col("b.root")) & F.coalesce(F.col("a.home") != F.col("b.home"), F.lit(True))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.part") == F.col("b.part")) & apart & may_link)
    return scratch.save(pairs.select(F.col("a.cls").alias("u"), F.col("b.cls").alias("v"), n_u.alias("n_u"), n_v.alias("n_v")).distinct(), "pairs"), rooted


def _linked(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """row_key, doc_id, n_shingles, root (a class; null without words) and component_id of every row of ``docs`` (row_key, doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    hashed = scratch.save(docs.mapInArrow(_hash_sets, SETS_SCHEMA), "hashed")

    sampled = hashed.filter(F.size("sampled") > 0).groupBy("cls").agg(F.first("sampled").alias("sampled"))
    common = sampled.select(F.explode("sampled").alias("token")).groupBy("token").count().filter(F.col("count") >= COMMON_COUNT)
    common = common.orderBy(F.desc("count"), "token").limit(COMMON_TOKENS).toPandas()
    order = spark.sparkContext.broadcast(TokenOrder(common["token"].to_numpy(np.int64).view(np.uint64), common["count"].to_numpy(np.int64)))
    common["parts"] = (common["count"] * SAMPLE // PART_POSTINGS + 1).astype(np.int32)
    common = common[common["parts"] > 1]
    hot = spark.createDataFrame(common[["token", "parts"]], "token long, parts int") if len(common) else None

    classes = scratch.save(hashed.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.min("row_key").alias("row_key")), "classes")
    shared = scratch.save(_posted(docs, order, hot), "shared")
    stars = scratch.save(_stars(shared, hot), "star-pairs")
    members = _load_members(docs, stars, classes, order, scratch)
    links, near = _near(stars, members, scratch)
    scratch.drop(members, stars)
    found, links = _rings(near, links, scratch)

    pairs, rooted = _crossings(shared, found, _homes(near), hot, scratch)
    scratch.drop(shared, rooted, near)
    members = _load_members(docs, pairs, classes, order, scratch)
    more = _verified(pairs, members, scratch)
    scratch.drop(members, pairs)
    parents = connected_components(found.select("u", "v").union(more), scratch)
    scratch.drop(found, more)

    named = classes.join(parents.withColumnRenamed("u", "cls"), "cls", "left").select("cls", "least_id", F.coalesce("v", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select("cls", "root", "component_id")
    full = hashed.select("row_key", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cls")).alias("cls")).join(named, "cls", "left")
    return full.select("row_key", "doc_id", "n_shingles", "root", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _row_key() -> Column:
    """A key of a row that is never null, alike for rows with equal ids and texts only."""
    return F.xxhash64("doc_id", "text").alias("row_key")


def link_documents(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    return _linked(docs.select(_row_key(), "doc_id", "text"), scratch).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One whole row of each component: that of the least doc_id, nulls last, and the least key.

    Rows without words are components of their own and stay.  Rows with equal ids
    and texts are one document; of those that differ in other columns, the one
    with the least hash of the row stays.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    linked = _linked(docs.select(_row_key(), "doc_id", "text"), scratch)
    first = linked.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")).select("first.row_key")
    chosen = first.union(linked.filter("n_shingles = 0").select("row_key").distinct())
    rows = docs.select(_row_key(), F.struct("*").alias("row")).join(chosen, "row_key", "left_semi")
    return rows.groupBy("row_key").agg(F.min_by("row", F.xxhash64(F.to_json("row", {"ignoreNullFields": "false"}))).alias("row")).select("row.*")
