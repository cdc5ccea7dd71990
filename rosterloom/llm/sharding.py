"""Balanced shards by label propagation under capacity quotas.

Documents are linked when their texts are equal.  Every document starts in a
shard drawn by hash.  Rounds of joins move linked documents to the shard where
most of their neighbours are, as far as that shard's quota of bytes allows, until
none that fits is left.
Documents of one group that are in one shard are alike to every vote, so they
vote and move as one unit: a group of any size is eight rows, and no join is
skewed by it.  Documents without links come last and even the sizes out: in
falling classes of size, each class is dealt to the shards in proportion to what
they lack, so that the last, smallest documents decide the difference.  If linked
documents alone overfill a shard, a hashed share of them is dealt out too.

Law: ``bytes`` (sizes near equal).  Slots number each shard's rows from 0.

Defined results: a null text has size 1 and is equal to other null texts only;
repeated rows are placed one by one, also with a null doc_id; ties go by hash of
the id; a text of any length counts by its size and hash alone; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch

SHARDS = 8
#: Share of an even shard that linked documents may fill.
LINKED_SHARE = 0.95
#: Rows of one window partition, about.
PART_ROWS = 50_000
#: Bytes from which documents without links count as a larger class.
SIZE_CLASSES = (1 << 15, 1 << 13, 1 << 11, 1 << 9, 0)
#: Units of one window partition, about, where units of a level are summed up.
LEVEL_UNITS = 20_000


def _sizes(df: DataFrame, key: str, value: str) -> dict[int, int]:
    """Sums by shard; at most one row a shard reaches the driver."""
    return {r[0]: int(r[1]) for r in df.groupBy(key).agg(F.sum(value)).collect()}


def _by_shard(values: dict[int, float], key: str) -> Column:
    out = F.lit(0.0)
    for shard, value in values.items():
        out = F.when(F.col(key) == shard, F.lit(float(value))).otherwise(out)
    return out


def _upto(wishes: DataFrame, level: Column, parts: int) -> DataFrame:
    """Adds ``upto``, the bytes asked of a target up to each unit, by rising ``level`` and then by hash.

    Two steps, as in ``_numbered``, so that no window holds all wishes of a target.
    """
    dealt = wishes.withColumn("level", level).withColumn("part", F.pmod(F.xxhash64("g", "start"), F.lit(parts)))
    sums = dealt.groupBy("target", "level", "part").agg(F.sum("bytes").alias("part_sum"))
    before = W.partitionBy("target").orderBy("level", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("target", "level", "part", F.coalesce(F.sum("part_sum").over(before), F.lit(0)).alias("part_start"))
    inside = W.partitionBy("target", "level", "part").orderBy(F.xxhash64("g"), "g", "start").rowsBetween(W.unboundedPreceding, 0)
    summed = dealt.withColumn("inside", F.sum("bytes").over(inside))
    return summed.join(starts, ["target", "level", "part"]).withColumn("upto", F.col("part_start") + F.col("inside"))


def propagate(units: DataFrame, cap: float, scratch: Scratch) -> DataFrame:
    """Units (g, start, shard, n, bytes) after their moves; one round is a few joins and aggregations.

    The first round grants large groups first, all others grant small units first,
    until none is left that fits.  A unit larger than what a shard has left does
    not ask, so it keeps no other out.  As a group's target only gains by moves, a
    unit moves once at most, and the rounds end.
    """
    parts = max(1, -(-units.count() // LEVEL_UNITS))
    falling = True
    while True:
        room = {t: max(0.0, cap - b) for t, b in _sizes(units, "shard", "bytes").items()}
        votes = units.groupBy("g", "shard").agg(F.sum("n").alias("n"))
        best = votes.groupBy("g").agg(F.max_by("shard", F.struct("n", F.xxhash64("g", "shard"))).alias("target"))
        wishes = units.join(best, "g").filter("shard <> target").filter(F.col("bytes") <= _by_shard(room, "target"))
        level = F.floor(F.log2("n" if falling else "bytes")).cast("int")
        granted = _upto(wishes, -level if falling else level, parts).filter(F.col("upto") <= _by_shard(room, "target")).select("g", "start", "target")
        moved = scratch.save(units.join(granted, ["g", "start"], "left").select("g", "start", F.coalesce("target", "shard").alias("shard"), "n", "bytes", F.col("target").isNotNull().alias("moved")), "units")
        any_moved = moved.filter("moved").limit(1).count()
        scratch.drop(units)
        units = moved.drop("moved")
        units._scratch_path = moved._scratch_path
        if not any_moved and not falling:
            return units
        falling = False


def _numbered(df: DataFrame, rows: int, keys: list[str], amount: str, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over all rows before, by keys, in order of hash.

    Two steps: sums of hashed parts, whose running totals are a small table, and
    running totals inside each part.
    """
    parts = max(1, -(-rows // PART_ROWS))
    dealt = df.withColumn("part", F.pmod(F.col("u"), F.lit(parts)))
    sums = dealt.groupBy(*keys, "part").agg(F.sum(amount).alias("part_sum"))
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, "part", F.coalesce(F.sum("part_sum").over(before), F.lit(0)).alias("part_start"))
    inside = W.partitionBy(*keys, "part").orderBy("u", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    summed = dealt.withColumn("inside", F.sum(amount).over(inside) - F.col(amount))
    return summed.join(starts, [*keys, "part"]).withColumn(name, F.col("part_start") + F.col("inside")).drop("part", "part_start", "inside")


def _deal(pool: DataFrame, rows: int, lack: dict[int, float], scratch: Scratch) -> list[DataFrame]:
    """Deals documents without links to what each shard lacks, larger classes first."""
    out = []
    upper = None
    for least in SIZE_CLASSES:
        some = pool.filter((F.col("size") >= least) & (F.lit(True) if upper is None else F.col("size") < upper))
        upper = least
        total = some.agg(F.sum("size")).first()[0]
        if not total:
            continue
        wanted = {s: max(0.0, x) for s, x in lack.items()}
        scale = total / (sum(wanted.values()) or 1.0)
        # the middle of a document decides, so that what is over and under evens out
        at = F.col("at") + F.col("size") / 2
        shard, reached = F.lit(max(lack)), 0.0
        bounds = []
        for s in sorted(wanted):
            reached += wanted[s] * scale
            bounds.append((s, reached))
        for s, bound in reversed(bounds[:-1]):
            shard = F.when(at < bound, F.lit(s)).otherwise(shard)
        dealt = _numbered(some.withColumn("one", F.lit(0)), rows, ["one"], "size", "at").withColumn("shard", shard.cast("int")).drop("one", "at")
        dealt = scratch.save(dealt, "dealt")
        for s, b in _sizes(dealt, "shard", "size").items():
            lack[s] -= b
        out.append(dealt)
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of every row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), text).alias("g"),
    )
    base = base.withColumn("u", F.xxhash64("doc_id", "g", F.lit(3))).withColumn("start", F.pmod(F.xxhash64("doc_id", "g", F.lit(5)), F.lit(shards)).cast("int"))
    base = scratch.save(base, "base")
    rows, total = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    even = total / shards

    units = base.groupBy("g", "start").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    linked = units.groupBy("g").agg(F.sum("n").alias("rows")).filter("rows > 1").select("g")
    units = scratch.save(units.join(linked, "g", "left_semi").select("g", "start", F.col("start").alias("shard"), "n", "bytes"), "units")
    cap = LINKED_SHARE * even
    units = propagate(units, cap, scratch)

    placed = base.join(units.select("g", "start", "shard"), ["g", "start"], "left")
    load = {s: 0 for s in range(shards)} | _sizes(units, "shard", "bytes")
    over = {s: max(0.0, 1 - cap / b) if b else 0.0 for s, b in load.items()}
    released = F.pmod(F.xxhash64("u", F.lit(9)), F.lit(1 << 20)) < _by_shard(over, "shard") * (1 << 20)
    placed = scratch.save(placed.withColumn("shard", F.when(~released, F.col("shard"))).drop("start", "g"), "placed")
    held = placed.filter(F.col("shard").isNotNull())
    load = {s: 0 for s in range(shards)} | _sizes(held, "shard", "size")
    dealt = _deal(placed.filter(F.col("shard").isNull()).drop("shard"), rows, {s: even - load[s] for s in range(shards)}, scratch)
    everything = held
    for some in dealt:
        everything = everything.unionByName(some)
    numbered = _numbered(everything.withColumn("one", F.lit(1).cast("long")), rows, ["shard"], "one", "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
