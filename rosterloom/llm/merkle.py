"""Merkle manifest of a dataset with inclusion proofs by coordinate lookup.

Each row is a leaf.  Leaves of a language ascend by doc_id; every eight consecutive
nodes of a level become one node above, until one is left, the language's subroot.
Subroots in order of language become the root in the same way.

The node table holds all nodes by (tree, level, position), a tree for each language
and one above them.  A leaf's proof needs nothing but its index and the number of
leaves in its tree: from these it lists the coordinates of its siblings, a join looks
them up, and the digests found are ordered, concatenated and folded.

Rows are numbered by a sort over ranges whose sizes are summed, and languages are
joined to rows in blocks of ``BLOCK_ROWS`` numbers, so that no step holds a language
in one task.  Levels with few nodes in all, which many leaves ask for, are broadcast:
at most ``SMALL_LEVEL`` nodes each.  A node of a larger level is asked for by a small
part of the leaves only, and is joined by a shuffle.  (Languages without bound would
make the lowest level of the upper tree large, with a hot sibling; adaptive execution
splits that.)

Defined results: null languages and null ids come first, each as a value of its own;
rows with equal language and id are ordered by leaf, and equal leaves are alike in
every result; a language with one row has its leaf as subroot, and a dataset with one
language its subroot as root; a text of any length is hashed whole; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch

#: Nodes that become one node above.
FAN = 8
#: Columns of a leaf, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Numbers in a block, in which languages are joined to rows.
BLOCK_ROWS = 1 << 16
#: Most nodes of a level that is broadcast, and most languages whose table is.
SMALL_LEVEL = 1 << 15
#: The tree above the languages.
TOP = -1


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256, as binary, of values that are each ``-`` if null, else their bytes' count, a colon, and themselves."""
    values = [c.cast("string") for c in columns]
    return _digest(F.concat(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values)))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def number_in_order(df: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Adds ``number``, gapless from 0, in ascending order of the keys with nulls first.

    Rows are sorted within ranges of keys; only the ranges' sizes are summed in one place.
    """
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    rows = scratch.save(rows, "sorted").withColumn("_range", F.shiftright("_place", 33))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_start"))
    return rows.join(F.broadcast(starts), "_range").withColumn("number", F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_range", "_place", "_start")


def _levels_below(n: Column, levels: int) -> Column:
    """The level of a tree's last node, for trees of up to ``FAN ** levels`` leaves."""
    out = F.lit(0)
    for k in range(levels):
        out = out + (n > FAN**k).cast("int")
    return out


def _count(n: Column, level: int) -> Column:
    """Nodes of a level that a tree with n leaves has; only for levels up to its last."""
    return F.floor((n + (FAN**level - 1)) / FAN**level).cast("long") if level else n


def _place(pos: Column, level: int) -> Column:
    return F.shiftright(pos, 3 * level)


def _depth(n: int) -> int:
    level = 0
    while n > FAN**level:
        level += 1
    return level


def build_levels(leaves: DataFrame, depth: int, scratch: Scratch) -> list[DataFrame]:
    """Written node tables (tree, n, pos, digest) of the levels 0 to ``depth``, from those of level 0; n is the tree's number of leaves."""
    levels = [leaves]
    for level in range(1, depth + 1):
        below = levels[-1].filter(F.col("n") > FAN ** (level - 1))
        runs = below.groupBy("tree", "n", _place(F.col("pos"), 1).alias("pos")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("run"))
        joined = F.array_join(F.transform("run", lambda x: _hex(x["digest"])), "")
        levels.append(scratch.save(runs.select("tree", "n", "pos", _digest(joined).alias("digest")), f"level-{level}"))
    return levels


_COORDINATES = "array<struct<tree:bigint,level:int,pos:bigint,stage:int,own:bigint>>"


def _siblings(tree: Column, level: int, place: Column, n: Column, stage: int) -> Column:
    """Coordinates of a run without the own node; a node alone in its run gives itself, with which nothing is concatenated."""
    first = place - F.pmod(place, F.lit(FAN))
    last = F.least(first + (FAN - 1), _count(n, level) - 1)
    run = F.filter(F.sequence(first, last), lambda p: (p != place) | (first == last))
    named = lambda p: F.struct(tree.cast("long").alias("tree"), F.lit(level).alias("level"), p.alias("pos"), F.lit(stage).alias("stage"), place.alias("own"))
    return F.when(n > FAN**level, F.transform(run, named)).otherwise(F.array().cast(_COORDINATES))


def required_coordinates(depth: int, languages: int) -> list[tuple[bool, int, Column]]:
    """(upper tree, level, coordinates) that a leaf (tree, n, pos) needs; stage -1 is its subroot."""
    tree, n, pos = F.col("tree"), F.col("n"), F.col("pos")
    out = []
    for level in range(depth + 1):
        at = F.struct(tree.alias("tree"), F.lit(level).alias("level"), F.lit(0).cast("long").alias("pos"), F.lit(-1).alias("stage"), F.lit(-1).cast("long").alias("own"))
        subroot = F.when(_levels_below(n, depth) == level, F.array(at)).otherwise(F.array().cast(_COORDINATES))
        out.append((False, level, F.concat(subroot, _siblings(tree, level, _place(pos, level), n, level))))
    count = F.lit(languages).cast("long")
    return out + [(True, level, _siblings(F.lit(TOP), level, _place(tree, level), count, depth + 1 + level)) for level in range(_depth(languages))]


def _looked_up(leaves: DataFrame, wanted: list[Column], nodes: DataFrame | None) -> DataFrame | None:
    """number and steps, the (stage, before, after) of each leaf's siblings in the given node tables."""
    if nodes is None:
        return None
    asked = leaves.select("number", F.explode(F.flatten(F.array(*wanted))).alias("c")).select("number", "c.*")
    found = asked.join(nodes, ["tree", "level", "pos"]).select("number", "stage", "own", "pos", "digest")
    runs = found.repartition("number").groupBy("number", "stage", "own").agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("run"))
    side = lambda test: F.array_join(F.transform(F.filter("run", test), lambda x: _hex(x["digest"])), "")
    steps = runs.select("number", F.struct("stage", side(lambda x: x["pos"] < F.col("own")).alias("before"), side(lambda x: x["pos"] > F.col("own")).alias("after")).alias("step"))
    return steps.groupBy("number").agg(F.collect_list("step").alias("steps"))


def prove_documents(docs: DataFrame, tampered: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Each row's doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``tampered`` is what the text is when the proof is checked (the text itself by
    default): folded_root starts from the leaf with it and goes on with the original
    siblings.  The root is one digest, and the numbers of languages and of leaves in
    the largest of them are all else that reaches the driver.
    """
    scratch = scratch or Scratch(docs.sparkSession, "merkle")
    text = F.col("text")
    checked = text if tampered is None else tampered
    columns = [F.col(c) for c in LEAF_COLUMNS]
    changed = F.when(~checked.eqNullSafe(text), leaf_digest([*columns[:-1], checked]))
    hashed = docs.select("doc_id", "lang", leaf_digest(columns).alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("row"))
    # the row's number only keeps rows that repeat in one range apart
    hashed = scratch.save(hashed, "leaves")
    numbered = number_in_order(hashed, ["lang", "doc_id", "leaf", "changed", "row"], scratch)
    trees = numbered.groupBy("lang").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("n"))
    trees = scratch.save(number_in_order(trees, ["start"], scratch).withColumnRenamed("number", "tree"), "trees")
    languages, most = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    if not languages:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

    blocks = F.sequence(F.floor(F.col("start") / BLOCK_ROWS), F.floor((F.col("start") + F.col("n") - 1) / BLOCK_ROWS))
    covered = trees.select(F.col("lang").alias("_lang"), "tree", "start", "n", F.explode(blocks).alias("_block"))
    placed = numbered.join(covered, (F.floor(F.col("number") / BLOCK_ROWS) == F.col("_block")) & F.col("lang").eqNullSafe(F.col("_lang")))
    leaves = scratch.save(placed.select("number", "tree", "n", (F.col("number") - F.col("start")).alias("pos"), "doc_id", "leaf", "changed"), "placed")

    depth = _depth(most)
    lower = build_levels(leaves.select("tree", "n", "pos", F.col("leaf").alias("digest")), depth, scratch)
    tops = [df.filter(_levels_below(F.col("n"), depth) == level).select(F.lit(TOP).cast("long").alias("tree"), F.lit(languages).cast("long").alias("n"), F.col("tree").alias("pos"), "digest") for level, df in enumerate(lower)]
    first = tops[0]
    for more in tops[1:]:
        first = first.union(more)
    upper = build_levels(scratch.save(first, "subroots"), _depth(languages), scratch)
    root = bytes(upper[-1].first()["digest"]).hex()

    sizes = trees.agg(*(F.sum(F.when(_levels_below(F.col("n"), depth) >= k, _count(F.col("n"), k)).otherwise(0)) for k in range(depth + 1))).first()
    parts: dict[bool, tuple[list[Column], list[DataFrame]]] = {True: ([], []), False: ([], [])}
    for top, level, coordinates in required_coordinates(depth, languages):
        count = -(-languages // FAN**level) if top else sizes[level]
        nodes = (upper if top else lower)[level].select("tree", F.lit(level).alias("level"), "pos", "digest")
        wanted, tables = parts[count <= SMALL_LEVEL]
        wanted.append(coordinates)
        tables.append(nodes)

    def lookup(small: bool, asking: DataFrame) -> DataFrame | None:
        wanted, tables = parts[small]
        nodes = None
        for table in tables:
            nodes = table if nodes is None else nodes.union(table)
        return _looked_up(asking, wanted, F.broadcast(nodes) if small and nodes is not None else nodes)

    coordinates = leaves.select("number", "tree", "n", "pos")
    proofs = leaves.select("number", "doc_id", "leaf", "changed").repartition("number")
    steps = F.array().cast("array<struct<stage:int,before:string,after:string>>")
    for small, name in ((True, "near"), (False, "far")):
        if (found := lookup(small, coordinates)) is not None:
            proofs = proofs.join(found.withColumnRenamed("steps", name), "number", "left")
            steps = F.concat(steps, F.coalesce(name, F.array().cast("array<struct<stage:int,before:string,after:string>>")))
    ordered = proofs.withColumn("steps", F.array_sort(steps))
    path = F.filter("steps", lambda s: s["stage"] >= 0)
    folded = F.aggregate(path, _hex(F.coalesce("changed", "leaf")), lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))
    siblings = F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")
    out = ordered.select("doc_id", _hex(F.col("leaf")).alias("leaf"), F.element_at("steps", 1)["after"].alias("subroot"), F.lit(root).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
