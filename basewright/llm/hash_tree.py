"""Shards by a hierarchical weighted hash tree.

The leaves of the tree are shards, its levels regions and racks; a node weighs what its
shards weigh. A row descends from the top: on each level every child draws a number
from the hash of the row's id and the child's name, divided by the child's weight, and the
least draw wins. A child is so chosen in proportion to its weight, and its draw depends
on nothing but its own name and weight. Where weights change, a row can only move into a
subtree that became heavier or out of one that became lighter; inside all other subtrees no
row moves. A shard that opens a region of its own (`grown`) takes rows only into itself.

Only the tree decides, never other rows, so one job over the ids places the rows; texts are
read for their size and checksum and not shuffled. Slots (gapless numbers inside a shard, in the order of the ids) come from a
range shuffle of slim rows: the place inside a range plus the counts of the ranges before it. No
task holds a whole shard, and a salt splits the rows of an id that many rows share.

Defined results: rows without an id hash as the empty string and share a shard, as repeated ids
do; a null text has no bytes and the checksum of the empty text. With an empty table the result is
empty. Equal rows each get a slot of their own. Other columns of the input are not carried along.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.shared import written
from .frames import bound, shuffle_partitions

#: Hexadecimal digits of a draw: 52 bits, exact in a double.
DIGITS = 13
#: Bytes that a record takes besides its text.
OVERHEAD = 8


@dataclass(frozen=True)
class Shard:
    """A leaf: its number, the numbers of the rack and region above it, and its weight."""

    shard: int
    rack: int
    region: int
    weight: float = 1.0


def even_tree(regions: int, racks: int, shards: int) -> list[Shard]:
    """Shards of weight 1: so many in each rack, so many racks in each region."""
    return [Shard(i, i // shards, i // (racks * shards)) for i in range(regions * racks * shards)]


def grown(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a rack and a region of its own: rows move only into it."""
    over = lambda numbers: max(numbers, default=-1) + 1
    return [*tree, Shard(over(s.shard for s in tree), over(s.rack for s in tree), over(s.region for s in tree), weight)]


def checked_tree(tree: Sequence[Shard]) -> list[Shard]:
    if not tree:
        raise ValueError("a tree needs at least one shard")
    if len({s.shard for s in tree}) < len(tree):
        raise ValueError("two shards have the same number")
    if len({(s.rack, s.region) for s in tree}) > len({s.rack for s in tree}):
        raise ValueError("a rack lies in two regions")
    if any(not 0 < s.weight < float("inf") for s in tree):
        raise ValueError("weights must be positive and finite")
    return sorted(tree, key=lambda s: (s.region, s.rack, s.shard))


def _children(tree: Sequence[Shard], parent: str | None, level: str) -> Column:
    """Map of parent -> [(number of the child, weight)]; without a level above, that of 0."""
    found: dict[int, dict[int, float]] = {}
    for s in tree:
        below = found.setdefault(getattr(s, parent) if parent else 0, {})
        number = getattr(s, level)
        below[number] = below.get(number, 0.0) + s.weight
    pairs = [
        x
        for above, below in found.items()
        for x in (F.lit(above), F.array(*(F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight")) for n, w in below.items())))
    ]
    return F.create_map(*pairs)


def _draw(key: Column, level: str, node: Column, weight: Column) -> Column:
    """An exponential variate with the node's weight as its rate, from the hash of key and node."""
    digest = F.md5(F.concat(F.lit(f"{level} "), node.cast("string"), F.lit(":"), key).cast("binary"))
    part = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
    return -F.ln((part + 0.5) / float(16**DIGITS)) / weight


def _chosen(key: Column, level: str, children: Column) -> Column:
    drawn = F.transform(children, lambda c: F.struct(_draw(key, level, c["node"], c["weight"]).alias("draw"), c["node"].alias("node")))
    return F.array_min(drawn)["node"]


def descended(key: Column, tree: Sequence[Shard]) -> Column:
    """A struct of the region, rack and shard that a key (a string) comes to."""
    tree = checked_tree(tree)
    regions, racks, shards = _children(tree, None, "region"), _children(tree, "region", "rack"), _children(tree, "rack", "shard")
    return bound(
        _chosen(key, "region", regions[F.lit(0)]),
        lambda region: bound(
            _chosen(key, "rack", racks[region]),
            lambda rack: F.struct(region.alias("region"), rack.alias("rack"), _chosen(key, "shard", shards[rack]).alias("shard")),
        ),
    )


def placed(docs: DataFrame, tree: Sequence[Shard], id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, and the region, rack and shard of each row."""
    whole = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    key = F.coalesce(F.col(id).cast("string"), F.lit(""))
    got = docs.select(
        F.col(id).alias("id"),
        (F.octet_length(whole).cast("long") + OVERHEAD).alias("size"),
        F.crc32(whole).alias("text_crc32"),
        descended(key, tree).alias("at"),
    )
    return got.select("id", "size", "text_crc32", "at.region", "at.rack", "at.shard")


def with_slots(rows: DataFrame, order_by: Sequence[str], shard: str = "shard") -> DataFrame:
    """`rows` with `slot`: 0, 1, 2 ... inside each shard, by `order_by`.

    Rows are dealt to ranges of (shard, order) and written, each with its place among the
    rows of its task; a shard's part of a range starts where the ranges before it end.
    `rows` should be slim: they are written twice and shuffled once.
    """
    keys = [shard, *order_by]
    # Written first: finding the ranges samples the rows, which must not read every text once more.
    salted = written(rows, "placed").withColumn("_salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(shuffle_partitions(rows), *keys, "_salt").sortWithinPartitions(*keys, "_salt")
    stored = written(ranged.drop("_salt").withColumn("_row", F.monotonically_increasing_id()), "slots")
    # The upper bits of a row's number are those of the task that wrote it.
    task = F.shiftright("_row", 33)
    parts = stored.groupBy(F.col(shard).alias("_shard"), task.alias("_task")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range, and one more for each shard that begins inside a range.
    starts = parts.select("_shard", "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    both = stored.withColumn("_of", task).join(starts, (F.col(shard) == F.col("_shard")) & (F.col("_of") == F.col("_task")))
    return both.withColumn("slot", F.col("_row") + F.col("_shift")).drop("_row", "_of", "_shard", "_task", "_shift")


def sharded(docs: DataFrame, tree: Sequence[Shard], bigger: Sequence[Shard], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's place in `tree`, its slot there, and its shard in the tree `bigger`."""
    rows = placed(docs, tree, id, text).withColumn("grown_shard", descended(F.coalesce(F.col("id").cast("string"), F.lit("")), bigger)["shard"])
    return with_slots(rows, ["id", "size", "text_crc32"])
