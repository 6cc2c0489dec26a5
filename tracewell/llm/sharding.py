"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

The tree.  Shards stand in racks, racks in regions.  A row descends from the root: at every node each
child draws -ln(u) / weight, where u in (0, 1) is a hash of the row's id and the child's name and weight
is the sum of the weights below the child; the least draw wins (ties: the first in the tree).  A child
wins with the share that its weight has, and a draw depends on no other child.  So where weights change,
draws change on the paths to the changed shards only: a row moves only between what wins or loses there,
and nothing moves among subtrees whose weights stay.

Layers.  What is added later is a layer of its own: at every node a child draws once for each layer that
it has weight in, and a row that a layer won descends within that layer.  One more shard raises the weights
of its rack and region by its own draw; rows that this draw wins go down to the new shard, all others stay
where they were.  Without layers they would be dealt anew among all shards of the region.

Slots.  Rows of a shard are numbered from 0 in ascending order of id (null last; equal ids in any order).
Order and numbers come from ranges of all rows that are counted side by side: no shard meets in one task,
and an id that many rows share is spread over ranges by its place in the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import dropped, saved, unused

#: Bytes that a row has besides its text.
ROW_BYTES = 16
#: Bits of a draw's hash: 13 hexadecimal digits, which a double holds exactly.
BITS = 52


@dataclass(frozen=True)
class Leaf:
    """A shard: its place in the tree, its weight, and the layer that it came with."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0
    layer: int = 0

    @property
    def path(self) -> tuple[str, str, str]:
        return f"{self.region}", f"{self.region}/{self.rack}", f"{self.region}/{self.rack}/{self.shard}"


def layout(shards: int, regions: int = 2, racks: int = 4) -> tuple[Leaf, ...]:
    """`shards` shards of weight 1 in `racks` racks in each of `regions` regions, as even as they come; one layer."""
    return tuple(Leaf(s % regions, s // regions % racks, s) for s in range(shards))


def grown(tree: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one more shard, the next number, in the rack of least weight; a layer of its own."""
    racks: dict[tuple[int, int], float] = {}
    for leaf in tree:
        at = (leaf.region, leaf.rack)
        racks[at] = racks.get(at, 0) + leaf.weight
    region, rack = min(racks, key=lambda at: (racks[at], at)) if racks else (0, 0)
    return (*tree, Leaf(region, rack, max((leaf.shard for leaf in tree), default=-1) + 1, weight, max((leaf.layer for leaf in tree), default=-1) + 1))


def shard_of(key: Column, tree: tuple[Leaf, ...]) -> Column:
    """The shard that a key (a string; null is the empty string) comes to; null in an empty tree.

    The tree is a map from each node to its children, so the expression has one step for each level, whatever
    the number of shards.  Weights of 0 or less take no rows.
    """
    children: dict[str, dict[tuple[str, int], float]] = {}
    numbers: dict[str, int] = {}
    for leaf in tree:
        if leaf.weight > 0:
            node = ""
            for name in leaf.path:
                own = children.setdefault(node, {})
                own[name, leaf.layer] = own.get((name, leaf.layer), 0.0) + leaf.weight
                node = f"{name}|{leaf.layer}"
            numbers[node] = leaf.shard
    if not numbers:
        return F.lit(None).cast("int")
    key = F.coalesce(key, F.lit(""))
    below = F.create_map(*[x for node, own in children.items() for x in (F.lit(node), F.array(*[F.struct(F.lit(f"{name}|{layer}").alias("node"), F.lit(float(w)).alias("weight")) for (name, layer), w in own.items()]))])
    node = F.lit("")
    for _ in range(3):
        node = F.array_min(F.transform(F.element_at(below, node), lambda c, i: F.struct(draw(key, c["node"], c["weight"]).alias("draw"), i.alias("i"), c["node"].alias("node"))))["node"]
    return F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), node)


def draw(key: Column, node: Column, weight: Column) -> Column:
    """The draw of a child: exponential with its weight as rate."""
    digits = F.substring(F.md5(F.concat(key, F.lit("|"), node).cast("binary")), 1, BITS // 4)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << BITS)
    return -F.ln(uniform) / weight


def numbered(df: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """df with each row's number from 0 within its `group`, in ascending `order` (null last; equal values
    in any order), as `out`.

    The rows are dealt out in ranges of (group, order, place in the input), numbered in each range, and the ranges'
    counts are added up for each group; so neither a large group nor a common value meets in one task.
    """
    row, part, local, base = (unused(df, c) for c in ("row", "part", "local", "base"))
    placed = saved(df.withColumn(row, F.monotonically_increasing_id()), "placed")
    by = [F.col(group).asc_nulls_last(), F.col(order).asc_nulls_last(), F.col(row)]
    ranged = placed.repartitionByRange(*by).withColumn(part, F.spark_partition_id())
    within = Window.partitionBy(part, group).orderBy(*by[1:])
    counted = saved(ranged.withColumn(local, F.row_number().over(within).cast("long") - 1), "ranged")
    dropped(placed)
    sums = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.groupBy(group, part).agg(F.count("*").alias(base)).withColumn(base, F.coalesce(F.sum(base).over(sums), F.lit(0)))
    bases = bases.select(F.col(group).alias("__group"), F.col(part).alias("__part"), F.col(base).alias("__base"))
    joined = counted.join(bases, F.col(group).eqNullSafe(F.col("__group")) & (F.col(part) == F.col("__part")))
    return joined.select(*[F.col(c) for c in df.columns], (F.col(local) + F.col("__base")).alias(out))


def shards(df: DataFrame, tree: tuple[Leaf, ...], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: doc_id, size (UTF-8 bytes of the text and 16), text_crc32, shard, slot and grown_shard.

    The id as text and the tree decide on the shard; a null id is the empty text, a null text has no
    bytes.  Equal ids are in one shard, with slots of their own.  Ids keep their type; other columns are ignored.
    """
    utf8 = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = F.col(doc_id).cast("string")
    rows = df.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(utf8) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        shard_of(key, grown(tree)).alias("grown_shard"),
    )
    return numbered(rows, "shard", "doc_id", "slot").select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
