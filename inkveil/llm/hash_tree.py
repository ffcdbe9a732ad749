"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws -ln(u) / weight, where u is hashed from the id and the child;
the smallest draw wins.  A draw depends on one child and its weight only, so a changed weight
moves rows only towards a child that gained or away from one that lost, at every level.
A new shard opens a region of its own, so it takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import gapless, prepare, read_table
from inkveil.session import spread

REGION_SHARDS, RACK_SHARDS = 4, 2


@dataclass(frozen=True)
class Tree:
    """regions -> racks -> ((shard, weight), …)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def of(shards: int) -> Tree:
        """Equal shards in regions of two racks of two."""
        flat = [(i, 1.0) for i in range(shards)]
        cut = lambda x, n: tuple(tuple(x[i:i + n]) for i in range(0, len(x), n))
        return Tree(tuple(cut(region, RACK_SHARDS) for region in cut(flat, REGION_SHARDS)))

    def shards(self) -> list[int]:
        return [s for region in self.regions for rack in region for s, _ in rack]

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, alone in a new region."""
        return Tree((*self.regions, (((max(self.shards(), default=-1) + 1, weight),),)))


def draw(key: Column, level: str, child: int, weight: float) -> Column:
    """An exponential draw with rate ``weight``; a child without weight never wins."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(child)), 11)
    u = (bits.cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight)) if weight > 0 else F.lit(float("inf"))


def _pick(key: Column, level: str, children: list[tuple[int, float, Column]]) -> Column:
    """The result of the child with the smallest draw."""
    if len(children) == 1:
        return children[0][2]
    drawn = F.array(*(F.struct(draw(key, level, c, w).alias("d"), F.lit(i).alias("i"))
                      for i, (c, w, _) in enumerate(children)))
    best = F.array_min(drawn)["i"]
    result = F.when(best == 0, children[0][2])
    for i, (_, _, value) in enumerate(children[1:], 1):
        result = result.when(best == i, value)
    return result


def shard_of(key: Column, tree: Tree) -> Column:
    """Descends the tree; a node's weight is the sum of what is below it.  Nodes are named by their first shard."""
    def leaves(node) -> list[tuple[int, float]]:
        return [(s, w) for rack in node for s, w in rack]

    regions = []
    for region in tree.regions:
        racks = []
        for rack in region:
            shards = [(s, w, F.lit(s)) for s, w in rack]
            racks.append((rack[0][0], sum(w for _, w in rack), _pick(key, "shard", shards)))
        below = leaves(region)
        regions.append((below[0][0], sum(w for _, w in below), _pick(key, "rack", racks)))
    return _pick(key, "region", regions)


def place(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document with its shard, the shard with one more, and a gapless slot there.

    Only the id decides; a null id is hashed as empty text, a null text has size 1 and the
    checksum of no bytes.  Rows with equal ids share a shard and get slots of their own.
    """
    tree = Tree.of(shards)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = spread(docs.select("doc_id", "text")).select(
        "doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"), shard_of(key, tree).alias("shard"), shard_of(key, tree.grow()).alias("grown_shard"))
    return gapless(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return place(read_table(prepare(spark), folder, "documents"))
