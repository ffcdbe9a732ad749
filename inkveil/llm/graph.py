"""Connected components, and links among rows that share a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the smallest node that it reaches.

    Alternating large-star and small-star steps: every step hangs neighbours on the smallest
    node seen, in two aggregations and joins; the edges never grow and end as stars around
    the smallest nodes.  Nulls, loops and repeated edges are dropped.  Each round is a stored table.
    """
    e = stored(edges.where(F.col("a") != F.col("b"))
               .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select("v", "u")).toDF("n", "m")
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = (both.join(low, "n").where(F.col("m") > F.col("n"))
                 .select(F.col("m").alias("u"), F.col("low").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(least, "u")
                 .select(F.explode(F.array(
                     F.struct(F.greatest("v", "low").alias("u"), F.least("v", "low").alias("v")),
                     F.struct("u", F.col("low").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        e, before = stored(small, "edges"), mark
        mark = _mark(e)
        if mark == before:
            break
    return e.toDF("node", "component").union(e.select("v", "v")).distinct()


def _mark(e: DataFrame) -> tuple:
    """Number of edges and a sum over them: equal for equal edge sets."""
    return tuple(e.agg(F.count(F.lit(1)),
                       F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components_by_key(keyed: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) over links between rows of ``keyed`` (key, node) that share a key.

    ``linked`` takes pairs (a, b) and returns those that are links.  Pairs are not all formed:
    every node is first tried with the smallest node of its key; then only keys that still hold
    several components are looked at again, and there only pairs from different components.
    A pair inside a component could not change the result, so no link is lost.
    """
    key = Window.partitionBy("key")
    shared = stored(
        keyed.withColumn("first", F.min("node").over(key)).withColumn("last", F.max("node").over(key))
        .where(F.col("first") < F.col("last")).select("key", "node", "first"), "shared")
    star = linked(shared.where(F.col("node") != F.col("first"))
                  .select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    near = components(star)
    named = (shared.select("key", "node").join(near, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    mixed = (named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where(F.col("lo") < F.col("hi")).select("key"))
    rest = stored(named.join(mixed, "key", "left_semi"), "rest")
    x, y = rest.toDF("key", "a", "ca"), rest.toDF("key", "b", "cb")
    across = linked(x.join(y, "key").where(F.col("ca") < F.col("cb"))
                    .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return components(near.select(F.col("component").alias("a"), F.col("node").alias("b")).union(across.select("a", "b")))


def differing(x: list[Column], y: list[Column]) -> Column:
    """Number of differing bits of two fingerprints, each of some 64-bit words."""
    total = F.lit(0)
    for p, q in zip(x, y, strict=True):
        total = total + F.bit_count(p.bitwiseXOR(q))
    return total
