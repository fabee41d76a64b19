"""Connected components of a table of links, by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). Every step is a partial minimum and
an equi-join that AQE may split where one node has most of the links. The joins are sort-merge joins at every size, so
the plan on a small input is that on a large one. The state between rounds is a table in
shared scratch storage, so a lost executor costs one step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release
from .common import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    out = links.join(least.hint("merge"), "a")
    moved = out.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _is_stars(links: DataFrame) -> bool:
    """Every node has one smaller neighbour or none, and none of those has a smaller one itself."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    sums = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for all nodes that have a link to another.

    ``links`` has columns ``a`` and ``b`` of one orderable type. Null ends and loops are ignored; repeated
    links do no harm; without links the result is empty."""
    spark = links.sparkSession
    low, high = F.least("a", "b"), F.greatest("a", "b")
    state = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    state, path = materialise(state.select(high.alias("a"), low.alias("b")).distinct(), "links")
    while not _is_stars(state):
        after, new_path = materialise(_small_star(_large_star(state)), "links")
        release(spark, path)
        state, path = after, new_path
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
