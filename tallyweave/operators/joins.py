"""Joins that the ledger operators share: null-safe anti join, as-of snapshots, precedence merge, nearest values, keep-first."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that a nearest-value join is dealt out in, at most.
MOST_RANGES = 256


def anti_join(new: DataFrame, old: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows of ``new`` whose key ``old`` does not have. Null-safe: null equals null; otherwise a null key is always new."""
    if not null_safe:
        return new.join(old.select(*keys), list(keys), "left_anti")
    right = old.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [new[k].eqNullSafe(right[f"__{k}"]) for k in keys])
    return new.join(right, same, "left_anti")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in an explicit order. Nulls in keys are one value."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def as_of(df: DataFrame, date_column: str, at: str) -> DataFrame:
    """Rows of the newest snapshot on or before a date: a pushed-down filter, a one-row maximum, an equality."""
    known = df.where(F.col(date_column) <= F.lit(at).cast(df.schema[date_column].dataType))
    newest = known.agg(F.max(date_column).alias("__at"))
    return known.join(F.broadcast(newest), F.col(date_column) == F.col("__at")).drop("__at")


def last_per_month(df: DataFrame, date_column: str) -> DataFrame:
    """Rows of each month's last snapshot date."""
    month = F.substring(F.col(date_column).cast("string"), 1, 7)
    rows = df.withColumn("month", month)
    last = rows.groupBy("month").agg(F.max(date_column).alias(date_column))
    return rows.join(last, ["month", date_column])


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def merge_by_precedence(first: DataFrame, second: DataFrame, key: Column, order: Sequence[str] = ()) -> DataFrame:
    """Rows of both, one per key; those of ``first`` win."""
    both = first.withColumn("__p", F.lit(0)).unionByName(second.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return keep_first(both.withColumn("__key", key), ["__key"], ["__p", *order]).drop("__p", "__key")


def nearest_by_mean(left: DataFrame, right: DataFrame, *, name: str, value: str, most: float = 0.5, top: int = 3) -> DataFrame:
    """For each left row the ``top`` right rows with the least relative difference of ``value``, below ``most``; ties by name.

    In the order of values these are among the ``top`` right rows on either side of the left one (and one more, as a row is
    not its own neighbour). Both sides are cut into ranges of about equal numbers at quantiles, each of which gets the
    outermost right rows of the ranges before and after it: two sorts within ranges, no join of values. The driver holds
    the outermost rows only, 2 (top + 1) for each range."""
    spark = left.sparkSession
    reach = top + 1
    extra = [c for c in right.columns if c not in (name, value)]
    a = left.where(F.col(value) > 0).select(F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
    b = right.where(F.col(value) > 0).select(F.col(value).cast("double").alias("value"), F.col(name).alias("near"), *extra)
    n = min(MOST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(b.approxQuantile("value", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []

    def within(low: int, high: int) -> Column:
        """The range of a value among those from ``low`` to ``high``, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("value") < cuts[mid], within(low, mid)).otherwise(within(mid + 1, high))

    part = within(0, len(cuts))
    seen = F.struct(F.col("value").alias("near_value"), "near", *extra).alias("seen")
    b = b.select("value", "near", seen, part.alias("part"))
    # towards the value from below and from above; among equals the smallest names come last, next to the left row
    ways = {"below": (F.asc("value"), F.desc("near")), "above": (F.desc("value"), F.desc("near"))}
    back = {"below": (F.desc("value"), F.asc("near")), "above": (F.asc("value"), F.asc("near"))}
    outermost = lambda keys: F.row_number().over(Window.partitionBy("part").orderBy(*keys)) <= reach
    edges = {w: b.withColumn("outer", outermost(keys)).where("outer").drop("outer").collect() for w, keys in back.items()}
    found = []
    for way, keys in ways.items():
        handed, held = [], []
        for p in range(len(cuts) + 1) if way == "below" else range(len(cuts), -1, -1):
            handed += [(r["value"], r["near"], r["seen"], p) for r in held]
            held = sorted([*held, *[r for r in edges[way] if r["part"] == p]], key=lambda r: (-r["value"] if way == "below" else r["value"], r["near"]))[:reach]
        known = b.unionByName(spark.createDataFrame(handed, b.schema))
        order = Window.partitionBy("part").orderBy(*keys)
        known = known.withColumn("group", F.collect_list("seen").over(order.rowsBetween(-(reach - 1), 0))).select("value", "near", "part", "group", F.lit(0).alias("asks"), F.lit(None).cast("string").alias("name"))
        asks = a.select("value", F.lit(None).cast("string").alias("near"), part.alias("part"), F.lit(None).cast(known.schema["group"].dataType).alias("group"), F.lit(1).alias("asks"), "name")
        upto = Window.partitionBy("part").orderBy(keys[0], "asks", F.desc("near")).rowsBetween(Window.unboundedPreceding, 0)
        found.append(known.unionByName(asks).withColumn("group", F.last("group", True).over(upto)).where("asks = 1").select("name", "value", F.explode("group").alias("seen")))
    pairs = found[0].unionByName(found[1]).select("name", "value", "seen.*").where("name <> near").distinct()
    ratio = F.abs(F.col("value") - F.col("near_value")) / F.greatest("value", "near_value")
    pairs = pairs.withColumn("difference", ratio).where(F.col("difference") < most)
    rank = F.row_number().over(Window.partitionBy("name").orderBy("difference", "near"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top)


def with_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each row beside a table of exactly one row."""
    return df.crossJoin(F.broadcast(bounds.limit(1)))
