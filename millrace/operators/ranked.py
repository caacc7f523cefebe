"""Ranked selection: first match, tiers, top-k, nearest rows, weighted choice, two-slot stores. Every order ends with a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_match(df: DataFrame, key: str, start, holds: Column, missing=-1) -> DataFrame:
    """One row with the smallest key >= start where `holds`, else `missing`."""
    return df.filter((F.col(key) >= start) & holds).agg(F.coalesce(F.min(key), F.lit(missing)).alias("found"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def tiered(df: DataFrame, tiers: list[Column], order: list[Column], n: int) -> DataFrame:
    """Up to n rows, of the first tier in order, then of the next; a row is in the first tier that it meets."""
    tier = None
    for i, t in enumerate(tiers, 1):
        tier = F.when(t, i) if tier is None else tier.when(t, i)
    return df.withColumn("tier", tier).filter("tier IS NOT NULL").orderBy("tier", *order).limit(n)


def reuse_candidate(df: DataFrame, by: list[str], dead: Column, clipped: Column, distance: Column, seq: str) -> DataFrame:
    """Of each group the first dead row, else the nearest of the rows out of view, first on ties."""
    rank = F.struct(F.when(dead, 0).otherwise(1).alias("tier"), F.when(dead, F.lit(0.0)).otherwise(distance).alias("d"), F.col(seq).alias("seq"))
    return df.filter(dead | clipped).groupBy(*by).agg(F.min(rank).alias("r")).select(*by, F.col("r.seq").alias(seq), F.col("r.tier").alias("tier"))


def nearest(df: DataFrame, by: list[str], distance: Column, seq: str, farthest: bool = False) -> DataFrame:
    """Of each group the row of least (greatest) distance, first on ties."""
    rank = F.struct((-distance if farthest else distance).alias("d"), F.col(seq).alias("seq"))
    got = df.groupBy(*by).agg(F.min(rank).alias("r"))
    return got.select(*by, F.col("r.seq").alias(seq), (-F.col("r.d") if farthest else F.col("r.d")).alias("distance"))


def weighted_choice(df: DataFrame, by: list[str], order: list[Column], weight: str, draw: Column) -> DataFrame:
    """Of each group the first row in order where floor(draw * total) - running weight <= 0; draw in [0, 1) is a column of the group."""
    w = W.partitionBy(*by)
    run = F.sum(weight).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    marked = df.withColumn("__run", run).withColumn("__x", F.floor(draw * F.sum(weight).over(w)))
    kept = marked.filter(F.col("__x") - F.col("__run") <= 0)
    return kept.withColumn("__r", F.row_number().over(w.orderBy(*order))).filter("__r = 1").drop("__run", "__x", "__r")


def depth_buckets(df: DataFrame, value: Column, low: float, high: float, n: int, seq: str) -> DataFrame:
    """df with `bucket` (n - 1 nearest to low, clamped) and `place`: buckets ascending, last in first out within one."""
    raw = F.floor((value - low) / (high - low) * n)
    bucket = (n - 1) - F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1))
    return df.withColumn("bucket", bucket.cast("int")).withColumn("place", F.row_number().over(W.partitionBy("bucket").orderBy(F.desc(seq))))


def merged_packets(df: DataFrame, key: str, seq: str, changed: Column) -> DataFrame:
    """Packets by key in order of arrival; changed ones are not merged and come first."""
    slot = F.when(changed, F.lit(0)).otherwise(1)
    alone = F.when(changed, F.col(seq)).otherwise(F.lit(-1))
    return df.groupBy(slot.alias("slot"), F.col(key), alone.alias("alone")).agg(F.array_sort(F.collect_list(seq)).alias("members"))


def used_slot(df: DataFrame, by: str, state: str = "state", slot: str = "slot", writes: str = "writes") -> DataFrame:
    """Which of two slots to use: -1 (wrong device) if slot 0 is empty, -2 (busy) if both are bad, the good one, or the one written more often, slot 0 on ties."""
    s = lambda i: F.max(F.when(F.col(slot) == i, F.col(state)))
    w = lambda i: F.max(F.when(F.col(slot) == i, F.col(writes)))
    got = df.groupBy(by).agg(s(0).alias("s0"), s(1).alias("s1"), w(0).alias("w0"), w(1).alias("w1"))
    use = F.when(F.col("s0") == "empty", -1).when((F.col("s0") == "bad") & (F.col("s1") == "bad"), -2).when(F.col("s0") == "bad", 1).when(F.col("s1") == "bad", 0).when(F.col("w0") >= F.col("w1"), 0).otherwise(1)
    return got.select(by, use.alias("use"))


def admitted(df: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """Requests accepted in order until `cap` of a group are."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__r") <= cap).drop("__r")


def entered(df: DataFrame, mode: str, slot: str, seq: str) -> DataFrame:
    """df with `at` and `place`, where a packet stands among those that are drawn. Unsorted packets go to the head of slot 0, immediate ones to the
    head of their own slot, so the last to come is first; bypassing ones go to the end of the children (slot -1) in order."""
    at = F.when(F.col(mode) == "unsorted", 0).when(F.col(mode) == "immediate", F.col(slot)).otherwise(-1)
    order = F.when(F.col(mode) == "bypass", F.col(seq)).otherwise(-F.col(seq))
    return df.withColumn("at", at.cast("int")).withColumn("place", F.row_number().over(W.partitionBy("at").orderBy(order)))


def traversed(df: DataFrame, at: str, place: str, tail: bool) -> DataFrame:
    """df with `drawn_before`, the number of packets of slots that are drawn earlier, and so its number in its whole order with its place: slots from the
    first on, or from the last where `tail`; slots are counted before they are ordered, so no task holds all packets."""
    sizes = df.groupBy(at).agg(F.count(F.lit(1)).alias("__n"))
    order = F.col(at).desc() if tail else F.col(at).asc()
    before = sizes.select(at, (F.sum("__n").over(W.orderBy(order)) - F.col("__n")).alias("drawn_before"))
    return df.join(before, at).withColumn("drawn", F.col("drawn_before") + F.col(place))
