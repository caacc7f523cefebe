"""Aggregations: quantifiers, repairs, bands, pivots, features, rollups. All are partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def quantified(keys: DataFrame, facts: DataFrame, on: list[str], holds: Column) -> DataFrame:
    """keys with `every` (true for a key without facts) and `some` (false for it)."""
    found = facts.groupBy(*on).agg(F.bool_and(holds).alias("every"), F.bool_or(holds).alias("some"))
    return keys.join(found, on, "left").withColumns({"every": F.coalesce("every", F.lit(True)), "some": F.coalesce("some", F.lit(False))})


def saturated_sum(df: DataFrame, by: list[str], value: Column, cap, name: str) -> DataFrame:
    """Sum cut at cap; the same as adding step by step with a cap for values that are never negative."""
    return df.groupBy(*by).agg(F.least(F.sum(value), F.lit(cap)).alias(name))


def high_water(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The highest running sum of each group."""
    run = F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.select(*by, run.alias("__run")).groupBy(*by).agg(F.max("__run").alias(name))


def recounted(ranges: DataFrame, bits: DataFrame, range_id: str, low: str, high: str, bit_id: str, is_set: Column, width: int) -> DataFrame:
    """Set bits counted in [low, high] of each range; ranges without bits count 0. Ids are met by cells of `width`."""
    cells = ranges.select(range_id, low, high, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))).alias("__cell"))
    marked = bits.filter(is_set).select(F.col(bit_id).alias("__bit"), F.floor(F.col(bit_id) / width).alias("__cell"))
    hit = cells.join(marked, "__cell").filter((F.col("__bit") >= F.col(low)) & (F.col("__bit") <= F.col(high)))
    counts = hit.groupBy(range_id).agg(F.count("__bit").alias("n"))
    return ranges.join(counts, range_id, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def stencil_count(grid: DataFrame, x: str, y: str, value: str, wanted) -> DataFrame:
    """(x, y, n): how many of a cell's 8 neighbours hold `wanted`; only cells that do are dealt out."""
    steps = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    given = grid.filter(F.col(value) == wanted).select(F.col(x).alias("gx"), F.col(y).alias("gy"), F.explode(steps).alias("s"))
    counts = given.groupBy((F.col("gx") + F.col("s.dx")).alias(x), (F.col("gy") + F.col("s.dy")).alias(y)).agg(F.count("s").alias("n"))
    return grid.select(x, y).join(counts, [x, y], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def banded(df: DataFrame, value: Column, edges: list[float], weight: Column) -> DataFrame:
    """(band, n, total): band i holds edges[i-1] <= value < edges[i], 0 what is below them all."""
    band = F.lit(0)
    for i, edge in enumerate(edges, 1):
        band = F.when(value >= edge, F.lit(i)).otherwise(band)
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("total"))


def examples(df: DataFrame, by: list[str], item: str, order: list[Column], k: int) -> DataFrame:
    """The first k items of each group, as an array in order."""
    ranked = df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__r") <= k)
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", item))), lambda e: e[item]).alias("examples"))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in `order`."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("__r = 1").drop("__r")


def registered_sums(objects: DataFrame, parts: DataFrame, key: str, size: str) -> DataFrame:
    """(key, size) of the registered objects: the sum of their parts' sizes, 0 without parts; parts of others count nothing."""
    sums = parts.groupBy(key).agg(F.sum(size).alias(size))
    return objects.select(key).join(sums, key, "left").select(key, F.coalesce(size, F.lit(0)).alias(size))
