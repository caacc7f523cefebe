"""Lookups by name and tree, claims, splines, raster samples, list edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W



def tree_first(nodes: DataFrame, wanted: DataFrame, name: str = "name", order: str = "preorder") -> DataFrame:
    """(name, id): the first node of each wanted name in pre-order; names are compared whole, a hash would only prefilter."""
    found = nodes.join(wanted.select(name).distinct(), name, "left_semi").groupBy(name).agg(F.min_by("id", order).alias("id"))
    return wanted.select(name).distinct().join(found, name, "left")


def name_index(names: DataFrame, wanted: DataFrame, name: str = "name", index: str = "idx", missing: int = -1) -> DataFrame:
    """(name, index) of wanted names, the first index where a name is repeated, `missing` where it is absent."""
    first = names.groupBy(name).agg(F.min(index).alias(index))
    return wanted.join(first, name, "left").withColumn(index, F.coalesce(index, F.lit(missing)))


def resolved_lists(lists: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """List entries with the row of the catalog that they name; entries that name nothing are dropped."""
    return lists.join(catalog, name)


def deficits(wanted: DataFrame, ours: DataFrame, by: list[str], item: str) -> DataFrame:
    """(by, item, short): items that the target has more often than we do."""
    a = wanted.groupBy(*by, item).agg(F.count(F.lit(1)).alias("w"))
    b = ours.groupBy(*by, item).agg(F.count(F.lit(1)).alias("o"))
    return a.join(b, [*by, item], "left").withColumn("short", F.col("w") - F.coalesce("o", F.lit(0))).filter("short > 0").select(*by, item, "short")


def first_occurrences(df: DataFrame, by: list[str], item: str, order: list[Column]) -> DataFrame:
    """(by, items): different items in the order in which they first occur."""
    first = df.withColumn("__p", F.row_number().over(W.partitionBy(*by).orderBy(*order))).groupBy(*by, item).agg(F.min("__p").alias("__p"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", item))), lambda e: e[item]).alias("items"))


def sampled(points: DataFrame, raster: DataFrame, key: str, size: float, threshold: float, height: float) -> DataFrame:
    """(key, hit): the point's cell (i, j) has a value above the threshold and a height within `height` of y; points off the raster have no hit."""
    at = points.select(key, "y", F.floor(F.col("x") / size).cast("long").alias("i"), F.floor(F.col("z") / size).cast("long").alias("j"))
    j = at.join(raster, ["i", "j"], "left")
    return j.select(key, F.coalesce((F.abs(F.col("y") - F.col("h")) <= height) & (F.col("value") > threshold), F.lit(False)).alias("hit"))


def list_edits(c: Column, insert_at: int, value, erase: int, keep: int) -> dict[str, Column]:
    """Container edits on an array column: insert (of none is none), erase at a place from 0, cut to a size, reversed, appended, prepended, nth or null."""
    lit = F.lit(value)
    return {
        "inserted": F.array_insert(c, insert_at + 1, lit), "erased": F.concat(F.slice(c, 1, erase), F.slice(c, erase + 2, F.size(c))), "resized": F.slice(c, 1, keep),
        "backward": F.reverse(c), "appended": F.concat(c, F.array(lit)), "prepended": F.concat(F.array(lit), c), "nth": F.get(c, F.lit(erase)),
    }


def list_cuts(c: Column, other: Column, at: int, first: int, last: int, value) -> dict[str, Column]:
    """Splice of another array in at a place (nothing, where it is the same array), removal of a value, erasure of the places first to last - 1, all from 0."""
    spliced = F.when(c == other, c).otherwise(F.concat(F.slice(c, 1, at), other, F.slice(c, at + 1, F.size(c))))
    return {"spliced": spliced, "removed": F.array_remove(c, value), "cut": F.concat(F.slice(c, 1, first), F.slice(c, last + 1, F.size(c)))}


def members(log: DataFrame, node: str, holder: str, seq: str) -> DataFrame:
    """(holder, members) after a log of appends, prepends and removals (`op`): a node is in one list alone, that of its last entry, and in none after a
    removal; prepended nodes stand before the others, the last one first."""
    last = log.groupBy(node).agg(F.max_by(F.struct(holder, "op", seq), seq).alias("l")).filter("l.op <> 'remove'")
    place = F.when(F.col("l.op") == "prepend", -F.col(f"l.{seq}")).otherwise(F.col(f"l.{seq}"))
    rows = last.select(F.col(f"l.{holder}").alias(holder), F.struct(place.alias("p"), node).alias("e"))
    return rows.groupBy(holder).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e[node]).alias("members"))


def preorder(nodes: DataFrame, write) -> DataFrame:
    """(id, path) of nodes (id, parent, place): the places from the root (parent null) down, so paths in order are the tree in pre-order. One join a
    level; nodes that no root leads to have no path."""
    level = write(nodes.filter("parent IS NULL").select("id", F.array("place").alias("path")), "tree-level")
    out = level
    while not level.isEmpty():
        below = nodes.select(F.col("id").alias("child"), "parent", "place").join(level, F.col("parent") == F.col("id"))
        level = write(below.select(F.col("child").alias("id"), F.concat("path", F.array("place")).alias("path")), "tree-level")
        out = out.unionAll(level)
    return out
