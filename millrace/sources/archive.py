"""Archives as tables of entries: (id, parent, name, is_file, type); lookups, counts and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import scalar as S


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, modified) of the files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def resolve(entries: DataFrame, paths: DataFrame, path: str, folders: bool = False) -> DataFrame:
    """(path, id) of the file (with folders: of the file or folder) that each path leads to from the root (parent null), components compared in lower
    case; null where a component is missing or stands behind a file, and where the path ends at a directory (with folders: at the root).

    '.' is passed over, '..' goes back by one and no farther than the root. One join a level, as many as the longest path has."""
    e = entries.select(F.col("id").cast("long").alias("e_id"), F.coalesce("parent", F.lit(-1)).cast("long").alias("e_parent"), F.lower("name").alias("e_name"), F.col("is_file").alias("e_file"))
    e = e.withColumn("__r", F.row_number().over(W.partitionBy("e_parent", "e_name").orderBy("e_id"))).filter("__r = 1").drop("__r")
    parts = F.filter(S.path_parts(F.col(path)), lambda p: p != ".")
    now = paths.select(path, parts.alias("parts")).withColumns({"trail": F.array(F.lit(-1).cast("long")), "file": F.lit(False), "lost": F.lit(False)})
    last = F.element_at("trail", -1)
    for i in range(now.agg(F.max(F.size("parts"))).first()[0] or 0):
        part = F.get("parts", F.lit(i))
        back = part == ".."
        j = now.join(e, (part == F.col("e_name")) & ~back & ~F.col("file") & ~F.col("lost") & (last == F.col("e_parent")), "left")
        found = F.col("e_id").isNotNull()
        shorter = F.when(F.size("trail") > 1, F.slice("trail", 1, F.size("trail") - 1)).otherwise(F.col("trail"))
        now = j.select(
            path, "parts", F.when(part.isNull(), F.col("trail")).when(back, shorter).when(found, F.concat("trail", F.array("e_id"))).otherwise(F.col("trail")).alias("trail"),
            F.when(part.isNull(), F.col("file")).when(back, F.lit(False)).otherwise(F.coalesce("e_file", F.lit(False))).alias("file"), (F.col("lost") | F.coalesce(part.isNotNull() & ~back & ~found, F.lit(False))).alias("lost"),
        )
    reached = ~F.col("lost") & (F.col("file") | ((last != -1) if folders else F.lit(False)))
    return now.select(path, F.when(reached, last).alias("id"))


def lookup(entries: DataFrame, wanted: DataFrame, by: str, direct: bool = False) -> DataFrame:
    """(by, slot) of the first entry, in order of slot, that has each wanted value of `by`; with direct the entry in the slot of that number
    comes before. Null where no entry has it."""
    first = entries.groupBy(by).agg(F.min("slot").alias("slot"))
    found = wanted.select(by).distinct().join(first, by, "left")
    if not direct:
        return found
    own = entries.filter(F.col(by) == F.col("slot")).select(by, F.col("slot").alias("own"))
    return found.join(own, by, "left").select(by, F.coalesce("own", "slot").alias("slot"))


def first_by(entries: DataFrame, holds) -> DataFrame:
    """The first entry in order of id that `holds`."""
    return entries.filter(holds).orderBy("id").limit(1)


def counts(entries: DataFrame) -> DataFrame:
    """(type, n) of the files."""
    return entries.filter("is_file").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def directory(entries: DataFrame, parent) -> DataFrame:
    """All entries of a directory, sub-directories included."""
    return entries.filter(F.col("parent").eqNullSafe(F.lit(parent)))
