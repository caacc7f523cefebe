"""Sharding by a k-d tree over metadata: law `bytes`, shards of near equal size.

A row weighs the UTF-8 bytes of its text plus OVERHEAD. Every metadata dimension is a whole number of BITS bits: VALUE_BITS of the value
within the table's range, then TIE_BITS of a hash of the row, then PLACE_BITS of a hash of the row's place in the written table, so
that rows of one value, and even equal rows, can be parted. A node of m leaves is split along the dimension in which it is widest,
at the weighted quantile that gives m//2 leaves their share: the median, where m is even.

All nodes of a level are split together. A pass sums weights by node, dimension and step (the key's first RADIX_BITS bits), on the map side
first; the step in which a node's quantile lies is looked into with the next RADIX_BITS bits only where it still weighs more than
TOLERANCE of a leaf. Splits are a table of one row a node: it is broadcast while a level has at most BROADCAST_NODES nodes, and joined by
node beyond, where no node is hot any more. The driver holds a count of open nodes and nothing else.

Rows are never gathered by node. Slots number a shard's rows from 0: rows are numbered in hash buckets of about SLOT_ROWS rows
of a shard, and the buckets' starts are added. Dimensions: log size, number of characters, source and language (places of
their hashes) and the id. Null metadata is the lowest value; null texts weigh OVERHEAD and have the CRC-32 of no bytes.
Rows of equal texts are a group. A group that weighs at most GROUP_SHARE of a shard's share has the keys of one point, so it lies in one shard; a
larger one is parted like other rows, since law `bytes` asks for even shards. Larger groups are fewer than shards / GROUP_SHARE, so what
is joined by group has no hot key. Ids that are no numbers have the place of their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import NumericType

from millrace.llm.common import cut, discard

OVERHEAD = 16
VALUE_BITS, TIE_BITS, PLACE_BITS = 20, 18, 22
BITS = VALUE_BITS + TIE_BITS + PLACE_BITS
RADIX_BITS = 12
TOLERANCE = 0.002
SLOT_ROWS = 500_000
BROADCAST_NODES = 100_000
#: The share of a shard up to which a group of equal texts stays together.
GROUP_SHARE = 0.05


def keyed(rows: DataFrame, dims: list[str]) -> DataFrame:
    """rows (with `tie` and `place`) with keys, an array of one key a dimension, in place of the dimensions (doubles, null allowed)."""
    ends = rows.agg(*(F.min(d).alias(f"lo_{d}") for d in dims), *(F.max(d).alias(f"hi_{d}") for d in dims)).first()
    top = (1 << VALUE_BITS) - 1
    low = F.col("tie") * F.lit(1 << PLACE_BITS) + F.pmod(F.xxhash64("place"), F.lit(1 << PLACE_BITS))
    made = []
    for d in dims:
        lo, hi = ends[f"lo_{d}"], ends[f"hi_{d}"]
        if lo is None or hi <= lo:
            value = F.lit(0).cast("long")
        else:
            value = F.coalesce(F.floor((F.col(d) - F.lit(float(lo))) / F.lit(float(hi) - float(lo)) * F.lit(float(top - 1))).cast("long") + 1, F.lit(0).cast("long"))
        made.append(value * F.lit(1 << (TIE_BITS + PLACE_BITS)) + low)
    return rows.select(*(c for c in rows.columns if c not in dims and c != "tie"), F.array(*made).alias("keys"))


def _beside(table: DataFrame, splits: DataFrame, nodes: int, how: str) -> DataFrame:
    return table.join(F.broadcast(splits) if nodes <= BROADCAST_NODES else splits, "node", how)


def _step(key: Column, depth: int) -> Column:
    return F.shiftright(key, BITS - depth).bitwiseAND((1 << RADIX_BITS) - 1)


def _crossed(sums: DataFrame, by: list[str]) -> DataFrame:
    """Of sums (by, target, below, step, w, ...) the row of the first step at which each group reaches its target, `below` brought up to it."""
    order = W.partitionBy(*by).orderBy("step")
    run = sums.withColumn("to", F.col("below") + F.sum("w").over(order)).withColumn("last", F.lead("step").over(order).isNull())
    reached = (F.col("to") >= F.col("target")) | F.col("last")
    return run.filter(reached & (F.col("to") - F.col("w") < F.col("target"))).withColumn("below", F.col("to") - F.col("w")).drop("to", "last")


def splits_of(placed: DataFrame, weight: str, nodes: int) -> DataFrame:
    """(node, dim, at) of each node of placed (node, leaves, weight, keys): rows whose key in dim is at most `at` go to the lower child."""
    each = placed.select("node", "leaves", weight, F.posexplode("keys").alias("dim", "key"))
    sums = each.groupBy("node", "leaves", "dim", _step(F.col("key"), RADIX_BITS).alias("step")).agg(F.sum(weight).alias("w"))
    own = W.partitionBy("node", "dim")
    wide = sums.withColumn("whole", F.sum("w").over(own)).withColumn("width", F.max("step").over(own) - F.min("step").over(own))
    wide = wide.withColumn("target", F.col("whole") * F.floor(F.col("leaves") / 2) / F.col("leaves")).withColumn("leaf", F.col("whole") / F.col("leaves")).withColumn("below", F.lit(0).cast("long"))
    best = _crossed(wide, ["node", "dim"]).groupBy("node").agg(F.max_by(F.struct("dim", "target", "leaf", "below", F.col("step").cast("long").alias("prefix"), "w"), F.struct("width", -F.col("dim"))).alias("s"))
    open_ = cut(best.select("node", "s.*"), "kd-splits")
    done, depth = [], RADIX_BITS
    while True:
        small = (F.col("w") <= F.lit(TOLERANCE) * F.col("leaf")) if depth < BITS else F.lit(True)
        # The step's nearer end.
        nearer = F.when(F.col("target") - F.col("below") < F.col("below") + F.col("w") - F.col("target"), F.col("prefix") - 1).otherwise(F.col("prefix"))
        done.append(open_.filter(small).select("node", "dim", (F.shiftleft(nearer + 1, BITS - depth) - 1).alias("at")))
        if depth >= BITS or not (left := open_.filter(~small).count()):
            break
        todo = open_.filter(~small).select("node", "dim", "target", "leaf", "below", "prefix")
        depth += RADIX_BITS
        near = _beside(placed.select("node", weight, "keys"), todo, left, "inner").withColumn("key", F.element_at("keys", F.col("dim") + 1))
        near = near.filter(F.shiftright("key", BITS - depth + RADIX_BITS) == F.col("prefix"))
        sums = near.groupBy("node", "dim", "target", "leaf", "below", "prefix", _step(F.col("key"), depth).alias("step")).agg(F.sum(weight).alias("w"))
        found = _crossed(sums, ["node"]).select("node", "dim", "target", "leaf", "below", (F.shiftleft("prefix", RADIX_BITS) + F.col("step")).alias("prefix"), "w")
        open_ = cut(found, "kd-splits")
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def grow(table: DataFrame, weight: str, shards: int) -> DataFrame:
    """table (with `keys`) and its leaf as column `node`; one written table a level."""
    table = table.withColumn("node", F.lit(0)).withColumn("leaves", F.lit(shards))
    nodes, most = 1, shards
    while most > 1:
        splits = splits_of(table.filter("leaves > 1"), weight, nodes)
        half = F.floor(F.col("leaves") / 2).cast("int")
        high = F.element_at("keys", F.col("dim") + 1) > F.col("at")
        parted = _beside(table, splits, nodes, "left").withColumn("half", half)
        node = F.when(F.col("at").isNull() | ~high, F.col("node")).otherwise(F.col("node") + F.col("half"))
        leaves = F.when(F.col("at").isNull(), F.col("leaves")).when(high, F.col("leaves") - F.col("half")).otherwise(F.col("half"))
        before, table = table, cut(parted.select(*(c for c in table.columns if c not in ("node", "leaves")), node.alias("node"), leaves.alias("leaves")), "kd-level")
        discard(before)
        nodes, most = min(2 * nodes, shards), most - most // 2
    return table


def grouped(rows: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """rows (group, crc, size, tie, place and dimensions) as a written table without `group`, in which the rows of each small group agree in all that keys are made of."""
    rows = cut(rows, "kd-rows")
    text = ["group", "crc", "size"]
    groups = cut(rows.groupBy(*text).agg(F.count(F.lit(1)).alias("n"), *(F.min(d).alias(f"g_{d}") for d in dims)).withColumn("weight", F.col("n") * F.col("size")), "kd-groups")
    most = F.lit(GROUP_SHARE / shards * (groups.agg(F.sum("weight")).first()[0] or 0))
    large = groups.filter((F.col("n") > 1) & (F.col("weight") > most)).select(*text)  # fewer than shards / GROUP_SHARE
    small = groups.filter((F.col("n") > 1) & (F.col("weight") <= most)).select(*text, *(f"g_{d}" for d in dims), F.lit(True).alias("kept"))
    apart = rows.join(F.broadcast(large), text, "left_semi")
    rest = rows.join(F.broadcast(large), text, "left_anti").join(small, text, "left")
    same = lambda one, other: F.when(F.col("kept"), one).otherwise(other)
    rest = rest.withColumns({"tie": same(F.pmod(F.xxhash64(*text), F.lit(1 << TIE_BITS)), F.col("tie")), "place": same(F.xxhash64(*text), F.col("place")), **{d: same(F.col(f"g_{d}"), F.col(d)) for d in dims}})
    columns = [c for c in rows.columns if c != "group"]
    found = cut(rest.select(*columns).unionAll(apart.select(*columns)), "kd-rows")
    discard(rows, groups)
    return found


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) of every row of docs; dims: name to a numeric Column, metadata() if None."""
    dims = metadata(docs, id_col) if dims is None else dims
    raw = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    size = F.octet_length(raw).cast("long") + OVERHEAD
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), size.alias("size"), F.crc32(raw).alias("crc"), F.xxhash64(raw).alias("group"), *(c.cast("double").alias(f"d_{d}") for d, c in dims.items()))
    names = ["d_size", *(f"d_{d}" for d in dims)]
    rows = rows.withColumn("d_size", F.log2(F.col("size").cast("double"))).withColumn("tie", F.pmod(F.xxhash64("i", "crc", "size"), F.lit(1 << TIE_BITS)))
    rows = grouped(rows.withColumn("place", F.monotonically_increasing_id()), names, shards)
    table = cut(keyed(rows, names), "kd-keys")
    buckets = max(1, -(-table.count() // (shards * SLOT_ROWS)))
    placed = grow(table, "size", shards).select("i", "size", "crc", F.col("node").alias("shard"), F.pmod(F.xxhash64("place"), F.lit(buckets)).cast("int").alias("bucket"))
    discard(rows)
    counts = placed.groupBy("shard", "bucket").agg(F.count("size").alias("n"))
    starts = counts.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    numbered = placed.withColumn("r", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("i", "crc", "size")))
    starts = F.broadcast(starts) if shards * buckets <= BROADCAST_NODES else starts
    joined = numbered.join(starts, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select(F.col("i").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("r") - 1).cast("long").alias("slot"))


def metadata(docs: DataFrame, id_col: str = "doc_id") -> dict[str, Column]:
    """The metadata dimensions that docs has."""
    place = lambda c: F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(F.col(c)), F.lit(1 << 20)))
    found = {c: (place(c) if c in ("source", "lang") else F.col(c)) for c in ("n_chars", "source", "lang") if c in docs.columns}
    numeric = isinstance(docs.schema[id_col].dataType, NumericType)
    return found | {"id": F.col(f"`{id_col}`") if numeric else F.when(F.col(f"`{id_col}`").isNotNull(), F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(1 << 20)))}
