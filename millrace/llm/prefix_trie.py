"""A prefix trie of conversations that share their first turns, merged by families first.

Conversations with ids base .. base+19 are a family. A member's first h turns (h from a hash of its id) are replaced by the
base's first h turns. Each family's rows are brought together by one shuffle; there its members are rebuilt, and equal
prefixes become nodes with a list of at most FAMILY members. Only these family nodes go on to the merge of the whole trie.

* Turns are numbered by ranges: rows are range-partitioned by (conversation, turn, content), so a conversation of any
  length is spread over many tasks, and each part's offset comes from a table of one row a conversation and part.
* A prefix of depth d has the key (d, x, y): x and y are exclusive-ors, over its turns, of 64-bit hashes of place and
  content (118 bits of SHA-256). Blocks of BLOCK turns are summed up apart and put together by the sums of the blocks
  before, so no window or join key gathers more than BLOCK rows of a conversation and no family more than FAMILY * BLOCK.
* Sums over subtrees need no rounds. A node belongs to its smallest member; a conversation's own nodes are the end of its
  path. A subtree's sum is what the node's owner owns from there on, plus everything that the other members own.

Defined results: rows without a conversation id are left out; a null turn comes first, turns that tie go by a hash of their content;
null role or text is empty; a family without a row of its base shares nothing; repeated rows are turns of their own;
other columns are never looked at; an empty table has no nodes, not even a root. `ends_sha256` is a hash over one list of
ids, so it is taken in order by one task a node, row by row; the list is never held.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, discard
from millrace.session import ship

#: Conversations of a family: ids with the same quotient.
FAMILY = 20
#: Turns of a conversation that are handled together.
BLOCK = 256
#: The base's first turns that a member may take over are fewer than this.
HEADS = 4
#: Bits of a row's place within its partition in monotonically_increasing_id.
_PLACE_BITS = 33
KEY = ["depth", "x", "y"]


def _lane(digest: Column, first: int) -> Column:
    return F.conv(F.substring(digest, first, 15), 16, 10).cast("bigint")


def _block(depth: Column) -> Column:
    return F.floor((depth - 1) / BLOCK).cast("bigint")


def numbered_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(conv, part, r, p, q, words) of each turn, its content as two numbers, and (conv, part, r0, before, n): the place of the
    first of a conversation's turns in each part, the number of its turns in earlier parts, and of all. The first is a written table."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("words")).filter("conv IS NOT NULL")
    # Rows that are equal in all else may be parted at any place: they are the same turn.
    order = ["conv", F.col("turn").asc_nulls_first(), "digest", F.xxhash64(F.monotonically_increasing_id())]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = turns.repartitionByRange(parts, *order).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "digest")
    at = F.col("at")
    placed = placed.withColumn("at", F.monotonically_increasing_id()).select("conv", F.shiftrightunsigned(at, _PLACE_BITS).alias("part"), at.bitwiseAND((1 << _PLACE_BITS) - 1).alias("r"), _lane(F.col("digest"), 1).alias("p"), _lane(F.col("digest"), 16).alias("q"), "words")
    placed = cut(placed, "trie-numbered")
    earlier = Window.partitionBy("conv").orderBy("part")
    runs = placed.groupBy("conv", "part").agg(F.min("r").alias("r0"), F.count("*").alias("n_part"))
    runs = runs.withColumn("before", F.sum("n_part").over(earlier.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_part")).withColumn("n", F.sum("n_part").over(Window.partitionBy("conv")))
    return placed, runs.drop("n_part")


def rebuilt_turns(turns: DataFrame, runs: DataFrame, heads: Column) -> tuple[DataFrame, DataFrame]:
    """((base, conv, depth, x, y, words, total) of each rebuilt turn, (base, conv, total) of each conversation). heads: how many
    of the base's first turns conversation `conv` takes over, below HEADS."""
    convs = runs.filter("before = 0").select("conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    firsts = convs.filter("conv = base").select("base", F.least("n", F.lit(HEADS - 1)).alias("given"))
    convs = convs.join(firsts, "base", "left").withColumn("own", F.when(F.col("conv") == F.col("base"), 0).otherwise(heads))
    convs = convs.withColumn("taken", F.least("own", F.coalesce("given", F.lit(0))))
    convs = cut(convs.select("base", "conv", "own", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("own"), F.lit(0))).alias("total")), "trie-conversations")
    places = runs.select("conv", "part", "r0", "before").join(convs, "conv")
    placed = turns.join(places, ["conv", "part"]).withColumn("i", F.col("before") + F.col("r") - F.col("r0"))
    kept = placed.filter("i >= own").select("base", "conv", (F.col("i") - F.col("own") + F.col("taken") + 1).alias("depth"), "p", "q", "words", "total")
    given = placed.filter(f"conv = base AND i < {HEADS - 1}").select("base", "i", "p", "q", "words")
    taken = given.join(convs.filter("taken > 0"), "base").filter("i < taken").select("base", "conv", (F.col("i") + 1).alias("depth"), "p", "q", "words", "total")
    return kept.unionByName(taken).select("base", "conv", "depth", F.xxhash64("depth", "p", "q").alias("x"), F.xxhash64("q", "depth", "p").alias("y"), "words", "total"), convs


def family_nodes(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, x, y, px, py, words, members, ends) of each node of each family's trie: the keys of a prefix and of its parent, the ids of
    the family's conversations that start with it, and of those that are it."""
    rows = rebuilt.withColumn("block", _block(F.col("depth")))
    blocks = rows.filter(F.col("total") > BLOCK).groupBy("base", "conv", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    # What comes before a block stands in front of its first turn, as if it were a turn.
    entering = blocks.select("base", "conv", (F.col("block") + 1).alias("block"), ((F.col("block") + 1) * BLOCK).alias("depth"), F.bit_xor("x").over(before).alias("x"), F.bit_xor("y").over(before).alias("y"))
    rows = rows.withColumn("real", F.lit(True)).unionByName(entering.withColumn("real", F.lit(False)), allowMissingColumns=True).repartition("base", "block")
    path = Window.partitionBy("base", "block", "conv").orderBy("depth", "real").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"kx": F.bit_xor("x").over(path), "ky": F.bit_xor("y").over(path)}).filter("real")
    grouped = rows.groupBy("base", "block", "depth", "kx", "ky").agg(
        F.max(F.col("kx").bitwiseXOR(F.col("x"))).alias("px"), F.max(F.col("ky").bitwiseXOR(F.col("y"))).alias("py"), F.max("words").alias("words"),
        F.collect_list("conv").alias("members"), F.collect_list(F.when(F.col("depth") == F.col("total"), F.col("conv"))).alias("ends"),
    )
    nodes = grouped.select("depth", F.col("kx").alias("x"), F.col("ky").alias("y"), "px", "py", "words", "members", "ends")
    zero = F.lit(0).cast("bigint")
    tops = convs.groupBy("base").agg(F.collect_list("conv").alias("members"), F.collect_list(F.when(F.col("total") == 0, F.col("conv"))).alias("ends"))
    return nodes.unionByName(tops.select(zero.alias("depth"), zero.alias("x"), zero.alias("y"), F.lit(None).cast("bigint").alias("px"), F.lit(None).cast("bigint").alias("py"), zero.alias("words"), "members", "ends"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256): SHA-256 of the comma-joined ids `conv` of each key, ascending. Ids pass in order and are not held."""
    ship(ends.sparkSession)

    def run(batches):
        key, digest, out = None, None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *now, conv in zip(*columns, strict=True):
                if now == key:
                    digest.update(b",%d" % conv)
                    continue
                if digest:
                    out.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(b"%d" % conv)
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*KEY, "ends_sha256"])
                out = []
        if digest:
            out.append((*key, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*KEY, "ends_sha256"])

    return ends.select(*KEY, "conv").repartition(*KEY).sortWithinPartitions(*KEY, "conv").mapInArrow(run, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, heads: Column | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    heads, over a column `conv`, says how many of its base's first turns a conversation takes over (below HEADS); by default crc32 of
    the id's decimal text modulo HEADS.
    """
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS if heads is None else heads
    turns, runs = numbered_turns(conversations, conv_col, turn_col, role_col, text_col)
    rebuilt, convs = rebuilt_turns(turns, runs, heads)
    rebuilt = cut(rebuilt, "trie-rebuilt")
    discard(turns)
    families = cut(family_nodes(rebuilt, convs), "trie-families")
    discard(rebuilt, convs)

    merged = families.groupBy(*KEY).agg(
        F.max("px").alias("px"), F.max("py").alias("py"), F.max("words").alias("words"), F.sum(F.size("members")).alias("n_convs"),
        F.min(F.array_min("members")).alias("owner"), F.sum(F.size("ends")).alias("n_ends"),
    )
    nodes = cut(merged.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("block", F.greatest(_block(F.col("depth")), F.lit(0))), "trie-nodes")

    # What each conversation owns, by blocks: the sum in later blocks, the depths at which it begins and ends, whether its end is a leaf.
    owned = nodes.groupBy("owner", "block").agg(F.sum("saved").alias("sum"), F.min("depth").alias("start"), F.max("depth").alias("last"), F.max((F.col("n_convs") == F.col("n_ends")).cast("bigint")).alias("leaf"))
    whole = Window.partitionBy("owner")
    later = whole.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, 0)
    owned = owned.select("owner", "block", (F.sum("sum").over(later) - F.col("sum")).alias("after"), F.sum("sum").over(whole).alias("total"), F.min("start").over(whole).alias("start"), F.max("last").over(whole).alias("last"), F.max("leaf").over(whole).alias("leaf"))
    owned = cut(owned, "trie-owned")

    # Members that don't own the node give it all that they own.
    first = owned.filter(F.col("block") == F.greatest(_block(F.col("start")), F.lit(0))).filter("start > 0")
    guests = first.select(F.col("owner").alias("conv"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(_block(F.col("start") - 1), F.lit(0)))).alias("block"), "total", "start", "leaf")
    members = families.select(*KEY, F.greatest(_block(F.col("depth")), F.lit(0)).alias("block"), F.explode("members").alias("conv"))
    given = members.join(guests, ["conv", "block"]).filter("depth < start").groupBy(*KEY).agg(F.sum("total").alias("guest_total"), F.sum("leaf").alias("guest_leaves"), F.count(F.when(F.col("start") == F.col("depth") + 1, 1)).alias("guest_children"))

    from_here = Window.partitionBy("owner", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    nodes_owned = nodes.join(owned.drop("total", "start"), ["owner", "block"]).withColumn("own_total", F.sum("saved").over(from_here) + F.col("after"))
    digests = _end_digests(families.select(*KEY, F.explode("ends").alias("conv")))
    full = nodes_owned.join(given, KEY, "left").join(digests, KEY, "left")
    # One parent may have a third of all nodes as children; the join by its key is one that Spark splits by itself.
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("owner").alias("parent_conv_id"))
    full = full.join(parents, ["depth", "px", "py"], "left")
    zero = F.lit(0).cast("bigint")
    return full.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs",
        ((F.col("depth") < F.col("last")).cast("bigint") + F.coalesce("guest_children", zero)).alias("n_children"),
        (F.col("leaf") + F.coalesce("guest_leaves", zero)).alias("n_leaves"),
        (F.col("own_total") + F.coalesce("guest_total", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
