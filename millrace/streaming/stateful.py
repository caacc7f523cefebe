"""Streaming operators: gated ticks, capped admission with eviction, keyed flags, generators.

State is per key and bounded by a cap; it lives in Spark's state store and is checkpointed in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.session import shared_folder, ship


def events_stream(spark: SparkSession, path: str, files_a_batch: int | None = 8) -> DataFrame:
    """A stream over the Parquet file or files of a table, event time as a timestamp. Files that are not in order of time go in one batch (None), or the watermark
    of those before takes rows of the later ones for late."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern may lead to one file, where a plain path must be a folder
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all input that is there now, through a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/millrace-stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def upserted(stream: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The latest row of each key. A batch is merged into the table that the batch before it left, which then goes, so what is kept is one row a key; a
    batch that is repeated reads the same table and writes the same rows."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/millrace-upsert-{name}-{uuid.uuid4().hex}"
    place = lambda epoch: f"{base}/kept/epoch={epoch}"
    schema, rest, done = stream.schema, [c for c in stream.columns if c not in keys], [-1]

    def batch(df: DataFrame, epoch: int) -> None:
        session = df.sparkSession
        if epoch:
            df = df.unionByName(session.read.schema(schema).parquet(place(epoch - 1)))
        last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
        last.write.mode("overwrite").parquet(place(epoch))
        done[0] = epoch
        if epoch > 1:  # the table before the last may still be asked for by a repeated batch
            path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(place(epoch - 2))
            path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(place(done[0])) if done[0] >= 0 else spark.createDataFrame([], schema)


def gated_ticks(stream: DataFrame, seq: str, period: int) -> DataFrame:
    """Rows at which a counter of `period` stands at 1."""
    return stream.filter(F.pmod(F.col(seq), F.lit(period)) == 1)


def admit(held: list[tuple[int, int]], item: int, priority: int, cap: int, stopping: set[int] = frozenset()) -> tuple[str, int | None]:
    """Admission to a list of (priority, item), oldest first: stored, replaced (same item), evicted (with the one that left) or rejected.

    A full list loses its lowest priority, the oldest of these, unless the newcomer is lower, or equal while that one is not stopping."""
    for i, (_, other) in enumerate(held):
        if other == item:
            held[i] = (priority, item)
            return "replaced", None
    if len(held) < cap:
        held.append((priority, item))
        return "stored", None
    low = min(range(len(held)), key=lambda i: held[i][0])
    if priority < held[low][0] or (priority == held[low][0] and held[low][1] not in stopping):
        return "rejected", None
    gone = held.pop(low)[1]
    held.append((priority, item))
    return "evicted", gone


def capped_admission(stream: DataFrame, key: str, item: str, priority: str, at: str, cap: int, ttl_ms: int | None = None) -> DataFrame:
    """(key, item, action, gone) of each request, with at most `cap` items held a key; with ttl_ms a key without requests for so long is released.

    Requests of one batch are taken in order of (at, item)."""
    ship(stream.sparkSession)

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["at", "item"], kind="stable")
        out = []
        for i, p in zip(rows["item"], rows["priority"], strict=True):
            action, gone = admit(held, int(i), int(p), cap)
            out.append((k[0], int(i), action, -1 if gone is None else gone))
        state.update(([p for p, _ in held], [i for _, i in held]))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["key", "item", "action", "gone"])

    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(item).cast("long").alias("item"), F.col(priority).cast("long").alias("priority"), F.col(at).alias("at"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(step, "key long, item long, action string, gone long", "priorities array<bigint>, items array<bigint>", "append", timeout)


def countdown(df: DataFrame, seq: str, interval: int) -> DataFrame:
    """Rows at which a counter that starts at `interval` and falls by one a row reaches 0 and starts anew."""
    return df.filter(F.pmod(F.col(seq) + 1, F.lit(interval + 1)) == 0)


def gate(waiting: list[tuple[int, int]], playing: list[tuple[int, int]], op: str, item: int, priority: int, cap: int, slots: int) -> str:
    """One request to a bounded ring: waiting and playing hold (priority, item), oldest first.

    'drain' moves waiting items to free slots, oldest first, and says how many. Any other request is 'full' where `cap` items wait, 'refused' where a slot is
    free or what plays at the lowest priority is of a higher one, else that is stopped, the oldest first, and the item 'waits'."""
    if op == "drain":
        n = min(len(waiting), slots - len(playing))
        playing += waiting[:n]
        del waiting[:n]
        return f"drained {n}"
    if len(waiting) == cap:
        return "full"
    low = min(range(len(playing)), key=lambda i: playing[i][0], default=None)
    if low is None or len(playing) < slots or playing[low][0] > priority:
        if len(playing) < slots and not waiting:
            playing.append((priority, item))
            return "plays"
        return "refused"
    playing.pop(low)
    waiting.append((priority, item))
    return "waits"


def gated_ring(stream: DataFrame, key: str, op: str, item: str, priority: str, at: str, cap: int, slots: int) -> DataFrame:
    """(key, item, action) of each request to a key's ring, taken in order of (at, item) in each batch; `cap` and `slots` bound the state."""
    ship(stream.sparkSession)

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, playing = ([tuple(x) for x in zip(p, i, strict=True)] for p, i in ((state.get[0], state.get[1]), (state.get[2], state.get[3]))) if state.exists else ([], [])
        rows = pd.concat(list(parts)).sort_values(["at", "item"], kind="stable")
        out = [(k[0], int(i), gate(waiting, playing, o, int(i), int(p), cap, slots)) for o, i, p in zip(rows["op"], rows["item"], rows["priority"], strict=True)]
        state.update(([p for p, _ in waiting], [i for _, i in waiting], [p for p, _ in playing], [i for _, i in playing]))
        yield pd.DataFrame(out, columns=["key", "item", "action"])

    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(op).alias("op"), F.col(item).cast("long").alias("item"), F.col(priority).cast("long").alias("priority"), F.col(at).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, item long, action string", "wp array<bigint>, wi array<bigint>, pp array<bigint>, pi array<bigint>", "append", GroupStateTimeout.NoTimeout)


def double_buffered(log: DataFrame, frame: str, key: str, value: str) -> DataFrame:
    """(frame, key, written, read): what a frame writes to the one buffer, as a sum, and reads from the other, which the frame just before it wrote; null
    where that wrote nothing."""
    now = log.groupBy(frame, key).agg(F.sum(value).alias("written"))
    before = now.select((F.col(frame) + 1).alias(frame), key, F.col("written").alias("read"))
    return now.join(before, [frame, key], "left")


def dispatched(cues: DataFrame, subscribers: DataFrame, bits: int) -> DataFrame:
    """(cue, id, nth): each cue (cue, mask) goes to the subscribers (id, mask, place) that share a bit with it, in order of place. Masks meet by their bits."""
    by_bit = lambda d, *names: d.select(*names, F.explode(F.filter(F.array(*(F.lit(b) for b in range(bits))), lambda b: F.call_function("shiftright", F.col("mask"), b).bitwiseAND(F.lit(1)) == 1)).alias("bit"))
    met = by_bit(cues, "cue").join(by_bit(subscribers, "id", "place"), "bit").select("cue", "id", "place").distinct()
    return met.select("cue", "id", F.row_number().over(W.partitionBy("cue").orderBy("place", "id")).alias("nth"))


def transactional(log: DataFrame, ns: str, key: str, value: str, seq: str) -> DataFrame:
    """(ns, key, good, working) after a log of op set, success and fail in each namespace: a success makes the working copy the good one, a fail (or restore) the
    good one the working copy. A set holds in the good copy if a success is the next of these after it, and in the working one also if none came."""
    after = W.partitionBy(ns).orderBy(seq).rowsBetween(1, W.unboundedFollowing)
    fate = F.first(F.when(F.col("op") != "set", F.col("op")), ignorenulls=True).over(after)
    sets = log.withColumn("fate", fate).filter("op = 'set'")
    last = lambda holds: F.max_by(F.when(holds, F.col(value)), F.when(holds, F.col(seq)))
    kept = F.col("fate") == "success"
    return sets.groupBy(ns, key).agg(last(kept).alias("good"), last(kept | F.col("fate").isNull()).alias("working")).filter("working IS NOT NULL")


def flags_state(log: DataFrame, ns: str, idx: str, value: str, seq: str, bounds: DataFrame) -> DataFrame:
    """(ns, idx, value) of namespaced flags from a log of sets and increments (`op`): the last set and the increments after it. Ids outside
    bounds (ns, size, is_bool) are passed over; increments of boolean namespaces count nothing, their values are 0 or 1."""
    x = log.join(F.broadcast(bounds), ns).filter((F.col(idx) >= 0) & (F.col(idx) < F.col("size")))
    last = x.filter("op = 'set'").groupBy(ns, idx).agg(F.max(F.struct(seq, F.col(value).alias("v"))).alias("s"))
    y = x.select(ns, idx, seq, value, "op", "is_bool").join(last, [ns, idx], "left")
    add = F.sum(F.when((F.col("op") == "inc") & ~F.col("is_bool") & (F.col("s").isNull() | (F.col(seq) > F.col(f"s.{seq}"))), F.col(value)).otherwise(0))
    got = y.groupBy(ns, idx).agg(F.first("is_bool").alias("b"), F.coalesce(F.max("s.v"), F.lit(0)).alias("base"), add.alias("add"))
    total = F.col("base") + F.col("add")
    return got.select(ns, idx, F.when(F.col("b"), F.when(total != 0, 1).otherwise(0)).otherwise(total).cast("long").alias("value"))


def scoped_reset(state: DataFrame, ns: str, scope: str, scopes: dict[str, list[int]]) -> DataFrame:
    """State without the namespaces of a scope and of those inside it; scopes from the widest to the narrowest, with their own namespaces."""
    names = list(scopes)
    gone = [n for s in names[names.index(scope) :] for n in scopes[s]]
    return state.filter(~F.col(ns).isin(gone))
