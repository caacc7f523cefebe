"""Queues between senders and workers: a ring fed by messages, copies through a transfer buffer, tasks of two priorities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.session import ship

#: Fixed ranges of a message: from TOKENS on it is a token to keep, from STOP on the worker ends, smaller ones ask for the next token.
TOKENS, STOP = 0x80000000, 0x10000


def worker_ring(log: DataFrame, key: str, order: list[str], message: str, capacity: int) -> DataFrame:
    """The rows of log up to a key's first stop, with kind, size and the break point that the message sets.

    A ring of capacity + 1 slots takes tokens without asking whether there is room: where one too many comes, the ring counts as empty and old tokens are
    overwritten. break_at is the token that a message arms (a second token itself; the one after the next where two or more are left), disarms tells
    that the last but one has gone. State is two running counts and the last token of a slot, so windows say it all."""
    c, n = F.col, capacity + 1
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    kind = F.when(c(message) >= TOKENS, "token").when(c(message) >= STOP, "stop").otherwise("next")
    counted = log.withColumn("kind", kind).withColumns({k: F.count_if(c("kind") == k).over(w) for k in ("token", "stop", "next")}).filter(c("stop") == 0)
    slot = F.when(c("kind") == "token", (c("token") - 1) % n).otherwise((c("next") + 1) % n)
    at = W.partitionBy(key, "slot").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    held = F.last(F.when(c("kind") == "token", c(message)), ignorenulls=True).over(at)
    sized = counted.withColumns({"size": F.pmod(c("token") - c("next"), F.lit(n)), "slot": slot}).withColumn("held", held)
    armed = ((c("kind") == "token") & (c("size") == 2)) | ((c("kind") == "next") & (c("size") >= 2))
    return sized.select(*log.columns, "kind", "size", F.when(armed, c("held")).alias("break_at"), ((c("kind") == "next") & (c("size") == 1)).alias("disarms"))


def buffered_copy(df: DataFrame, key: str, data: str, size: Column, chunk: int) -> DataFrame:
    """(key, chunk, offset, bytes): `size` bytes asked of each binary, in pieces of `chunk` through one buffer that starts with zeros.

    Where the data end before, a piece is copied whole all the same: behind what was read stands what the buffer held before."""
    c, d = F.col, F.col("d")
    full, rest = F.floor(F.length(d) / chunk).cast("int"), F.length(d) % chunk
    zeros = F.unhex(F.repeat(F.lit("00"), chunk))
    stale = F.when(full > 0, F.substring(d, F.greatest(full - 1, F.lit(0)) * chunk + 1, F.lit(chunk))).otherwise(zeros)
    at = df.select(key, F.coalesce(F.col(data), F.lit(b"")).alias("d"), size.alias("size")).filter("size > 0")
    at = at.select(key, "d", "size", F.explode(F.sequence(F.lit(0), F.floor((c("size") - 1) / chunk).cast("int"))).alias("chunk"))
    last = F.concat(F.substring(d, full * chunk + 1, F.lit(chunk)), F.substring(stale, rest + 1, F.lit(chunk)))
    held = F.when(c("chunk") < full, F.substring(d, c("chunk") * chunk + 1, F.lit(chunk))).otherwise(last)
    return at.select(key, "chunk", (c("chunk") * chunk).alias("offset"), F.substring(held, F.lit(1), F.least(c("size") - c("chunk") * chunk, F.lit(chunk)).cast("int")).alias("bytes"))


def post(queue: list[int], waiting: list[tuple[str, int]], op: str, item: int, cap: int) -> str:
    """One request to a queue of at most cap tasks: 'low' is put behind, 'high' in front, 'take' takes the first. A sender that finds no room 'waits'; each
    task taken lets in the sender that has waited longest."""
    if op == "take":
        if not queue:
            return "empty"
        took = queue.pop(0)
        if waiting:
            post(queue, [], *waiting.pop(0), cap)
        return f"took {took}"
    if len(queue) >= cap:
        waiting.append((op, item))
        return "waits"
    queue.insert(0 if op == "high" else len(queue), item)
    return "queued"


def task_queue(stream: DataFrame, key: str, op: str, item: str, at: str, cap: int) -> DataFrame:
    """(key, item, action) of each request to a key's queue, taken in order of (at, item) in each batch; the state is what is queued and who waits."""
    ship(stream.sparkSession)

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue, ops, items = (list(x) for x in state.get) if state.exists else ([], [], [])
        waiting = list(zip(ops, items, strict=True))
        rows = pd.concat(list(parts)).sort_values(["at", "item"], kind="stable")
        out = [(k[0], int(i), post(queue, waiting, o, int(i), cap)) for o, i in zip(rows["op"], rows["item"], strict=True)]
        state.update((queue, [o for o, _ in waiting], [i for _, i in waiting]))
        yield pd.DataFrame(out, columns=["key", "item", "action"])

    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(op).alias("op"), F.col(item).cast("long").alias("item"), F.col(at).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, item long, action string", "queue array<bigint>, ops array<string>, items array<bigint>", "append", GroupStateTimeout.NoTimeout)
