"""Keyed state over event time, in processors whose results do not depend on how a stream is cut into batches.

Rows wait in a list state until the watermark has passed them; a timer then takes those that are due in order of (at, seq). Rows more
than the watermark's delay out of order are late and left out, as everywhere in Structured Streaming. Expiry is a timer of
event time. Times are microseconds; the watermark knows milliseconds, so a row counts for it by the next whole one, and is due with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.session import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started in here keep their state in RocksDB, which transformWithState asks for."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


#: Keys share their state by buckets, so that what a call to the state store costs is paid by the bucket. A bucket's rows that are due at once stand in one task.
#: A stream that goes on from a checkpoint must keep its number.
BUCKETS = 4096
#: Levels of a stack in one entry of its state.
PIECE = 64


class InOrder(StatefulProcessor):
    """Takes each key's rows (at, seq, op) of a bucket in order; subclasses say what is kept and given out. Keys are texts in here, as null would make others floats."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key array<string>, at array<bigint>, seq array<bigint>, op array<string>")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, rows: list[tuple], now: int) -> Iterator[tuple]:
        """What rows (key, at, seq, op) that are due, by key and in order, and the time that has come, give out."""
        raise NotImplementedError

    def wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def wait(self, rows: list[tuple]) -> None:
        self.waiting.appendValue(tuple(map(list, zip(*rows, strict=True))))
        self.wake(min(r[1] for r in rows))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.wait(list(zip(*(part[n].tolist() for n in ("key", "at", "seq", "op")), strict=True)))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [r for part in self.waiting.get() for r in zip(*part, strict=True)] if self.waiting.exists() else []
        due = sorted((r for r in held if r[1] <= now), key=lambda r: (r[0] or "", r[1], r[2]))
        if due:
            self.waiting.clear()
            if len(due) < len(held):
                self.wait([r for r in held if r[1] > now])
        yield pd.DataFrame(list(self.take(due, now)), columns=self.columns)

    def close(self) -> None:
        pass


class Held(InOrder):
    """A key is held from its first row until `ttl` microseconds pass without another; then it is released and its state goes."""

    schema, columns = "key string, held_from long, released_at long, n long", ["key", "held_from", "released_at", "n"]

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.hold = handle.getValueState("hold", "key array<string>, first array<bigint>, last array<bigint>, n array<bigint>")

    def take(self, rows: list[tuple], now: int) -> Iterator[tuple]:
        holds = {k: h for k, *h in zip(*self.hold.get(), strict=True)} if self.hold.exists() else {}
        for key, at, _, _ in rows:
            first, last, n = holds.get(key, (at, at, 0))
            if at >= last + self.ttl:
                yield key, first, last + self.ttl, n
                first, n = at, 0
            holds[key] = first, at, n + 1
        for key, (first, last, n) in holds.items():
            if last + self.ttl <= now:
                yield key, first, last + self.ttl, n
        left = [(k, *h) for k, h in holds.items() if h[1] + self.ttl > now]
        if left:
            self.hold.update(tuple(map(list, zip(*left, strict=True))))
            self.wake(min(r[2] for r in left) + self.ttl)
        else:
            self.hold.clear()


class Stacked(InOrder):
    """A key's stack of states: an op pushes its text, `pop` takes the top off, of an empty stack nothing. PIECE levels are an entry of a map, so no op reads the whole stack."""

    schema, columns = "key string, seen long, depth long, top string", ["key", "seen", "depth", "top"]

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getMapState("size", "key string", "seen bigint, depth bigint")
        self.levels = handle.getMapState("levels", "key string, piece bigint", "ops array<string>")

    def piece(self, key: str | None, i: int) -> list[str]:
        return list(self.levels.getValue((key, i))[0])

    def take(self, rows: list[tuple], now: int) -> Iterator[tuple]:
        for key, some in groupby(rows, lambda r: r[0]):
            seen, depth = self.size.getValue((key,)) or (0, 0)
            low, pushed = depth, []  # what lies below `low` is as it was, what was pushed lies above
            for _, _, _, op in some:
                seen += 1
                if op != "pop":
                    pushed.append(op)
                elif pushed:
                    pushed.pop()
                elif low:
                    low -= 1
            first, now_depth = low // PIECE, low + len(pushed)
            ops = (self.piece(key, first)[: low % PIECE] if low % PIECE else []) + pushed
            if now_depth != low or low != depth:
                for i in range(0, len(ops), PIECE):
                    self.levels.updateValue((key, first + i // PIECE), (ops[i : i + PIECE],))
                for i in range(-(-now_depth // PIECE), -(-depth // PIECE)):
                    self.levels.removeKey((key, i))
            self.size.updateValue((key,), (seen, now_depth))
            yield key, seen, now_depth, ops[-1] if ops else self.piece(key, first - 1)[-1] if low else None


def in_order(stream: DataFrame, key: str, at: str, seq: str, op: str | None, late: str, processor: InOrder) -> DataFrame:
    """What processor gives for the rows of a stream, by key, in order of (at, seq); `at` is a timestamp, `late` how far rows may be out of order."""
    ship(stream.sparkSession)
    rows = stream.select(F.col(key).cast("long").cast("string").alias("key"), F.timestamp_millis(F.ceil(F.unix_micros(at) / 1000).cast("long")).alias("time"), F.unix_micros(at).alias("at"), F.col(seq).cast("long").alias("seq"), (F.col(op) if op else F.lit(None)).cast("string").alias("op"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    made = dealt.withWatermark("time", late).groupBy("bucket").transformWithStateInPandas(processor, processor.schema, "Append", "EventTime")
    return made.withColumn("key", F.col("key").cast("long"))
