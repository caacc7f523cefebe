"""Keyed state across batches of any size, and versions that survive failures, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.session import place
from millrace.streaming import keyed, stateful, versioned

START = dt.datetime(2024, 1, 1)


def files(spark, path, rows, number):
    """rows (id, second, key, op) in `number` files, read in order of their names' times."""
    import os
    import time

    step = -(-len(rows) // number)
    for k in range(number):
        some = [(i, START + dt.timedelta(seconds=s), u, o) for i, s, u, o in rows[k * step : (k + 1) * step]]
        spark.createDataFrame(some, "event_id long, ts timestamp, user_id long, op string").coalesce(1).write.parquet(f"{path}/w{k}")
        (part,) = (f for f in os.listdir(f"{path}/w{k}") if f.startswith("part"))
        os.makedirs(f"{path}/in.parquet", exist_ok=True)
        os.rename(f"{path}/w{k}/{part}", f"{path}/in.parquet/{k:03}.parquet")
        os.utime(f"{path}/in.parquet/{k:03}.parquet", (time.time() - 1000 + k, time.time() - 1000 + k))
    return f"{path}/in.parquet"


def some_rows():
    rnd = random.Random(12)
    rows = [(i, 20 * i + rnd.randint(0, 200), rnd.randint(0, 5), rnd.choice(["pop", "a", "b", "c"])) for i in range(240)]
    return rows + [(999, 20_000, 77, "z")]


def plain_stacks(rows):
    stacks, seen = {}, {}
    for i, s, u, o in sorted(rows, key=lambda r: (r[1], r[0])):
        seen[u] = seen.get(u, 0) + 1
        stack = stacks.setdefault(u, [])
        if o != "pop":
            stack.append(o)
        elif stack:
            stack.pop()
    return sorted((u, seen[u], len(s), s[-1] if s else None) for u, s in stacks.items())


def plain_held(rows, ttl, now):
    out, last = [], {}
    for _, s, u, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if u in last and s >= last[u][1] + ttl:
            out.append((u, last[u][0], last[u][1] + ttl, last[u][2]))
            del last[u]
        a, _, n = last.get(u, (s, s, 0))
        last[u] = (a, s, n + 1)
    out += [(u, a, b + ttl, n) for u, (a, b, n) in last.items() if b + ttl <= now]
    return sorted(out)


@pytest.mark.parametrize("batch", [1, 3, 8])
def test_batches_of_any_size_give_the_same(spark, tmp_path, batch):
    rows = some_rows()
    path = files(spark, str(tmp_path), rows, 8)
    stream = lambda: stateful.events_stream(spark, path, batch)
    with keyed.rocksdb(spark):
        stacks = stateful.drained(keyed.in_order(stream(), "user_id", "ts", "event_id", "op", "300 seconds", keyed.Stacked()), "stack")
        held = stateful.drained(keyed.in_order(stream(), "user_id", "ts", "event_id", None, "300 seconds", keyed.Held(90_000_000)), "held")
    now = 20_000 - 300
    due = [r for r in rows if r[1] <= now]
    last = stacks.groupBy("key").agg(F.max(F.struct("seen", "depth", "top")).alias("l")).select("key", "l.*")
    assert sorted(map(tuple, last.collect())) == plain_stacks(due)
    zero = int(START.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000
    got = sorted((r["key"], (r["held_from"] - zero) // 1_000_000, (r["released_at"] - zero) // 1_000_000, r["n"]) for r in held.collect())
    assert got == plain_held(due, 90, now) and len(got) > 20


def test_transactions_survive_a_failure_between_write_and_commit(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    ops = [(i, 10 * i, rnd.randint(0, 2), rnd.choice(["set", "set", "set", "success", "fail"])) for i in range(90)]
    path = files(spark, str(tmp_path), ops, 6)
    log = lambda: stateful.events_stream(spark, path, 1).select(F.col("user_id").alias("ns"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("k"), (F.col("event_id") % 7).alias("v"), "op")
    want = set()
    for ns in range(3):
        good, working = {}, {}
        for i, _, u, o in ops:
            if u == ns:
                if o == "set":
                    working = working | {i % 4: i % 7}
                elif o == "success":
                    good = working
                else:
                    working = good
        want |= {(ns, k, good.get(k), v) for k, v in working.items()}
    target, state, real, calls = place(spark, "versions"), place(spark, "versions-state"), versioned.Versions.commit, []

    def fails_once(self, version):
        calls.append(version)
        if calls.count(3) == 1 and version == 3:
            raise RuntimeError("between write and commit")
        real(self, version)

    monkeypatch.setattr(versioned.Versions, "commit", fails_once)
    with pytest.raises(Exception, match="between write and commit"):
        versioned.transactions(log(), target, state, "ns", "k", "v", "seq")
    schema = "ns bigint, k bigint, good bigint, working bigint"
    assert versioned.Versions(spark, target, schema).last() == 2
    found = versioned.transactions(log(), target, state, "ns", "k", "v", "seq")
    assert calls.count(3) == 2 and {tuple(r) for r in found.read().collect()} == want and found.committed() == [3, 4, 5]
    before = {tuple(r) for r in found.read(4).collect()}
    found.roll_back(4)
    assert found.last() == 4 and {tuple(r) for r in found.read().collect()} == before
    assert not found.advance(4, lambda df: df.limit(0)) and found.advance(5, lambda df: df.limit(0)) and found.read().count() == 0
    assert versioned.Versions(spark, f"{target}-none", schema).read().count() == 0


class Calls:
    """The states of one bucket in memory; counts what is asked of them."""

    def __init__(self):
        self.n, self.timers = 0, []

    def registerTimer(self, at):
        self.n += 1
        self.timers.append(at)

    def state(self):
        calls, kept = self, {}

        class State:
            def __getattr__(self, name):
                calls.n += 1
                return {
                    "exists": lambda: bool(kept), "clear": kept.clear, "get": lambda: list(kept.values()) if 0 in kept else kept.get(""), "update": lambda v: kept.update({"": v}),
                    "appendValue": lambda v: kept.update({len(kept): v}), "getValue": kept.get, "updateValue": lambda k, v: kept.update({k: v}), "removeKey": kept.pop,
                }[name]

        return State()

    def getListState(self, *_):
        return self.state()

    getValueState = getMapState = getListState


def driven(processor, batches):
    """What a processor gives for batches of rows (key, second, seq, op) of one bucket, each followed by the time that its last row has come to; and calls of state."""
    import pandas as pd

    calls, out = Calls(), []
    processor.init(calls)
    for rows in batches:
        list(processor.handleInputRows((0,), iter([pd.DataFrame([(str(k), s * 1_000_000, i, o) for k, s, i, o in rows], columns=["key", "at", "seq", "op"])]), None))
        now = max(r[1] for r in rows) * 1000
        for at in sorted(t for t in calls.timers if t <= now):
            calls.timers.remove(at)
            out += [tuple(r) for part in processor.handleExpiredTimer((0,), type("Time", (), {"getCurrentWatermarkInMs": lambda _, now=now: now})(), at) for r in part.itertuples(index=False)]
    return out, calls.n


def test_keys_of_a_bucket_share_their_calls_of_state():
    rows = [(k, 100 * n + k % 90, 1000 * n + k, "a") for n in range(3) for k in range(500)]
    got, calls = driven(keyed.Held(60_000_000), [rows[:500], rows[500:1000], rows[1000:]])
    want = plain_held([(i, s, k, o) for k, s, i, o in rows], 60, 289)
    assert sorted((int(k), a // 1_000_000, b // 1_000_000, n) for k, a, b, n in got) == want and len(want) > 1000
    assert calls < 50


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_stacks_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(keyed, "PIECE", piece)
    rnd = random.Random(3)
    for p in (0.3, 0.5, 0.7):
        rows = [(rnd.randint(0, 4), s, s, "pop" if rnd.random() < p + 0.2 * (-1) ** (s // 200) else f"a{s}") for s in range(1200)]
        ends = [0]
        while ends[-1] < len(rows):
            ends.append(min(len(rows), ends[-1] + rnd.randint(1, 90)))
        got, _ = driven(keyed.Stacked(), [rows[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        last = {int(k): (int(k), seen, depth, top) for k, seen, depth, top in got}
        assert sorted(last.values()) == plain_stacks([(i, s, k, o) for k, s, i, o in rows])


def test_tables_of_many_files_in_no_order_lose_no_rows(spark, tmp_path):
    """More files than two batches of eight, none before another in time; some rows without a user."""
    from millrace.plans import registry

    rows = [(i, 280 * i, None if i % 11 == 0 else i * i % 13, "a") for i in range(800)]
    some = [(i, START + dt.timedelta(seconds=s), u, "t") for i, s, u, _ in rows]
    spark.createDataFrame(some, "event_id long, ts timestamp, user_id long, event_type string").repartition(20, F.rand(8)).write.parquet(f"{tmp_path}/all/events.parquet")
    zero = int(START.replace(tzinfo=dt.UTC).timestamp())
    got = registry.QUERIES["released_keys"](spark, f"{tmp_path}/all").selectExpr("user_id", "unix_seconds(held_from::timestamp)", "unix_seconds(released_at::timestamp)", "n").collect()
    want = plain_held([(i, s, -1 if u is None else u, o) for i, s, u, o in rows], 2700, 280 * 799)
    assert sorted((-1 if k is None else k, a - zero, b - zero, n) for k, a, b, n in got) == want and want[0][0] == -1
    stacks = plain_stacks([(i, s, u, "pop" if i % 3 == 0 else f"t{i % 10}") for i, s, u, _ in rows if u is not None])
    assert sorted(map(tuple, registry.QUERIES["stack_states"](spark, f"{tmp_path}/all").collect())) == stacks
