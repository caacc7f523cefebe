"""Queues, scripts and edits against plain loops."""

import datetime
import random

import pytest

from millrace.functions import machine
from millrace.operators import diffs
from millrace.plans.registry import QUERIES
from millrace.plans.services import SCRIPT
from millrace.streaming import queues


def events(spark, tmp_path, n=400, users=5):
    rows = [(i, i * i % users, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i // 3)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return rows


def test_worker_ring_against_a_ring_of_slots(spark, tmp_path):
    rows, rings, want = events(spark, tmp_path, 900), {}, []
    for e, user, _ in rows:
        ring = rings.setdefault(user, {"slots": [None] * 5, "r": 0, "w": 0, "ended": False})
        message = 65536 if e % 211 == 4 else e + 2**31 if e % 5 < 3 else e
        ring["ended"] |= message == 65536
        if ring["ended"]:
            continue
        if message >= 2**31:
            ring["slots"][ring["w"]] = message
            ring["w"] = (ring["w"] + 1) % 5
        else:
            ring["r"] = (ring["r"] + 1) % 5
        size = (ring["w"] - ring["r"]) % 5
        if message >= 2**31:
            want.append((user, e, "token", size, message if size == 2 else None, False))
        else:
            want.append((user, e, "next", size, ring["slots"][(ring["r"] + 1) % 5] if size >= 2 else None, size == 1))
    assert {w[3] for w in want} == {0, 1, 2, 3, 4} and any(r["ended"] for r in rings.values())
    made = QUERIES["worker_ring"](spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, made), key=lambda r: r[1]) == want


def test_buffered_copy_against_a_buffer(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randbytes(rnd.randint(0, 20)), rnd.randint(0, 40)) for i in range(60)] + [(90, None, 5), (91, b"abc", -1), (92, b"abcdef", None)]
    want = []
    for k, data, size in rows:
        buffer = bytearray(4)
        for chunk, at in enumerate(range(0, size or 0, 4)):
            n = min(4, size - at)
            read = (data or b"")[at : at + n]
            buffer[: len(read)] = read
            want.append((k, chunk, at, bytes(buffer[:n])))
    from pyspark.sql import functions as F

    made = queues.buffered_copy(spark.createDataFrame(rows, "k long, data binary, n int"), "k", "data", F.col("n"), 4).collect()
    assert sorted((r["k"], r["chunk"], r["offset"], bytes(r["bytes"])) for r in made) == want


def test_task_queue_against_a_loop(spark, tmp_path):
    rows, held, want = events(spark, tmp_path), {}, []
    for e, user, _ in rows:
        queue, blocked = held.setdefault(user, ([], []))
        if e % 3:
            high = e % 5 == 0
            if len(queue) == 3:
                blocked.append((high, e))
                want.append((user, e, "waits"))
            else:
                queue[:] = [e, *queue] if high else [*queue, e]
                want.append((user, e, "queued"))
        elif queue:
            want.append((user, e, f"took {queue.pop(0)}"))
            if blocked:
                high, late = blocked.pop(0)
                queue[:] = [late, *queue] if high else [*queue, late]
        else:
            want.append((user, e, "empty"))
    assert len({w[2].split()[0] for w in want}) == 4
    assert sorted(map(tuple, QUERIES["task_queue"](spark, f"file://{tmp_path}").collect())) == sorted(want)


def test_edit_combinations_against_a_loop(spark, tmp_path):
    rnd = random.Random(6)
    lines = [(o, n, rnd.randint(1, 30), rnd.choice("ANR"), float(rnd.randint(1, 50))) for o in range(40) for n in range(1, rnd.randint(2, 8))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for o in {x[0] for x in lines}:
        tries = sorted(((-(q - 10), n, s % 5, f) for k, n, s, f, q in lines if k == o and q > 10))
        kept, score = [], 0.0
        for loss, n, site, flag in tries:
            new = score - loss - 12 * sum(f == flag for _, _, f in kept)
            if site not in {s for _, s, _ in kept} and new > score + 1e-6:
                kept, score = [*kept, (n, site, flag)], new
        if tries:
            want[o] = ([n for n, _, _ in kept], score)
    assert {r["l_orderkey"]: (r["kept"], r["score"]) for r in QUERIES["edit_combinations"](spark, f"file://{tmp_path}").collect()} == want


def test_leftovers_are_paired_in_order(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z"), (3, "s")], "k long, e string")
    b = spark.createDataFrame([(1, "x"), (1, "a"), (1, "b"), (1, "c"), (3, "s")], "k long, e string")
    assert sorted(map(tuple, diffs.paired_leftovers(a, b, ["k"], "e").collect())) == [(1, 1, "x", "a"), (1, 2, "y", "b"), (1, 3, None, "c"), (2, 1, "z", None)]


def run(source, *variables, budget=10**6, **host):
    made = machine.Machine(machine.assembled(source), list(variables), host)
    made.tick(budget)
    return made


def test_machine_instructions():
    value = lambda text, *v, **h: run("\n".join(text.split(";")), *v, **h).values
    assert value("int 2147483647; int 1; add") == [-(2**31)] and value("int -7; int 2; div") == [-3] and value("int -7; int 2; mod") == [-1]
    assert value("flt 7.5; int 2; div") == [3.75] and value("flt 7.9; int 4; mod") == [3] and value("int 1; int 0; div") == [None]
    assert value("str a b; str a b; eq") == [1] and value("str a; int 0; le") == [1] and value("str a; neg") == ["a"] and value("flt 1.5; neg") == [-1.5]
    assert value("int 3; not") == [0] and value("int 3; int 0; or") == [1] and value("int 3; int 0; and") == [0]
    assert value("int 6; int 3; band") == [2] and value("int 6; int 3; bor") == [7] and value("int 1; int 31; shl") == [-(2**31)] and value("int -8; int 33; shr") == [-4]
    assert value("inc 0 0; dec 0 1; nop", 4, 9) == [5, 8] and value("int 3; int 4; host sub 2", sub=lambda a, b: a - b) == [-1]
    assert value("add") == [0] and value("var 0 7") == [0] and value("room 3; layer 1; back; int 9") == []
    with pytest.raises(ValueError):
        machine.assembled("jump 3")


def test_machine_calls_nest_and_give_back_their_layers():
    source = """
      int 6
      call fact 1
      end
    fact:
      layer 1
      var 1 0
      zero one
      var 1 0
      var 1 0
      int 1
      sub
      call fact 1
      mul
      back
    one:
      int 1
      back"""
    made = run(source)
    assert made.values == [720] and made.ended and not made.frames and made.store == [] and made.base[1] == 0
    assert run("call f 0\nend\nf:\nint 5\nback").values == [5]


def test_machine_keeps_its_place_between_ticks_and_locks():
    whole = run(SCRIPT, 84, 36)
    parts = machine.Machine(machine.assembled(SCRIPT), [84, 36])
    n = 0
    while not parts.ended:
        parts.tick(7)
        n += 1
    assert parts.store == whole.store and parts.steps == whole.steps and n == -(-whole.steps // 7) and whole.store[2] == 12
    locked = machine.Machine(machine.assembled("host lock 0\nint 1\nint 2\nadd\nhost unlock 0\nend"), [])
    locked.tick(2)
    assert locked.steps == 2 and locked.values == [3] and locked.ended  # only locking and ending are counted
    with pytest.raises(RuntimeError):
        machine.Machine(machine.assembled("host lock 0\nx:\ngo x"), []).tick(2, 50)


def test_script_runs_are_dealt_to_tasks(spark, monkeypatch):
    from millrace.operators import scripts

    monkeypatch.setattr(scripts, "TASK_RUNS", 50)
    made = scripts.script_runs(spark.range(200).coalesce(1), "id", "var 0 0\nint 2\nmul\nset 0 1\nend", ["id"], {"twice": 1}, 10, 2)
    assert made.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, made.collect())) == [(i, True, 1, 5, 2.0 * i) for i in range(200)]
