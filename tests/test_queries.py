"""Every registered query against its oracle, and the streaming queries against plain loops, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from millrace.plans.registry import ORACLES, QUERIES
from millrace.streaming.stateful import admit, gate

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [[columns[i] for i in order], *sorted(tuple(repr(row[i]) for i in order) for row in rows)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, oracle, name):
    made = QUERIES[name](spark, DATA)
    wanted = oracle.execute(ORACLES[name])
    assert plain(made.columns, [tuple(r) for r in made.collect()]) == plain([d[0] for d in wanted.description], wanted.fetchall())


def test_session_cap_against_a_loop(spark):
    events = pd.read_parquet(f"{DATA}/events.parquet").sort_values(["ts", "event_id"])
    held, want = {}, []
    for r in events.itertuples():
        action, gone = admit(held.setdefault(r.user_id, []), r.event_id, r.event_id * 7 % 10, 4)
        want.append((r.user_id, r.event_id, action, -1 if gone is None else gone))
    assert sorted(map(tuple, QUERIES["session_cap"](spark, DATA).collect())) == sorted(want)


def test_ring_gate_against_a_loop(spark):
    events = pd.read_parquet(f"{DATA}/events.parquet").sort_values(["ts", "event_id"])
    rings, want = {}, []
    for r in events.itertuples():
        waits, plays = rings.setdefault(r.user_id, ([], []))
        priority = r.event_id * 7 % 10
        if r.event_id % 4 == 0:
            n = 0
            while waits and len(plays) < 2:
                plays.append(waits.pop(0))
                n += 1
            action = f"drained {n}"
        elif len(waits) == 1:
            action = "full"
        elif len(plays) < 2:
            action = "refused" if waits else "plays"
            plays += [] if waits else [(priority, r.event_id)]
        elif (lowest := min(p for p, _ in plays)) > priority:
            action = "refused"
        else:
            plays.remove(next(x for x in plays if x[0] == lowest))
            waits.append((priority, r.event_id))
            action = "waits"
        want.append((r.user_id, r.event_id, action))
    made = sorted(map(tuple, QUERIES["ring_gate"](spark, DATA).collect()))
    assert made == sorted(want) and {"full", "refused", "plays", "waits", "drained 1"} <= {a for _, _, a in made}
    assert gate([], [], "drain", 1, 1, 2, 2) == "drained 0"


def test_work_claims_against_a_loop(spark):
    held = {}
    for r in pd.read_parquet(f"{DATA}/events.parquet").sort_values("event_id").itertuples():
        key, owner = r.event_id % 200, str(r.user_id % 7)
        if r.event_id % 5 < 3:
            held.setdefault(key, owner)
        elif held.get(key) == owner:
            del held[key]
    assert sorted(map(tuple, QUERIES["work_claims"](spark, DATA).collect())) == sorted(held.items())


def test_spline_table_meets_its_equations(spark):
    rows = {}
    for r in pd.read_parquet(f"{DATA}/embeddings.parquet").sort_values("vec_id").itertuples():
        rows.setdefault(r.label, []).append((float(r.vec_id), float(r.embedding[0])))
    made = {(r["label"], r["u"]): r["m"] for r in QUERIES["spline_table"](spark, DATA).collect()}
    assert len(made) == sum(map(len, rows.values()))
    for label, points in rows.items():
        u, y = zip(*points, strict=True)
        m = [made[label, x] for x in u]
        assert m[0] == m[-1] == 0
        for i in range(1, len(u) - 1):
            h0, h1 = u[i] - u[i - 1], u[i + 1] - u[i]
            assert h0 * m[i - 1] + 2 * (h0 + h1) * m[i] + h1 * m[i + 1] == pytest.approx((y[i + 1] - y[i]) / h1 - (y[i] - y[i - 1]) / h0, abs=1e-6)


def test_cover_curve_against_a_loop(spark):
    lines = pd.read_parquet(f"{DATA}/lineitem.parquet")
    needs = [set(g) for _, g in lines.groupby("l_orderkey")["l_suppkey"]]
    fixed, want = set(), []
    classes = {k: sum(k in n for n in needs) for k in set().union(*needs)}
    for step in range(len(classes)):
        gain = {k: sum(n - fixed == {k} for n in needs) for k in classes if k not in fixed}
        best = max(sorted(gain), key=lambda k: (gain[k], classes[k]))
        fixed.add(best)
        want.append((step + 1, best, sum(n <= fixed for n in needs)))
    assert [tuple(r) for r in QUERIES["cover_curve"](spark, DATA).orderBy("step").collect()] == want


def test_wall_pushout_against_a_loop(spark):
    parts = pd.read_parquet(f"{DATA}/part.parquet")
    walls = [(i, math.cos(i * 0.7), math.sin(i * 0.7), -(i % 20) * 100.0, i % 9 * 10.0, i % 9 * 10.0 + 60, i % 20) for i in range(400)]
    want = {}
    for r in parts.itertuples():
        k = r.p_partkey
        x, y, z = k * 41 % 4500 + 0.5, r.p_size * 6.0, k * 67 % 4090 + 0.25
        cell, hits, met = math.floor(x / 225) % 20, 0, False
        for _, nx, nz, plane, low, high, _ in sorted((w for w in walls if w[6] == cell), key=lambda w: (-w[5], w[0])):
            if high < y:
                break
            if low > y or hits == 4:
                met |= low <= y
                continue
            met = True
            d = plane + x * nx + z * nz
            if abs(d) <= 50:
                x, z, hits = x + (50 - d) * nx, z + (50 - d) * nz, hits + 1
        if met:
            want[k] = (round(x, 5), round(z, 5), hits)
    made = {r["p_partkey"]: (r["x"], r["z"], r["hits"]) for r in QUERIES["wall_pushout"](spark, DATA).collect()}
    assert made.keys() == want.keys() and any(h for _, _, h in want.values())
    for k, (x, z, hits) in want.items():
        assert made[k][2] == hits and made[k][:2] == pytest.approx((x, z), abs=2e-5)


def test_segment_first_hit_against_a_loop(spark):
    size = 1024.0
    height = lambda a, b: (a * 13 + b * 7) % 11 * 20.0
    triangles = []
    for n in range(256):
        i, j = n % 16, n // 16
        p, q, r, o = ((a * 256.0, height(a, b), b * 256.0) for a, b in ((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)))
        triangles += [(n * 2, p, q, r), (n * 2 + 1, p, r, o)]
    sub = lambda a, b: tuple(x - y for x, y in zip(a, b, strict=True))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    laid = {}
    for seq, a, b, c in triangles:
        n = cross(sub(b, a), sub(c, b))
        n = tuple(v / math.sqrt(dot(n, n)) for v in n)
        for gx in range(int(min(a[0], b[0], c[0]) // size), int(max(a[0], b[0], c[0]) // size) + 1):
            for gz in range(int(min(a[2], b[2], c[2]) // size), int(max(a[2], b[2], c[2]) // size) + 1):
                laid.setdefault((gz, gx), []).append((seq % 3, seq, a, b, c, n, -dot(n, a)))
    want = {}
    for k in pd.read_parquet(f"{DATA}/part.parquet")["p_partkey"]:
        p, q = (k * 41 % 4000 + 0.5, 300.0, k * 67 % 4000 + 0.25), (k * 41 % 4000 + 60.5, -50.0, k * 67 % 4000 + 90.25)
        # The segment's cells lie in order of z and x, as both of its ends grow that way.
        for gz in range(int(p[2] // size), int(q[2] // size) + 1):
            for gx in range(int(p[0] // size), int(q[0] // size) + 1):
                inside = [t for t in (i / 4000 for i in range(4001)) if (p[0] + t * 60) // size == gx and (p[2] + t * 90) // size == gz]
                for _, seq, a, b, c, n, plane in sorted(laid.get((gz, gx), [])) if inside else []:
                    dp, dq = dot(n, p) + plane, dot(n, q) + plane
                    if dp == dq or not 0 <= dp / (dp - dq) <= 1 or k in want:
                        continue
                    at = tuple(u + dp / (dp - dq) * (v - u) for u, v in zip(p, q, strict=True))
                    ends = [sub(v, at) for v in (a, b, c)]
                    turn = sum(math.atan2(math.sqrt(dot(x := cross(ends[i], ends[i - 2]), x)), dot(ends[i], ends[i - 2])) for i in range(3))
                    if abs(turn - 2 * math.pi) <= 0.001:
                        want[k] = (seq, dp / (dp - dq))
    made = {r["p_partkey"]: (r["hit"], r["t"]) for r in QUERIES["segment_first_hit"](spark, DATA).collect()}
    assert made.keys() == want.keys() and len(want) > 100
    assert all(made[k][0] == seq and made[k][1] == pytest.approx(t, abs=1e-6) for k, (seq, t) in want.items())
