"""Golden and brute-force cases of the table operators."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, diffs, graphs, ordered, ranked, spatial, texts
from millrace.session import discard, written

c = F.col


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_backward_fill(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 5, 0, 9])] + [("b", 0, 0), ("b", 1, 7)], "k string, i int, v int")
    got = ordered.backward_fill(d, ["k"], ["i"], "v")
    assert [r["v"] for r in got.orderBy("k", "i").collect()] == [5, 5, 9, 9, 0, 7]


def test_edges_and_run_lengths(spark):
    d = spark.createDataFrame([(i, m) for i, m in enumerate([1, 3, 2, 3])], "i int, m int")
    assert [r["p"] for r in ordered.rising_edges(d, [], ["i"], "m", "p").orderBy("i").collect()] == [1, 2, 0, 1]
    r = spark.createDataFrame([(0, 2, "a"), (1, 0, "b"), (2, 1, "c")], "i int, d int, v string")
    assert [x["v"] for x in ordered.run_length_decode(r, "d", "v", ["i"]).orderBy("i", "frame").collect()] == ["a", "a", "b", "c"]


def test_keyframes_before_between_after(spark):
    keys = spark.createDataFrame([(0, 10, 1.0), (0, 20, 3.0)], "k int, key_at int, v double")
    probes = spark.createDataFrame([(0, t) for t in (5, 10, 15, 20, 30)], "k int, at int")
    got = ordered.keyframes(probes, keys, ["k"], "at", "key_at", "v")
    assert [r["value"] for r in got.orderBy("at").collect()] == [1, 1, 2, 3, 3]


def test_weighted_choice(spark):
    d = spark.createDataFrame([(g, i, w) for g in range(3) for i, w in ((0, 1), (1, 3))], "g int, i int, w int")
    got = ranked.weighted_choice(d, ["g"], [c("i")], "w", c("g") / 4.0 + 0.01)
    assert [r["i"] for r in got.orderBy("g").collect()] == [0, 0, 1]


def test_two_slots(spark):
    cases = [("a", 0, "valid", 4), ("a", 1, "valid", 4), ("b", 0, "bad", 9), ("b", 1, "valid", 1), ("c", 0, "bad", 0), ("c", 1, "bad", 0), ("d", 0, "empty", 0), ("d", 1, "valid", 3)]
    got = ranked.used_slot(spark.createDataFrame(cases, "k string, slot int, state string, writes int"), "k")
    assert rows(got) == [("a", 0), ("b", 1), ("c", -2), ("d", -1)]


def test_reuse_prefers_dead_then_nearest_clipped(spark):
    d = spark.createDataFrame([(1, 0, 9.0, False), (1, 1, 5.0, False), (2, 0, 1.0, False), (2, 1, 50.0, True)], "g int, i int, d double, dead boolean")
    got = ranked.reuse_candidate(d, ["g"], c("dead"), F.lit(True), c("d"), "i")
    assert rows(got) == [(1, 1, 1), (2, 1, 0)]


def test_ground_takes_the_first_accepted_not_the_highest(spark):
    tri = "seq long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"
    t = spark.createDataFrame([(0, 0.0, 10.0, 0.0, 100.0, 10.0, 0.0, 100.0, 10.0, 100.0), (1, 0.0, 0.0, 0.0, 100.0, 90.0, 0.0, 100.0, 0.0, 100.0)], tri)
    from millrace.functions import scalar as S

    made = S.triangle([c("ax"), c("ay"), c("az")], [c("bx"), c("by"), c("bz")], [c("cx"), c("cy"), c("cz")])
    t = t.select("*", *(v.alias(n) for n, v in made.items()))
    p = spark.createDataFrame([(1, 80.0, 200.0, 10.0), (2, 5000.0, 0.0, 5000.0)], "k int, x double, y double, z double")
    got = {r["k"]: (r["height"], r["hit"]) for r in spatial.first_surface(p, t, "k").collect()}
    assert got == {1: (10.0, 0), 2: (spatial.NO_GROUND, None)}
    tie = spatial.merged_surface(spark.createDataFrame([(1, 5.0, 7)], "k int, height double, hit int"), spark.createDataFrame([(1, 5.0, 8)], "k int, height double, hit int"), "k")
    assert rows(tie) == [(1, 5.0, "static", 8)]


def test_meeting_pairs_once(spark):
    rnd = random.Random(1)
    pts = [(i, rnd.uniform(-300, 300), rnd.uniform(0, 20), rnd.uniform(-300, 300), rnd.uniform(20, 60), 30.0) for i in range(120)]
    got = rows(spatial.meeting_pairs(spark.createDataFrame(pts, "k int, x double, y double, z double, r double, h double"), "k", ["x", "y", "z"], "r", "h"))

    def shells(x, z, r):
        lo = max(int((abs(x) + abs(z) - r) // 70), 0)
        return {s % 256 for s in range(lo, max(int((abs(x) + abs(z) + r) // 70) - 1, lo) + 1)}

    want = [(a[0], b[0]) for i, a in enumerate(pts) for b in pts[i + 1 :] if shells(a[1], a[3], a[4]) & shells(b[1], b[3], b[4]) and abs(a[2] - b[2]) <= 30 and (a[4] + b[4]) ** 2 > (a[1] - b[1]) ** 2 + (a[3] - b[3]) ** 2]
    assert got == sorted(want, key=repr) and len(want) > 20


def test_near_pairs_against_brute_force(spark):
    rnd = random.Random(2)
    pts = [(i, rnd.random(), rnd.random()) for i in range(200)]
    got = {(r["a"], r["b"]) for r in spatial.near_pairs(spark.createDataFrame(pts, "k int, x double, y double"), "k", ["x", "y"], 0.1).collect()}
    assert got == {(a[0], b[0]) for i, a in enumerate(pts) for b in pts[i + 1 :] if 0.001 <= (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 < 0.01}


def test_wall_pushout_against_a_loop(spark):
    rnd = random.Random(3)
    walls = [(s, nx, nz, rnd.uniform(-40, 40), rnd.choice([0.0, 10.0]), rnd.choice([15.0, 30.0])) for s in range(12) for nx, nz in [rnd.choice([(1.0, 0.0), (0.0, 1.0), (0.6, 0.8)])]]
    points = [(k, rnd.uniform(-30, 30), rnd.choice([5.0, 12.0, 20.0]), rnd.uniform(-30, 30)) for k in range(40)]
    w = spark.createDataFrame(walls, "seq int, nx double, nz double, plane double, min_y double, max_y double")
    p = spark.createDataFrame(points, "k int, x double, y double, z double")
    got = {r["k"]: r for r in spatial.pushed_out(p.crossJoin(w), "k", 10.0, 3).collect()}
    for k, x, y, z in points:
        near = [v for v in walls if v[4] <= y <= v[5]]
        if not near:
            assert k not in got
            continue
        n = 0
        for _, nx, nz, plane, _, _ in sorted(near, key=lambda v: (-v[5], v[0])):
            d = plane + x * nx + z * nz
            if abs(d) <= 10 and n < 3:
                x, z, n = x + (10 - d) * nx, z + (10 - d) * nz, n + 1
        assert (got[k]["x"], got[k]["z"], got[k]["hits"]) == (pytest.approx(x), pytest.approx(z), n)


def test_multiset_difference(spark):
    a = spark.createDataFrame([(1, x) for x in "aab"], "k int, v string")
    b = spark.createDataFrame([(1, x) for x in "abb"], "k int, v string")
    assert rows(diffs.multiset_difference(a, b, ["k"], "v")) == [(1, "a", "left", 1), (1, "b", "right", 1)]
    assert rows(diffs.multiset_difference(a, a, ["k"], "v")) == []
    assert rows(diffs.outer_delta(a.groupBy("v").count(), a.groupBy("v").count(), ["v"], "count")) == []


def test_next_hop_takes_the_other_of_two(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (1, 3, 9.0), (2, 1, 1.0)], "src long, dst long, length double")
    w = spark.createDataFrame([(0, 1, 2), (1, 2, 1), (2, 7, None)], "walker long, cur long, prev long")
    assert rows(graphs.next_hop(w, e)) == [(0, 3), (1, 1), (2, 7)]


def test_shortest_paths_and_closure(spark):
    rnd = random.Random(4)
    e = [(a, b, float(rnd.randint(1, 9))) for a in range(30) for b in rnd.sample(range(30), 3)]
    edges = spark.createDataFrame(e, "src long, dst long, length double")
    dist = {0: 0.0}
    for _ in range(40):
        for a, b, w in e:
            if a in dist and dist[a] + w < dist.get(b, 1e9):
                dist[b] = dist[a] + w
    assert dict(rows(graphs.shortest_paths(edges, spark.createDataFrame([(0,)], "id long"), 40, written, discard))) == dist
    assert {i for _, i in rows(graphs.closure(edges.select("src", "dst"), spark.createDataFrame([(0,)], "id long"), 40, written, discard))} == set(dist)


def test_greedy_cover(spark):
    d = spark.createDataFrame([(["a"],)] * 3 + [(["a", "b"],)] * 2 + [(["b", "c"],)] * 4, "classes array<string>")
    assert rows(graphs.greedy_cover(d, 9, written, discard)) == [(1, "a", 3), (2, "b", 5), (3, "c", 9)]


def test_stencil_and_bands(spark):
    g = spark.createDataFrame([(x, y, 255 if (x, y) != (1, 1) else 0) for x in range(3) for y in range(3)], "x int, y int, v int")
    got = {(r["x"], r["y"]): r["n"] for r in aggregates.stencil_count(g, "x", "y", "v", 255).collect()}
    assert got[1, 1] == 8 and got[0, 0] == 2
    b = aggregates.banded(spark.createDataFrame([(49.9,), (50.0,), (95.0,)], "v double"), c("v"), [50, 80, 95], F.lit(1))
    assert rows(b) == [(0, 1, 1), (1, 1, 1), (3, 1, 1)]


def test_token_table_and_alignment(spark):
    d = spark.createDataFrame([(1, "a = b; // x\nc()"), (2, None)], "k int, t string")
    assert rows(texts.token_table(d, "k", "t")) == sorted([(1, i, "name" if t.isalpha() else "operator", t, n) for i, (t, n) in enumerate([("a", 1), ("=", 1), ("b", 1), (";", 1), ("c", 2), ("(", 2), (")", 2)])], key=repr)
    pairs = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "a", "q", "b", "c", "y"]), (2, ["a", "$P", "d"], ["a", "(", "b", ")", "d"]), (3, ["a"], ["z"])], "k int, p array<string>, t array<string>")
    got = {r["k"]: (round(r["cost"], 3), r["start"], r["end_at"]) for r in texts.aligned(pairs, "p", "t", 0.0).collect()}
    assert got[1] == (0.3, 1, 5) and got[2] == (0.0, 0, 5) and got[3][0] == 1.0


def test_claims_against_a_loop(spark):
    from millrace.operators import series

    rnd = random.Random(5)
    log = [(rnd.randint(0, 9), rnd.choice("abc"), i, rnd.choice(["claim", "claim", "release"])) for i in range(300)]
    held = {}
    for k, o, _, op in log:
        if op == "claim":
            held.setdefault(k, o)
        elif held.get(k) == o:
            del held[k]
    got = series.claimed(spark.createDataFrame(log, "k int, o string, i int, op string"), "k", "o", "i", written)
    assert dict(rows(got)) == held


def test_spline_meets_its_equations(spark):
    import numpy as np

    from millrace.operators import series

    rng = np.random.default_rng(6)
    u, y = np.sort(rng.random(9)), rng.random(9)
    h, d = np.diff(u), np.diff(y) / np.diff(u)
    got = series.natural_spline(spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(u, y, strict=True)] + [(2, 0.0, 1.0)], "k int, u double, y double"), "k", "u", "y", written)
    m = np.array([r["m"] for r in got.filter("k = 1").orderBy("u").collect()])
    assert m[0] == m[-1] == 0
    assert np.allclose(h[:-1] * m[:-2] + 2 * (h[:-1] + h[1:]) * m[1:-1] + h[1:] * m[2:], np.diff(d))


def test_cover_and_clusters(spark):
    d = spark.createDataFrame([(1, p) for p in (1, 2, 9, 10, 30)], "k int, p int")
    assert [r["island"] for r in ordered.islands(d, ["k"], "p", 2).orderBy("p").collect()] == [0, 0, 1, 1, 2]
    r = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbba")], "k int, i int, v string")
    assert [(x["v"], x["n"], x["start"]) for x in ordered.runs(r, ["k"], ["i"], "v").orderBy("run").collect()] == [("a", 2, 1), ("b", 3, 3), ("a", 1, 6)]


def test_next_tier_fills_what_is_left(spark):
    d = spark.createDataFrame([(i, "x" if i in (3, 5) else "y" if i % 2 else "z") for i in range(8)], "i int, t string")
    got = ranked.tiered(d, [c("t") == "x", c("t") == "y"], [c("i")], 3)
    assert [(r["i"], r["tier"]) for r in got.orderBy("tier", "i").collect()] == [(3, 1), (5, 1), (1, 2)]
