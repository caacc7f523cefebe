"""Queries and operators against brute force over whole tables."""

import heapq
import math
import random
import re

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.plans.registry import ORACLES, QUERIES


def tokens(x):
    return [w for w in re.split(r"[\W_]+", (x or "").lower()) if w]


def test_near_copies_finds_passages_that_many_documents_hold(spark, tmp_path):
    passage = "the copied passage stands in very many of these documents word for word"
    items = [(1, passage), (2, "a rare passage that one single document holds near its end"), (3, "nothing like this is anywhere"), (4, ""), (5, None)]
    docs = [(i, f"before{i} {passage} after{i}") for i in range(70)] + [(100 + i, f"filler{i} of the words") for i in range(20)]
    docs += [(200, "It ends so: a rare passage that one single document holds near its END!"), (201, passage.replace("copied", "")), (202, None), (203, " ".join(sorted(passage.split())))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, p in items:
        for d, t in docs:
            a, b = tokens(p), tokens(t)
            told = [w for w in a if w not in text.KEYWORDS]
            if told and sum(w in set(b) for w in told) >= 0.8 * len(told) and (similarity := text.align(a, b)[3]) >= 0.8:
                want.add((i, d, round(similarity, 4)))
    assert len([w for w in want if w[0] == 1]) >= 71
    made = [tuple(r) for r in QUERIES["near_copies"](spark, f"file://{tmp_path}").select("item_id", "doc_id", "similarity").collect()]
    assert len(made) == len(want) and set(made) == want


def test_shortest_paths_reach_all_suppliers_against_dijkstra(spark, tmp_path):
    n = 60
    spark.range(1, n + 1).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    want, heap = {}, [(0.0, 1)]
    while heap:
        dist, at = heapq.heappop(heap)
        if at in want:
            continue
        want[at] = dist
        for to in (at + 1, at + 7, at - 3):
            if 1 <= to <= n:
                heapq.heappush(heap, (dist + (at * 31 + to * 17) % 23 + 1, to))
    assert len(want) == n and max(want.values()) > 30
    made = [(r["id"], r["dist"]) for r in QUERIES["shortest_path"](spark, f"file://{tmp_path}").collect()]
    assert len(made) == n and dict(made) == want


def test_include_closure_takes_all_orders_and_starts(spark, tmp_path):
    rnd = random.Random(11)
    lines = [(i, p, s) for i, (p, s) in enumerate([(rnd.randint(1, 60), rnd.randint(1, 25)) for _ in range(70)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 201), (201, 202), (202, 200), (5, 5)])]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {(p, s) for _, p, s in lines}
    want = {(i, i) for e in edges for i in e}
    while more := {(start, d) for start, at in want for s, d in edges if s == at} - want:
        want |= more
    made = [tuple(r) for r in QUERIES["include_closure"](spark, f"file://{tmp_path}").select("start", "id").collect()]
    assert len(made) == len(want) and set(made) == want


def test_tables_of_shortest_paths_do_not_grow_with_the_way(spark):
    from millrace.operators import graphs
    from millrace.session import discard, written

    rnd, tables = random.Random(1), {}
    for n in (50, 200):
        made = []
        write = lambda df, name, made=made: made.append(name) or written(df, name)
        edges = [(k, to, float(rnd.randint(0, 9))) for k in range(n) for to in (k + 1, k + 7, k - 3) if 0 <= to < n] + [(n + 5, 0, 1.0), (3, 3, 1.0), (4, 5, 0.0)]
        got = dict(map(tuple, graphs.shortest_paths(spark.createDataFrame(edges, "src long, dst long, length double"), spark.createDataFrame([(0,), (n // 2,), (n + 9,)], "id long"), n, write, discard).collect()))
        want = {0: 0.0, n // 2: 0.0, n + 9: 0.0}
        while new := {b: d for a, b, x in edges if a in want and (d := want[a] + x) < want.get(b, math.inf)}:
            for b, d in new.items():
                want[b] = min(d, want.get(b, math.inf))
        assert got == want
        tables[n] = len(made)
    assert tables[200] < 2 * tables[50]


def test_every_supplier_is_an_area(spark, tmp_path):
    spark.range(1, 61).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    parts = [(i, i * 13 % 50 + 1) for i in range(1, 500)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    inside = lambda most: sorted(p for p, z in parts if any((p % 400 - s * 29 % 400) ** 2 + (z % 30 - s * 11 % 30) ** 2 <= 9 for s in range(1, most + 1)))
    made = sorted(r["p_partkey"] for r in QUERIES["contained_in_any"](spark, f"file://{tmp_path}").collect())
    assert made == inside(60) and inside(20) != inside(60) and len(made) < len(parts)


def plain_align(pattern, words, insert=0.3, widest=12):
    """Least cost by the table's definition, cell by cell."""
    before = [0.0] * (len(words) + 1)
    for p in pattern:
        row = []
        for j in range(len(words) + 1):
            ways = [before[j] + 1]
            if j:
                ways.append(row[j - 1] + insert)
                same = p == words[j - 1] or (p == text.LOCAL and re.match(r"[\w$]", words[j - 1]))
                if same or p != text.PARAMETER:
                    ways.append(before[j - 1] + (not same))
            row.append(min(ways))
        if p == text.PARAMETER:
            for j in range(len(words)):
                depth = 0
                for end in range(j, min(len(words), j + widest)):
                    depth += (words[end] in "([{") - (words[end] in ")]}")
                    if depth < 0 or (not depth and words[end] in ";,?:"):
                        break
                    if not depth:
                        row[end + 1] = min(row[end + 1], before[j])
        before = row
    return min(before)


def test_align_equals_the_plain_table():
    rnd = random.Random(3)
    for _ in range(400):
        words = [rnd.choice("a b c ( ) [ ] , ; foo".split()) for _ in range(rnd.randint(0, 25))]
        pattern = [rnd.choice(["a", "b", "c", "(", ")", text.LOCAL, text.PARAMETER]) for _ in range(rnd.randint(0, 8))]
        cost, start, end, similarity = text.align(pattern, words)
        assert abs(cost - plain_align(pattern, words)) < 1e-9 and 0 <= start <= end <= len(words)
        assert abs(similarity - (1 - cost / len(pattern) if pattern else 1)) < 1e-9
    assert text.align([text.PARAMETER], [")"])[0] == 1  # one unbalanced bracket is no parameter
    assert text.align("f ( $P ) ;".split(), "x = f ( g ( 1 ) ) ;".split())[:3] == (0, 2, 10)


def test_scan_and_normal_forms():
    source = """#define A 1
int f(int a) { // remark
  float x = 3.0f; x <<= 0xFFu; /* two
lines */ return this->b[a].c(x) == 'q' && "s//t"; }"""
    found = text.scan(source)
    assert [t for _, t, _ in found[:14]] == ["int", "f", "(", "int", "a", ")", "{", "float", "x", "=", "3.0f", ";", "x", "<<="]
    assert ("number", "0xFFu", 3) in found and ("operator", "==", 4) in found and ("text", '"s//t"', 4) in found and ("char", "'q'", 4) in found
    made = text.normal_tokens([t for _, t, _ in found], {"a"}, {"x"})
    assert " ".join(made[6:]) == "{ float $L = 3 ; $L <<= 0xFF ; c ( $L ) == 'q' && \"s//t\" }"
    assert text.informative(["if", "foo", "true", "3", "u8"]) == ["foo", "true"]


def test_sequence_differences_of_users(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, i % 9, rnd.choice("xyz")) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for user in range(9):
        a, b = ([t for i, u, t in rows if u == user and i % 2 == r] for r in (0, 1))
        # Longest matches, found anew: the first longest common block, then the same on both sides of it.

        def blocks(a0, a1, b0, b1, a=a, b=b):
            best = (0, 0, 0)
            for i in range(a0, a1):
                for j in range(b0, b1):
                    k = 0
                    while i + k < a1 and j + k < b1 and a[i + k] == b[j + k]:
                        k += 1
                    best = max(best, (k, -i, -j))
            k, i, j = best[0], -best[1], -best[2]
            return [*blocks(a0, i, b0, j), (i, j, k), *blocks(i + k, a1, j + k, b1)] if k else []

        counts, i, j = [0, 0, 0], 0, 0
        for x, y, k in [*blocks(0, len(a), 0, len(b)), (len(a), len(b), 0)]:
            gone, come = x - i, y - j
            counts[2 if gone and come else 1 if gone else 0] += max(gone, come)
            i, j = x + k, y + k
        want[user] = tuple(counts)
    made = {r["user_id"]: (r["inserted"], r["deleted"], r["replaced"]) for r in QUERIES["order_sequence_diff"](spark, f"file://{tmp_path}").collect()}
    assert made == want


def same_as_sql(spark, name, **tables):
    """The query's rows over tables of rows (schema, rows), and the rows of its SQL."""
    import tempfile

    import duckdb

    folder, con = tempfile.mkdtemp(prefix="spark-"), duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    wanted = con.execute(ORACLES[name])
    names = sorted(d[0] for d in wanted.description)
    want = sorted(repr([dict(zip([d[0] for d in wanted.description], r, strict=True))[n] for n in names]) for r in wanted.fetchall())
    made = sorted(repr([r[n] for n in names]) for r in QUERIES[name](spark, f"file://{folder}").collect())
    assert made == want
    return want


def test_half_turns_and_vectors_with_gaps(spark):
    vectors = [[-1, 0, 0, 1, 0, 0], [-1, -0.0, 0, 1, 0, 0], [-1, 1e-6, 0, 1, 0, 0], [-1, -1e-6, 0, 1, 0, 0], [0] * 6, [1, 2, 3, -1, -2, -3], [None, 1, 2, 3, 4, 5], None]
    rows = [(i, v and [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    assert len(same_as_sql(spark, "vector_measures", embeddings=("vec_id long, embedding array<float>", rows))) == len(rows)


def test_bodies_meet_as_in_a_loop_and_copies_are_one_body(spark):
    from millrace.operators import spatial

    rnd = random.Random(5)
    shapes = [(rnd.uniform(-150, 150), rnd.uniform(0, 60), rnd.uniform(-150, 150), rnd.choice((0.0, 4.0, 9.0, 30.0)), rnd.choice((0.0, 5.0, 40.0))) for _ in range(90)] + [(0.0, 7.0 * i, 0.0, 5.0, 7.0) for i in range(9)]
    bodies = [(k, *shape) for k, shape in enumerate(shapes + rnd.choices(shapes, k=120))] + [(900, None, 1.0, 1.0, 5.0, 5.0)]
    df = spark.createDataFrame(bodies, "k long, x double, y double, z double, r double, h double")

    def shells(b):
        reach = abs(b[1]) + abs(b[3])
        low = max(math.floor((reach - b[4]) / 70), 0)
        return [s % 256 for s in range(low, max(math.floor((reach + b[4]) / 70) - 1, low) + 1)]

    def meet(a, b, first=False):
        near = set(shells(a)[:1] if first else shells(a)) & set(shells(b))
        return near and a[2] <= b[2] + b[5] and a[2] + a[5] >= b[2] and (a[4] + b[4]) ** 2 > (a[1] - b[1]) ** 2 + (a[3] - b[3]) ** 2

    whole = bodies[:-1]
    args = ("k", ["x", "y", "z"], "r", "h")
    pairs = sorted((a[0], b[0]) for a in whole for b in whole if a[0] < b[0] and meet(a, b))
    assert len(pairs) > 200 and sorted(map(tuple, spatial.meeting_pairs(df, *args).collect())) == pairs
    for first in (False, True):
        want = {a[0]: min(hits) for a in whole if a[0] % 3 == 0 and (hits := [b[0] for b in whole if b[0] % 3 == 1 and meet(a, b, first)])}
        assert dict(map(tuple, spatial.first_met(df.filter("k % 3 = 0"), df.filter("k % 3 = 1"), *args, first=first).collect())) == want
    want = {a[0]: sorted(hits, key=lambda k: (k * 7 % 11, k))[:3] for a in whole if a[0] % 4 and (hits := [b[0] for b in whole if b[0] != a[0] and meet(a, b)])}
    spatial.LISTED, kept = 16, spatial.LISTED
    made = dict(map(tuple, spatial.first_hits(df.filter("k % 4 <> 0"), df, *args, 3, F.col("k") * 7 % 11).collect()))
    spatial.LISTED = kept
    assert made == want


def most_joined(df):
    """Most rows that any join of the plan put out, once df has run."""
    df.collect()

    def walk(p):
        name, below = p.nodeName(), p.children()
        inner = [p.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [p.plan()] if "QueryStage" in name else [below.apply(i) for i in range(below.size())]
        own = [p.metrics().apply("numOutputRows").value()] if "Join" in name and p.metrics().contains("numOutputRows") else []
        return max(own + [walk(q) for q in inner], default=0)

    return walk(df._jdf.queryExecution().executedPlan())


def test_equal_rows_are_looked_up_once(spark):
    from millrace.operators import graphs, spatial
    from millrace.session import written

    n = 300
    points = spark.range(n).selectExpr("id AS k", "3.0D AS x", "4.0D AS z", "5L AS v", "10.0D AS px", "20.0D AS py", "10.0D AS pz", "11.0D AS qx", "-20.0D AS qy", "12.0D AS qz")
    areas = spatial.first_area(points, spark.range(n).selectExpr("id + 7 AS area", "concat('T', id) AS type", "0.0D AS x1", "0.0D AS z1", "9.0D AS x2", "9.0D AS z2"), "k", 16.0, "none")
    assert most_joined(areas) <= n and {r["type"] for r in areas.collect()} == {"T0"} and areas.count() == n
    slots = spatial.range_first(points, spark.range(n).selectExpr("id + 7 AS slot", "0L AS lo", "9L AS hi"), "k", "v", "lo", "hi", "slot", 4, reserved=0)
    assert most_joined(slots) <= n and {r["slot"] for r in slots.collect()} == {7} and slots.count() == n
    flat = spark.range(8).selectExpr("id AS seq", "id % 3 AS list", "0.0D AS ax", "0.0D AS ay", "0.0D AS az", "0.0D AS bx", "0.0D AS b_y", "90.0D AS bz", "90.0D AS cx", "0.0D AS cy", "0.0D AS cz", "0.0D AS nx", "1.0D AS ny", "0.0D AS nz", "0.0D AS plane").withColumnRenamed("b_y", "by")
    hits = spatial.segment_hits(points, flat, "k")
    assert most_joined(hits) <= n and {(r["hit"], r["t"]) for r in hits.collect()} == {(0, 0.5)} and hits.count() == n
    tables = []
    write = lambda df, name: tables.append(written(df, name)) or tables[-1]
    near = graphs.nearest_on_edges(points, spark.range(n).selectExpr("id + 7 AS edge", "0.0D AS ax", "0.0D AS az", "9.0D AS bx", "0.0D AS bz"), "k", 16.0, write)
    assert {(r["edge"], r["distance"]) for r in near.collect()} == {(7, 4.0)} and near.count() == n and max(t.count() for t in tables) == 1


def test_nearest_and_farthest_balances_as_in_sql(spark):
    from millrace.operators import graphs

    rnd = random.Random(8)
    balance = lambda: rnd.choice([None, 0.0, -0.0, 5.5, 1e6, *(round(rnd.uniform(-99, 99), 2) for _ in range(6))])
    suppliers = [(i, rnd.choice((1, 2, 3)), balance()) for i in range(1, 90)] + [(91, 7, None), (93, 7, None)]
    customers = [(i, rnd.choice((1, 2, 3, 7, 8, None)), balance()) for i in range(1, 200)]
    parts = [(i, rnd.choice((1, 2, 3, 26, 8)), balance()) for i in range(1, 200)]
    graphs.CELL_VALUES, kept = 3, graphs.CELL_VALUES
    s, k = ("s_suppkey long, s_nationkey int, s_acctbal double", suppliers), ("c_custkey long, c_nationkey int, c_acctbal double", customers)
    assert len(same_as_sql(spark, "nearest_supplier", supplier=s, customer=k)) > 100
    assert len(same_as_sql(spark, "nearest_visible", part=("p_partkey long, p_size int, p_retailprice double", parts), customer=k)) > 100
    graphs.CELL_VALUES = kept
    n = 500
    left, right = spark.range(n).selectExpr("id AS a", "1 AS g", "2.0D AS v"), spark.range(n).selectExpr("id AS b", "1 AS g", "2.0D AS w")
    for how in (graphs.nearest_along, graphs.farthest_along):
        made = how(left, right, ["g"], "a", "v", "b", "w")
        assert most_joined(made) <= n and {r["b"] for r in made.collect()} == {0} and made.count() == n


def test_shortest_paths_go_through_blocks(spark):
    from millrace.operators import graphs
    from millrace.session import discard, written

    rnd, kept = random.Random(2), (graphs.BLOCK, graphs.BLOCK_ENDS)
    graphs.BLOCK, graphs.BLOCK_ENDS = 64, 30
    try:
        tables = {}
        for n, ways in ((700, lambda k: (k + 1, k + 7, k - 3)), (120, lambda k: (rnd.randrange(120), rnd.randrange(120)))):
            edges = [(k, to, float(rnd.randint(0, 9))) for k in range(n) for to in ways(k) if 0 <= to < n and k % 97 != 5]
            want, heap = {}, [(0.0, 3), (0.0, n // 2)]
            while heap:
                dist, at = heapq.heappop(heap)
                if at not in want:
                    want[at] = dist
                    for a, b, length in edges:
                        if a == at:
                            heapq.heappush(heap, (dist + length, b))
            made = []
            got = graphs.shortest_paths(spark.createDataFrame(edges, "src long, dst long, length double"), spark.createDataFrame([(3,), (n // 2,)], "id long"), n, lambda df, name, made=made: made.append(name) or written(df, name), discard)
            assert dict(map(tuple, got.collect())) == want
            tables[n] = len(made)
        assert tables[700] <= 24
    finally:
        graphs.BLOCK, graphs.BLOCK_ENDS = kept


def test_the_report_joins_orders_and_lines_once(spark, tmp_path):
    from datetime import datetime

    day = lambda n: datetime(1995, 1, 1 + n)
    orders = [(k, price, day(k % 7)) for k, price in enumerate((10.0, 90000.0, 60000.0, 5.0, 70000.0))]
    lines = [(0, 4.0, day(3)), (0, 6.0, day(0)), (1, 10.0, day(0)), (1, 20.0, day(2)), (2, 60000.0, day(1)), (8, 1.0, day(1)), (8, 1.0, day(1)), (9, 90000.0, day(1))]
    tables = {"orders": ("o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz", orders), "lineitem": ("l_orderkey long, l_extendedprice double, l_shipdate timestamp_ntz", lines)}
    assert len(same_as_sql(spark, "validation_report", **tables)) == 4
    assert same_as_sql(spark, "validation_report", orders=(tables["orders"][0], orders[:1]), lineitem=(tables["lineitem"][0], lines[:2])) == []
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert QUERIES["validation_report"](spark, f"file://{tmp_path}")._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_candidates_are_joined_by_all_their_keys(spark, tmp_path):
    parts = [(k, "T", f"B{k % 50}", 1, float(k % 40)) for k in range(200)] + [(900, None, "B1", 1, 1.0), (901, "T", None, 1, 1.0), (902, "T", "B1", 1, None)]
    schema = "p_partkey long, p_type string, p_brand string, p_size int, p_retailprice double"
    want = same_as_sql(spark, "multikey_candidates", part=(schema, parts))
    spark.createDataFrame(parts, schema).write.parquet(f"{tmp_path}/part.parquet")
    assert 300 < len(want) and most_joined(QUERIES["multikey_candidates"](spark, f"file://{tmp_path}")) <= 2 * len(want)


def test_closure_does_not_write_what_outer_nodes_reach(spark, monkeypatch):
    from millrace.operators import graphs
    from millrace.session import discard, written

    ring = [(k, (k + 1) % 12) for k in range(12)]
    edges = ring + [(100 + k, 20 + k % 5) for k in range(80)] + [(100 + k, 30) for k in range(80)] + [(20 + k, k) for k in range(5)] + [(30, 31), (40, 41), (3, 50), (3, 3)]
    reach = {(i, i) for e in edges for i in e} | {(900, 900)}
    while more := {(start, d) for start, at in reach for s, d in edges if s == at} - reach:
        reach |= more
    table = written(spark.createDataFrame(edges, "src long, dst long"), "edges")
    for shared, asked in ((graphs.SHARED_PAIRS, {a for a, _ in reach}), (0, {4, 20, 100, 101, 31, 900})):
        monkeypatch.setattr(graphs, "SHARED_PAIRS", shared)
        pairs = []

        def write(df, name, pairs=pairs):
            made = written(df, name)
            pairs += [made.count()] if name == "closure" else []
            return made

        made = [tuple(r) for r in graphs.closure(table, spark.createDataFrame([(a,) for a in asked], "id long"), 20, write, discard).collect()]
        want = {p for p in reach if p[0] in asked}
        assert len(made) == len(want) and set(made) == want
        assert sum(pairs) < 100 < len(reach) / 10


def reach_of(edges):
    """All (start, id), by brute force."""
    reach = {(i, i) for e in edges for i in e}
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    front = reach
    while front := {(start, d) for start, at in front for d in to.get(at, ())} - reach:
        reach = reach | front
    return reach


def test_closure_puts_all_components_together_at_once(spark, monkeypatch):
    from millrace.operators import graphs
    from millrace.session import discard, written

    rings = [(1000 * r + k, 1000 * r + (k + d) % 20) for r in range(9) for k in range(20) for d in (1, 3)]
    edges = rings + [(1000 * r + 100 + k, 1000 * r + k % 20) for r in range(9) for k in range(160)] + [(1000 * r + 5, 1000 * r + 1000) for r in range(3)] + [(7, 7), (1, 2), (9999, 9999)]
    want = reach_of(edges)
    table = written(spark.createDataFrame(edges, "src long, dst long"), "edges")
    nodes = table.selectExpr("src AS id").union(table.selectExpr("dst AS id")).distinct()
    for shared in (10**6, 0):
        monkeypatch.setattr(graphs, "SHARED_NODES", shared, raising=False)
        monkeypatch.setattr(graphs, "SHARED_PAIRS", shared)
        pairs = []

        def write(df, name, pairs=pairs):
            made = written(df, name)
            pairs += [made.count()] if name == "closure" else []
            return made

        made = [tuple(r) for r in graphs.closure(table, nodes, 20, write, discard).collect()]
        assert len(made) == len(want) and set(made) == want
        assert sum(pairs) < 200 < len(want) / 100


def test_include_closure_shuffles_lines_once(spark, tmp_path):
    rnd = random.Random(7)
    lines = [(rnd.randint(1, 300), rnd.randint(1, 20)) for _ in range(900)] + [(400, 401), (401, 402), (403, 403), (None, 404), (405, None)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = QUERIES["include_closure"](spark, f"file://{tmp_path}")
        plan = found._jdf.queryExecution().executedPlan().toString()
        made = [tuple(r) for r in found.select("start", "id").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = reach_of([e for e in lines if None not in e]) | {(x, x) for e in lines for x in e}
    assert len(made) == len(want) and set(made) == want
    assert "SortMergeJoin" not in plan and plan.count("REPARTITION_BY_NUM") == 1


def test_leftovers_and_owners_have_as_many_tasks_as_rows_ask_for(spark, monkeypatch, tmp_path):
    from millrace.operators import diffs
    from millrace.plans import extra

    rnd = random.Random(5)
    lines = [(k, rnd.randint(1, 9), rnd.randint(1, 9)) for k in range(40) for _ in range(rnd.randint(1, 6))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    for module in (diffs, extra):
        monkeypatch.setattr(module, "TASK_ROWS", 10)
    owners = QUERIES["owner_order"](spark, f"file://{tmp_path}")
    assert owners.rdd.getNumPartitions() == 1 + len(lines) // 10
    want = {}
    for k in {k for k, _, _ in lines}:
        own = sorted((p, s) for o, p, s in lines if o == k)
        first = list(dict.fromkeys(s % 4 for _, s in own))
        want[k] = first == sorted(first, key=lambda w: min(s for _, s in own if s % 4 == w))
    assert dict(map(tuple, owners.collect())) == want
    a = spark.createDataFrame([(k % 20, None if k % 7 == 0 else f"x{k % 3}") for k in range(60)], "g long, item string")
    made = diffs.paired_leftovers(a, a.filter("item IS NULL OR item <> 'x1'"), ["g"], "item")
    assert made.rdd.getNumPartitions() > 8
    assert sorted(r["left"] for r in made.collect()) == ["x1"] * a.filter("item = 'x1'").count()
