"""Queries over spatial lookups and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import scalar as S
from millrace.operators import spatial as P
from millrace.plans.base import query
from millrace.session import table

c = F.col


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as upright cylinders."""
    k = c("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", ((k * 37) % 1000 - 500).cast("double").alias("x"), (c("p_size") * 2).cast("double").alias("y"), ((k * 91) % 800 - 400).cast("double").alias("z"), (k % 6 + 4).cast("double").alias("r"), (k % 20 + 10).cast("double").alias("h"))


BODIES = """WITH b AS (SELECT p_partkey AS k, ((p_partkey * 37) % 1000 - 500)::DOUBLE AS x, (p_size * 2)::DOUBLE AS y, ((p_partkey * 91) % 800 - 400)::DOUBLE AS z, (p_partkey % 6 + 4)::DOUBLE AS r, (p_partkey % 20 + 10)::DOUBLE AS h FROM part),
e AS (SELECT *, greatest(floor((abs(x) + abs(z) - r) / 70), 0)::BIGINT AS s0, floor((abs(x) + abs(z) + r) / 70)::BIGINT - 1 AS s1 FROM b),
s AS (SELECT *, [i % 256 FOR i IN range(s0, greatest(s1, s0) + 1)] AS shells FROM e),
m AS (SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON a.k < b.k AND list_has_any(a.shells, b.shells) AND a.y <= b.y + b.h AND a.y + a.h >= b.y AND (a.r + b.r)**2 > (a.x - b.x)**2 + (a.z - b.z)**2)"""


@query(f"{BODIES} SELECT a, b FROM m")
def shell_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.meeting_pairs(_bodies(spark, sf_dir), "p_partkey", ["x", "y", "z"], "r", "h")


@query(f"""{BODIES}, d AS (SELECT a AS attacker, b AS sufferer FROM m UNION ALL SELECT b, a FROM m),
f AS (SELECT attacker, sufferer, row_number() OVER (PARTITION BY attacker ORDER BY sufferer) AS r FROM d WHERE attacker % 3 <> 0 AND sufferer % 5 <> 0)
SELECT attacker, list(sufferer ORDER BY sufferer) AS "values" FROM f WHERE r <= 3 GROUP BY attacker""")
def capped_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bodies(spark, sf_dir)
    return P.first_hits(b.filter("p_partkey % 3 <> 0"), b.filter("p_partkey % 5 <> 0"), "p_partkey", ["x", "y", "z"], "r", "h", 3)


@query(f"""{BODIES}, g AS (SELECT *, k % 3 AS grp FROM s)
SELECT p.k AS probe, min(q.k) AS first FROM g p JOIN g q ON p.grp = 0 AND q.grp = 1 AND list_has_any(p.shells, q.shells) AND p.y <= q.y + q.h AND p.y + p.h >= q.y AND (p.r + q.r)**2 > (p.x - q.x)**2 + (p.z - q.z)**2 GROUP BY p.k""")
def probe_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe rows look only at their own shells; the build side is not joined with itself."""
    b = _bodies(spark, sf_dir)
    return P.first_met(b.filter("p_partkey % 3 = 0"), b.filter("p_partkey % 3 = 1"), "p_partkey", ["x", "y", "z"], "r", "h")


@query(f"""{BODIES} SELECT k, 'near' AS rule FROM b WHERE y <= 40 + 30 AND y + h >= 40 AND (r + 120)**2 > x**2 + z**2 AND k % 4 <> 0
UNION ALL SELECT k, 'high' FROM b WHERE y <= 90 + 30 AND y + h >= 90 AND (r + 200)**2 > x**2 + z**2 AND k % 4 = 1""")
def scheduled_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups against one fixed row each, the enabled joins of the schedule united; a fixed row is a literal, not a join."""
    b = _bodies(spark, sf_dir)
    rules = [("near", 40.0, 120.0, c("p_partkey") % 4 != 0, True), ("high", 90.0, 200.0, c("p_partkey") % 4 == 1, True), ("off", 0.0, 999.0, F.lit(True), False)]
    made = [b.filter(group & S.cylinders_meet([c("x"), c("y"), c("z")], c("r"), c("h"), [0.0, y, 0.0], r, 30.0)).select(c("p_partkey").alias("k"), F.lit(name).alias("rule")) for name, y, r, group, on in rules if on]
    return made[0].unionAll(made[1])


def _terrain(spark: SparkSession, lift: float = 0.0, every: int = 1) -> DataFrame:
    """Two triangles a square over a 16 x 16 field of 256-unit squares, with heights from the place."""
    rows = []
    for n in range(0, 256, every):
        i, j = n % 16, n // 16
        corner = lambda a, b: (a * 256.0, (a * 13 + b * 7) % 11 * 20.0 + lift, b * 256.0)
        p, q, r, o = corner(i, j), corner(i + 1, j), corner(i + 1, j + 1), corner(i, j + 1)
        rows += [(n * 2, *p, *q, *r), (n * 2 + 1, *p, *r, *o)]
    t = spark.createDataFrame(rows, "seq long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    made = S.triangle([c("ax"), c("ay"), c("az")], [c("bx"), c("by"), c("bz")], [c("cx"), c("cy"), c("cz")])
    return t.select("*", *(v.alias(n) for n, v in made.items()))


def _drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", ((k * 41) % 4500 + 0.5).alias("x"), (c("p_size") * 6.0).alias("y"), ((k * 67) % 4090 + 0.25).alias("z"))


TERRAIN = """s AS (SELECT id, id % 16 AS i, id // 16 AS j FROM range(256) r(id)),
t AS (SELECT id * 2 AS seq, i * 256.0::DOUBLE AS ax, ((i*13 + j*7) % 11 * 20.0)::DOUBLE AS ay, j * 256.0::DOUBLE AS az, i*256.0::DOUBLE + 256 AS bx, (((i+1)*13 + j*7) % 11 * 20.0)::DOUBLE AS b_y, j*256.0::DOUBLE AS bz, i*256.0::DOUBLE+256 AS cx, (((i+1)*13 + (j+1)*7) % 11 * 20.0)::DOUBLE AS cy, j*256.0::DOUBLE+256 AS cz FROM s
UNION ALL SELECT id * 2 + 1, i*256.0, (i*13 + j*7) % 11 * 20.0, j*256.0, i*256.0+256, ((i+1)*13 + (j+1)*7) % 11 * 20.0, j*256.0+256, i*256.0, (i*13 + (j+1)*7) % 11 * 20.0, j*256.0+256 FROM s),
n AS (SELECT *, (b_y-ay)*(cz-bz)-(bz-az)*(cy-b_y) AS nx, (bz-az)*(cx-bx)-(bx-ax)*(cz-bz) AS ny, (bx-ax)*(cy-b_y)-(b_y-ay)*(cx-bx) AS nz, least(ay,b_y,cy) AS min_y, greatest(ay,b_y,cy) AS max_y FROM t),
d AS (SELECT p_partkey AS k, (p_partkey*41) % 4500 + 0.5::DOUBLE AS x, p_size * 6.0::DOUBLE AS y, (p_partkey*67) % 4090 + 0.25::DOUBLE AS z FROM part),
h AS (SELECT d.k, d.y, n.*, ay - (nx*(x-ax) + nz*(z-az)) / ny AS height, x, z FROM d JOIN n ON (bx-ax)*(z-az) - (bz-az)*(x-ax) >= -1 AND (cx-bx)*(z-bz) - (cz-bz)*(x-bx) >= -1 AND (ax-cx)*(z-cz) - (az-cz)*(x-cx) >= -1)"""


@query(f"""WITH {TERRAIN}, f AS (SELECT k, height, seq, row_number() OVER (PARTITION BY k ORDER BY min_y DESC, max_y DESC, seq) AS r FROM h WHERE y >= height - 78)
SELECT d.k AS p_partkey, round(coalesce(f.height, -32767), 5) AS height, f.seq AS hit FROM d LEFT JOIN f ON d.k = f.k AND f.r = 1""")
def ground_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_surface(_drops(spark, sf_dir), _terrain(spark), "p_partkey").withColumn("height", F.round("height", 5))


@query(f"""WITH {TERRAIN}, f AS (SELECT k, height, seq, row_number() OVER (PARTITION BY k ORDER BY max_y, min_y, seq) AS r FROM h WHERE y <= height + 78)
SELECT d.k AS p_partkey, round(coalesce(f.height, 9999999), 5) AS height, f.seq AS hit FROM d LEFT JOIN f ON d.k = f.k AND f.r = 1""")
def roof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_surface(_drops(spark, sf_dir), _terrain(spark), "p_partkey", roof=True).withColumn("height", F.round("height", 5))


@query(f"""WITH {TERRAIN}, f AS (SELECT k, height, seq, row_number() OVER (PARTITION BY k ORDER BY min_y DESC, max_y DESC, seq) AS r FROM h WHERE y >= height - 78),
m AS (SELECT k, height + 15 AS height, seq, row_number() OVER (PARTITION BY k ORDER BY min_y DESC, max_y DESC, seq) AS r FROM h WHERE seq // 2 % 3 = 0 AND y >= height + 15 - 78),
j AS (SELECT d.k, coalesce(f.height, -32767) AS sh, f.seq AS ss, coalesce(m.height, -32767) AS mh, m.seq AS ms FROM d LEFT JOIN f ON d.k = f.k AND f.r = 1 LEFT JOIN m ON d.k = m.k AND m.r = 1)
SELECT k AS p_partkey, round(CASE WHEN mh > sh THEN mh ELSE sh END, 5) AS height, CASE WHEN mh > sh THEN 'moving' ELSE 'static' END AS source, CASE WHEN mh > sh THEN ms ELSE ss END AS hit FROM j""")
def moving_surface_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    drops = _drops(spark, sf_dir)
    moving = P.first_surface(drops, _terrain(spark, 15.0, 3), "p_partkey")
    return P.merged_surface(moving, P.first_surface(drops, _terrain(spark), "p_partkey"), "p_partkey").withColumn("height", F.round("height", 5))


@query("""
WITH d AS (SELECT p_partkey AS k, (p_partkey*41) % 4500 + 0.5::DOUBLE AS x, (p_partkey*67) % 4090 + 0.25::DOUBLE AS z FROM part),
g AS (SELECT i, j, ((i*13 + j*7) % 11 * 20.0)::DOUBLE AS h FROM range(17) a(i), range(17) b(j)),
u AS (SELECT k, floor(x/256)::BIGINT AS i, floor(z/256)::BIGINT AS j, x/256 - floor(x/256) AS u, z/256 - floor(z/256) AS v FROM d),
f AS (SELECT k, u, v, a.h AS h00, b.h AS h10, c.h AS h01, e.h AS h11 FROM u LEFT JOIN g a ON a.i=u.i AND a.j=u.j LEFT JOIN g b ON b.i=u.i+1 AND b.j=u.j LEFT JOIN g c ON c.i=u.i AND c.j=u.j+1 LEFT JOIN g e ON e.i=u.i+1 AND e.j=u.j+1)
SELECT k AS p_partkey, round(CASE WHEN u >= v THEN h00 + u*(h10-h00) + v*(h11-h10) ELSE h00 + v*(h01-h00) + u*(h11-h01) END, 5) AS height FROM f""")
def implicit_grid_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = c("id") % 17, F.floor(c("id") / 17)
    grid = spark.range(289).select(i.alias("i"), j.cast("long").alias("j"), ((i * 13 + j * 7) % 11 * 20.0).alias("h"))
    return P.tile_height(_drops(spark, sf_dir), grid, "p_partkey", 256.0).withColumn("height", F.round("height", 5))


@query()
def wall_pushout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent fold over the walls of each centre's cell; held against a plain loop in the tests."""
    k, s = c("id"), c("id") * 0.7
    walls = spark.range(400).select(k.alias("seq"), F.cos(s).alias("nx"), F.sin(s).alias("nz"), (-(k % 20) * 100.0).alias("plane"), (k % 9 * 10.0).alias("min_y"), (k % 9 * 10.0 + 60).alias("max_y"), (k % 20).alias("cell"))
    drops = _drops(spark, sf_dir).withColumn("cell", F.floor(c("x") / 225).cast("long") % 20)
    return P.pushed_out(drops.join(walls, "cell"), "p_partkey", 50.0, 4).select("p_partkey", F.round("x", 5).alias("x"), F.round("z", 5).alias("z"), "hits")


@query("""
WITH b AS (SELECT i AS box, (i * 37 % 45) * 100.0::DOUBLE AS cx, (i % 5) * 20.0::DOUBLE AS cy, (i * 53 % 40) * 100.0::DOUBLE AS cz FROM range(60) t(i)),
d AS (SELECT p_partkey AS k, (p_partkey*41) % 4500 + 0.5::DOUBLE AS x, p_size * 6.0::DOUBLE AS y, (p_partkey*67) % 4090 + 0.25::DOUBLE AS z FROM part),
f AS (SELECT k, min(box) AS box FROM d JOIN b ON abs(x-cx) < 150 AND abs(z-cz) < 200 AND y-cy > 0 AND y-cy < 250 GROUP BY k), a AS (SELECT d.k, coalesce(box, -1) AS box FROM d LEFT JOIN f ON d.k = f.k)
SELECT k AS p_partkey, box, box <> -1 AND box = lead(box) OVER (ORDER BY k) AS same_as_next FROM a""")
def box_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16 to J18: first box of a point, membership, and whether neighbours by key share one; keys, not points, are ordered in one window."""
    i = c("id")
    boxes = spark.range(60).select(i.alias("box"), ((i * 37 % 45) * 100.0).alias("cx"), ((i % 5) * 20.0).alias("cy"), ((i * 53 % 40) * 100.0).alias("cz"), *(F.lit(0.0).alias(r) for r in ("rx", "ry", "rz")), F.lit(300.0).alias("ex"), F.lit(250.0).alias("ey"), F.lit(400.0).alias("ez"))
    found = P.first_box(_drops(spark, sf_dir), boxes, "p_partkey", 512.0)
    after = found.select((c("p_partkey") - 1).alias("p_partkey"), c("box").alias("next"))
    return found.join(after, "p_partkey", "left").select("p_partkey", "box", F.when(c("box") == -1, False).otherwise(c("box") == c("next")).alias("same_as_next"))


@query("""
WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
p AS (SELECT a.vec_id AS a, b.x, b.y, b.z FROM v a JOIN v b ON a.vec_id <> b.vec_id AND (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 >= 0.001 AND (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 < 0.01),
m AS (SELECT a, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n, round(coalesce(m.x - v.x, 0), 6) + 0.0 AS to_x, round(coalesce(m.y - v.y, 0), 6) + 0.0 AS to_y, round(coalesce(m.z - v.z, 0), 6) + 0.0 AS to_z FROM v LEFT JOIN m ON a = vec_id""")
def radius_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", *(c("embedding")[i].cast("double").alias(n) for i, n in enumerate("xyz")))
    got = P.neighbour_sums(v, P.near_pairs(v, "vec_id", ["x", "y", "z"], 0.1), "vec_id", ["x", "y", "z"])
    return got.select("vec_id", "n", *((F.round(f"to_{n}", 6) + 0.0).alias(f"to_{n}") for n in "xyz"))


@query("""
WITH r AS (SELECT s_suppkey AS slot, (s_suppkey * 17) % 900 AS lo, (s_suppkey * 17) % 900 + s_suppkey % 90 AS hi FROM supplier WHERE s_suppkey % 7 <> 3)
SELECT c_custkey, min(slot) AS slot FROM customer LEFT JOIN r ON c_custkey % 1000 BETWEEN lo AND hi AND c_custkey % 1000 <> 0 GROUP BY c_custkey""")
def range_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token 0 is held by no range; ranges without a callback (one in seven) do not count."""
    s = c("s_suppkey")
    ranges = table(spark, sf_dir, "supplier").filter(s % 7 != 3).select(s.alias("slot"), ((s * 17) % 900).alias("lo"), ((s * 17) % 900 + s % 90).alias("hi"))
    values = table(spark, sf_dir, "customer").select("c_custkey", (c("c_custkey") % 1000).alias("v"))
    return P.range_first(values, ranges, "c_custkey", "v", "lo", "hi", "slot", 64, reserved=0)


@query()
def segment_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First triangle along each part's segment in cell order; held against a plain loop in the tests."""
    k = c("p_partkey")
    segments = table(spark, sf_dir, "part").select("p_partkey", ((k * 41) % 4000 + 0.5).alias("px"), F.lit(300.0).alias("py"), ((k * 67) % 4000 + 0.25).alias("pz"), ((k * 41) % 4000 + 60.5).alias("qx"), F.lit(-50.0).alias("qy"), ((k * 67) % 4000 + 90.25).alias("qz"))
    return P.segment_hits(segments, _terrain(spark).withColumn("list", c("seq") % 3), "p_partkey").withColumn("t", F.round("t", 6))


@query("""
WITH r AS (SELECT (s_suppkey * 29 % 400)::DOUBLE AS cx, (s_suppkey * 11 % 30)::DOUBLE AS cz FROM supplier)
SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM r WHERE (p_partkey % 400 - cx)**2 + (p_size % 30 - cz)**2 <= 9)""")
def contained_in_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that lie in the area of any supplier: semi-join by cell of the radius, then the exact test."""
    areas = table(spark, sf_dir, "supplier").select((c("s_suppkey") * 29 % 400).cast("double").alias("cx"), (c("s_suppkey") * 11 % 30).cast("double").alias("cz"))
    laid = P.cells_of(areas, [c("cx") - 3, c("cz") - 3], [c("cx") + 3, c("cz") + 3], 3.0, ["gx", "gz"])
    points = table(spark, sf_dir, "part").select("p_partkey", (c("p_partkey") % 400).cast("double").alias("x"), (c("p_size") % 30).cast("double").alias("z"))
    points = points.withColumns({"gx": F.floor(c("x") / 3).cast("long"), "gz": F.floor(c("z") / 3).cast("long")})
    near = (points["gx"] == laid["gx"]) & (points["gz"] == laid["gz"]) & (S.squared_distance([c("x"), c("z")], [c("cx"), c("cz")]) <= 9)
    return points.join(laid, near, "left_semi").select("p_partkey")


def _sides(names: list[str], p: str) -> str:
    """SQL: p lies on one side of all sides of a triangle."""
    ends = list(zip(names, names[1:] + names[:1], strict=True))
    on = lambda sign: " AND ".join(f"({v}x-{u}x)*({p}z-{u}z) - ({v}z-{u}z)*({p}x-{u}x) {sign} 0" for u, v in ends)
    return f"(({on('>=')}) OR ({on('<=')}))"


def _crossed(a: str, b: str, p: str, q: str) -> str:
    """SQL: the segments a-b and p-q cross."""
    side = lambda u, v, w: f"(({v}z-{u}z)*({w}x-{u}x) - ({v}x-{u}x)*({w}z-{u}z) >= 0)"
    return f"({side(a, b, p)} <> {side(a, b, q)} AND {side(p, q, a)} <> {side(p, q, b)})"


SQUARE = ["p", "q", "r", "s"]
TOUCHES = " OR ".join(
    [f"({k}x BETWEEN px AND rx AND {k}z BETWEEN pz AND rz)" for k in "abc"] + [_sides(["a", "b", "c"], k) for k in SQUARE]
    + [_crossed(SQUARE[i], SQUARE[(i + 1) % 4], "abc"[j], "abc"[(j + 1) % 3]) for i in range(4) for j in range(3)]
)


@query(f"""
WITH t AS (SELECT p_partkey AS k, (p_partkey * 3 % 200)::DOUBLE AS ax, (p_size * 5)::DOUBLE AS az, (p_partkey * 3 % 200 + 25)::DOUBLE AS bx, (p_size * 5 + 4)::DOUBLE AS bz, (p_partkey * 3 % 200 + 6)::DOUBLE AS cx, (p_size * 5 + 17)::DOUBLE AS cz, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE 1 END AS ny FROM part),
b AS (SELECT *, unnest(range(least(greatest(floor((least(ax,bx,cx) - 3) / 10)::BIGINT, 0), 21), least(greatest(floor((greatest(ax,bx,cx) + 3) / 10)::BIGINT, 0), 21) + 1)) AS gx FROM t),
g AS (SELECT *, unnest(range(least(greatest(floor((least(az,bz,cz) - 3) / 10)::BIGINT, 0), 24), least(greatest(floor((greatest(az,bz,cz) + 3) / 10)::BIGINT, 0), 24) + 1)) AS gz FROM b),
s AS (SELECT *, gx*10.0::DOUBLE AS px, gz*10.0::DOUBLE AS pz, gx*10.0::DOUBLE+10 AS qx, gz*10.0::DOUBLE AS qz, gx*10.0::DOUBLE+10 AS rx, gz*10.0::DOUBLE+10 AS rz, gx*10.0::DOUBLE AS sx, gz*10.0::DOUBLE+10 AS sz FROM g)
SELECT k, gx, gz FROM s WHERE ny < 0 OR {TOUCHES}""")
def triangle_cell_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that triangles touch, on a grid of 22 x 25 cells."""
    k, z = c("p_partkey") * 3 % 200, c("p_size") * 5
    corners = {"ax": k, "az": z, "bx": k + 25, "bz": z + 4, "cx": k + 6, "cz": z + 17}
    t = table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), *(v.cast("double").alias(n) for n, v in corners.items()), F.when(c("p_partkey") % 5 == 0, -1).otherwise(1).alias("ny"))
    return P.covered_cells(t, "k", 10.0, F.lit(3.0), (22, 25))


@query(f"""{BODIES}, g AS (SELECT *, k % 3 AS grp FROM s)
SELECT p.k AS probe, min(q.k) AS first FROM g p JOIN g q ON p.grp = 0 AND q.grp = 1 AND q.k % 7 <> 0 AND list_contains(q.shells, p.shells[1]) AND p.y <= q.y + q.h AND p.y + p.h >= q.y AND (p.r + q.r)**2 > (p.x - q.x)**2 + (p.z - q.z)**2 GROUP BY p.k""")
def first_bucket_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe rows look at their first shell alone; rows of one kind (key divisible by 7) are passed over."""
    b = _bodies(spark, sf_dir)
    return P.first_met(b.filter("p_partkey % 3 = 0"), b.filter("p_partkey % 3 = 1 AND p_partkey % 7 <> 0"), "p_partkey", ["x", "y", "z"], "r", "h", first=True)


@query(f"""{BODIES}, d AS (SELECT a AS attacker, b AS sufferer FROM m UNION ALL SELECT b, a FROM m),
f AS (SELECT attacker, sufferer, row_number() OVER (PARTITION BY attacker ORDER BY sufferer * 7919 % 1009, sufferer) AS r FROM d)
SELECT attacker, list(sufferer ORDER BY r) AS "values" FROM f WHERE r <= 4 GROUP BY attacker""")
def first_met_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four of each, in the order in which they are met."""
    b = _bodies(spark, sf_dir)
    return P.first_hits(b, b, "p_partkey", ["x", "y", "z"], "r", "h", 4, c("p_partkey") * 7919 % 1009)


@query(f"""WITH {TERRAIN}, f AS (SELECT k, height, seq, row_number() OVER (PARTITION BY k ORDER BY min_y DESC, max_y DESC, seq) AS r FROM h WHERE y >= height - 78),
m AS (SELECT k, height + 15 AS height, seq, row_number() OVER (PARTITION BY k ORDER BY min_y DESC, max_y DESC, seq) AS r FROM h WHERE seq // 2 % 3 = 0 AND y >= height + 15 - 78),
j AS (SELECT d.k, coalesce(f.height, -32767) AS sh, f.seq AS ss, coalesce(m.height, -32767) AS mh, m.seq AS ms, (40 + d.k % 9 * 15)::DOUBLE AS ph FROM d LEFT JOIN f ON d.k = f.k AND f.r = 1 LEFT JOIN m ON d.k = m.k AND m.r = 1)
SELECT k AS p_partkey, round(greatest(mh, ph, sh), 5) AS height, CASE WHEN mh > greatest(ph, sh) THEN 'moving' WHEN ph > sh THEN 'plane' ELSE 'static' END AS source, CASE WHEN mh > greatest(ph, sh) THEN ms WHEN ph > sh THEN NULL ELSE ss END AS hit FROM j""")
def plane_surface_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static ground, a plane that replaces it where strictly higher, then moving ground where strictly higher still."""
    drops = _drops(spark, sf_dir)
    static = P.with_plane(P.first_surface(drops, _terrain(spark), "p_partkey"), "p_partkey", (c("p_partkey") % 9 * 15 + 40).cast("double"))
    return P.merged_surface(P.first_surface(drops, _terrain(spark, 15.0, 3), "p_partkey"), static, "p_partkey").withColumn("height", F.round("height", 5))


@query(f"""WITH {TERRAIN}, f AS (SELECT k, height, row_number() OVER (PARTITION BY k ORDER BY min_y DESC, max_y DESC, seq) AS r FROM h WHERE y >= height - 78 AND k % 32 >= 16)
SELECT d.k AS id, round(coalesce(f.height, d.y), 5) AS y FROM d LEFT JOIN f ON d.k = f.k AND f.r = 1""")
def snapped_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _drops(spark, sf_dir).select(c("p_partkey").alias("id"), "x", "y", "z", (c("p_partkey") % 32).alias("flags"))
    return P.snapped(nodes, _terrain(spark), 0x10).select("id", F.round("y", 5).alias("y"))


@query("""
WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS hx, embedding[5]::DOUBLE AS hy, embedding[6]::DOUBLE AS hz FROM embeddings),
p AS (SELECT a.vec_id AS a, b.*, (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 AS d2, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz FROM v a JOIN v b ON a.vec_id <> b.vec_id AND (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 >= 0.001 AND (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 < 0.01),
m AS (SELECT a, count(*) AS n, sum(dx/d2*0.1) AS sx, sum(dy/d2*0.1) AS sy, sum(dz/d2*0.1) AS sz, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(hx) AS hx, avg(hy) AS hy, avg(hz) AS hz FROM p GROUP BY a),
j AS (SELECT v.vec_id, m.n, m.sx, m.sy, m.sz, m.x - v.x AS tx, m.y - v.y AS ty, m.z - v.z AS tz, sqrt(m.hx**2 + m.hy**2 + m.hz**2) AS l, m.hx / nullif(l, 0) - v.hx AS ax, m.hy / nullif(l, 0) - v.hy AS ay, m.hz / nullif(l, 0) - v.hz AS az FROM v LEFT JOIN m ON a = vec_id)
SELECT vec_id, coalesce(n, 0) AS n, round(coalesce(sx, 0), 5) + 0.0 AS away_x, round(coalesce(sy, 0), 5) + 0.0 AS away_y, round(coalesce(sz, 0), 5) + 0.0 AS away_z,
  round(coalesce(tx / nullif(sqrt(tx**2+ty**2+tz**2), 0), 0), 5) + 0.0 AS toward_x, round(coalesce(ty / nullif(sqrt(tx**2+ty**2+tz**2), 0), 0), 5) + 0.0 AS toward_y, round(coalesce(tz / nullif(sqrt(tx**2+ty**2+tz**2), 0), 0), 5) + 0.0 AS toward_z,
  round(coalesce(ax / nullif(sqrt(ax**2+ay**2+az**2), 0), 0), 5) + 0.0 AS along_hx, round(coalesce(ay / nullif(sqrt(ax**2+ay**2+az**2), 0), 0), 5) + 0.0 AS along_hy, round(coalesce(az / nullif(sqrt(ax**2+ay**2+az**2), 0), 0), 5) + 0.0 AS along_hz FROM j""")
def flock_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separation, cohesion and alignment of each row's neighbours."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", *(c("embedding")[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "hx", "hy", "hz"))))
    got = P.flock(v, "vec_id", ["x", "y", "z"], ["hx", "hy", "hz"], 0.1)
    return got.select("vec_id", "n", *((F.round(n, 5) + 0.0).alias(n) for n in got.columns if n not in ("vec_id", "n")))


@query("""
WITH a AS (SELECT s_suppkey AS area, 'T' || s_suppkey % 4 AS type, (s_suppkey * 37 % 45 * 100)::DOUBLE AS x1, (s_suppkey * 53 % 40 * 100)::DOUBLE AS z1 FROM supplier),
d AS (SELECT p_partkey, (p_partkey*41) % 4500 + 0.5::DOUBLE AS x, (p_partkey*67) % 4090 + 0.25::DOUBLE AS z FROM part), f AS (SELECT p_partkey, arg_min(type, area) AS type FROM d JOIN a ON x BETWEEN x1 AND x1 + 250 AND z BETWEEN z1 AND z1 + 150 GROUP BY 1)
SELECT d.p_partkey, coalesce(f.type, 'none') AS type FROM d LEFT JOIN f ON d.p_partkey = f.p_partkey""")
def area_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = c("s_suppkey")
    x, z = (s * 37 % 45 * 100).cast("double"), (s * 53 % 40 * 100).cast("double")
    areas = table(spark, sf_dir, "supplier").select(s.alias("area"), F.concat(F.lit("T"), (s % 4).cast("string")).alias("type"), x.alias("x1"), z.alias("z1"), (x + 250).alias("x2"), (z + 150).alias("z2"))
    return P.first_area(_drops(spark, sf_dir), areas, "p_partkey", 256.0, "none")
