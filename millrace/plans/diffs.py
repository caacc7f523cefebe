"""Queries over differences between two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import diffs as D
from millrace.plans.base import query
from millrace.session import table

c = F.col


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even and odd orders' quantities by part and status."""
    lines = table(spark, sf_dir, "lineitem")
    sums = lambda d: d.groupBy("l_partkey", "l_returnflag").agg(F.sum("l_quantity").cast("long").alias("size"), F.min("l_linestatus").alias("section"))
    return sums(lines.filter("l_orderkey % 2 = 0")), sums(lines.filter("l_orderkey % 2 = 1"))


SIDES = """WITH a AS (SELECT l_partkey, l_returnflag, sum(l_quantity)::BIGINT AS size, min(l_linestatus) AS section FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL),
b AS (SELECT l_partkey, l_returnflag, sum(l_quantity)::BIGINT AS size, min(l_linestatus) AS section FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY ALL)"""


@query(f"""{SIDES} SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, coalesce(a.size, 0) AS a, coalesce(b.size, 0) AS b, coalesce(b.size, 0) - coalesce(a.size, 0) AS delta
FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.l_returnflag = b.l_returnflag WHERE coalesce(b.size, 0) <> coalesce(a.size, 0)""")
def outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.outer_delta(*_sides(spark, sf_dir), ["l_partkey", "l_returnflag"], "size")


@query(f"""{SIDES} SELECT l_partkey, l_returnflag, 'lost' AS side FROM a ANTI JOIN b USING (l_partkey, l_returnflag) UNION ALL SELECT l_partkey, l_returnflag, 'gained' FROM b ANTI JOIN a USING (l_partkey, l_returnflag)""")
def lost_gained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.lost_gained(*_sides(spark, sf_dir), ["l_partkey", "l_returnflag"])


@query(f"""{SIDES} SELECT a.l_partkey, a.l_returnflag, a.size AS size_a, a.section AS section_a, b.size AS size_b, b.section AS section_b FROM a JOIN b ON a.l_partkey = b.l_partkey AND a.l_returnflag = b.l_returnflag WHERE a.size <> b.size OR a.section <> b.section""")
def changed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.changed(*_sides(spark, sf_dir), ["l_partkey", "l_returnflag"], ["size", "section"])


@query("""
WITH a AS (SELECT l_suppkey, l_partkey, count(*) FILTER (l_orderkey % 2 = 0) AS a, count(*) FILTER (l_orderkey % 2 = 1) AS b FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_partkey, CASE WHEN a > b THEN 'left' ELSE 'right' END AS side, abs(a - b) AS n FROM a WHERE a <> b""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return D.multiset_difference(lines.filter("l_orderkey % 2 = 0"), lines.filter("l_orderkey % 2 = 1"), ["l_suppkey"], "l_partkey")


@query("""
WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pa, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pb FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)
SELECT o_custkey, count(*) AS n, count(*) FILTER (pa <> pb) AS violations FROM a GROUP BY o_custkey""")
def order_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By date on one side, by key on the other, on the orders that both have."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return D.order_verdict(o.filter("o_orderkey % 5 <> 0"), o.filter("o_orderkey % 7 <> 0"), ["o_custkey"], "o_orderkey", [c("o_orderdate"), c("o_orderkey")], [c("o_orderkey")])


@query("""
WITH m AS (SELECT o_custkey, year(o_orderdate) AS y, count(*)::DOUBLE AS n, max(o_shippriority) AS x, sum(o_totalprice) AS s FROM (SELECT *, 0 AS o_shippriority FROM orders) GROUP BY ALL),
k AS (SELECT DISTINCT o_custkey FROM m WHERE y IN (1996, 1997)),
v AS (SELECT k.o_custkey, u.metric, coalesce(max(CASE u.metric WHEN 'n' THEN n ELSE round(s, 2) END) FILTER (y = 1996), 0) AS f, coalesce(max(CASE u.metric WHEN 'n' THEN n ELSE round(s, 2) END) FILTER (y = 1997), 0) AS t FROM k CROSS JOIN (VALUES ('n'), ('s')) u(metric) LEFT JOIN m ON m.o_custkey = k.o_custkey GROUP BY ALL)
SELECT o_custkey, metric, f AS "from", t AS "to", CASE WHEN f > t THEN 'regression' ELSE 'progression' END AS kind FROM v WHERE f <> t""")
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    of = lambda y: o.filter(c("y") == y).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))
    return D.regressions(of(1996), of(1997), ["o_custkey"], ["n", "s"])


@query("""
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)
SELECT a.o_custkey, CASE WHEN b.n IS NULL THEN 'MISSING' WHEN b.n > a.n THEN 'better' WHEN b.n < a.n THEN 'worse' ELSE 'same' END AS status FROM a LEFT JOIN b USING (o_custkey)""")
def rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    of = lambda y: o.filter(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return D.status_of(of(1996), of(1997), ["o_custkey"], "n")


@query("""
WITH l AS (SELECT p_partkey AS left_at, CASE WHEN p_size % 3 <> 0 THEN (p_partkey * 7) % 2500 END AS right_at, p_brand AS lv FROM part), r AS (SELECT c_custkey AS right_at, c_mktsegment AS rv FROM customer)
SELECT left_at, l.right_at, lv, rv FROM l LEFT JOIN r ON l.right_at = r.right_at UNION ALL SELECT NULL, r.right_at, NULL, rv FROM r WHERE r.right_at NOT IN (SELECT right_at FROM l WHERE right_at IS NOT NULL)""")
def positional_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "part").select(c("p_partkey").alias("at"), F.when(c("p_size") % 3 != 0, (c("p_partkey") * 7) % 2500).alias("link"), c("p_brand").alias("v"))
    return D.linked(left, table(spark, sf_dir, "customer").select(c("c_custkey").alias("at"), c("c_mktsegment").alias("v")), "link", "at", "v")


@query("""
WITH a AS (SELECT l_orderkey, list(l_partkey % 7 ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT l_orderkey, list(l_partkey % 7 ORDER BY l_partkey DESC, l_linenumber DESC, l_suppkey) AS b FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, CASE WHEN a IS NULL THEN 'right' WHEN b IS NULL THEN 'left' WHEN a = b THEN 'same' WHEN list_sort(a) = list_sort(b) THEN 'order' ELSE 'diff' END AS verdict FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey""")
def bag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    bag = lambda d, key, n: d.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(key)), lambda e: e["v"]).alias(n))
    v = (c("l_partkey") % 7).alias("v")
    a = bag(lines.filter("l_orderkey % 3 <> 0"), F.struct("l_linenumber", "l_partkey", "l_suppkey", v), "a")
    b = bag(lines.filter("l_orderkey % 4 <> 0"), F.struct((-c("l_partkey")).alias("p"), (-c("l_linenumber")).alias("n"), "l_suppkey", v), "b")
    return a.join(b, "l_orderkey", "full_outer").select("l_orderkey", D.bag_verdict(c("a"), c("b")).alias("verdict"))


@query("""
WITH w AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), d AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40), s AS (SELECT l_partkey AS k FROM lineitem WHERE l_discount = 0.1)
SELECT k AS l_partkey, CASE WHEN k IN (SELECT k FROM s) THEN 'INLINED' ELSE 'NOBODY' END AS reason FROM w WHERE k NOT IN (SELECT k FROM d)""")
def anti_join_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return D.missing_with_reason(lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'A' AND l_quantity > 40"), lines.filter("l_discount = 0.1"), ["l_partkey"])


@query("""
WITH u AS (SELECT p_type AS name, min(p_brand) AS v FROM part WHERE p_size < 3 GROUP BY 1 HAVING count(DISTINCT p_brand) = 1), e AS (SELECT p_type, p_size, min(p_brand) AS v FROM part WHERE p_size < 3 GROUP BY ALL)
SELECT p_partkey, coalesce(e.v, u.v) AS binding FROM part p LEFT JOIN e ON e.p_type = p.p_type AND e.p_size = p.p_size LEFT JOIN u ON u.name = p.p_type""")
def unambiguous_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    small = part.filter("p_size < 3")
    exact = small.groupBy("p_type", "p_size").agg(F.min("p_brand").alias("e"))
    named = D.unambiguous(small.select("p_size", "p_type", "p_brand"), "p_size", "p_type", "p_brand").withColumnRenamed("p_brand", "u")
    return part.join(exact, ["p_type", "p_size"], "left").join(named, "p_type", "left").select("p_partkey", F.coalesce("e", "u").alias("binding"))


@query("""
WITH a AS (SELECT l_suppkey, l_returnflag AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) AS p FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_suppkey, l_returnflag AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) AS p FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT a.v AS a, b.v AS b, count(*) AS n FROM a JOIN b ON a.l_suppkey = b.l_suppkey AND a.p = b.p AND a.v <> b.v GROUP BY ALL""")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return D.adjacent_mismatches(lines.filter("l_orderkey % 2 = 0"), lines.filter("l_orderkey % 2 = 1"), ["l_suppkey"], "l_returnflag", [c("l_orderkey"), c("l_linenumber"), c("l_partkey"), c("l_returnflag")])


@query("""
WITH f AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS sem, bool_or(l_tax > 0.06) AS ari, bool_or(l_discount > 0.08) AS inl FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN sem THEN 'SEMANTIC' WHEN ari THEN 'ARITH' WHEN inl THEN 'INLINE' ELSE 'CLEAN' END AS verdict FROM f""")
def set_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(c("l_returnflag") == "R").alias("sem"), F.bool_or(c("l_tax") > 0.06).alias("ari"), F.bool_or(c("l_discount") > 0.08).alias("inl"))
    return f.select("l_orderkey", F.when(c("sem"), "SEMANTIC").when(c("ari"), "ARITH").when(c("inl"), "INLINE").otherwise("CLEAN").alias("verdict"))


@query("""
SELECT severity, kind, count(*) AS n FROM (
  SELECT 'error' AS severity, 'MISSING' AS kind, o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT 'error', 'BINDING', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'error', 'ORDER', o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate
  UNION ALL SELECT 'warning', 'SIZE', o_orderkey FROM (SELECT o_orderkey, max(o_totalprice) AS t, sum(l_extendedprice) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) WHERE abs(t - s) > 50000) GROUP BY ALL""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lines are joined once; each order's counts are summed up."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", F.lit(True).alias("o"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate", F.lit(True).alias("l"))
    both, met = orders.join(lines, c("o_orderkey") == c("l_orderkey"), "full_outer"), c("o").isNotNull() & c("l").isNotNull()
    counts = {"MISSING": c("l").isNull(), "BINDING": c("o").isNull(), "ORDER": met & (c("l_shipdate") < c("o_orderdate"))}
    sums = both.groupBy("o_orderkey").agg(*(F.count_if(v).alias(k) for k, v in counts.items()), F.max(F.when(met, c("o_totalprice"))).alias("t"), F.sum(F.when(met, c("l_extendedprice"))).alias("s"))
    total = sums.agg(*(F.sum(k).alias(k) for k in counts), F.count_if(F.abs(c("t") - c("s")) > 50000).alias("SIZE"))
    kinds = F.array(*(F.struct(F.lit("warning" if k == "SIZE" else "error").alias("severity"), F.lit(k).alias("kind"), c(k).alias("n")) for k in (*counts, "SIZE")))
    return total.select(F.inline(kinds)).filter("n > 0")


@query("""
WITH u AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT c_custkey, round(total, 2) AS total FROM customer JOIN u ON c_custkey = o_custkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') AND c_acctbal BETWEEN 0 AND 9000 ORDER BY total DESC, c_custkey LIMIT 60""")
def fresh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not changed of late, open bytes first; the report has 60 places."""
    orders = table(spark, sf_dir, "orders")
    recent = orders.filter("o_orderdate >= timestamp_ntz'1998-01-01'").select(c("o_custkey").alias("c_custkey"))
    total = orders.filter("o_orderstatus <> 'F'").groupBy(c("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = table(spark, sf_dir, "customer").filter("c_acctbal BETWEEN 0 AND 9000").join(recent, "c_custkey", "left_anti").join(total, "c_custkey")
    return rows.select("c_custkey", "total").orderBy(F.desc("total"), "c_custkey").limit(60)


@query("""
WITH m AS (SELECT p_partkey, p_retailprice - 1000 AS gap FROM part WHERE p_retailprice <> 1000), l AS (SELECT l_partkey, sum(l_extendedprice) AS b, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS callers FROM lineitem WHERE l_discount > 0 GROUP BY 1)
SELECT p_partkey, round(coalesce(b, 0), 2) AS bytes, coalesce(len(callers), 0) AS callers FROM m LEFT JOIN l ON p_partkey = l_partkey""")
def mismatch_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").filter("l_discount > 0").groupBy(c("l_partkey").alias("p_partkey")).agg(F.sum("l_extendedprice").alias("b"), F.countDistinct("l_suppkey").alias("callers"))
    return table(spark, sf_dir, "part").filter("p_retailprice <> 1000").join(calls, "p_partkey", "left").select("p_partkey", F.round(F.coalesce("b", F.lit(0.0)), 2).alias("bytes"), F.coalesce("callers", F.lit(0)).alias("callers"))


@query("""
SELECT a.p_partkey AS a, b.p_partkey AS b, 'same' AS tag FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
UNION ALL SELECT a.p_partkey, b.p_partkey, 'loose' FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_brand <> b.p_brand AND a.p_partkey < b.p_partkey AND a.p_retailprice = b.p_retailprice""")
def multikey_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size", "p_retailprice")
    # Each kind is joined by all that it asks to be equal.
    same = part.toDF("a", "t", "br", "s", "pr").join(part.toDF("b", "t", "br", "s", "pr2"), ["t", "br", "s"]).filter("a < b")
    loose = part.toDF("a", "t", "br", "s", "pr").join(part.toDF("b", "t", "br2", "s", "pr"), ["t", "s", "pr"]).filter("a < b AND br <> br2")
    return same.select("a", "b", F.lit("same").alias("tag")).unionAll(loose.select("a", "b", F.lit("loose").alias("tag")))
