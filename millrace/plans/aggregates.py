"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.plans.base import query
from millrace.session import table


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS living FROM orders GROUP BY o_custkey""")
def filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") != "F").alias("living"))


@query("""SELECT l_orderkey, sum(l_linenumber)::BIGINT AS degree FROM lineitem GROUP BY l_orderkey HAVING sum(l_linenumber) < 6""")
def children_sum_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("degree")).filter("degree < 6")


@query("""
WITH r AS (SELECT i AS rid, i * 120 AS lo, i * 120 + CASE WHEN i % 2 = 0 THEN 119 ELSE 749 END AS hi FROM range(0, 20) t(i))
SELECT rid, lo, hi, count(p_partkey) AS n FROM r LEFT JOIN part ON p_partkey BETWEEN lo AND hi AND p_size > 25 GROUP BY rid, lo, hi""")
def derived_count_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.range(20).select(F.col("id").alias("rid"), (F.col("id") * 120).alias("lo"), (F.col("id") * 120 + F.when(F.col("id") % 2 == 0, 119).otherwise(749)).alias("hi"))
    return A.recounted(ranges, table(spark, sf_dir, "part"), "rid", "lo", "hi", "p_partkey", F.col("p_size") > 25, 128)


@query("""
SELECT c_custkey, coalesce(bool_and(o_orderstatus = 'F'), true) AS every, coalesce(bool_or(o_orderstatus = 'F'), false) AS some
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def all_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return A.quantified(table(spark, sf_dir, "customer").select("c_custkey"), facts, ["c_custkey"], F.col("o_orderstatus") == "F")


@query("""
WITH r AS (SELECT user_id, sum((event_id % 11)::BIGINT - 5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)
SELECT user_id, max(s)::BIGINT AS record FROM r GROUP BY user_id""")
def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.high_water(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_id") % 11 - 5, "record")


@query("""SELECT l_suppkey, count(DISTINCT l_partkey) AS once, least(sum(l_linenumber), 99)::BIGINT AS capped FROM lineitem GROUP BY l_suppkey""")
def set_once_and_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    once = lines.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("once"))
    return once.join(A.saturated_sum(lines, ["l_suppkey"], F.col("l_linenumber"), 99, "capped"), "l_suppkey")


@query("""
WITH g AS (SELECT DISTINCT (p_partkey % 40)::INT AS x, p_size AS y FROM part), v AS (SELECT x, y, CASE WHEN (x * 7 + y * 3) % 5 = 0 THEN 255 ELSE 0 END AS v FROM g)
SELECT a.x, a.y, count(b.x) AS n FROM v a LEFT JOIN v b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y) AND b.v = 255 GROUP BY a.x, a.y""")
def stencil_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).cast("int").alias("x"), F.col("p_size").alias("y")).distinct()
    grid = grid.withColumn("v", F.when((F.col("x") * 7 + F.col("y") * 3) % 5 == 0, 255).otherwise(0))
    return A.stencil_count(grid, "x", "y", "v", 255)


@query("""
SELECT CASE WHEN l_extendedprice >= 60000 THEN 4 WHEN l_extendedprice >= 40000 THEN 3 WHEN l_extendedprice >= 20000 THEN 2 WHEN l_extendedprice >= 5000 THEN 1 ELSE 0 END AS band,
  count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1""")
def banded_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.banded(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), [5000, 20000, 40000, 60000], F.col("l_linenumber"))


@query("""SELECT l_suppkey, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY l_suppkey ORDER BY quantity DESC, l_suppkey LIMIT 15""")
def category_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))
    return sums.orderBy(F.desc("quantity"), "l_suppkey").limit(15)


@query("""
SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS "O", count(*) FILTER (l_linestatus = 'F') AS "F", count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_returnflag""")
def pivot_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    shown = lines.groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1))).na.fill(0)
    return shown.join(lines.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders")), "l_returnflag")


@query("""
WITH t AS (SELECT event_type, user_id, (event_id % 97)::BIGINT AS code FROM events), u AS (SELECT event_type, code, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, code) AS r FROM u)
SELECT a.event_type, a.uniq, a.raw, a.users, list(r.code ORDER BY r.r) AS examples
FROM (SELECT event_type, count(DISTINCT code) AS uniq, count(*) AS raw, count(DISTINCT user_id) AS users FROM t GROUP BY event_type) a JOIN r ON a.event_type = r.event_type AND r.r <= 2 GROUP BY ALL""")
def unique_versus_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_type", "user_id", (F.col("event_id") % 97).alias("code"))
    sums = t.groupBy("event_type").agg(F.countDistinct("code").alias("uniq"), F.count(F.lit(1)).alias("raw"), F.countDistinct("user_id").alias("users"))
    top = A.examples(t.groupBy("event_type", "code").agg(F.count(F.lit(1)).alias("n")), ["event_type"], "code", [F.desc("n"), F.col("code")], 2)
    return sums.join(top, "event_type")


@query("""
WITH k AS (SELECT l_orderkey, l_returnflag AS kind, greatest(count(*) FILTER (l_linenumber % 2 = 0), count(*) FILTER (l_linenumber % 2 = 1)) AS n FROM lineitem GROUP BY ALL),
p AS (SELECT l_orderkey, coalesce(sum(n) FILTER (kind = 'A'), 0)::BIGINT AS a, coalesce(sum(n) FILTER (kind = 'N'), 0)::BIGINT AS n, coalesce(sum(n) FILTER (kind = 'R'), 0)::BIGINT AS r FROM k GROUP BY l_orderkey)
SELECT l_orderkey, a, n, r, a + n + r AS total FROM p WHERE a + n + r BETWEEN 1 AND 3""")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger side's count of each kind, pivoted; small totals are kept."""
    side = F.col("l_linenumber") % 2
    sides = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.greatest(F.count_if(side == 0), F.count_if(side == 1)).alias("n"))
    shown = sides.groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).sum("n").na.fill(0).toDF("l_orderkey", "a", "n", "r")
    return shown.withColumn("total", F.col("a") + F.col("n") + F.col("r")).filter("total BETWEEN 1 AND 3")


@query("""SELECT CASE WHEN l_discount = 0 THEN 'exact' WHEN l_tax > 0.04 THEN 'frame' WHEN l_quantity < 10 THEN 'slots' ELSE 'other' END AS status, count(*) AS n FROM lineitem GROUP BY 1""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_discount") == 0, "exact").when(F.col("l_tax") > 0.04, "frame").when(F.col("l_quantity") < 10, "slots").otherwise("other")
    return table(spark, sf_dir, "lineitem").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def hourly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return table(spark, sf_dir, "events").groupBy(hour).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.countDistinct("user_id").alias("users"))


@query("""
WITH s AS (SELECT a.l_returnflag AS bucket, abs(epoch(b.l_shipdate) - epoch(a.l_shipdate))::BIGINT AS sec FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2)
SELECT bucket, count(*) AS n, sum(sec)::BIGINT AS total, round(avg(sec), 3) AS mean, max(sec) AS slowest FROM s GROUP BY bucket""")
def span_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts paired with ends by id, time summed by the start's bucket."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select("l_orderkey", "l_linenumber", "l_returnflag", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("at"))
    start, end = lines.filter("l_linenumber = 1"), lines.filter("l_linenumber = 2").select("l_orderkey", F.col("at").alias("until"))
    spans = start.join(end, "l_orderkey").select(F.col("l_returnflag").alias("bucket"), F.abs(F.col("until") - F.col("at")).alias("sec"))
    return spans.groupBy("bucket").agg(F.count("sec").alias("n"), F.sum("sec").alias("total"), F.round(F.avg("sec"), 3).alias("mean"), F.max("sec").alias("slowest"))


@query("""SELECT l_partkey, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS candidates, count(DISTINCT l_orderkey) FILTER (l_discount = 0) AS exact, count(DISTINCT l_orderkey) FILTER (l_returnflag <> 'R' AND l_discount <> 0) AS others FROM lineitem GROUP BY l_partkey""")
def caller_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, e, o = F.col("l_returnflag") == "R", F.col("l_discount") == 0, F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct(F.when(r, o)).alias("candidates"), F.countDistinct(F.when(e, o)).alias("exact"), F.countDistinct(F.when(~r & ~e, o)).alias("others"))


@query("""
SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[ \n\t]+')) AS word FROM benchmark) WHERE word <> '' GROUP BY ALL""")
def feature_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), "[ \n\t]+")).alias("word"))
    return words.filter("word <> ''").groupBy("item_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT coalesce(r_name, 'all') AS region, coalesce(n_name, 'all') AS nation, count(c_custkey) AS n, round(sum(c_acctbal), 2) AS balance
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)""")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    made = joined.rollup("r_name", "n_name").agg(F.count("c_custkey").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return made.select(F.coalesce("r_name", F.lit("all")).alias("region"), F.coalesce("n_name", F.lit("all")).alias("nation"), "n", "balance")


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT o_orderstatus, word, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT *, unnest(string_split(o_orderpriority, '-')) AS word FROM l WHERE r = 1) GROUP BY ALL""")
def latest_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = A.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    words = last.select("o_orderstatus", "o_totalprice", F.explode(F.split("o_orderpriority", "-")).alias("word"))
    return words.groupBy("o_orderstatus", "word").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
