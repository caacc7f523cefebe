"""Queries over ranked selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import graphs as G
from millrace.operators import ranked as R
from millrace.plans.base import query
from millrace.session import table

c = F.col


@query("""SELECT coalesce(min(l_orderkey), -1) AS found FROM lineitem WHERE l_orderkey >= 100 AND l_quantity = 17""")
def first_match_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_match(table(spark, sf_dir, "lineitem"), "l_orderkey", 100, c("l_quantity") == 17)


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND lower(o_orderpriority) LIKE '%high%' AND o_orderkey & 3 <> 0""")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.filter(c("o_orderstatus").isin("F", "P") & F.lower("o_orderpriority").contains("high") & (c("o_orderkey").bitwiseAND(F.lit(3)) != 0)).select("o_orderkey", "o_orderstatus")


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'kept' ELSE 'removed' END AS list, row_number() OVER (PARTITION BY o_totalprice > 200000, o_custkey ORDER BY o_orderkey) AS seq FROM orders)
SELECT o_orderkey, list, seq::INT AS seq FROM r""")
def stable_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("list", F.when(c("o_totalprice") > 200000, "kept").otherwise("removed"))
    return R.top_k(orders, ["list", "o_custkey"], [c("o_orderkey")], 1 << 30, "seq").select("o_orderkey", "list", "seq")


@query("""
WITH d AS (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS d FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_suppkey % 4 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS lo, row_number() OVER (PARTITION BY c_custkey ORDER BY d DESC, s_suppkey) AS hi FROM d)
SELECT c_custkey, max(s_suppkey) FILTER (lo = 1) AS nearest, max(s_suppkey) FILTER (hi = 1) AS farthest FROM r GROUP BY c_custkey""")
def nearest_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest and farthest among a nation's suppliers without the flag."""
    suppliers = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 0").select(c("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    customers = table(spark, sf_dir, "customer").select(c("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    found = lambda how, name: how(customers, suppliers, ["nation"], "c_custkey", "c_acctbal", "s_suppkey", "s_acctbal").withColumnRenamed("s_suppkey", name)
    return found(G.nearest_along, "nearest").join(found(G.farthest_along, "farthest"), "c_custkey")


@query("""
WITH t AS (SELECT p_brand, p_partkey, CASE WHEN p_size = 1 THEN 0 WHEN p_size > 20 THEN 1 END AS tier, CASE WHEN p_size = 1 THEN 0 ELSE abs(p_retailprice - 1400) END AS d FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier, d, p_partkey) AS r FROM t WHERE tier IS NOT NULL) SELECT p_brand, p_partkey, tier FROM r WHERE r = 1""")
def reuse_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reuse_candidate(table(spark, sf_dir, "part"), ["p_brand"], c("p_size") == 1, c("p_size") > 20, F.abs(c("p_retailprice") - 1400), "p_partkey")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN 1 WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 3 END AS tier FROM orders ORDER BY tier, o_orderkey LIMIT 200""")
def tiered_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the number of places to fill."""
    tiers = [(c("o_orderstatus") == "P") & (c("o_totalprice") > 400000), c("o_orderpriority") == "1-URGENT", F.lit(True)]
    return R.tiered(table(spark, sf_dir, "orders"), tiers, [c("o_orderkey")], 200).select("o_orderkey", "tier")


@query("""SELECT p_brand, p_partkey, rank::INT AS rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size + p_retailprice / 100, p_partkey DESC) AS rank FROM part) WHERE rank <= 3""")
def topk_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low scores win; of equal scores the newer key: the clean tie rule, not one that reads stale states."""
    return R.top_k(table(spark, sf_dir, "part"), ["p_brand"], [c("p_size") + c("p_retailprice") / 100, F.desc("p_partkey")], 3).select("p_brand", "p_partkey", "rank")


@query("""
WITH w AS (SELECT p_brand, p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS run, sum(p_size) OVER (PARTITION BY p_brand) AS total FROM part),
x AS (SELECT *, floor((ascii(right(p_brand, 1)) % 10) / 10.0 * total) AS x FROM w) SELECT p_brand, min(p_partkey) AS chosen FROM x WHERE x - run <= 0 GROUP BY p_brand""")
def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draw is a column, so that engines can be compared."""
    draw = F.ascii(F.right(c("p_brand"), F.lit(1))) % 10 / 10.0
    return R.weighted_choice(table(spark, sf_dir, "part"), ["p_brand"], [c("p_partkey")], "p_size", draw).select("p_brand", c("p_partkey").alias("chosen"))


@query("""
WITH b AS (SELECT p_partkey, 15 - least(greatest(floor((p_retailprice - 1000) / 800 * 16), 0), 15)::INT AS bucket FROM part)
SELECT p_partkey, bucket, (row_number() OVER (PARTITION BY bucket ORDER BY p_partkey DESC))::INT AS place FROM b""")
def depth_bucket_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.depth_buckets(table(spark, sf_dir, "part"), c("p_retailprice"), 1000.0, 1800.0, 16, "p_partkey").select("p_partkey", "bucket", "place")


@query("""
SELECT CASE WHEN p_size = 7 THEN 0 ELSE 1 END AS slot, p_type, CASE WHEN p_size = 7 THEN p_partkey ELSE -1 END AS alone, list(p_partkey ORDER BY p_partkey) AS members FROM part GROUP BY ALL""")
def material_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merged_packets(table(spark, sf_dir, "part"), "p_type", "p_partkey", c("p_size") == 7)


@query("""
WITH s AS (SELECT l_orderkey AS k, l_linenumber - 1 AS slot, CASE WHEN l_quantity < 8 THEN 'bad' WHEN l_quantity > 47 AND l_linenumber = 1 THEN 'empty' ELSE 'valid' END AS state, l_partkey % 9 AS writes FROM lineitem WHERE l_linenumber <= 2),
g AS (SELECT k, max(state) FILTER (slot = 0) AS s0, max(state) FILTER (slot = 1) AS s1, max(writes) FILTER (slot = 0) AS w0, max(writes) FILTER (slot = 1) AS w1 FROM s GROUP BY k)
SELECT k, CASE WHEN s0 = 'empty' THEN -1 WHEN s0 = 'bad' AND s1 = 'bad' THEN -2 WHEN s0 = 'bad' THEN 1 WHEN s1 = 'bad' THEN 0 WHEN w0 >= w1 THEN 0 ELSE 1 END AS use FROM g""")
def two_slot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = c("l_quantity"), c("l_linenumber")
    state = F.when(q < 8, "bad").when((q > 47) & (n == 1), "empty").otherwise("valid")
    s = table(spark, sf_dir, "lineitem").filter(n <= 2).select(c("l_orderkey").alias("k"), (n - 1).alias("slot"), state.alias("state"), (c("l_partkey") % 9).alias("writes"))
    return R.used_slot(s, "k")


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_totalprice < 250000) WHERE r <= 5""")
def capped_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.admitted(table(spark, sf_dir, "orders").filter("o_totalprice < 250000"), ["o_custkey"], [c("o_orderdate"), c("o_orderkey")], 5).select("o_orderkey", "o_custkey")


@query("""
SELECT p_partkey, rank::INT AS rank FROM (SELECT p_partkey, row_number() OVER (ORDER BY (p_size = 50) DESC, p_retailprice DESC, p_size, p_partkey) AS rank FROM part) WHERE rank <= 40""")
def lexicographic_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactness first, then the metrics one after the other; the report has 40 places."""
    top = table(spark, sf_dir, "part").orderBy((c("p_size") == 50).desc(), F.desc("p_retailprice"), "p_size", "p_partkey").limit(40)
    return R.top_k(top, [], [(c("p_size") == 50).desc(), F.desc("p_retailprice"), c("p_size"), c("p_partkey")], 40).select("p_partkey", "rank")


@query("""SELECT event_id, user_id FROM events WHERE event_id % 8 = 1 AND (event_id * 7919 % 1000) / 1000.0 <= CASE WHEN user_id % 3 = 0 THEN 0.6 ELSE 0.2 END""")
def gated_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 and M7 in batch: every eighth tick passes, then by its region's probability, with the draw from the id."""
    p = F.when(c("user_id") % 3 == 0, 0.6).otherwise(0.2)
    return table(spark, sf_dir, "events").filter((c("event_id") % 8 == 1) & ((c("event_id") * 7919 % 1000) / 1000.0 <= p)).select("event_id", "user_id")
