"""Queries over scans, filters and ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.base import query
from millrace.session import table



@query("""
SELECT o_custkey, count(*) FILTER (l_returnflag = 'R') AS open_lines,
       round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 2) AS open_revenue
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'
GROUP BY o_custkey HAVING count(*) FILTER (l_returnflag = 'R') > 0
ORDER BY open_lines, open_revenue, o_custkey LIMIT 40""")
def closure_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with least left to return: filter, join, aggregate, having, ranked limit (the limit is the report)."""
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    is_open = F.col("l_returnflag") == "R"
    left = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey")
        .agg(F.count_if(is_open).alias("open_lines"), F.round(F.sum(F.when(is_open, F.col("revenue")).otherwise(0.0)), 2).alias("open_revenue"))
    )
    return left.filter("open_lines > 0").orderBy("open_lines", "open_revenue", "o_custkey").limit(40)
