"""Two versions of data flow made of the lines of orders, compared unit by unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import dataflow as D
from millrace.plans.base import query
from millrace.session import discard, table, written

c = F.col


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, values, operands) of orders: the k-th line is a value of content flag and status, whose operands are the line before (the first line's is
    the last one, as in a loop) and line 3k mod n + 1; lines of status F are effects; blocks hold four lines each. Version q numbers values backwards, swaps the
    operands of flag N (whose places are alike), has another content in every fifth unit, another operand in every seventh, two values in the
    other's position in every third, and a block more in every eleventh."""
    lines = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("unit"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", c("l_returnflag").alias("flag"), c("l_linestatus").alias("status"))
    w = W.partitionBy("unit").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "flag", "status")
    lines = lines.select("unit", "flag", "status", F.row_number().over(w).alias("k"), F.count("*").over(W.partitionBy("unit")).alias("n"))
    both = lines.withColumn("version", F.explode(F.array(F.lit("p"), F.lit("q"))))
    is_q, every = c("version") == "q", lambda m: (c("unit") % m == 0) & is_q
    block = F.floor((c("k") - 1) / 4).cast("int")
    value = lambda k: F.when(is_q, c("n") + 1 - k).otherwise(k)
    content = F.concat("flag", "status", F.when(every(5) & (c("k") == 2), "!").otherwise(""))
    effects = F.row_number().over(W.partitionBy("unit", "version", block).orderBy(F.when(c("status") == "F", 0).otherwise(1), "k"))
    pos = F.when(every(3) & (c("k") <= 2) & (c("n") > 1), 3 - c("k")).otherwise(c("k"))
    values = both.select("unit", "version", value(c("k")).alias("value"), content.alias("content"), block.alias("block"), pos.alias("pos"), F.when(c("status") == "F", effects).alias("effect"))
    before = F.when(c("k") == 1, c("n")).otherwise(c("k") - 1)
    other = F.when(every(7) & (c("k") == 1), F.lit(1).cast("long")).otherwise(c("k") * 3 % c("n") + 1)
    places = F.when(c("flag") == "N", F.array(F.struct(F.lit(0).alias("place"), other.alias("o")), F.struct(F.lit(0).alias("place"), before.alias("o")))).otherwise(F.array(F.struct(F.lit(0).alias("place"), before.alias("o")), F.struct(F.lit(1).alias("place"), other.alias("o"))))
    operands = both.withColumn("x", F.explode(places)).select("unit", "version", value(c("k")).alias("value"), c("x.place").alias("place"), value(c("x.o")).alias("operand"))
    tops = both.groupBy("unit", "version").agg(F.floor((F.max("n") - 1) / 4).cast("int").alias("last")).withColumn("last", c("last") + F.when(every(11), 1).otherwise(0))
    blocks = tops.select("unit", "version", "last", F.explode(F.sequence(F.lit(0), c("last"))).alias("block"))
    ends = c("block") == c("last")
    blocks = blocks.select("unit", "version", "block", F.when(ends, "ret").otherwise("br").alias("kind"), F.when(ends, F.array().cast("array<int>")).otherwise(F.array(c("block") + 1, F.lit(0))).alias("successors"))
    return blocks, values, operands


LINES = """l AS (SELECT l_orderkey AS unit, l_returnflag AS flag, l_linestatus AS status, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
v AS (SELECT unit, ver, k, flag || status || CASE WHEN ver = 'q' AND unit % 5 = 0 AND k = 2 THEN '!' ELSE '' END AS content, (k - 1) // 4 AS block, CASE WHEN ver = 'q' AND unit % 3 = 0 AND k <= 2 AND n > 1 THEN 3 - k ELSE k END AS pos,
  CASE WHEN status = 'F' THEN row_number() OVER (PARTITION BY unit, ver, (k - 1) // 4, status ORDER BY k) END AS effect, flag, n FROM l, (VALUES ('p'), ('q')) t(ver)),
o AS (SELECT unit, ver, k, CASE WHEN place = 1 AND flag <> 'N' THEN 1 ELSE 0 END AS place, CASE WHEN place = 0 THEN CASE WHEN k = 1 THEN n ELSE k - 1 END WHEN ver = 'q' AND unit % 7 = 0 AND k = 1 THEN 1 ELSE k * 3 % n + 1 END AS operand FROM v, (VALUES (0), (1)) t(place))"""


@query(f"""
WITH RECURSIVE {LINES}, e AS (SELECT *, false AS own FROM o UNION ALL SELECT unit, ver, k, 0, k, true FROM v), size AS (SELECT max(2 * n) AS n FROM l),
r(step, unit, ver, k, class) AS (SELECT 0, unit, ver, k, md5(content) FROM v UNION ALL
  SELECT any_value(step) + 1, e.unit, e.ver, e.k, md5(max(class) FILTER (own) || string_agg(place || class, ',' ORDER BY place, class) FILTER (NOT own))
  FROM r JOIN e ON e.unit = r.unit AND e.ver = r.ver AND e.operand = r.k WHERE step < (SELECT n FROM size) GROUP BY e.unit, e.ver, e.k),
done AS (SELECT r.*, block, effect FROM r JOIN v USING (unit, ver, k) WHERE step = (SELECT n FROM size)),
d AS (SELECT coalesce(p.unit, q.unit) AS unit, coalesce(p.block, q.block) AS block, coalesce(p.effect, q.effect) AS effect FROM (SELECT * FROM done WHERE ver = 'p' AND effect IS NOT NULL) p FULL JOIN (SELECT * FROM done WHERE ver = 'q' AND effect IS NOT NULL) q
      ON p.unit = q.unit AND p.block = q.block AND p.effect = q.effect WHERE p.class IS DISTINCT FROM q.class),
told AS (SELECT unit, arg_min('block ' || block || ' effect ' || effect, (block, effect)) AS reason FROM d GROUP BY unit),
orders AS (SELECT unit, string_agg(content, ',' ORDER BY pos) FILTER (ver = 'p') = string_agg(content, ',' ORDER BY pos) FILTER (ver = 'q') AS same, max((n - 1) // 4) + 1 AS blocks FROM v GROUP BY unit)
SELECT unit, CASE WHEN unit % 11 = 0 THEN 'UNSUPPORTED' WHEN reason IS NOT NULL THEN 'DIFFERENT' ELSE 'EQUIVALENT' END AS verdict,
       CASE WHEN unit % 11 = 0 THEN blocks || ' vs ' || (blocks + 1) || ' blocks' ELSE coalesce(reason, CASE WHEN same THEN 'L1' ELSE 'L2' END) END AS reason FROM orders LEFT JOIN told USING (unit)""")
def flow_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a unit of data flow in two versions: EQUIVALENT, DIFFERENT or UNSUPPORTED, and why."""
    blocks, values, operands = _graphs(spark, sf_dir)
    return D.verdicts(written(blocks, "flow-blocks"), written(values, "flow-values"), written(operands, "flow-operands"), ("p", "q"), written, discard)
