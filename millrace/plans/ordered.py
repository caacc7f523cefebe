"""Queries over ordered analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.operators import ordered as O
from millrace.operators import series
from millrace.plans.base import query
from millrace.session import table, written

BY_TIME = ["ts", "event_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""
WITH z AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END AS v FROM events),
n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c,
  first_value(nullif(v, 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM z)
SELECT event_id, user_id, CASE WHEN c >= 3 THEN coalesce(nx, v) ELSE v END AS v FROM n""")
def backward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _events(spark, sf_dir).select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id")).alias("v"))
    return O.backward_fill(z, ["user_id"], BY_TIME, "v").drop("ts")


@query("""
WITH z AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN value END AS v FROM events)
SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS v FROM z""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _events(spark, sf_dir).select("event_id", "user_id", "ts", F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("v"))
    return O.forward_fill(z, ["user_id"], BY_TIME, "v", 0.0).select("event_id", "v")


@query("""
WITH d AS (SELECT event_type, ts::DATE::TIMESTAMP AS day, event_id, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT event_type, day, event_id, event_id - lag(event_id, 1, 0) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM d WHERE r = 1""")
def progress_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = O.last_per_period(_events(spark, sf_dir), ["event_type"], F.date_trunc("day", "ts").cast("timestamp_ntz"), [F.desc("ts"), F.desc("event_id")])
    delta = F.col("event_id") - F.lag("event_id", 1, 0).over(W.partitionBy("event_type").orderBy("period"))
    return last.select("event_type", F.col("period").alias("day"), "event_id", delta.alias("delta"))


@query("""
WITH e AS (SELECT event_type, floor(epoch(ts))::BIGINT AS s, event_id AS v FROM events), last AS (SELECT event_type, max((s, v)) AS e FROM e GROUP BY 1),
b AS (SELECT e.event_type, any_value(last.e) AS e, max((s, v)) FILTER (s <= last.e[1] - 72 * 3600) AS old, min((s, v)) AS first FROM e JOIN last USING (event_type) GROUP BY 1),
c AS (SELECT event_type, e, coalesce(old, first) AS b FROM b), r AS (SELECT event_type, e, (e[2] - b[2]) / nullif((e[1] - b[1]) / 86400.0, 0) AS slope FROM c)
SELECT event_type, round(slope, 4) AS per_day, round(CASE WHEN slope > 0 THEN (1000000 - e[2]) / slope ELSE 1e9 END, 3) AS days_left FROM r""")
def trailing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"), F.col("event_id").alias("v"))
    got = O.trailing_rate(e, ["event_type"], "s", "v", 72, 1000000)
    return got.select("event_type", F.round("per_day", 4).alias("per_day"), F.round(F.least("days_left", F.lit(1e9)), 3).alias("days_left"))


@query("""
WITH p AS (SELECT date_trunc('hour', ts) AS hour, max_by(event_id, (ts, event_id)) AS v FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1),
t AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS tokens FROM events WHERE event_id % 7 = 0 GROUP BY 1),
j AS (SELECT coalesce(p.hour, t.hour) AS hour, p.v, coalesce(tokens, 0) AS tokens FROM p FULL JOIN t ON p.hour = t.hour)
SELECT hour, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING), 0) AS v, tokens FROM j""")
def hourly_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hourly series on the union of their hours: one carried forward, the other 0 where it has no row. Hours, not rows, are ordered in one window."""
    e = _events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    first = e.agg(F.min("event_type").alias("t"))
    p = e.join(F.broadcast(first), F.col("event_type") == F.col("t"), "left_semi").groupBy("hour").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("v"))
    t = e.filter("event_id % 7 = 0").groupBy("hour").agg(F.count(F.lit(1)).alias("tokens"))
    j = p.join(t, "hour", "full_outer").select("hour", "v", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    return O.forward_fill(j, [], ["hour"], "v", 0)


@query("""
WITH m AS (SELECT event_id, user_id, ts, (event_id * 5 % 16)::BIGINT AS mask FROM events)
SELECT event_id, mask, mask & xor(mask, lag(mask, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS pressed FROM m""")
def rising_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _events(spark, sf_dir).select("event_id", "user_id", "ts", (F.col("event_id") * 5 % 16).alias("mask"))
    return O.rising_edges(m, ["user_id"], BY_TIME, "mask", "pressed").select("event_id", "mask", "pressed")


@query("""
SELECT l_orderkey, l_linenumber, unnest(range(1, greatest((l_quantity % 6)::INT, 1) + 1))::INT AS frame, l_partkey FROM lineitem""")
def rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_quantity") % 6)
    return O.run_length_decode(lines, "d", "l_partkey", ["l_orderkey", "l_linenumber"])


@query("""
WITH g AS (SELECT event_id, user_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 60 THEN 1 ELSE 0 END AS gap FROM events)
SELECT event_id, user_id, sum(gap) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS island FROM g""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.islands(_events(spark, sf_dir).select("event_id", "user_id"), ["user_id"], "event_id", 60)


@query("""
WITH n AS (SELECT user_id, event_type, row_number() OVER w AS pos, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) - 1 AS run FROM n)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS n, min(pos)::INT AS start FROM r GROUP BY user_id, run""")
def run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.runs(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), ["user_id"], BY_TIME, "event_type")


@query("""
WITH p AS (SELECT label AS k, vec_id AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2), 0) AS d FROM p WINDOW w AS (PARTITION BY k ORDER BY i)),
s AS (SELECT k, i, sum(d) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS s, sum(d) OVER (PARTITION BY k) AS t FROM d)
SELECT k, i, round(s / nullif(t, 0), 6) AS u FROM s""")
def chord_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    p = table(spark, sf_dir, "embeddings").select(c("label").alias("k"), c("vec_id").alias("i"), *(c("embedding")[j].cast("double").alias(n) for j, n in enumerate("xyz")))
    return series.chord_length(p, ["k"], "i", ["x", "y", "z"], written).select("k", "i", F.round("u", 6).alias("u"))


@query("""
WITH k AS (SELECT user_id, event_id AS "at", value, (event_id % 5) - 2 AS slope FROM events), p AS (SELECT u AS user_id, t AS "at" FROM (SELECT DISTINCT user_id AS u FROM events), range(0, 12000, 1500) r(t)),
b AS (SELECT p.user_id, p."at", max(k."at") FILTER (k."at" <= p."at") AS pa, min(k."at") FILTER (k."at" > p."at") AS na FROM p JOIN k USING (user_id) GROUP BY ALL),
v AS (SELECT b.*, a.value AS v0, a.slope AS m0, n.value AS v1, n.slope AS m1, (b."at" - pa) / (na - pa)::DOUBLE AS u, (na - pa)::DOUBLE AS span FROM b LEFT JOIN k a ON a.user_id = b.user_id AND a."at" = pa LEFT JOIN k n ON n.user_id = b.user_id AND n."at" = na)
SELECT user_id, "at", round(CASE WHEN pa IS NULL THEN v1 WHEN na IS NULL OR pa = "at" THEN v0
  ELSE v0*(1 + u*u*(2*u-3)) + v1*(u*u*(3-2*u)) + span*(m0*u*(1+u*(u-2)) + m1*u*u*(u-1)) END, 5) AS value FROM v""")
def asof_hermite(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("at"), "value", (F.col("event_id") % 5 - 2).alias("slope"))
    probes = keys.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10500).cast("long"), F.lit(1500).cast("long"))).alias("at"))
    return O.keyframes(probes, keys.withColumnRenamed("at", "key_at"), ["user_id"], "at", "key_at", "value", "slope").withColumn("value", F.round("value", 5))


@query("""
SELECT p.user_id, p."at", max(k.event_id) AS before FROM (SELECT DISTINCT user_id, event_id + event_id % 2 AS "at" FROM events) p LEFT JOIN events k ON p.user_id = k.user_id AND k.event_id < p."at" GROUP BY ALL""")
def segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment before a parameter: lower bound, one step back."""
    keys = _events(spark, sf_dir).select("user_id", "event_id")
    probes = keys.select("user_id", (F.col("event_id") + F.col("event_id") % 2).alias("at")).distinct()
    return O.asof(probes, keys, ["user_id"], "at", "event_id", [], strict=True).select("user_id", "at", F.col("prev_at").alias("before"))


@query("""
WITH p AS (SELECT p_partkey, (p_partkey % 50)::DOUBLE AS now, (p_size - 25)::DOUBLE AS rate FROM part),
n AS (SELECT *, greatest(now + rate, 5.0) AS l0 FROM p), l AS (SELECT *, CASE WHEN l0 >= 45 THEN 45 - 0.001 ELSE l0 END AS later FROM n)
SELECT p_partkey, CASE WHEN now <= later THEN now <= 20 AND 20 < later ELSE later <= 20 AND 20 < now END AS passed FROM l""")
def frame_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, rate = (F.col("p_partkey") % 50).cast("double"), (F.col("p_size") - 25).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", O.frame_passed(now, rate, 5.0, 45.0, 20.0).alias("passed"))
