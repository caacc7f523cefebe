"""Queries over queues, scripts that run, and effects and edits of two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import diffs as D
from millrace.operators import scripts
from millrace.plans.base import query
from millrace.session import table
from millrace.streaming import queues, stateful

c = F.col


@query("""
WITH m AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 211 = 4 THEN 65536 WHEN event_id % 5 < 3 THEN 2147483648 + event_id ELSE event_id % 65536 END AS message FROM events),
k AS (SELECT *, message >= 2147483648 AS is_token, message < 65536 AS is_next, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM m),
n AS (SELECT *, count(*) FILTER (is_token) OVER w AS tokens, count(*) FILTER (is_next) OVER w AS nexts, count(*) FILTER (NOT is_token AND NOT is_next) OVER w AS stops FROM k WINDOW w AS (PARTITION BY user_id ORDER BY i)),
s AS (SELECT *, (((tokens - nexts) % 5) + 5) % 5 AS size FROM n WHERE stops = 0),
h AS (SELECT s.*, (SELECT max_by(t.message, t.i) FROM s t WHERE t.user_id = s.user_id AND t.is_token AND t.i <= s.i AND (t.tokens - 1) % 5 = (s.nexts + 1) % 5) AS after FROM s)
SELECT user_id, event_id, CASE WHEN is_token THEN 'token' ELSE 'next' END AS kind, size, CASE WHEN is_token AND size = 2 THEN message WHEN is_next AND size >= 2 THEN after END AS break_at, is_next AND size = 1 AS disarms FROM h""")
def worker_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of users to their workers, each with a ring for four tokens."""
    e = c("event_id")
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(e % 211 == 4, queues.STOP).when(e % 5 < 3, e + queues.TOKENS).otherwise(e % queues.STOP).alias("message"))
    return queues.worker_ring(log, "user_id", ["ts", "event_id"], "message", 4).drop("ts", "message")


@query("""
WITH p AS (SELECT p_partkey, hex(substr(p_name, 1, p_size)) AS d, p_size + 9 AS size FROM part), k AS (SELECT *, length(d) // 2 AS n, length(d) // 2 // 8 AS whole FROM p),
x AS (SELECT *, unnest(range(0, (size - 1) // 8 + 1)) AS chunk FROM k),
b AS (SELECT *, CASE WHEN chunk < whole THEN substr(d, chunk * 16 + 1, 16) ELSE substr(d, whole * 16 + 1) || substr(CASE WHEN whole > 0 THEN substr(d, (whole - 1) * 16 + 1, 16) ELSE repeat('00', 8) END, n % 8 * 2 + 1) END AS held FROM x)
SELECT p_partkey, chunk::INT AS chunk, (chunk * 8)::INT AS "offset", substr(held, 1, least(size - chunk * 8, 8)::INT * 2) AS bytes FROM b""")
def buffered_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More bytes asked than names have, eight at a time."""
    names = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr("substring(p_name, 1, p_size)").cast("binary").alias("name"))
    return queues.buffered_copy(names, "p_partkey", "name", c("p_size") + 9, 8).withColumn("bytes", F.hex("bytes"))


@query()
def task_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of two priorities by user, from a stream; held against a plain loop in the tests."""
    op = F.when(c("event_id") % 3 == 0, "take").when(c("event_id") % 5 == 0, "high").otherwise("low")
    s = stateful.events_stream(spark, f"{sf_dir}/events.parquet").withColumn("op", op)
    return stateful.drained(queues.task_queue(s, "user_id", "op", "event_id", "ts", 3), "tasks")


#: Variables 0 and 1 are given; 2 becomes their greatest common divisor, 3 a sum over 1 to variable 1 that wraps, 4 counts.
SCRIPT = """
  var 0 0
  var 0 1
  call divisor 2
  set 0 2
  int 0
  set 0 4
  int 0
  set 0 3
more:
  var 0 4
  var 0 1
  lt
  zero done
  inc 0 4
  drop
  var 0 3
  var 0 4
  var 0 4
  mul
  int 405030201
  mul
  add
  set 0 3
  go more
done:
  end
divisor:
  layer 1
  room 1
again:
  var 1 1
  zero found
  var 1 0
  var 1 1
  mod
  set 1 2
  var 1 1
  set 1 0
  var 1 2
  set 1 1
  go again
found:
  var 1 0
  back
"""


@query("""
WITH RECURSIVE g(p_partkey, a, b, k) AS (SELECT p_partkey, p_partkey::BIGINT, p_size::BIGINT, 0 FROM part UNION ALL SELECT p_partkey, b, a % b, k + 1 FROM g WHERE b <> 0),
s AS (SELECT p.p_partkey, p_size::BIGINT AS n, g.a AS divisor, 23 + 11 * g.k + 15 * p_size::BIGINT - 4 AS steps FROM part p JOIN g ON g.p_partkey = p.p_partkey AND g.b = 0)
SELECT p_partkey, steps <= 640 AS ended, least(ceil(steps / 64.0), 10)::INT AS ticks, least(steps, 640)::BIGINT AS steps, divisor::DOUBLE AS divisor,
  CASE WHEN steps <= 640 THEN ((n * (n + 1) * (2 * n + 1) // 6 * 405030201 + 2147483648) % 4294967296 - 2147483648)::DOUBLE END AS total FROM s""")
def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script with a loop and a call for each part, 64 steps a tick and at most ten ticks; those that did not end have no total."""
    runs = scripts.script_runs(table(spark, sf_dir, "part"), "p_partkey", SCRIPT, ["p_partkey", "p_size"], {"divisor": 2, "total": 3}, 64, 10)
    return runs.withColumn("total", F.when(c("ended"), c("total")))


@query("""
WITH a AS (SELECT l_orderkey, CASE WHEN x < y THEN 'store(' || x || ',' || y || ')' ELSE 'store(' || y || ',' || x || ')' END AS effect FROM (SELECT l_orderkey, 'r' || l_partkey % 5 AS x, 's' || l_suppkey % 3 AS y FROM lineitem)),
b AS (SELECT l_orderkey, CASE WHEN x < y THEN 'store(' || x || ',' || y || ')' ELSE 'store(' || y || ',' || x || ')' END AS effect FROM (SELECT l_orderkey, 'r' || l_partkey % 5 AS x, 's' || (l_suppkey + CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END) % 3 AS y FROM lineitem)),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY effect) AS place FROM (FROM a EXCEPT ALL FROM b)), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY effect) AS place FROM (FROM b EXCEPT ALL FROM a))
SELECT coalesce(l.l_orderkey, r.l_orderkey) AS l_orderkey, coalesce(l.place, r.place)::INT AS place, l.effect AS "left", r.effect AS "right" FROM l FULL JOIN r ON l.l_orderkey = r.l_orderkey AND l.place = r.place""")
def effect_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of an order's lines in two versions, arguments in canonical order, what is left on either side set beside each other."""
    lines = table(spark, sf_dir, "lineitem")
    effect = lambda y, flip: F.concat(F.lit("store("), F.array_join(F.array_sort(F.array(*[F.concat(F.lit("r"), (c("l_partkey") % 5).cast("string")), F.concat(F.lit("s"), (y % 3).cast("string"))][::flip])), ","), F.lit(")"))
    a = lines.select("l_orderkey", effect(c("l_suppkey"), 1).alias("effect"))
    b = lines.select("l_orderkey", effect(c("l_suppkey") + F.when(c("l_partkey") % 4 == 0, 1).otherwise(0), -1).alias("effect"))
    return D.paired_leftovers(a, b, ["l_orderkey"], "effect")


@query()
def edit_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as edits of their order at one of five sites; edits of one return flag spoil each other by 12 a pair. Held against a plain loop in the tests."""
    edits = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_suppkey") % 5).alias("site"), "l_returnflag", (c("l_quantity") - 10).cast("double").alias("gain"))
    alike = lambda all_, e: F.size(F.filter(all_, lambda k: k["l_returnflag"] == e["l_returnflag"])) - 1
    # Each pair is met from both sides.
    scored = lambda all_: F.aggregate(all_, F.lit(0.0), lambda sum_, e: sum_ + e["gain"] - alike(all_, e) * 6.0)
    return D.combined_edits(edits, "l_orderkey", "site", "l_linenumber", "gain", ["l_returnflag"], scored)
