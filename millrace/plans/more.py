"""Queries over texts, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import texts as X
from millrace.plans.base import query
from millrace.session import place, table, written
from millrace.sources import archive, logs, packed
from millrace.streaming import stateful

c = F.col


def _sql(pattern: str) -> str:
    """A pattern in SQL quotes."""
    return "'" + pattern.replace("'", "''") + "'"


@query(f"""
WITH p AS (SELECT item_id, regexp_extract_all(text, {_sql("(?m)" + T.re2(T.PATTERN))}) AS pieces FROM benchmark),
u AS (SELECT item_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM p),
l AS (SELECT *, 1 + coalesce(sum(length(piece) - length(replace(piece, chr(10), ''))) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS line FROM u),
k AS (SELECT *, CASE WHEN regexp_matches(piece, '^(//|/[*]|[ \\t]*#|\\s)') THEN 'dropped' WHEN starts_with(piece, '"') THEN 'text' WHEN starts_with(piece, chr(39)) THEN 'char' WHEN regexp_matches(piece, '^[.]?[0-9]') THEN 'number' WHEN regexp_matches(piece, '^[A-Za-z_]') THEN 'name' ELSE 'operator' END AS kind FROM l)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY i) - 1)::INT AS pos, kind, piece AS token, line FROM k WHERE kind <> 'dropped'""")
def lexed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.token_table(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query()
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain: aligned at 0.8, with four fifths of an item's words that are no keywords, repeats counted. Held against
    brute force in the tests."""
    tokens = lambda t: F.filter(F.split(F.lower(F.coalesce(c(t), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    items = table(spark, sf_dir, "benchmark").select("item_id", tokens("text").alias("w"), F.filter(tokens("text"), lambda w: ~w.isin(sorted(T.KEYWORDS))).alias("told"))
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("w"))
    return X.near_copies(items, docs, "item_id", "doc_id", "w", "told", 0.8, 0.8, written).select("item_id", "doc_id", F.round("similarity", 4).alias("similarity"))


@query()
def order_sequence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of a user's even and odd events, compared as sequences."""
    e = table(spark, sf_dir, "events")
    seq = lambda r, n: e.filter(c("event_id") % 2 == r).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias(n))
    return X.sequence_diffs(seq(0, "a").join(seq(1, "b"), "user_id"), "a", "b")


@query("""SELECT l_orderkey AS id, l_linenumber AS line, l_partkey - 200 AS part, l_tax > 0.04 AS taxed, round(l_extendedprice::FLOAT::DOUBLE, 2) AS price FROM lineitem""")
def packed_table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as self-describing binary tables, a file a task, and read from them by rows: five of the six columns are decoded."""
    packed.register(spark)
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), c("l_quantity").alias("quantity"), (c("l_partkey").cast("int") - 200).alias("part"), (c("l_tax") > 0.04).alias("taxed"), c("l_extendedprice").alias("price"))
    path = place(spark, "tables")
    rows.repartition(6).write.format("packed_table").option("path", path).mode("append").save()
    found = spark.read.format("packed_table").option("path", path).option("splitBytes", 4 << 20).schema("id long, line int, part int, taxed boolean, price double").load()
    return found.select("id", "line", c("part").cast("long").alias("part"), "taxed", F.round("price", 2).alias("price"))


@query("""SELECT p_partkey AS id, p_size AS size, (p_partkey % 16)::BIGINT AS low, p_size > 25 AS big, round(p_retailprice::FLOAT::DOUBLE, 2) AS price FROM part""")
def packed_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-describing binary tables of parts; a file's own header gives the schema, with the names that are known."""
    packed.register(spark)
    rows = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_size").cast("long").alias("size"), (c("p_partkey") % 16).alias("low"), (c("p_size") > 25).cast("long").alias("big"), c("p_retailprice").alias("price"))
    path = place(spark, "tables")
    rows.repartition(3).write.format("packed_table").option("path", path).mode("append").save()
    found = spark.read.format("packed_table").option("path", path).option("names", "price, id, low, size, big").load()
    return found.select("id", c("size").cast("int").alias("size"), "low", (c("big") != 0).alias("big"), F.round(c("price").cast("double"), 2).alias("price"))


@query("""
WITH e AS (SELECT page_id, regexp_extract(lower(url), '^https?://([^/]+)', 1) AS host, regexp_extract(lower(url), '^https?://[^/]+/([^/]*)', 1) AS leaf FROM pages)
SELECT host, count(*) AS n FROM e WHERE page_id % 7 <> 0 GROUP BY host""")
def archive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by host; every seventh entry is a directory."""
    p = table(spark, sf_dir, "pages")
    entries = p.select(c("page_id").alias("id"), F.lit(None).cast("long").alias("parent"), c("url").alias("name"), (c("page_id") % 7 != 0).alias("is_file"), F.regexp_extract(F.lower("url"), "^https?://([^/]+)", 1).alias("type"))
    return archive.counts(entries).withColumnRenamed("type", "host")


@query("""
SELECT s.scope, s.name, CASE WHEN EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = s.scope) THEN (SELECT min(n_nationkey) FROM nation n WHERE n.n_regionkey = s.scope AND n.n_name = s.name) ELSE NULL END AS value
FROM (SELECT r_regionkey AS scope, n_name AS name FROM region, nation) s""")
def layered_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    local = n.select(c("n_regionkey").alias("scope"), c("n_name").alias("name"), c("n_nationkey").alias("value"))
    wanted = table(spark, sf_dir, "region").select(c("r_regionkey").alias("scope"), F.explode(F.array(F.lit(0))).alias("x")).join(F.broadcast(n.select("n_name"))).select("scope", c("n_name").alias("name"))  # two dimension tables of fixed size
    return logs.layered_params(local, n.select(c("n_name").alias("name"), c("n_nationkey").alias("value")), wanted)


@query("""SELECT event_id, user_id FROM events WHERE event_id % 5 = 1""")
def stream_gated_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stateful.events_stream(spark, f"{sf_dir}/events.parquet")
    return stateful.drained(stateful.gated_ticks(s, "event_id", 5).select("event_id", "user_id"), "ticks")


@query()
def session_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped admission with eviction by user; held against a plain loop in the tests."""
    s = stateful.events_stream(spark, f"{sf_dir}/events.parquet").withColumn("priority", c("event_id") * 7 % 10)
    return stateful.drained(stateful.capped_admission(s, "user_id", "event_id", "priority", "ts", 4), "cap")


@query("""SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def stream_latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stateful.events_stream(spark, f"{sf_dir}/events.parquet").select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "event_type")
    return stateful.upserted(s, ["user_id"], "at", "latest").select("user_id", "event_id", "event_type")


@query("""
WITH x AS (SELECT user_id % 4 AS ns, event_id % 200 AS idx, event_id, CASE WHEN event_id % 3 = 0 THEN 'set' ELSE 'inc' END AS op, (event_id % 5)::BIGINT AS value, (user_id % 4) % 2 = 0 AS b FROM events WHERE event_id % 200 < CASE WHEN user_id % 4 < 2 THEN 120 ELSE 60 END),
s AS (SELECT ns, idx, max_by(value, event_id) AS v, max(event_id) AS at FROM x WHERE op = 'set' GROUP BY ALL),
t AS (SELECT x.ns, x.idx, any_value(b) AS b, coalesce(any_value(s.v), 0) AS base, sum(CASE WHEN op = 'inc' AND NOT b AND (s.at IS NULL OR event_id > s.at) THEN value ELSE 0 END) AS add FROM x LEFT JOIN s ON s.ns = x.ns AND s.idx = x.idx GROUP BY x.ns, x.idx)
SELECT ns, idx, CASE WHEN b THEN (base + add <> 0)::BIGINT ELSE (base + add)::BIGINT END AS value FROM t WHERE ns NOT IN (2, 3)""")
def namespaced_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by namespace from a log, then a reset of the middle scope, which takes the inner one with it."""
    log = table(spark, sf_dir, "events").select((c("user_id") % 4).alias("ns"), (c("event_id") % 200).alias("idx"), "event_id", F.when(c("event_id") % 3 == 0, "set").otherwise("inc").alias("op"), (c("event_id") % 5).alias("value"))
    bounds = spark.range(4).select(c("id").alias("ns"), F.when(c("id") < 2, 120).otherwise(60).alias("size"), (c("id") % 2 == 0).alias("is_bool"))
    return stateful.scoped_reset(stateful.flags_state(log, "ns", "idx", "value", "event_id", bounds), "ns", "game", {"card": [0, 1], "game": [2], "stage": [3]})
