"""Queries over states, lists, trees, verdicts, draws and orders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.functions import text as T
from millrace.operators import aggregates as A
from millrace.operators import diffs as D
from millrace.operators import lookups as L
from millrace.operators import ordered as O  # noqa: E741
from millrace.operators import ranked as R
from millrace.operators import series
from millrace.operators import texts as X
from millrace.plans.base import query
from millrace.plans.sources import _batches
from millrace.session import place, table, written
from millrace.streaming import keyed, stateful, versioned

c = F.col


@query("""
WITH last AS (SELECT make_timestamp((epoch_us(max(ts)) + 999) // 1000 * 1000) AS t FROM events),
g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 45 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS held_from, max(ts) + INTERVAL 45 MINUTE AS released_at, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 45 MINUTE <= (SELECT t FROM last)""")
def released_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are held, in a stream's state, until 45 minutes pass without an event of theirs; those that are released by the time of the last event."""
    s = stateful.events_stream(spark, f"{sf_dir}/events.parquet", None)
    with keyed.rocksdb(spark):
        got = stateful.drained(keyed.in_order(s, "user_id", "ts", "event_id", None, "0 seconds", keyed.Held(45 * 60 * 1_000_000)), "held")
    return got.select(c("key").alias("user_id"), *(F.timestamp_micros(n).cast("timestamp_ntz").alias(n) for n in ("held_from", "released_at")), "n")


@query("""
WITH w AS (SELECT event_id // 100 AS frame, user_id % 10 AS slot, sum(event_id % 7)::BIGINT AS written FROM events GROUP BY ALL) SELECT a.frame, a.slot, a.written, b.written AS read FROM w a LEFT JOIN w b ON b.frame = a.frame - 1 AND b.slot = a.slot""")
def double_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.floor(c("event_id") / 100).alias("frame"), (c("user_id") % 10).alias("slot"), (c("event_id") % 7).alias("v"))
    return stateful.double_buffered(e, "frame", "slot", "v")


@query("""
SELECT n_nationkey AS cue, s_suppkey AS id, (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey * 37 % 101, s_suppkey))::INT AS nth FROM nation JOIN supplier ON ((n_nationkey * 5 + 1) % 64) & (s_suppkey * 11 % 64) <> 0""")
def cue_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = c("s_suppkey")
    cues = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("cue"), ((c("n_nationkey") * 5 + 1) % 64).cast("long").alias("mask"))
    return stateful.dispatched(cues, table(spark, sf_dir, "supplier").select(s.alias("id"), (s * 11 % 64).alias("mask"), (s * 37 % 101).alias("place")), 6)


@query("""
WITH l AS (SELECT user_id AS ns, event_id AS seq, event_id % 5 AS k, event_id % 97 AS v, CASE WHEN event_id % 9 = 0 THEN 'success' WHEN event_id % 9 = 4 THEN 'fail' ELSE 'set' END AS op FROM events),
n AS (SELECT s.*, (SELECT arg_min(b.op, b.seq) FROM l b WHERE b.ns = s.ns AND b.seq > s.seq AND b.op <> 'set') AS fate FROM l s WHERE s.op = 'set'),
r AS (SELECT ns, k, arg_max(v, seq) FILTER (fate = 'success') AS good, arg_max(v, seq) FILTER (fate = 'success' OR fate IS NULL) AS working FROM n GROUP BY ALL) SELECT * FROM r WHERE working IS NOT NULL""")
def transactional_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and working copies of users' entries, kept by a sink of numbered versions."""
    i = c("event_id")
    log = stateful.events_stream(spark, f"{sf_dir}/events.parquet").select(c("user_id").alias("ns"), i.alias("seq"), (i % 5).alias("k"), (i % 97).alias("v"), F.when(i % 9 == 0, "success").when(i % 9 == 4, "fail").otherwise("set").alias("op"))
    return versioned.transactions(log, place(spark, "versions"), place(spark, "versions-state"), "ns", "k", "v", "seq").read()


@query("""
WITH e AS (SELECT user_id AS key, CASE WHEN event_id % 3 = 0 THEN 'pop' ELSE event_type || event_id % 10 END AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT *, sum(CASE WHEN op = 'pop' THEN -1 ELSE 1 END) OVER (PARTITION BY key ORDER BY i) AS s FROM e), d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY key ORDER BY i)) AS depth FROM s),
f AS (SELECT key, count(*) AS seen, arg_max(depth, i)::INT AS depth FROM d GROUP BY key)
SELECT f.key, f.seen, f.depth, CASE WHEN f.depth > 0 THEN arg_max(d.op, d.i) FILTER (d.op <> 'pop' AND d.depth = f.depth) END AS top FROM f JOIN d ON d.key = f.key GROUP BY f.key, f.seen, f.depth""")
def stack_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's stack of states after all of their events, from a stream."""
    op = F.when(c("event_id") % 3 == 0, "pop").otherwise(F.concat("event_type", (c("event_id") % 10).cast("string")))
    s = stateful.events_stream(spark, f"{sf_dir}/events.parquet", None).filter("user_id IS NOT NULL").withColumn("op", op)
    with keyed.rocksdb(spark):
        made = stateful.drained(keyed.in_order(s, "user_id", "ts", "event_id", "op", "0 seconds", keyed.Stacked()), "stack")
    return made.groupBy("key").agg(F.max(F.struct("seen", "depth", "top")).alias("l")).select("key", "l.seen", c("l.depth").cast("int").alias("depth"), "l.top")


@query()
def ring_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded ring with a priority gate by user; held against a plain loop in the tests."""
    op = F.when(c("event_id") % 4 == 0, "drain").otherwise("request")
    s = stateful.events_stream(spark, f"{sf_dir}/events.parquet").withColumns({"op": op, "priority": c("event_id") * 7 % 10})
    return stateful.drained(stateful.gated_ring(s, "user_id", "op", "event_id", "priority", "ts", 1, 2), "ring")


@query("""
WITH a AS (SELECT l_orderkey, list(l_partkey % 10 ORDER BY l_partkey, l_linenumber) AS v, list(l_suppkey % 10 ORDER BY l_suppkey) AS o FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, v, CASE WHEN l_orderkey % 3 = 0 THEN v ELSE o END AS o FROM a)
SELECT l_orderkey, CASE WHEN v = o THEN v ELSE list_concat(list_concat(v[:2], o), v[3:]) END AS spliced, list_filter(v, lambda x: x <> 3) AS removed, list_concat(v[:1], v[4:]) AS cut FROM b""")
def list_splices(spark: SparkSession, sf_dir: str) -> DataFrame:
    sorted_by = lambda n, *k: F.transform(F.array_sort(F.collect_list(F.struct(*k))), lambda e: e[n] % 10)
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(sorted_by("l_partkey", "l_partkey", "l_linenumber").alias("v"), sorted_by("l_suppkey", "l_suppkey").alias("o"))
    other = F.when(c("l_orderkey") % 3 == 0, c("v")).otherwise(c("o"))
    return a.select("l_orderkey", *(e.alias(n) for n, e in L.list_cuts(c("v"), other, 2, 1, 3, 3).items()))


@query("""
WITH e AS (SELECT event_id AS seq, user_id AS node, event_id % 7 AS list, CASE event_id % 5 WHEN 0 THEN 'prepend' WHEN 1 THEN 'remove' ELSE 'append' END AS op FROM events), l AS (SELECT node, arg_max(list, seq) AS list, arg_max(op, seq) AS op, max(seq) AS seq FROM e GROUP BY node)
SELECT list, list(node ORDER BY CASE WHEN op = 'prepend' THEN -seq ELSE seq END) AS members, list(node ORDER BY CASE WHEN op = 'prepend' THEN -seq ELSE seq END)[3] AS third FROM l WHERE op <> 'remove' GROUP BY list""")
def list_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes move between lists; the third node of each, null where there are fewer."""
    i = c("event_id")
    log = table(spark, sf_dir, "events").select(i.alias("seq"), c("user_id").alias("node"), (i % 7).alias("list"), F.when(i % 5 == 0, "prepend").when(i % 5 == 1, "remove").otherwise("append").alias("op"))
    return L.members(log, "node", "list", "seq").withColumn("third", F.get("members", F.lit(2)))


@query("""
WITH RECURSIVE e AS (SELECT event_id AS seq, user_id + 1 AS node, (user_id + 1) // (2 + event_id % 3) AS parent, CASE event_id % 16 WHEN 0 THEN 'prepend' WHEN 1 THEN 'remove' ELSE 'append' END AS op FROM events),
l AS (SELECT node, arg_max(parent, seq) AS parent, CASE WHEN arg_max(op, seq) = 'prepend' THEN -max(seq) ELSE max(seq) END AS place, arg_max(op, seq) AS op FROM e GROUP BY node), k AS (SELECT * FROM l WHERE op <> 'remove'),
t(id, path) AS (SELECT 0::BIGINT, [0::BIGINT] UNION ALL SELECT node, list_append(path, place) FROM t JOIN k ON parent = id)
SELECT id, len(path)::INT AS depth, (row_number() OVER (ORDER BY path))::INT AS nth FROM t""")
def tree_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children appended, prepended and removed, with all that is below them; the tree in pre-order."""
    i, node = c("event_id"), c("user_id") + 1
    log = table(spark, sf_dir, "events").select(i.alias("seq"), node.alias("node"), F.floor(node / (i % 3 + 2)).alias("parent"), F.when(i % 16 == 0, "prepend").when(i % 16 == 1, "remove").otherwise("append").alias("op"))
    kids = L.members(log, "node", "parent", "seq").select("parent", F.posexplode("members").alias("place", "id"))
    nodes = kids.select("id", "parent", "place").unionAll(spark.range(1).select("id", F.lit(None).cast("long"), F.lit(0)))
    paths = series.numbered(L.preorder(nodes, written), [], ["path"], written)
    return paths.select("id", F.size("path").alias("depth"), (c("pos") + 1).cast("int").alias("nth"))


@query("""
WITH RECURSIVE n AS (SELECT p_partkey AS id, p_partkey // 4 AS parent, (p_partkey * 7 % 11) * 100000 + p_partkey AS place, p_name AS name FROM part WHERE p_partkey > 0 UNION ALL SELECT 0, NULL, 0, p_name FROM part WHERE p_partkey = 0),
t(id, path) AS (SELECT id, [place] FROM n WHERE parent IS NULL UNION ALL SELECT n.id, list_append(path, place) FROM t JOIN n ON n.parent = t.id)
SELECT name, arg_min(t.id, path) AS id FROM n JOIN t ON t.id = n.id GROUP BY name UNION ALL SELECT 'no such name', NULL""")
def tree_search_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first node of each name, a node before what is below it."""
    k = c("p_partkey")
    nodes = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k > 0, F.floor(k / 4)).alias("parent"), F.when(k > 0, (k * 7 % 11) * 100000 + k).otherwise(0).alias("place"), c("p_name").alias("name"))
    placed = nodes.join(L.preorder(nodes, written), "id")
    return L.tree_first(placed, nodes.select("name").union(spark.createDataFrame([("no such name",)], "name string")), order="path")


@query("""
WITH f AS (SELECT l_orderkey AS unit, l_linenumber % 2 AS side, CASE l_suppkey % 4 WHEN 0 THEN 'call' WHEN 1 THEN 'data' WHEN 2 THEN 'op' ELSE 'call' END AS kind, l_partkey % 6 AS item FROM lineitem),
d AS (SELECT unit, kind, item, count(*) FILTER (side = 0) <> count(*) FILTER (side = 1) AS d FROM f GROUP BY ALL),
p AS (SELECT unit, list_sort(list(DISTINCT kind) FILTER (d AND kind IN ('call', 'data', 'cmp'))) AS why, coalesce(bool_or(d AND kind = 'op'), false) AS op, bool_or(d AND kind = 'call') AS calls, bool_and(NOT (d AND kind = 'call') OR item < 3) AS weak, bool_or(d AND kind IN ('data', 'cmp')) AS strong FROM d GROUP BY unit)
SELECT unit, CASE WHEN why IS NOT NULL THEN CASE WHEN calls AND weak AND NOT strong THEN 'INLINE' ELSE 'SEMANTIC' END WHEN op THEN 'ARITH' ELSE 'CLEAN' END AS verdict, coalesce(why, []) AS why FROM p""")
def set_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two multisets of items a unit, compared kind by kind; items under 3 are weak calls."""
    kind = F.when(c("l_suppkey") % 4 == 1, "data").when(c("l_suppkey") % 4 == 2, "op").otherwise("call")
    f = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("unit"), (c("l_linenumber") % 2).alias("side"), kind.alias("kind"), (c("l_partkey") % 6).alias("item"))
    return D.set_verdicts(f.filter("side = 0"), f.filter("side = 1"), "unit", c("item") < 3, ["call", "data", "cmp"])


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
SELECT a.l_orderkey, a.k::INT AS k, CASE WHEN a.l_quantity = b.l_quantity AND a.l_suppkey % 3 = b.l_suppkey % 3 THEN 'exact' WHEN a.l_suppkey % 3 <> b.l_suppkey % 3 THEN 'frame' WHEN abs(a.l_quantity - b.l_quantity) < 10 THEN 'slots' ELSE 'other' END AS status
FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND a.k + 1 = b.k""")
def compared_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order with the next one."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("k"), c("l_quantity").alias("size"), (c("l_suppkey") % 3).alias("frame"))
    rules = [((c("a_size") == c("b_size")) & (c("a_frame") == c("b_frame")), "exact"), (c("a_frame") != c("b_frame"), "frame"), (F.abs(c("a_size") - c("b_size")) < 10, "slots")]
    return D.compared(lines, lines.withColumn("k", c("k") - 1), ["l_orderkey", "k"], rules, "other")


@query("""
WITH m AS (SELECT p_partkey AS id, string_split(p_name, ' ')[1] || p_type || string_split(p_name, ' ')[2] AS method, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[2] AS last, p_brand AS owner, p_size + 1000 * (p_partkey % 5) AS size FROM part), a AS (SELECT * FROM m)
SELECT a.id AS a, b.id AS b, CASE WHEN a.method = b.method AND a.owner = b.owner THEN '=' WHEN a.method = b.method THEN '~' ELSE '%' END AS tag FROM m a JOIN m b ON a.size = b.size AND a.id < b.id AND (a.method = b.method OR (a.owner = b.owner AND a.first = b.first AND a.last = b.last))""")
def sibling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same method, owner and size; other owners; other methods that begin and end alike."""
    words = F.split("p_name", " ")
    rows = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.concat(F.get(words, F.lit(0)), F.initcap(F.lower("p_type")), F.initcap(F.get(words, F.lit(1)))).alias("method"), c("p_brand").alias("owner"), (c("p_size") + 1000 * (c("p_partkey") % 5)).alias("size"))
    return D.sibling_candidates(rows)


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN 'm' || p_partkey ELSE NULL END AS method, CASE p_partkey % 5 WHEN 0 THEN 'Cls' || p_size WHEN 1 THEN 'Inner' || p_size WHEN 2 THEN 'Box' WHEN 3 THEN '' END AS class FROM part""")
def mangled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of a class, of a nested class, of a template, free functions, and plain names."""
    k, m, inner = c("p_partkey"), F.concat(F.lit("m"), c("p_partkey").cast("string")), F.concat(F.lit("Inner"), c("p_size").cast("string"))
    cls = F.concat(F.lit("Cls"), c("p_size").cast("string"))
    sized = lambda n: F.concat(F.length(n).cast("string"), n)
    forms = [F.concat(m, F.lit("__"), sized(cls), F.lit("Fv")), F.concat(m, F.lit("__Q25Outer"), sized(inner), F.lit("CFi")), F.concat(m, F.lit("__Q23Abc6Box<i>"), F.lit("Fv")), F.concat(m, F.lit("__FiPc")), F.concat(F.lit("plain"), k.cast("string"))]
    symbol = F.get(F.array(*forms), (k % 5).cast("int"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    # A file of a few bytes a row is one task's, whatever its rows take.
    parts = parts.repartition(1 + parts.count() // 50_000)
    return parts.select("p_partkey", S.mangled_key(symbol, "method").alias("method"), S.mangled_key(symbol, "class").alias("class"))


@query("""
WITH p AS (SELECT p_partkey, 'r' || p_partkey % 7 AS x, 's' || p_size % 5 AS y, p_size - 20 AS k, p_partkey % 9 - 4 AS m FROM part)
SELECT p_partkey, CASE WHEN k + m = 0 THEN 'add(' || array_to_string(list_sort([x, y]), ',') || ')' ELSE 'add(' || array_to_string(list_sort([x, y, 'c' || (k + m)]), ',') || ')' END AS total,
  'fmul(' || array_to_string(list_sort([x, 'fsub(' || y || ',' || x || ')']), ',') || ')' AS product, x AS twice FROM p""")
def canonical_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(r):
        x, y, k, m = f"r{r['p_partkey'] % 7}", f"s{r['p_size'] % 5}", f"c{r['p_size'] - 20}", f"c{r['p_partkey'] % 9 - 4}"
        total = T.canonical("add", x, k, T.canonical("add", m, y))
        return [(r["p_partkey"], total, T.canonical("fmul", T.canonical("fneg", T.canonical("fsub", x, y)), x), T.canonical("fneg", T.canonical("fneg", x)))]

    return _batches(spark, table(spark, sf_dir, "part").select("p_partkey", "p_size"), make, "p_partkey long, total string, product string, twice string")


@query("""
WITH s AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q, CASE l_partkey % 4 WHEN 0 THEN '$P' WHEN 1 THEN '$L' ELSE 'a' || l_partkey % 4 END AS x FROM lineitem),
t AS (SELECT o, n, p, s, q, CASE p % 3 WHEN 0 THEN 'g' || s || ' ( ' || x || ' , ' || q || '.50 , d ) ;' WHEN 1 THEN 'if ( ' || x || ' < 0x' || s || ' ) { ' || x || ' = m' || p || ' ; }' ELSE 'h ( ' || q || ' ) + k [ ' || x || ' ]' END AS line FROM s)
SELECT o AS l_orderkey, string_agg(line, ' ' ORDER BY n, p, s, q) AS normal FROM t GROUP BY o""")
def normal_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of code, a line a statement, in normal form: receivers, returns and number suffixes gone, names of parameters and locals replaced."""
    p, s, q, x = c("l_partkey"), c("l_suppkey").cast("string"), c("l_quantity").cast("long").cast("string"), F.concat(F.lit("a"), (c("l_partkey") % 4).cast("string"))
    name = p.cast("string")
    call = F.concat(F.lit("this->v"), name, F.lit("[2].g"), s, F.lit("("), x, F.lit(", "), q, F.lit(".50f, (b[c.e()]).d); // g(x)"))
    branch = F.concat(F.lit("if (p->"), x, F.lit(" < 0x"), s, F.lit("UL) { "), x, F.lit(" = f(1)->m"), name, F.lit("; }"))
    branch = F.replace(branch, F.concat(F.lit("p->"), x), x)
    back = F.concat(F.lit("return this->h("), q, F.lit(".0) + t.k["), x, F.lit("]; /* ; */"))
    line = F.when(p % 3 == 0, call).when(p % 3 == 1, branch).otherwise(back)
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", c("l_quantity").alias("q"), line.alias("line"))
    bodies = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("all"))
    bodies = bodies.select("l_orderkey", F.array_join(F.transform("all", lambda e: e["line"]), "\n").alias("text"), F.array(F.lit("a0")).alias("parameters"), F.array(F.lit("a1")).alias("locals"))
    return X.normal_forms(bodies, "l_orderkey", "text", "parameters", "locals", informative=False).select("l_orderkey", F.array_join("normal", " ").alias("normal"))


@query("""
WITH w AS (SELECT l_orderkey, list(l_partkey % 65536 ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, a[1:greatest(len(a) - 2, 0)] AS v FROM w)
SELECT l_orderkey, ((coalesce(list_sum(v), 0) % 65536)::BIGINT << 16) | (coalesce(list_sum([65535 - x FOR x IN v]), 0) % 65536)::BIGINT AS checksum FROM x""")
def checksum_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of the lines' words, the last four bytes, where the checksum itself stands, left out."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    words = F.transform(F.slice("l", F.lit(1), F.greatest(F.size("l") - 2, F.lit(0))), lambda x: x["l_partkey"] % 65536)
    return lines.select("l_orderkey", S.checksum16(words).alias("checksum"))


@query("""SELECT o_orderkey, coalesce(sum(l_quantity), 0)::BIGINT AS size FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <> 3 WHERE o_orderstatus <> 'P' GROUP BY o_orderkey""")
def registered_shape_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of polygons summed by registered object."""
    objects = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey")
    parts = table(spark, sf_dir, "lineitem").filter("l_linenumber <> 3").select(c("l_orderkey").alias("o_orderkey"), c("l_quantity").cast("long").alias("size"))
    return A.registered_sums(objects, parts, "o_orderkey", "size")


@query("""
WITH d AS (SELECT event_id, ('0x' || substr(md5(event_id::VARCHAR || '/3'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM events) SELECT event_id, u AS draw, round(-2 + u * 7, 9) AS ranged, (2 + floor(u * 5))::BIGINT AS whole FROM d""")
def uniform_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = S.hash_draw(c("event_id"), 3)
    return table(spark, sf_dir, "events").select("event_id", u.alias("draw"), F.round(S.uniform_in(u, -2.0, 5.0), 9).alias("ranged"), S.uniform_whole(u, 1, 6).alias("whole"))


@query("""
SELECT s_suppkey, list_transform(range(9, 15), lambda n: list_reduce(list_concat([(s_suppkey + 1) & 4294967295], range(n)), lambda x, y: x * 16807 % 2147483647)) AS numbers FROM supplier""")
def seeded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six numbers of each seed's generator."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.seeded_numbers(c("s_suppkey"), 6).alias("numbers"))


@query("""
WITH p AS (SELECT p_partkey, (p_partkey % 900 - 300)::DOUBLE AS a, (p_size * 17)::DOUBLE AS b FROM part)
SELECT p_partkey, CASE WHEN d >= 180 THEN d - 360 ELSE d END AS difference, ((a % 360) + 360) % 360 AS turned FROM (SELECT *, (((a - b) % 360) + 360) % 360 AS d FROM p)""")
def angle_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (c("p_partkey") % 900 - 300).cast("double"), (c("p_size") * 17).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", S.angle_difference(a, b).alias("difference"), S.wrap360(a).alias("turned"))


@query("""
WITH p AS (SELECT p_partkey, (p_partkey % 60 - 3)::DOUBLE AS now, (p_size - 25)::DOUBLE * 2 AS rate FROM part), n AS (SELECT *, now + rate AS later FROM p),
s AS (SELECT *, list_min([later + 10 * n FOR n IN range(20) IF later + 10 * n >= 5]) AS up, list_max([later - 30 * n FOR n IN range(20) IF later - 30 * n < 45]) AS down, greatest(CASE WHEN later >= 45 THEN 45 - 0.001 ELSE later END, 5) AS bounded FROM n)
SELECT p_partkey, CASE WHEN now < 5 THEN up <= 20 AND 20 < 15 WHEN now >= 45 THEN 15 <= 20 AND 20 < down WHEN later < 5 THEN (5 <= 20 AND 20 < now) OR (up <= 20 AND 20 < 15) WHEN later >= 45 THEN (now <= 20 AND 20 < 45) OR (15 <= 20 AND 20 < down)
    WHEN now <= later THEN now <= 20 AND 20 < later ELSE later <= 20 AND 20 < now END AS looped, CASE WHEN now <= bounded THEN now <= 20 AND 20 < bounded ELSE bounded <= 20 AND 20 < now END AS swung FROM s""")
def looped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does playback pass frame 20, looped over 5 to 45 with the loop at 15, and to and fro?"""
    now, rate = (c("p_partkey") % 60 - 3).cast("double"), (c("p_size") - 25).cast("double") * 2
    passed = lambda how: O.frame_passed_on(how, now, rate, 5.0, 45.0, 15.0, 20.0)
    return table(spark, sf_dir, "part").select("p_partkey", passed("loop").alias("looped"), passed("ping_pong").alias("swung"))


@query("""
WITH m AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'unsorted' WHEN 1 THEN 'bypass' ELSE 'immediate' END AS mode, p_size % 8 AS slot FROM part), a AS (SELECT *, CASE mode WHEN 'unsorted' THEN 0 WHEN 'immediate' THEN slot ELSE -1 END AS "at" FROM m)
SELECT p_partkey, "at"::INT AS "at", (row_number() OVER (PARTITION BY "at" ORDER BY CASE WHEN mode = 'bypass' THEN p_partkey ELSE -p_partkey END))::INT AS place,
  row_number() OVER (ORDER BY "at", CASE WHEN mode = 'bypass' THEN p_partkey ELSE -p_partkey END) AS head, row_number() OVER (ORDER BY "at" DESC, CASE WHEN mode = 'bypass' THEN p_partkey ELSE -p_partkey END) AS tail FROM a""")
def draw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsorted, immediate and bypassing packets, and their order from the first slot and from the last."""
    mode = F.when(c("p_partkey") % 4 == 0, "unsorted").when(c("p_partkey") % 4 == 1, "bypass").otherwise("immediate")
    placed = R.entered(table(spark, sf_dir, "part").select("p_partkey", mode.alias("mode"), (c("p_size") % 8).alias("slot")), "mode", "slot", "p_partkey")
    head = R.traversed(placed, "at", "place", tail=False).select("p_partkey", "at", "place", c("drawn").alias("head"))
    return head.join(R.traversed(placed, "at", "place", tail=True).select("p_partkey", c("drawn").alias("tail")), "p_partkey")
