"""Queries over sources and sinks: tables are written in a format below the shared folder and read back from it."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.base import query
from millrace.session import place, ship, table
from millrace.sources import archive, binary, logs, packed

c = F.col


@query("""SELECT p_brand AS unit, p_size > 1 AS complete, p_type AS category, p_name AS function, p_size::BIGINT AS size, p_size * 2.0::DOUBLE AS fuzzy FROM part""")
def report_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON reports, one a part and line, with numbers as texts."""
    p = table(spark, sf_dir, "part")
    function = F.struct(c("p_name").alias("name"), c("p_size").cast("string").alias("size"), (c("p_size") * 2.0).alias("fuzzy_match_percent"))
    meta = F.struct(F.array("p_type").alias("progress_categories"), (c("p_size") > 1).alias("complete"))
    path = place(spark, "report")
    p.select(F.array(F.struct(c("p_brand").alias("name"), meta.alias("metadata"), F.array(function).alias("functions"))).alias("units")).write.json(path)
    return logs.report_functions(spark, path, one_a_file=False)


@query("""SELECT replace(r_name, ' ', '_') AS section, 'n' || n_nationkey AS symbol, (n_nationkey * 16 + 4)::BIGINT AS size, n_nationkey % 3 <> 0 AS live FROM nation JOIN region ON n_regionkey = r_regionkey""")
def link_map_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linker maps, a file a region, each with its section's heading first."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey"))
    mark = F.when(c("n_nationkey") % 3 == 0, "UNUSED  ").otherwise(F.format_string("%08x", c("n_nationkey")))
    line = F.format_string("  %s %06x %08x  4 n%d \tobj.o", mark, c("n_nationkey") * 16 + 4, c("n_nationkey") * 256, c("n_nationkey"))
    files = n.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("rows"))
    path = place(spark, "maps")
    files.select("r_name", F.concat(F.replace(c("r_name"), F.lit(" "), F.lit("_")), F.lit(" section layout\n"), c("rows")).alias("value")).repartition(5, "r_name").write.partitionBy("r_name").text(path)
    return logs.map_rows(spark, f"{path}/*").select("section", "symbol", "size", "live")


@query("""SELECT date_trunc('hour', ts) AS hour, sum(event_id % 100)::BIGINT AS tokens FROM events GROUP BY 1""")
def usage_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event logs as JSON lines; lines of other kinds count nothing."""
    e = table(spark, sf_dir, "events")
    stamp = F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    path = place(spark, "usage")
    e.select(F.lit("assistant").alias("type"), stamp, F.struct(F.struct((c("event_id") % 100).alias("output_tokens")).alias("usage")).alias("message")).write.json(path)
    return logs.token_usage(spark, path).select(c("hour").cast("timestamp_ntz").alias("hour"), "tokens")


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer""")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "tsv")
    logs.write_tsv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return logs.read_tsv(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("""SELECT 's' || s_suppkey AS symbol, CASE WHEN s_suppkey % 2 = 0 THEN 'T' ELSE 'W' END AS kind, (s_suppkey * 8)::BIGINT AS size FROM supplier""")
def symbol_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = c("s_suppkey")
    path = place(spark, "symbols")
    table(spark, sf_dir, "supplier").select(F.format_string("%08x %08x %s s%d", s * 64, s * 8, F.when(s % 2 == 0, "T").otherwise("W"), s)).write.text(path)
    return logs.symbol_rows(spark, path).select("symbol", "kind", "size")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE n_nationkey + 100 END AS id FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files in their regions' folders, looked up in other letters; every fifth path ends at the folder."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    folders = r.select(c("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), c("r_name").alias("name"), F.lit(False).alias("is_file"), F.lit("").alias("type"))
    files = n.select((c("n_nationkey") + 100).cast("long").alias("id"), c("n_regionkey").cast("long").alias("parent"), c("n_name").alias("name"), F.lit(True).alias("is_file"), F.lit("BIN").alias("type"))
    full = n.join(r, c("n_regionkey") == c("r_regionkey")).select("n_nationkey", F.lower("r_name").alias("folder"), F.upper("n_name").alias("file"))
    paths = table(spark, sf_dir, "customer").join(full, c("c_nationkey") == c("n_nationkey"))
    paths = paths.select("c_custkey", F.when(c("c_custkey") % 5 == 0, F.concat(F.lit("/"), c("folder"))).otherwise(F.concat_ws("/", F.lit(""), "folder", "file")).alias("path"))
    found = archive.resolve(folders.unionAll(files), paths.select("path").distinct(), "path")
    return paths.join(found, "path").select("c_custkey", "id")


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS plain, 'Yaz0' AS codec FROM documents""")
def block_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts compressed to blocks and decompressed, whole."""
    ship(spark)

    def run(batches):
        import hashlib

        for b in batches:
            blocks = [binary.compress_literal((t or "").encode()) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "plain": [hashlib.sha256(binary.decompress(x)).hexdigest() for x in blocks], "codec": [binary.codec_of(x) for x in blocks]})

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, plain string, codec string")


@query("""
SELECT '/' || n_name AS path, 'Group' AS type, n_nationkey::BIGINT AS key, NULL::BIGINT AS cust, NULL::DOUBLE AS balance FROM (SELECT DISTINCT n_name, n_nationkey, c_custkey // 2000 FROM nation JOIN customer ON c_nationkey = n_nationkey)
UNION ALL SELECT '/' || n_name || '/' || c_name, 'Leaf', c_custkey % 65536, c_custkey, round(c_acctbal::FLOAT::DOUBLE, 2) FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def scene_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged record trees, a file for each nation and 2,000 keys with its customers as leaves, and a record of an unknown type in each that is passed over."""
    packed.register(spark)
    text = lambda s: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(s)), 4, "0")), s.cast("binary"))

    def record(kind: str, name, key, body):
        tail = F.concat(text(F.lit(kind)), text(name), body)
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(tail) + 6), 8, "0")), F.unhex(F.lpad(F.hex(key), 4, "0")), tail)

    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey"))
    number = F.unhex(F.lpad(F.hex("c_custkey"), 16, "0"))
    leaves = customers.select("n_nationkey", "n_name", F.floor(c("c_custkey") / 2000).alias("piece"), record("Leaf", c("c_name"), c("c_custkey") % 65536, F.concat(number, text(F.round(c("c_acctbal").cast("float").cast("double"), 2).cast("string")))).alias("leaf"))
    odd = record("Odd", F.lit("?"), F.lit(0), F.lit(bytes(11)))
    files = leaves.groupBy("n_nationkey", "n_name", "piece").agg(F.count("*").alias("n"), F.collect_list("leaf").alias("all"))
    joined = F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x))
    content = record("Group", c("n_name"), c("n_nationkey"), F.concat(F.unhex(F.lpad(F.hex(c("n") + 1), 8, "0")), odd, joined))
    path = place(spark, "scenes")
    files.select(F.format_string("%d-%d.scn", c("n_nationkey"), c("piece")).alias("name"), content.alias("content")).write.format("byte_files").option("path", path).mode("append").save()
    found = spark.read.format("scene_tree").option("path", path).option("groups", "Group").option("types", "Leaf: q cust, text balance").load()
    return found.select("path", "type", c("key").cast("long").alias("key"), c("props")["cust"].cast("long").alias("cust"), c("props")["balance"].cast("double").alias("balance"))


@query("""
SELECT user_id, count(*)::BIGINT AS saves, count(*) FILTER (event_id % 512 < 120)::BIGINT AS low FROM (SELECT DISTINCT user_id, event_id % 512 AS event_id FROM events) GROUP BY user_id""")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot a user, its derived count made anew on reading."""
    ship(spark)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        on = set((g["event_id"] % 512).tolist())
        raw = binary.snapshot_bytes(0, len(on) - 1, 0, [i in on for i in range(512)], [])
        back = binary.read_snapshot(raw)
        return pd.DataFrame({"user_id": [g["user_id"].iloc[0]], "saves": [back["saves"]], "low": [back["shines"]]})

    return table(spark, sf_dir, "events").select("user_id", "event_id").groupBy("user_id").applyInPandas(run, "user_id long, saves long, low long")


def _batches(spark: SparkSession, df: DataFrame, make, schema: str) -> DataFrame:
    """What make(row dict) gives (a list of tuples) for each row."""
    ship(spark)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for b in batches:
            yield pd.DataFrame([t for r in b.to_dict("records") for t in make(r)], columns=names)

    return df.mapInPandas(run, schema)


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS plain, 'Yay0' AS codec, octet_length(encode(coalesce(text, ''))) > 1000 AS smaller FROM documents""")
def split_block_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts compressed to blocks of three tables and decompressed, whole; long ones get smaller."""
    import hashlib

    def make(r):
        plain = (r["text"] or "").encode()
        block = binary.compress_split(plain)
        return [(r["doc_id"], hashlib.sha256(binary.decompress(block)).hexdigest(), binary.codec_of(block), len(plain) > 1000 and len(block) < len(plain))]

    return _batches(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), make, "doc_id long, plain string, codec string, smaller boolean")


@query("""SELECT p_partkey, p_name AS name, p_size AS size, p_retailprice::FLOAT::DOUBLE AS price, p_size AS peeked, -p_size AS again, left(p_name, 3) AS short, TRUE AS ended FROM part""")
def typed_stream_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed writes with padding, read back with skips, alignment, peeks and seeks; a read past the end is marked."""
    import struct as layout

    def make(r):
        out = binary.Writer().number("I", r["p_partkey"]).text(r["p_name"]).align(4, 0xFF).number("h", r["p_size"]).skip(5, 7).number("i", -r["p_size"]).number("f", r["p_retailprice"]).text(r["p_name"])
        cur = binary.Cursor(bytes(out.data))
        key, name = cur.number("I"), cur.text()
        cur.align(4)
        peeked = layout.unpack(">h", cur.peek(2))[0]
        size = cur.number("h")
        cur.skip(5)
        at = cur.at
        cur.seek(cur.at + 4)
        price, short = cur.number("f"), cur.text(4)
        cur.raw(1)
        ended = cur.ended
        cur.seek(at)
        return [(key, name, size, price, peeked, cur.number("i"), short, ended and not cur.ended)]

    return _batches(spark, table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), make, "p_partkey long, name string, size int, price double, peeked int, again int, short string, ended boolean")


@query("""SELECT p_brand AS brand, p_partkey AS id, p_size AS size FROM part""")
def fixed_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted arrays of records of one type, one a brand."""
    ship(spark)

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        bodies = [bytes(binary.Writer().number("I", int(k)).number("i", int(s)).data) for k, s in zip(g["id"], g["size"], strict=True)]
        return pd.DataFrame({"brand": [g["brand"].iloc[0]], "content": [binary.array_bytes(bodies)]})

    packed = table(spark, sf_dir, "part").select(c("p_brand").alias("brand"), c("p_partkey").alias("id"), c("p_size").alias("size")).groupBy("brand").applyInPandas(pack, "brand string, content binary")
    body = lambda cur: {"id": cur.number("I"), "size": cur.number("i")}
    return _batches(spark, packed, lambda r: [(r["brand"], x["id"], x["size"]) for x in binary.array_rows(bytes(r["content"]), body)], "brand string, id long, size int")


@query("""
WITH m AS (SELECT n_regionkey AS region, n_name AS text, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS id FROM nation) SELECT region, id::INT AS id, text, (coalesce(sum(length(text) + 1) OVER (PARTITION BY region ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS "offset" FROM m""")
def message_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message tables of tagged blocks, one a region."""
    texts = table(spark, sf_dir, "nation").groupBy(c("n_regionkey").alias("region")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("texts"))
    return _batches(spark, texts, lambda r: [(r["region"], m["id"], m["text"], m["offset"]) for m in binary.message_rows(binary.message_bytes(list(r["texts"])))], "region int, id int, text string, offset int")


@query("""SELECT 'r=' || r_regionkey AS folder, count(*) AS files, sum(length(n_name) + 1)::BIGINT AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder with their lengths: one a nation, in its region's folder."""
    n = table(spark, sf_dir, "nation")
    path = place(spark, "listing")
    n.repartition(25, "n_nationkey").select(c("n_name").alias("value"), c("n_regionkey").alias("r"), c("n_nationkey").alias("n")).write.partitionBy("r", "n").text(path)
    found = archive.listing(spark, path).filter(c("name").startswith("part-"))
    return found.groupBy(F.regexp_extract("path", "/(r=[0-9]+)/", 1).alias("folder")).agg(F.count("name").alias("files"), F.sum("length").alias("bytes"))


@query("""
WITH e AS (SELECT s_suppkey AS slot, s_suppkey * 7 % 150 AS id, 'f' || s_nationkey AS name, 'T' || s_suppkey % 6 AS type, s_suppkey // 2 * 64 AS pointer FROM supplier), w AS (SELECT DISTINCT p_partkey % 160 AS k FROM part),
d AS (SELECT k, (SELECT slot FROM e WHERE slot = k AND id = k) AS own, (SELECT min(slot) FROM e WHERE id = k) AS scan, (SELECT min(slot) FROM e WHERE name = 'f' || k) AS named, (SELECT min(slot) FROM e WHERE type = 'T' || k) AS typed, (SELECT slot FROM e WHERE slot = k) AS placed, (SELECT min(slot) FROM e WHERE pointer = k * 64) AS pointed FROM w)
SELECT k, coalesce(own, scan) AS by_id, named AS by_name, typed AS by_type, placed AS by_index, pointed AS by_pointer FROM d""")
def archive_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by id (its own slot first), name, type, index and the address of their data, at which several may stand."""
    s = c("s_suppkey")
    e = table(spark, sf_dir, "supplier").select(s.alias("slot"), (s * 7 % 150).alias("id"), F.concat(F.lit("f"), c("s_nationkey").cast("string")).alias("name"), F.concat(F.lit("T"), (s % 6).cast("string")).alias("type"), s.alias("index"), (F.floor(s / 2) * 64).alias("pointer"))
    w = table(spark, sf_dir, "part").select((c("p_partkey") % 160).alias("k")).distinct()
    w = w.select("k", c("k").alias("id"), F.concat(F.lit("f"), c("k").cast("string")).alias("name"), F.concat(F.lit("T"), c("k").cast("string")).alias("type"), c("k").alias("index"), (c("k") * 64).alias("pointer"))
    for by in ("id", "name", "type", "index", "pointer"):
        w = w.join(archive.lookup(e, w, by, direct=by == "id").withColumnRenamed("slot", f"by_{by}"), by, "left")
    return w.select("k", "by_id", "by_name", "by_type", "by_index", "by_pointer")


@query("""
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN c_nationkey + 100 WHEN 2 THEN c_nationkey + 100 WHEN 3 THEN n_regionkey WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE c_nationkey + 100 END::BIGINT AS id FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with '.' and '..', in any letters, ten levels deep, past the root, at a folder, missing, and behind a file."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    folders = r.select(c("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), c("r_name").alias("name"), F.lit(False).alias("is_file"))
    files = n.select((c("n_nationkey") + 100).cast("long").alias("id"), c("n_regionkey").cast("long").alias("parent"), c("n_name").alias("name"), F.lit(True).alias("is_file"))
    full = table(spark, sf_dir, "customer").join(n, c("c_nationkey") == c("n_nationkey")).join(r, c("n_regionkey") == c("r_regionkey"))
    a, b = F.lower("r_name"), F.upper("n_name")
    forms = [
        F.concat(a, F.lit("/none/../"), b), F.concat(F.lit("./"), a, F.lit("/./"), b), F.concat(F.lit("../../"), a, F.lit("/"), b), F.concat(a, F.lit("/"), b, F.lit("/..")), F.concat(a, F.lit("/"), b, F.lit("/more")), F.lit("/"),
        F.concat(*[x for _ in range(4) for x in (a, F.lit("/../"))], a, F.lit("/"), b, F.lit("/../"), b),
    ]
    paths = full.select("c_custkey", F.get(F.array(*forms), (c("c_custkey") % 7).cast("int")).alias("path"))
    found = archive.resolve(folders.unionAll(files), paths.select("path").distinct(), "path", folders=True)
    return paths.join(found, "path").select("c_custkey", "id")


@query("""SELECT s_suppkey, s_name, s_acctbal FROM supplier""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "json")
    logs.write_json(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return spark.read.schema("s_suppkey long, s_name string, s_acctbal double").json(path)


@query("""
SELECT 0 AS line, '| n_name | customers |' AS text UNION ALL SELECT 1, '|-|-|' UNION ALL
SELECT (1 + row_number() OVER (ORDER BY n DESC, n_name))::INT, '| ' || n_name || ' | ' || n || ' |' FROM (SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, n_name LIMIT 10)""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten first rows of a report as lines of a Markdown table."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))
    lines = logs.markdown_table(n.orderBy(F.desc("customers"), "n_name"), 10).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


@query("""SELECT date_trunc('hour', ts) AS hour, sum(event_id % 100)::BIGINT AS tokens, count(DISTINCT user_id % 3) AS files FROM events GROUP BY 1""")
def usage_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event logs in three files: tokens and distinct files of each hour."""
    e = table(spark, sf_dir, "events")
    stamp = F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    path = place(spark, "usage-files")
    e.select((c("user_id") % 3).alias("agent"), F.lit("assistant").alias("type"), stamp, F.struct(F.struct((c("event_id") % 100).alias("output_tokens")).alias("usage")).alias("message")).repartition(3, "agent").write.partitionBy("agent").json(path)
    return logs.token_usage(spark, f"{path}/*/*.json").select(c("hour").cast("timestamp_ntz").alias("hour"), "tokens", "files")
