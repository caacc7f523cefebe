"""Text, JSON and TSV sources and sinks: linker maps, symbol lists, reports, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

REPORT_MEASURES = "struct<fuzzy_match_percent:double,total_code:string,matched_code:string,matched_code_percent:double,total_data:string,matched_data:string,matched_data_percent:double,total_functions:int,matched_functions:int,complete_code:string,complete_code_percent:double,complete_data:string,total_units:int,complete_units:int>"
REPORT = f"""measures {REPORT_MEASURES}, categories array<struct<id:string,name:string,measures:{REPORT_MEASURES}>>,
units array<struct<name:string,measures:{REPORT_MEASURES},metadata:struct<source_path:string,progress_categories:array<string>,complete:boolean>,
functions:array<struct<name:string,size:string,fuzzy_match_percent:double,metadata:struct<demangled_name:string,virtual_address:string>>>,
sections:array<struct<name:string,size:string,fuzzy_match_percent:double>>>>"""


def report_functions(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """(unit, complete, category, function, size, fuzzy) of nested reports, one a file or one a line; digit texts become numbers, a missing measure 0."""
    units = spark.read.schema(REPORT).option("multiLine", str(one_a_file).lower()).json(path).select(F.explode("units").alias("u"))
    f = units.select("u.name", "u.metadata", F.explode_outer("u.functions").alias("f"))
    return f.select(F.col("name").alias("unit"), F.coalesce("metadata.complete", F.lit(False)).alias("complete"), F.get("metadata.progress_categories", F.lit(0)).alias("category"), F.col("f.name").alias("function"), F.coalesce(F.col("f.size").try_cast("bigint"), F.lit(0)).alias("size"), F.coalesce("f.fuzzy_match_percent", F.lit(0.0)).alias("fuzzy"))


def map_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, section, symbol, size, address, object, live) of linker maps. A section's heading holds for the lines below it in its file."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    w = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    raw = raw.withColumn("section", F.last(F.nullif(F.regexp_extract("value", r"^(\S+) section layout", 1), F.lit("")), ignorenulls=True).over(w))
    row = r"^\s+(UNUSED|[0-9a-f]+)\s+([0-9a-f]{6,})\s+(\S+)?\s*\d*\s+(\S+)\s+\t?(\S+)\s*$"
    x = lambda i: F.regexp_extract("value", row, i)
    got = raw.filter(F.col("value").rlike(row)).select("file", "line", "section", x(4).alias("symbol"), F.conv(x(2), 16, 10).cast("bigint").alias("size"), F.when(F.rlike(x(3), F.lit("^[0-9a-f]+$")), F.conv(x(3), 16, 10).cast("bigint")).alias("address"), x(5).alias("object"), (x(1) != "UNUSED").alias("live"))
    return got


def symbol_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, symbol, kind, size) of symbol lists with address, size, kind and name a line."""
    row = r"^([0-9a-fA-F]+)\s+([0-9a-fA-F]+)\s+([A-Za-z])\s+(\S+)$"
    x = lambda i: F.regexp_extract("value", row, i)
    return spark.read.text(path).filter(F.col("value").rlike(row)).select(F.input_file_name().alias("file"), x(4).alias("symbol"), x(3).alias("kind"), F.conv(x(2), 16, 10).cast("bigint").alias("size"))


def token_usage(spark: SparkSession, path: str) -> DataFrame:
    """(hour, tokens, files) of event logs, one JSON a line; lines without usage count nothing, broken lines are passed over."""
    schema = "type string, timestamp string, message struct<usage:struct<output_tokens:bigint,input_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>>"
    e = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())
    e = e.select("file", F.date_trunc("hour", F.try_to_timestamp("timestamp")).alias("hour"), F.col("message.usage.output_tokens").alias("n")).filter("hour IS NOT NULL")
    return e.groupBy("hour").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.countDistinct("file").alias("files"))


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", str(header).lower()).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", str(header).lower()).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_table(df: DataFrame, limit: int) -> str:
    """The first rows of a report as a Markdown table; a report is small, so it is made on the driver."""
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in cells) + " |"
    return "\n".join([line(df.columns), "|" + "-|" * len(df.columns), *(line(r) for r in rows)])


def layered_params(local: DataFrame, common: DataFrame, wanted: DataFrame) -> DataFrame:
    """(scope, name, value) of wanted names: a scope that has a local file takes it whole, without falling back name by name; others take the common one."""
    own = local.select("scope").distinct().withColumn("__own", F.lit(True))
    w = wanted.join(own, "scope", "left")
    a = w.filter("__own").select("scope", "name").join(local, ["scope", "name"], "left").select("scope", "name", "value")
    b = w.filter("__own IS NULL").select("scope", "name").join(common.select("name", "value"), "name", "left").select("scope", "name", "value")
    return a.unionAll(b)
