"""Queries over script values and functions called by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import registry as R
from millrace.functions import scalar as S
from millrace.plans.base import query
from millrace.session import table

c = F.col

INT32 = "(((({0}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"


@query(f"""
WITH v AS (SELECT p_partkey, p_name, {INT32.format("p_partkey * 40503 * 65537")} AS a, p_size::BIGINT - 25 AS b, p_size % 8 AS n, p_retailprice AS r FROM part)
SELECT p_partkey, {INT32.format("a + 2000000000")} AS plus, {INT32.format("a - 2000000000")} AS minus, {INT32.format("a * b")} AS times,
  CASE WHEN b <> 0 THEN {INT32.format("trunc(a / nullif(b, 0)::DOUBLE)::BIGINT")} END AS quotient, CASE WHEN b <> 0 THEN a - b * trunc(a / nullif(b, 0)::DOUBLE)::BIGINT END AS remainder,
  CASE WHEN b <> 0 THEN trunc(r)::BIGINT - b * trunc(trunc(r) / nullif(b, 0))::BIGINT END AS float_remainder, a * 0.5::DOUBLE AS half, a::DOUBLE AS text_plus,
  a & 255 AS low_bits, a | b AS either, {INT32.format("a * (1 << n)")} AS up, floor(a / (1 << n)::DOUBLE)::BIGINT AS down FROM v""")
def script_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers wrap at 32 bits; a remainder is of whole parts; bits and shifts."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", S.int32(c("p_partkey") * 40503 * 65537).alias("a"), (c("p_size").cast("long") - 25).alias("b"), (c("p_size") % 8).alias("n"), "p_retailprice")
    a, b, n = ((c(k), "int") for k in "abn")
    return p.select(
        "p_partkey", S.script_arith("+", *a, F.lit(2_000_000_000), "int")[0].alias("plus"), S.script_arith("-", *a, F.lit(2_000_000_000), "int")[0].alias("minus"), S.script_arith("*", *a, *b)[0].alias("times"),
        S.script_arith("/", *a, *b)[0].alias("quotient"), S.script_arith("%", *a, *b)[0].alias("remainder"), S.script_arith("%", c("p_retailprice"), "float", *b)[0].alias("float_remainder"),
        S.script_arith("*", *a, F.lit(0.5), "float")[0].alias("half"), S.script_arith("+", c("p_name"), "string", c("a").cast("double"), "float")[0].alias("text_plus"),
        S.script_bits("&", *a, F.lit(255), "int").alias("low_bits"), S.script_bits("|", *a, *b).alias("either"), S.script_bits("<<", *a, *n).alias("up"), S.script_bits(">>", *a, *n).alias("down"),
    )


@query(f"""
WITH v AS (SELECT p_partkey, p_name, p_retailprice, {INT32.format("p_partkey * 40503 * 65537")} AS a, p_size % 3 AS b FROM part)
SELECT p_partkey, (a % 2 <> 0 AND b <> 0)::INT AS both, (a % 2 <> 0 OR b <> 0)::INT AS either, (b = 0)::INT AS neither, {INT32.format("-a")} AS negated, -p_retailprice AS negated_float, p_name AS negated_text,
  0 AS int_kind, 1 AS float_kind, 2 AS text_kind FROM v""")
def script_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = S.int32(c("p_partkey") * 40503 * 65537), c("p_size") % 3
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.script_logic("and", S.script_int(a, "int") % 2, b).alias("both"), S.script_logic("or", S.script_int(a, "int") % 2, b).alias("either"), S.script_logic("not", b).alias("neither"),
        S.script_negate(a, "int").alias("negated"), S.script_negate(c("p_retailprice"), "float").alias("negated_float"), S.script_negate(c("p_name"), "string").alias("negated_text"),
        S.script_typeof("int").alias("int_kind"), S.script_typeof("float").alias("float_kind"), S.script_typeof("string").alias("text_kind"),
    )


@query("""
SELECT p_partkey, (p_partkey & 240) AS missing_shift, 0.0::DOUBLE AS no_arguments, least(p_size, 30)::DOUBLE AS extra, p_size::DOUBLE AS folded, 0 AS folded_kind FROM part""")
def repaired_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with too few and too many arguments."""
    R.register(spark)
    (value, kind), *rest = S.repaired([(c("p_size"), "int"), (c("p_name"), "string"), (F.lit(1.5), "float")], 1)
    padded = S.repaired([(c("p_size"), "int")], 2)
    return table(spark, sf_dir, "part").select(
        "p_partkey", R.call("ml_bits", c("p_partkey"), F.lit(240)).alias("missing_shift"), R.call("ml_clamp").alias("no_arguments"), R.call("ml_clamp", c("p_size"), F.lit(0), F.lit(30), c("p_name")).alias("extra"),
        S.script_arith("+", value, kind, *padded[1])[0].cast("double").alias("folded"), padded[1][0].alias("folded_kind"),
    )


@query("""
WITH p AS (SELECT p_partkey, p_name, p_type, p_size::DOUBLE AS s, (p_partkey % 37)::DOUBLE AS k, p_partkey FROM part)
SELECT p_partkey, CASE WHEN s < 20 THEN least(s + 3, 20.0::DOUBLE) WHEN s > 20 THEN greatest(s - 2, 20.0::DOUBLE) ELSE s END AS converged, ((k * 50 - 100) % 360 + 360) % 360 AS turned, ((s - k * 20 + 180) % 360 + 360) % 360 - 180 AS turn,
  round(sqrt((s - 20)**2 + (k - 9)**2), 6) AS away, (s - 20)**2 + (k - 9)**2 <= 100 AS near, s BETWEEN 5 AND 30 AND k BETWEEN 3 AND 20 AS inside, trunc((s - 5) / 4)::INT AS cell, 5 + (s / 50) * 20 AS blended,
  contains(lower(p_name), 'ring') AS has_ring, md5(regexp_replace(p_type || p_partkey, '[0-9]+', 'X', 'g')) AS masked, p_partkey - 7 * trunc(p_partkey / 7.0::DOUBLE)::BIGINT AS modulo, coalesce(try_cast(p_name AS DOUBLE), 0.0::DOUBLE) AS number FROM p""")
def domain_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions called by name in SQL text."""
    R.register(spark)
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_type", "CAST(p_size AS DOUBLE) AS s", "CAST(p_partkey % 37 AS DOUBLE) AS k")
    return p.selectExpr(
        "p_partkey", "ml_converge(s, 20, 3, 2) AS converged", "ml_wrap360(k * 50 - 100) AS turned", "ml_angle_difference(s, k * 20) AS turn", "round(ml_distance2(s, k, 20, 9), 6) AS away", "ml_near(s, k, 20, 9, 10) AS near",
        "ml_in_rect(s, k, 5, 3, 30, 20) AS inside", "ml_cell(s, 5, 4) AS cell", "ml_lerp(5, 25, s / 50) AS blended", "ml_contains(p_name, 'RING') AS has_ring", "ml_masked(p_type || p_partkey) AS masked", "ml_mod(p_partkey, 7) AS modulo", "ml_float(p_name) AS number",
    )


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 END AS kind FROM events""")
def value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each value of a column that holds whole numbers, fractions, texts and nothing."""
    i = c("event_id")
    forms = F.when(i % 5 == 0, i.cast("string")).when(i % 5 == 1, F.concat(i.cast("string"), F.lit(".5"))).when(i % 5 == 2, F.concat(F.lit('"'), c("event_type"), F.lit('"'))).when(i % 5 == 3, F.get_json_object("props", "$.k")).otherwise(F.lit("null"))
    return table(spark, sf_dir, "events").select("event_id", S.script_kind_of(F.parse_json(forms)).alias("kind"))
