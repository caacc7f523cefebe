"""Functions by name: the SQL surface of the scalar library, registered with a session."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: SQL functions, so that calls stay inside the JVM and are seen by the optimiser.
SQL_FUNCTIONS = {
    "ml_clamp": ("t DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN t > high THEN high WHEN t < low THEN low ELSE t END"),
    "ml_wrap": ("t DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN low >= high THEN low ELSE low + pmod(t - low, high - low) END"),
    "ml_bits": ("v BIGINT, mask BIGINT, shift INT", "BIGINT", "shiftrightunsigned(v & mask, shift)"),
    "ml_percent": ("v DOUBLE", "STRING", "format_string('%.2f', CASE WHEN v > 99.99 AND v < 100 THEN 99.99 ELSE v END)"),
    "ml_int": ("v STRING", "INT", "coalesce(try_cast(v AS INT), 0)"),
    "ml_float": ("v STRING", "DOUBLE", "coalesce(try_cast(v AS DOUBLE), 0.0D)"),
    "ml_int32": ("v BIGINT", "BIGINT", "pmod(v + 2147483648, 4294967296) - 2147483648"),
    "ml_add": ("a BIGINT, b BIGINT", "BIGINT", "pmod(a + b + 2147483648, 4294967296) - 2147483648"),
    "ml_mod": ("a BIGINT, b BIGINT", "BIGINT", "a - b * (a div nullif(b, 0))"),
    "ml_flag": ("v BIGINT, mask BIGINT", "BOOLEAN", "v & mask <> 0"),
    "ml_converge": ("now DOUBLE, target DOUBLE, up DOUBLE, down DOUBLE", "DOUBLE", "CASE WHEN now < target THEN least(now + up, target) WHEN now > target THEN greatest(now - down, target) ELSE now END"),
    "ml_wrap360": ("a DOUBLE", "DOUBLE", "pmod(a, 360.0D)"),
    "ml_angle_difference": ("a DOUBLE, b DOUBLE", "DOUBLE", "pmod(a - b + 180.0D, 360.0D) - 180.0D"),
    "ml_distance2": ("ax DOUBLE, ay DOUBLE, bx DOUBLE, b_y DOUBLE", "DOUBLE", "sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y))"),
    "ml_near": ("ax DOUBLE, ay DOUBLE, bx DOUBLE, b_y DOUBLE, reach DOUBLE", "BOOLEAN", "(ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y) <= reach * reach"),
    "ml_in_rect": ("x DOUBLE, y DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "BOOLEAN", "x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2"),
    "ml_cell": ("v DOUBLE, origin DOUBLE, size DOUBLE", "INT", "CAST((v - origin) / size AS INT)"),
    "ml_lerp": ("a DOUBLE, b DOUBLE, t DOUBLE", "DOUBLE", "a + t * (b - a)"),
    "ml_hermite": ("u DOUBLE, v0 DOUBLE, m0 DOUBLE, v1 DOUBLE, m1 DOUBLE", "DOUBLE", "v0 * (1 + u * u * (2 * u - 3)) + v1 * (u * u * (3 - 2 * u)) + m0 * u * (1 + u * (u - 2)) + m1 * u * u * (u - 1)"),
    "ml_contains": ("v STRING, part STRING", "BOOLEAN", "contains(lower(v), lower(part))"),
    "ml_leaf": ("path STRING", "STRING", "element_at(split(path, '/'), -1)"),
    "ml_draw_in": ("draw DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "low + draw * (high - low)"),
    "ml_masked": ("v STRING", "STRING", "md5(regexp_replace(v, '[0-9]+', 'X'))"),
}


def arity(name: str) -> int:
    return len(SQL_FUNCTIONS[name][0].split(","))


def call(name: str, *arguments: Column) -> Column:
    """A call with repaired arity: arguments too many are left out from the end, missing ones are 0. (In SQL text a wrong number is an analysis error.)"""
    n = arity(name)
    return F.call_function(name, *arguments[:n], *[F.lit(0)] * (n - len(arguments)))


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; an unknown name in a query is an analysis error, as is a wrong number of arguments."""
    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)
