"""Golden values of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalar as S


@pytest.fixture(scope="module")
def value(spark):
    def one(*columns):
        got = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
        return got[0] if len(got) == 1 else tuple(got)

    return one


def test_ranges(value):
    assert value(S.wrap(370, 0, 360), S.wrap(-10, 0, 360), S.wrap(5, 5, 5)) == (10, 350, 5)
    assert value(S.clamp(5, 0, 3), S.clamp(-1, 0, 3), S.clamp(2, 5, 1)) == (3, 0, 1)
    assert value(S.converge(0, 10, 3, 4), S.converge(9, 10, 3, 4), S.converge(20, 10, 3, 4), S.converge(11, 10, 3, 4)) == (3, 10, 16, 10)
    assert value(S.angle_difference(350, 10), S.angle_difference(10, 350), S.wrap360(-90.0)) == (-20, 20, 270)


def test_angles_and_vectors(value):
    assert value(S.atan_turns(1.0, 0.0), S.atan_turns(0.0, 1.0), S.atan_turns(-1.0, 0.0), S.atan_turns(0.0, -1.0)) == (0, 16384, -32768, -16384)
    assert value(S.distance([0, 0, 0], [1, 2, 2]), S.angle_between([1, 0, 0], [0, 1, 0])) == (3, pytest.approx(math.pi / 2))
    q = [value(c) for c in S.quaternion(90, 0, 0)]
    assert q == pytest.approx([math.sqrt(0.5), 0, 0, math.sqrt(0.5)])
    assert [value(c) for c in S.quaternion_blend([0, 0, 0, 1.0], [0, 0, 0, -1.0], 0.5)] == pytest.approx([0, 0, 0, 1])
    assert [value(c) for c in S.rotation_of_axis(0.0, 2.0, 0.0)][0] == -90


def test_hermite_passes_its_points(value):
    assert value(S.hermite(2.0, 2.0, 5.0, 1.0, 4.0, 9.0, -1.0), S.hermite(4.0, 2.0, 5.0, 1.0, 4.0, 9.0, -1.0)) == (5, 9)


def test_formats_and_hashes(value):
    assert value(S.percent(99.995), S.percent(100.0), S.percent(99.5)) == ("99.99", "100.00", "99.50")
    assert value(S.name_hash(F.lit("ab"))) == ord("a") * 3 + ord("b")
    assert value(S.path_parts(F.lit("/A//b/C"))) == ["a", "b", "c"]
    assert value(S.digits_to_long(F.lit("042")), S.digits_to_long(F.lit("4x"))) == (42, None)


def test_predicates_at_their_edges(value):
    assert value(S.cylinders_meet([0, 0, 0], 1, 1, [2, 0, 0], 1, 1), S.cylinders_meet([0, 0, 0], 1, 1, [1.99, 0, 0], 1, 1)) == (False, True)
    assert value(S.cylinders_meet([0, 0, 0], 1, 1, [1, 1, 0], 1, 1)) is True
    assert value(S.in_cylinder([1, 0, 0], [0, 0, 0], 1, 2)) is True
    assert value(S.in_box([1, 0.5, 0], [0, 0, 0], [0, 0, 0], [2, 1, 2]), S.in_box([0.99, 0.5, 0], [0, 0, 0], [0, 0, 0], [2, 1, 2])) == (False, True)
    assert value(S.segments_cross([0, 0], [2, 2], [0, 2], [2, 0]), S.segments_cross([0, 0], [1, 1], [2, 0], [3, 1])) == (True, False)


def test_script_values(value):
    assert value(S.script_arith("+", F.lit("x"), "string", F.lit(1), "int")[0], S.script_arith("/", F.lit(7), "int", F.lit(2), "int")[0], S.script_arith("/", F.lit(7), "int", F.lit(2.0), "float")[0]) == (1, 3, 3.5)
    assert value(S.script_arith("/", F.lit(-7), "int", F.lit(2), "int")[0], S.script_arith("%", F.lit(-7), "int", F.lit(2), "int")[0], S.script_arith("/", F.lit(1), "int", F.lit(0), "int")[0]) == (-3, -1, None)
    assert value(S.script_compare("<", F.lit("a"), "string", F.lit("b"), "string"), S.script_compare("==", F.lit("a"), "string", F.lit("a"), "string")) == (False, True)
    assert value(S.script_int(F.lit(-2.7), "float"), S.script_text(F.lit(3), "int")) == (-2, "")
    assert value(S.bit_field(F.lit(0b110100), 0b111000, 3), S.bit_flag(F.lit(8), 7)) == (0b110, False)
    assert value(S.checksum16(F.array(F.lit(1), F.lit(2)))) == (3 << 16) | (65536 * 2 - 2 - 3) % 65536


def test_mangled_keys_of_long_symbols_take_no_square_of_their_length(spark):
    import time

    long = "_" * 30_000
    forms = {"run__3CarFv": ("run", "Car"), "a__b__Q25Outer5InnerFi": ("a__b", "Inner"), "go__Q23Abc6Box<i>Fv": ("go", "Box"), "f__FiPc": ("f", ""), "plain": (None, None), "__F": (None, None), "_1__2__3Abc": ("_1", "__"), "é__3Car": (None, None), long: (None, None), long + "3Car": (long[:-2], "Car")}
    df = spark.createDataFrame([(f,) for f in forms], "s string")
    began = time.monotonic()
    got = {r["s"]: (r["method"], r["class"]) for r in df.select("s", *(S.mangled_key(F.col("s"), p).alias(p) for p in ("method", "class"))).collect()}
    assert got == forms and time.monotonic() - began < 20
