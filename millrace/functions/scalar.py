"""Scalar functions over Columns: ranges, angles, vectors, interpolation, bit fields, hashes, formats, script values.

Everything is computed in double precision inside the JVM. Angles in 16 bits count 65536 to the turn.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TURN = 65536.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def wrap(t, low, high) -> Column:
    """t moved by whole widths into [low, high); low where the range is empty."""
    t, low, high = _c(t), _c(low), _c(high)
    width = F.nullif(F.greatest(high - low, F.lit(0)), F.lit(0))
    return F.when(low >= high, low).otherwise(low + F.pmod(t - low, width))


def clamp(t, low, high) -> Column:
    """t within [low, high]; the upper end is tested first, so it wins where the ends cross."""
    t, low, high = _c(t), _c(low), _c(high)
    return F.when(t > high, high).when(t < low, low).otherwise(t)


def converge(now, target, up, down) -> Column:
    """now moved toward target by at most `up` when below and `down` when above, never past it."""
    now, target = _c(now), _c(target)
    return F.when(now < target, F.least(now + _c(up), target)).when(now > target, F.greatest(now - _c(down), target)).otherwise(now)


def signed16(x: Column) -> Column:
    """The low 16 bits of a whole number as a signed number."""
    return F.pmod(x.cast("long") + 32768, F.lit(65536)) - 32768


def turns_between(x, y) -> Column:
    """Angle of (x, y) in 65536ths of a turn, from -32768 to 32768: half a turn keeps its sign, a negative zero too, which Spark's atan2 drops."""
    angle = F.atan2(_c(y), _c(x))
    return F.round(F.when(_c(y).cast("string") == "-0.0", -angle).otherwise(angle) * TURN / (2 * math.pi)).cast("long")


def atan_turns(x, y) -> Column:
    """Angle of (x, y) as a signed 16-bit turn; exact arc tangent in place of a table, within 11 units of a 1024-step table."""
    return signed16(F.rint(F.atan2(_c(y), _c(x)) * (TURN / (2 * math.pi))))


def angle_difference(a, b) -> Column:
    """The signed shortest turn from b to a in degrees, in [-180, 180)."""
    return wrap(_c(a) - _c(b), -180.0, 180.0)


def wrap360(a) -> Column:
    return wrap(a, 0.0, 360.0)


def squared_distance(a: list, b: list) -> Column:
    parts = [(_c(p) - _c(q)) * (_c(p) - _c(q)) for p, q in zip(a, b, strict=True)]
    return sum(parts[1:], parts[0])


def distance(a: list, b: list) -> Column:
    return F.sqrt(squared_distance(a, b))


def dot(a: list, b: list) -> Column:
    parts = [_c(p) * _c(q) for p, q in zip(a, b, strict=True)]
    return sum(parts[1:], parts[0])


def cross(a: list, b: list) -> list[Column]:
    (ax, ay, az), (bx, by, bz) = map(_c, a), map(_c, b)
    return [ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx]


def angle_between(a: list, b: list) -> Column:
    """Radians between two vectors, by the length of the cross product and the dot product."""
    c = cross(a, b)
    return F.atan2(F.sqrt(dot(c, c)), dot(a, b))


def matrix_product(a: list[list], b: list[list]) -> list[list[Column]]:
    """The product of two matrices of columns or numbers; zeros and ones drop out."""

    def term(x, y):
        return None if isinstance(x, int) and x == 0 or isinstance(y, int) and y == 0 else y if isinstance(x, int) and x == 1 else x if isinstance(y, int) and y == 1 else _c(x) * _c(y)

    def cell(row, column):
        parts = [t for x, y in zip(row, column, strict=True) if (t := term(x, y)) is not None]
        return sum(parts[1:], parts[0]) if parts else 0

    return [[cell(row, column) for column in zip(*b, strict=True)] for row in a]


def roll_pitch_heading(roll, pitch, heading) -> list[list[Column]]:
    """3 x 3 rotation of angles in degrees: about x, then y, then z."""
    sine, cosine = lambda v: F.sin(F.radians(_c(v))), lambda v: F.cos(F.radians(_c(v)))
    about_x = [[1, 0, 0], [0, cosine(roll), -sine(roll)], [0, sine(roll), cosine(roll)]]
    about_y = [[cosine(pitch), 0, sine(pitch)], [0, 1, 0], [-sine(pitch), 0, cosine(pitch)]]
    about_z = [[cosine(heading), -sine(heading), 0], [sine(heading), cosine(heading), 0], [0, 0, 1]]
    return [[_c(v) for v in row] for row in matrix_product(about_z, matrix_product(about_y, about_x))]


def rotation_of_axis(x, y, z) -> tuple[Column, Column]:
    """(pitch, yaw) in degrees of a direction; straight up is -90, straight down 90."""
    x, y, z = map(_c, (x, y, z))
    length = F.sqrt(x * x + y * y + z * z)
    up = y / length
    pitch = F.when(up == 1, F.lit(-90.0)).when(up == -1, F.lit(90.0)).otherwise(-F.degrees(F.atan2(up, F.sqrt(1 - up * up))))
    return pitch, F.degrees(F.atan2(x, z))


def sine_table(bits: int) -> Column:
    """Samples of a sine over 2**bits steps of a turn and a quarter more, so that the cosine is the table from a quarter on."""
    n = 1 << bits
    return F.transform(F.sequence(F.lit(0), F.lit(n + n // 4 - 1)), lambda i: F.sin(i * (2 * math.pi / n)))


def quaternion(x, y, z) -> list[Column]:
    """(x, y, z, w) of Euler angles in degrees."""
    (sx, cx), (sy, cy), (sz, cz) = ((F.sin(F.radians(_c(v)) / 2), F.cos(F.radians(_c(v)) / 2)) for v in (x, y, z))
    return [sx * cy * cz - cx * sy * sz, cz * cx * sy + sz * sx * cy, sz * cx * cy - cz * sx * sy, cx * cy * cz + sx * sy * sz]


def quaternion_blend(a: list, b: list, t) -> list[Column]:
    """Linear blend of two quaternions on the shorter side; the result is not scaled to length 1."""
    side = F.when(dot(a, b) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return [(1 - _c(t)) * _c(p) + _c(t) * side * _c(q) for p, q in zip(a, b, strict=True)]


def hermite(t, t0, v0, m0, t1, v1, m1) -> Column:
    """Cubic through (t0, v0) and (t1, v1) with slopes m0 and m1."""
    t, t0, v0, m0, t1, v1, m1 = map(_c, (t, t0, v0, m0, t1, v1, m1))
    span = t1 - t0
    u = (t - t0) / span
    return v0 * (1 + u * u * (2 * u - 3)) + v1 * (u * u * (3 - 2 * u)) + span * (m0 * u * (1 + u * (u - 2)) + m1 * u * u * (u - 1))


def bit_field(c, mask: int, shift: int) -> Column:
    """The bits of mask, moved down by shift, of an unsigned 32-bit number held in a long."""
    return F.shiftrightunsigned(_c(c).cast("long").bitwiseAND(F.lit(mask)), shift)


def bit_flag(c, mask: int) -> Column:
    return _c(c).cast("long").bitwiseAND(F.lit(mask)) != 0


def name_hash(text, base: int = 3, modulus: int = 65536, lower: bool = False) -> Column:
    """h = code + base * h over the characters, modulo; the 16-bit name hash by default."""
    text = F.lower(_c(text)) if lower else _c(text)
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * base + c, F.lit(modulus)))


def path_parts(path) -> Column:
    """Lower-cased components of a path, empty ones left out."""
    return F.filter(F.split(F.lower(_c(path)), "/"), lambda p: p != "")


def to_cell(v, offset, size) -> Column:
    """(v - offset) / size, truncated toward zero."""
    return ((_c(v) - _c(offset)) / _c(size)).cast("int")


def depth_of(v, offset, step=0.025, limit: int = 255, missing: float = -9999.0) -> Column:
    """Depth in steps, truncated; `missing` from the limit on."""
    d = ((_c(v) - _c(offset)) * _c(step)).cast("int")
    return F.when(d >= limit, F.lit(missing)).otherwise(d.cast("double"))


def triangle(p1: list, p2: list, p3: list) -> dict[str, Column]:
    """nx, ny, nz (unit normal), plane (distance), min_y and max_y; all but the normal are null for a triangle of no area."""
    n = cross([_c(b) - _c(a) for a, b in zip(p1, p2, strict=True)], [_c(c) - _c(b) for b, c in zip(p2, p3, strict=True)])
    length = F.sqrt(dot(n, n))
    real = length > 0
    unit = [F.when(real, v / length).otherwise(v) for v in n]
    return {
        "nx": unit[0], "ny": unit[1], "nz": unit[2],
        "plane": F.when(real, -dot(unit, p1)),
        "min_y": F.when(real, F.least(_c(p1[1]), _c(p2[1]), _c(p3[1]))),
        "max_y": F.when(real, F.greatest(_c(p1[1]), _c(p2[1]), _c(p3[1]))),
    }


def rect_move(rect: list, dx, dy) -> list[Column]:
    x1, y1, x2, y2 = map(_c, rect)
    return [x1 + _c(dx), y1 + _c(dy), x2 + _c(dx), y2 + _c(dy)]


def rect_intersect(a: list, b: list) -> tuple[list[Column], Column]:
    """The common rectangle and whether it has an area."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = map(_c, a), map(_c, b)
    got = [F.greatest(ax1, bx1), F.greatest(ay1, by1), F.least(ax2, bx2), F.least(ay2, by2)]
    return got, (got[0] < got[2]) & (got[1] < got[3])


def fuzzy_contains(text, part) -> Column:
    return F.lower(_c(text)).contains(F.lower(_c(part)))


def percent(v) -> Column:
    """Two decimals; only a true 100 prints as 100.00, all between 99.99 and it as 99.99."""
    v = _c(v)
    return F.format_string("%.2f", F.when((v > 99.99) & (v < 100), F.lit(99.99)).otherwise(v))


def classify(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds."""
    found = None
    for condition, label in rules:
        found = F.when(condition, label) if found is None else found.when(condition, label)
    return found.otherwise(default)


def in_cylinder(p: list, base: list, radius, height) -> Column:
    """Inclusive on every side."""
    x, y, z = map(_c, p)
    bx, by, bz = map(_c, base)
    return (y >= by) & (y <= by + _c(height)) & (squared_distance([x, z], [bx, bz]) <= _c(radius) * _c(radius))


def to_box(p: list, centre: list, rotation: list) -> list[Column]:
    """p in the axes of a box: moved by the centre, then turned back about z, y and x, by angles in degrees."""
    dx, dy, dz = (_c(a) - _c(b) for a, b in zip(p, centre, strict=True))
    rx, ry, rz = (F.radians(-_c(r)) for r in rotation)
    dx, dy = dx * F.cos(rz) - dy * F.sin(rz), dx * F.sin(rz) + dy * F.cos(rz)
    dx, dz = dx * F.cos(ry) + dz * F.sin(ry), dz * F.cos(ry) - dx * F.sin(ry)
    return [dx, dy * F.cos(rx) - dz * F.sin(rx), dy * F.sin(rx) + dz * F.cos(rx)]


def in_box(p: list, centre: list, rotation: list, extent: list) -> Column:
    """Open on every side: x and z within half the extent, y from the base up."""
    dx, dy, dz = to_box(p, centre, rotation)
    ex, ey, ez = map(_c, extent)
    return (F.abs(dx) < ex / 2) & (F.abs(dz) < ez / 2) & (dy > 0) & (dy < ey)


def box_ratio(p: list, centre: list, rotation: list, extent: list) -> list[Column]:
    """Where p lies in the box on each axis, 0 to 1 between its sides."""
    dx, dy, dz = to_box(p, centre, rotation)
    ex, ey, ez = map(_c, extent)
    return [(dx + ex / 2) / ex, dy / ey, (dz + ez / 2) / ez]


def cylinders_meet(a: list, ra, ha, b: list, rb, hb) -> Column:
    """Upright cylinders overlap; touching at the side is no hit, touching at top or bottom is."""
    ay, by, reach = _c(a[1]), _c(b[1]), _c(ra) + _c(rb)
    return (ay <= by + _c(hb)) & (ay + _c(ha) >= by) & (reach * reach > squared_distance([a[0], a[2]], [b[0], b[2]]))


def segments_cross(p0: list, p1: list, p2: list, p3: list) -> Column:
    """The segments p0-p1 and p2-p3 cross; a point on the line counts to its non-negative side."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = (map(_c, p) for p in (p0, p1, p2, p3))
    side = lambda ax, ay, bx, by, px, py: (by - ay) * (px - bx) - (bx - ax) * (py - by) >= 0
    return (side(x0, y0, x1, y1, x2, y2) != side(x0, y0, x1, y1, x3, y3)) & (side(x2, y2, x3, y3, x0, y0) != side(x2, y2, x3, y3, x1, y1))


def in_triangle(p: list, a: list, b: list, c: list, tolerance: float = 0.0) -> Column:
    """All three edge sides of p are at least `tolerance`, for corners in counter-clockwise order."""
    (px, py), (ax, ay), (bx, by), (cx, cy) = (map(_c, v) for v in (p, a, b, c))
    px, py = _c(p[0]), _c(p[1])
    side = lambda ux, uy, vx, vy: (vx - ux) * (py - uy) - (vy - uy) * (px - ux)
    return (side(ax, ay, bx, by) >= tolerance) & (side(bx, by, cx, cy) >= tolerance) & (side(cx, cy, ax, ay) >= tolerance)


def in_rect(p: list, low: list, high: list) -> Column:
    """Closed on every side."""
    return (_c(p[0]) >= _c(low[0])) & (_c(p[0]) <= _c(high[0])) & (_c(p[1]) >= _c(low[1])) & (_c(p[1]) <= _c(high[1]))


def digits_to_long(text) -> Column:
    """Text of digits alone as a number; other text is null."""
    return F.when(_c(text).rlike("^[0-9]+$"), _c(text).try_cast("bigint"))


# Script values: numbers are int or double columns, text has no number.


def script_int(c, kind: str) -> Column:
    """Whole part of a number, 0 for text."""
    return F.lit(0) if kind == "string" else F.coalesce(_c(c).try_cast("int"), F.lit(0)) if kind == "int" else F.when(_c(c) < 0, F.ceil(_c(c))).otherwise(F.floor(_c(c))).cast("int")


def script_float(c, kind: str) -> Column:
    return F.lit(0.0) if kind == "string" else _c(c).cast("double")


def script_text(c, kind: str) -> Column:
    return _c(c) if kind == "string" else F.lit("")


def int32(c) -> Column:
    """A whole number wrapped into 32 signed bits, as a long."""
    return F.pmod(_c(c).cast("long") + 2**31, F.lit(2**32)) - 2**31


def script_arith(op: str, a, a_kind: str, b, b_kind: str) -> tuple[Column, str]:
    """(value, kind) of a op b: double if either is, else 32-bit whole numbers that wrap; whole division truncates, division by zero is
    null. The remainder is of whole numbers alone and has the sign of a."""
    if "float" in (a_kind, b_kind) and op != "%":
        x, y = script_float(a, a_kind), script_float(b, b_kind)
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op](), "float"
    x, y = script_int(a, a_kind).cast("long"), script_int(b, b_kind).cast("long")
    quotient = F.call_function("div", x, F.nullif(y, F.lit(0).cast("long")))
    return int32({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: quotient, "%": lambda: x - y * quotient}[op]()), "int"


def script_bits(op: str, a, a_kind: str, b, b_kind: str) -> Column:
    """&, |, << and >> of whole parts in 32 bits; >> keeps the sign, shift counts are taken modulo 32."""
    x, y = script_int(a, a_kind), script_int(b, b_kind)
    made = {"&": lambda: x.bitwiseAND(y), "|": lambda: x.bitwiseOR(y), "<<": lambda: F.call_function("shiftleft", x, y), ">>": lambda: F.call_function("shiftright", x, y)}[op]()
    return made.cast("long")


def script_negate(a, kind: str) -> Column:
    """-a of a number; text stays as it is."""
    return _c(a) if kind == "string" else -_c(a) if kind == "float" else int32(-script_int(a, kind).cast("long"))


#: Fixed codes of the kinds.
SCRIPT_KINDS = {"int": 0, "float": 1, "string": 2}


def script_typeof(kind: str) -> Column:
    return F.lit(SCRIPT_KINDS[kind])


def script_kind_of(value: Column) -> Column:
    """The kind of a value that is a VARIANT, found at run time: of a whole number, a number with a fraction, a text; null of anything else."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "BIGINT", SCRIPT_KINDS["int"]).when((kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL"), SCRIPT_KINDS["float"]).when(kind == "STRING", SCRIPT_KINDS["string"])


def repaired(arguments: list[tuple[Column, str]], n: int) -> list[tuple[Column, str]]:
    """n arguments: those too many are left out from the end, missing ones are the whole number 0."""
    return [*arguments[:n], *[(F.lit(0), "int")] * (n - len(arguments))]


def script_compare(op: str, a, a_kind: str, b, b_kind: str) -> Column:
    """Texts are equal as texts; ordered, they count as 0, as text does beside numbers."""
    if a_kind == b_kind == "string" and op in ("==", "!="):
        return (_c(a) == _c(b)) if op == "==" else (_c(a) != _c(b))
    x, y = (script_float(a, a_kind), script_float(b, b_kind)) if "float" in (a_kind, b_kind) else (script_int(a, a_kind), script_int(b, b_kind))
    return {"==": x == y, "!=": x != y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op]


def script_logic(op: str, a: Column, b: Column | None = None) -> Column:
    """0 or 1; both sides are evaluated."""
    x = a != 0
    return F.when({"and": lambda: x & (b != 0), "or": lambda: x | (b != 0), "not": lambda: ~x}[op](), 1).otherwise(0)


def uniform_in(draw, low, high) -> Column:
    """A number in [low, high) from a draw in [0, 1)."""
    return _c(low) + _c(draw) * (_c(high) - _c(low))


def uniform_whole(draw, low, high) -> Column:
    """A whole number from low + 1 to high, both held, from a draw in [0, 1)."""
    return (_c(low) + 1 + F.floor(_c(draw) * (_c(high) - _c(low)))).cast("long")


def hash_draw(key, seed: int = 0) -> Column:
    """A draw in [0, 1) from the first 52 bits of md5(key '/' seed)."""
    text = F.concat(_c(key).cast("string"), F.lit(f"/{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def mangled_key(symbol, part: str) -> Column:
    """The `class` or the `method` of a mangled symbol, template arguments left out; null for other names, no class for free functions.

    method__<length><class>..., method__Q<depth> and that many <length><name>, of which the last is the class, and method__F... of a free function."""
    symbol = _c(symbol)

    # A name ends at the first two underscores before such a tail; nothing is told without one, as names are not empty.
    told = lambda tail, group: F.nullif(F.regexp_extract(symbol, f"(?s)^([A-Za-z_][A-Za-z0-9_]*?)__{tail}", group), F.lit(""))
    plain, nested, free = "([0-9]+[A-Za-z_].*)", "Q([0-9])(.*)", "F"
    if part == "method":
        return F.coalesce(told(plain, 1), told(nested, 1), told(free, 1))

    def one(state, _):
        digits = F.regexp_extract(state["rest"], r"^(\d+)", 1)
        size = F.coalesce(digits.try_cast("int"), F.lit(0))
        name = F.substr(state["rest"], F.length(digits) + 1, size)
        rest = F.substr(state["rest"], F.length(digits) + 1 + size)
        return F.struct(F.when(digits == "", state["name"]).otherwise(name).alias("name"), F.when(digits == "", F.lit("")).otherwise(rest).alias("rest"))

    depth = F.coalesce(told(nested, 2).try_cast("int"), F.lit(0))
    start = F.struct(F.lit("").alias("name"), F.coalesce(told(nested, 3), F.lit("")).alias("rest"))
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    inner = F.aggregate(steps, start, one, lambda state: state["name"])
    tail = told(plain, 2)
    size = F.regexp_extract(tail, "^[0-9]+", 0)
    outer = F.substr(tail, F.length(size) + 1, F.coalesce(size.try_cast("int"), F.lit(0)))
    bare = lambda name: F.regexp_replace(name, "<.*", "")
    return F.when(tail.isNotNull(), bare(outer)).when(told(nested, 2).isNotNull(), bare(inner)).when(told(free, 1).isNotNull(), F.lit(""))


def seeded_numbers(seed, n: int) -> Column:
    """The first n numbers of the seeded multiplicative generator, after its warm-up, in the order its table of 32 is filled."""
    # Multiplier, modulus, rounds of warm-up.
    start = F.pmod(_c(seed) + 1, F.lit(1 << 32)).cast("long")
    step = lambda made, _: F.concat(made, F.array(F.element_at(made, -1) * 16807 % 2147483647))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(8 + n)), F.array(F.when(start == 0, F.lit(1).cast("long")).otherwise(start)), step)
    return F.slice(made, 10, n)


def checksum16(words: Column) -> Column:
    """Sum of 16-bit words in the high half, sum of their complements in the low half, of an array of words."""
    total = F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + w.cast("long"))
    inverse = F.size(words).cast("long") * 65535 - total
    return F.shiftleft(F.pmod(total, F.lit(65536)), 16).bitwiseOR(F.pmod(inverse, F.lit(65536)))


def text_key(text) -> Column:
    return F.sha1(_c(text))


def masked_key(text, pattern: str = "[0-9]+", mask: str = "X") -> Column:
    """MD5 of text with what the pattern matches masked."""
    return F.md5(F.regexp_replace(_c(text), pattern, mask))


def fixed_offset(ts, hours: int) -> Column:
    """A timestamp without zone moved by whole hours."""
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(hours))
