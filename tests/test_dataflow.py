"""Class refinement and verdicts against plain loops."""

import random

from millrace.operators import dataflow
from millrace.session import discard, written


def plain_classes(values, operands):
    """{(unit, version, value): class number} by refinement in Python; unit by unit."""
    label = {v[:3]: ("", v[3] or "") for v in values}
    while True:
        step = {}
        for v in label:
            met = [(p, label.get((*v[:2], o), "missing")) for u, w, x, p, o in operands if (u, w, x) == v]
            step[v] = (label[v], tuple(sorted(met, key=repr)))
        names = {u: {c: i for i, c in enumerate(sorted({step[v] for v in step if v[0] == u}, key=repr))} for u in {v[0] for v in label}}
        new = {v: names[v[0]][step[v]] for v in label}
        if len({(v[0], c) for v, c in new.items()}) == len({(v[0], c) for v, c in label.items()}):
            return new
        label = new


def partition(classes):
    groups = {}
    for v, c in classes.items():
        groups.setdefault((v[0], c), set()).add(v)
    return sorted(map(sorted, groups.values()))


def test_classes_equal_plain_refinement(spark):
    rnd = random.Random(6)
    values, operands = [], []
    for unit in range(12):
        n = rnd.randint(1, 14)
        for version in "pq":
            values += [(unit, version, v, rnd.choice(["a", "b", None] if unit % 2 else ["a"])) for v in range(n)]
            operands += [(unit, version, v, rnd.choice([0, 0, 1]), rnd.randint(0, n)) for v in range(n) for _ in range(rnd.randint(0, 3))]
    # a long chain settles late, a short one soon
    values += [(50, "p", v, "a") for v in range(30)]
    operands += [(50, "p", v, 0, v + 1) for v in range(29)]
    v = spark.createDataFrame(values, "unit long, version string, value long, content string")
    o = spark.createDataFrame(operands, "unit long, version string, value long, place int, operand long")
    got = {(r["unit"], r["version"], r["value"]): r["class"] for r in dataflow.refined_classes(v, o, written, discard).collect()}
    assert len(got) == len(values) and partition(got) == partition(plain_classes(values, operands))
    assert dataflow.refined_classes(v.limit(0), o.limit(0), written, discard).count() == 0


def test_verdicts_of_small_units(spark):
    blocks, values, operands = [], [], []

    def unit(number, p, q, p_blocks=(("ret", []),), q_blocks=(("ret", []),)):
        for version, made, shape in (("p", p, p_blocks), ("q", q, q_blocks)):
            blocks.extend((number, version, k, kind, succ) for k, (kind, succ) in enumerate(shape))
            for pos, (value, content, ops, effect) in enumerate(made):
                values.append((number, version, value, content, 0, pos, effect))
                operands.extend((number, version, value, place, o) for place, o in ops)

    add = lambda a, b: [(1, "x", [], None), (2, "y", [], None), (3, "add", [(0, a), (0, b)], None), (4, "store", [(0, 3)], 1)]
    sub = lambda a, b: [(1, "x", [], None), (2, "y", [], None), (3, "sub", [(0, a), (1, b)], None), (4, "store", [(0, 3)], 1)]
    unit(1, add(1, 2), add(2, 1))
    unit(2, sub(1, 2), sub(2, 1))
    unit(3, add(1, 2), [(9, "y", [], None), (8, "x", [], None), (7, "add", [(0, 9), (0, 8)], None), (6, "store", [(0, 7)], 1)])
    unit(4, add(1, 2), add(1, 2), q_blocks=(("br", [1]), ("ret", [])))
    unit(5, add(1, 2), add(1, 2), p_blocks=(("br", [1]), ("ret", [])), q_blocks=(("br", [0]), ("ret", [])))
    unit(6, add(1, 2), [*add(1, 2), (5, "store", [(0, 1)], 2)])
    unit(7, [(1, "phi", [(0, 2)], 1), (2, "inc", [(0, 1)], None)], [(5, "phi", [(0, 6)], 1), (6, "inc", [(0, 5)], None)])
    blocks.append((8, "p", 0, "ret", []))
    b = spark.createDataFrame(blocks, "unit long, version string, block int, kind string, successors array<int>")
    v = spark.createDataFrame(values, "unit long, version string, value long, content string, block int, pos int, effect int")
    o = spark.createDataFrame(operands, "unit long, version string, value long, place int, operand long")
    got = {r["unit"]: (r["verdict"], r["reason"]) for r in dataflow.verdicts(b, v, o, ("p", "q"), written, discard).collect()}
    assert got == {
        1: ("EQUIVALENT", "L1"), 2: ("DIFFERENT", "block 0 effect 1"), 3: ("EQUIVALENT", "L2"), 4: ("UNSUPPORTED", "1 vs 2 blocks"), 5: ("UNSUPPORTED", "block 0"),
        6: ("DIFFERENT", "block 0 effect 2"), 7: ("EQUIVALENT", "L1"), 8: ("UNSUPPORTED", "1 vs 0 blocks"),
    }


def test_small_units_are_refined_within_tasks_and_large_ones_in_rounds(spark, monkeypatch):
    rnd = random.Random(8)
    values, operands = [], []
    for unit in range(20):
        n = rnd.randint(1, 5)
        for version in "pq":
            values += [(unit, version, v, rnd.choice(["a", "b", "", None])) for v in range(n)]
            operands += [(unit, version, v, rnd.choice([0, 0, 1]), rnd.randint(0, n)) for v in range(n + 1) for _ in range(rnd.randint(0, 3))]
    values += [(70, "p", v, "a") for v in range(12)]
    operands += [(70, "p", v, 0, v + 1) for v in range(11)]
    v = spark.createDataFrame(values, "unit long, version string, value long, content string")
    o = spark.createDataFrame(operands, "unit long, version string, value long, place int, operand long")
    want = partition(plain_classes(values, operands))
    monkeypatch.setattr(dataflow, "SIDE_BY_SIDE", 40)
    for small, most in ((10_000, 2), (20, 100)):
        monkeypatch.setattr(dataflow, "SMALL_UNIT", small)
        tables = []
        write = lambda df, name, tables=tables: tables.append(name) or written(df, name)
        got = {(r["unit"], r["version"], r["value"]): r["class"] for r in dataflow.refined_classes(v, o, write, discard).collect()}
        assert len(got) == len(values) and partition(got) == want
        assert len(tables) <= most
