"""Round trips of the binary layouts and readers of text sources."""

import json
import struct

from millrace.functions.text import minstd, normal_tokens, sequence_diff
from millrace.sources import archive, binary, logs
from millrace.streaming.stateful import admit


def test_table_round_trip(spark, tmp_path):
    columns = {"id": "u32", "n": "s32", "on": "bool", "x": "f32"}
    data = [{"id": 7, "n": -3, "on": 1, "x": 0.5}, {"id": 2**32 - 1, "n": 0, "on": 0, "x": -1.25}]
    raw = binary.table_bytes(columns, data)
    got = list(binary.table_rows(raw, columns | {"none": "u32"}))
    assert got == [{"id": 7, "n": -3, "on": True, "x": 0.5, "none": None}, {"id": 2**32 - 1, "n": 0, "on": False, "x": -1.25, "none": None}]
    assert list(binary.table_rows(b"", columns)) == []
    (tmp_path / "a.bin").write_bytes(binary.compress_literal(raw))
    (tmp_path / "b.bin").write_bytes(raw)
    read = binary.read_files(spark, str(tmp_path), lambda b: binary.table_rows(b, {"id": "u32", "n": "s32", "on": "bool", "x": "f32"}), "id long, n int, on boolean, x double")
    assert sorted((r["id"], r["n"]) for r in read.collect()) == [(7, -3), (7, -3), (2**32 - 1, 0), (2**32 - 1, 0)]


def test_bit_fields_and_cursor():
    raw = struct.pack(">iiiI", 1, 1, 28, 4) + struct.pack(">IIHBB", binary.field_hash("f"), 0x00FF0000, 0, 16, 0) + struct.pack(">I", 0xAABBCCDD)
    assert list(binary.table_rows(raw, {"f": "u32"})) == [{"f": 0xBB}] and list(binary.table_rows(raw, {"f": "bool"})) == [{"f": True}]
    cur = binary.Cursor(b"\x00\x05hello\x01")
    assert cur.peek(2) == b"\x00\x05" and cur.text(4) == "hel" and cur.number("B") == 1
    assert cur.raw(9) == b"" and cur.ended and cur.seek(3) == -5 and not cur.ended and cur.seek(99) == 5


def test_decompression():
    plain = b"abc" + b"z" * 400 + bytes(range(256)) * 3
    block = binary.compress_literal(plain)
    assert binary.codec_of(block) == "Yaz0" and binary.decompress(block) == plain and binary.decompress(block, 3, 5) == b"zzzzz"
    assert binary.decompress(b"plain") == b"plain"
    # Yay0: literal a, then a match of 5 at distance 1
    yay = b"Yay0" + struct.pack(">III", 6, 20, 22) + struct.pack(">I", 0x80000000) + struct.pack(">H", (3 << 12) | 0) + b"a"
    assert binary.decompress(yay) == b"aaaaaa"


def test_scene_messages_snapshot():
    text = lambda s: struct.pack(">H", len(s)) + s.encode()
    rec = lambda kind, name, body: (lambda tail: struct.pack(">IH", 6 + len(tail), 1) + tail)(text(kind) + text(name) + body)
    unknown = rec("Odd", "x", b"\x00" * 9)
    leaf = rec("Leaf", "l", struct.pack(">I", 9))
    tree = rec("Group", "root", struct.pack(">I", 3) + leaf + unknown + leaf)
    got = list(binary.scene_rows(tree, {"Leaf": lambda c: {"v": c.number("I")}}, {"Group"}))
    assert [(r["id"], r["parent_id"], r["path"], r["props"]) for r in got] == [(0, None, "/root", {}), (1, 0, "/root/l", {"v": "9"}), (2, 0, "/root/l", {"v": "9"})]
    assert list(binary.array_rows(struct.pack(">I", 2) + leaf + leaf, lambda c: {"v": c.number("I")})) == [{"v": 9}, {"v": 9}]
    info = b"INF1" + struct.pack(">IHHI", 24, 2, 4, 0) + struct.pack(">II", 0, 3)
    blocks = b"\0" * 32 + info + b"DAT1" + struct.pack(">I", 8 + 6) + b"ab\0cd\0"
    assert [r["text"] for r in binary.message_rows(blocks)] == ["ab", "cd"]
    snap = binary.snapshot_bytes(5, 2, 0, [True, False, True], [7])
    back = binary.read_snapshot(snap)
    assert (back["valid"], back["time"], back["saves"], back["shines"], back["bools"], back["ints"][0]) == (True, 5, 3, 2, [0, 2], 7)
    assert not binary.read_snapshot(b"\0\0\0\x05")["valid"]


def test_archive_lookup(spark):
    e = spark.createDataFrame([(0, None, "Data", False, ""), (1, 0, "A.bin", True, "BIN"), (2, 0, "sub", False, ""), (3, 2, "b.TXT", True, "TXT")], "id long, parent long, name string, is_file boolean, type string")
    p = spark.createDataFrame([("/data/a.BIN",), ("DATA/sub/B.txt",), ("data/sub",), ("data/a.bin/x",), ("none",)], "p string")
    assert {r["p"]: r["id"] for r in archive.resolve(e, p, "p").collect()} == {"/data/a.BIN": 1, "DATA/sub/B.txt": 3, "data/sub": None, "data/a.bin/x": None, "none": None}
    assert archive.directory(e, 0).count() == 2 and {r["type"]: r["n"] for r in archive.counts(e).collect()} == {"BIN": 1, "TXT": 1}


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.map").write_text(".text section layout\n  00000000 000010 80003100  4 main \tmain.o\n  UNUSED   000024 ........ dead main.o\n.data section layout\n  00000010 00000c 80004000  4 tab \ttab.o\n")
    got = {r["symbol"]: r for r in logs.map_rows(spark, str(tmp_path / "m.map")).collect()}
    assert (got["main"]["section"], got["main"]["size"], got["tab"]["section"]) == (".text", 16, ".data")
    report = {"units": [{"name": "u", "metadata": {"complete": True, "progress_categories": ["game"]}, "functions": [{"name": "f", "size": "12", "fuzzy_match_percent": 50.0}, {"name": "g", "size": "x"}]}]}
    (tmp_path / "r.json").write_text(json.dumps(report))
    assert sorted((r["function"], r["size"], r["fuzzy"], r["category"]) for r in logs.report_functions(spark, str(tmp_path / "r.json")).collect()) == [("f", 12, 50.0, "game"), ("g", 0, 0.0, "game")]
    (tmp_path / "e.jsonl").write_text('{"timestamp":"2026-01-01T05:10:00Z","message":{"usage":{"output_tokens":4}}}\nbroken\n{"timestamp":"2026-01-01T05:50:00Z","message":{"usage":{"output_tokens":6}}}\n')
    assert [(r["tokens"], r["files"]) for r in logs.token_usage(spark, str(tmp_path / "e.jsonl")).collect()] == [(10, 1)]
    d = spark.createDataFrame([(1, "a\tb")], "i int, s string")
    logs.write_tsv(d, str(tmp_path / "t"))
    assert logs.read_tsv(spark, str(tmp_path / "t"), "i int, s string").count() == 1
    assert logs.markdown_table(d, 5).splitlines()[0] == "| i | s |"


def test_plain_text_functions():
    assert normal_tokens(["return", "this", "->", "a", ".", "b", "+", "p", "*", "x", "-", "3.0f"], {"p"}, {"x"}) == ["b", "+", "$P", "*", "$L", "-", "3"]
    assert sequence_diff("abc", "axcd") == {"insert": 1, "delete": 0, "replace": 1}
    assert minstd(0, 2) == [x for x in minstd(0, 3)][:2] and all(0 < v < 2**31 - 1 for v in minstd(9, 40))


def test_admission_rules():
    held = [(5, 1), (3, 2)]
    assert admit(held, 2, 4, 2) == ("replaced", None) and admit(held, 3, 3, 2) == ("rejected", None)
    assert admit(held, 3, 4, 2) == ("rejected", None) and admit(held, 3, 4, 2, {2}) == ("evicted", 2) and held == [(5, 1), (4, 3)]
