"""The binary data sources: several files and ranges, pruning by schema, faults, commits."""

import os
import struct

import pytest

from millrace.sources import binary, packed


def read(spark, path, schema=None, **options):
    reader = spark.read.format("packed_table").option("path", str(path))
    for key, value in options.items():
        reader = reader.option(key, value)
    return (reader.schema(schema) if schema else reader).load()


def test_files_in_ranges_and_pruned_columns(spark, tmp_path):
    packed.register(spark)
    rows = [(i, i - 40, i % 3 == 0, i * 0.5, f"{i}") for i in range(100)]
    spark.createDataFrame(rows, "id long, n int, on boolean, x float, s string").drop("s").repartition(3).write.format("packed_table").option("path", str(tmp_path)).mode("append").save()
    assert len(os.listdir(tmp_path)) == 3 and not [f for f in os.listdir(tmp_path) if f.startswith(".")]
    found = read(spark, tmp_path, "x double, none long, n int", splitBytes=100)
    assert found.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, found.collect())) == sorted((x, None, n) for _, n, _, x, _ in rows)
    by_header = read(spark, tmp_path, names="id,on")
    assert by_header.columns[0] == "id" and by_header.columns[2] == "on" and by_header.columns[3].startswith("hash_") and dict(by_header.dtypes)[by_header.columns[3]] == "float"
    assert sorted((r["id"], r[3]) for r in by_header.collect()) == [(i, x) for i, _, _, x, _ in rows]
    more = spark.createDataFrame([(7, 1, False, 2.0)], "id long, n int, on boolean, x float")
    more.write.format("packed_table").option("path", str(tmp_path)).mode("overwrite").save()
    assert [tuple(r) for r in read(spark, tmp_path, "id long, on boolean").collect()] == [(7, False)]


def test_masked_and_text_fields(spark, tmp_path):
    packed.register(spark)
    f = binary.field_hash
    head = struct.pack(">iiiI", 2, 3, 52, 12) + struct.pack(">IIHBB", f("low"), 0xFF00, 0, 8, 4) + struct.pack(">IIHBB", f("flag"), 1, 0, 0, 5) + struct.pack(">IIHBB", f("name"), 0xFFFFFFFF, 4, 0, 1)
    (tmp_path / "a.tbl").write_bytes(head + struct.pack(">I8s", 0xABCD, b"x\0junk") + struct.pack(">I8s", 0x1200, "名前".encode("shift_jis")))
    assert [tuple(r) for r in read(spark, tmp_path, "low long, flag boolean, name string").collect()] == [(0xAB, True, "x"), (0x12, False, "名前")]
    assert [(n, t) for n, t in read(spark, tmp_path, names="low,flag,name").dtypes] == [("low", "bigint"), ("flag", "bigint"), ("name", "string")]


@pytest.mark.parametrize("raw", [b"\0" * 7, struct.pack(">iiiI", 5, 0, 16, 4) + b"\0" * 8, struct.pack(">iiiI", -1, 0, 16, 4), struct.pack(">iiiI", 1, 1, 28, 4) + struct.pack(">IIHBB", 1, 1, 2, 0, 0) + b"\0" * 4])
def test_corrupt_files_are_named_or_passed_over(spark, tmp_path, raw):
    packed.register(spark)
    (tmp_path / "good.tbl").write_bytes(binary.table_bytes({"id": "u32"}, [{"id": 3}]))
    (tmp_path / "bad.tbl").write_bytes(raw)
    for split in (1, 1 << 20):
        with pytest.raises(Exception, match="CorruptFile.*bad.tbl"):
            read(spark, tmp_path, "id long", splitBytes=split).collect()
        assert [r["id"] for r in read(spark, tmp_path, "id long", splitBytes=split, onCorrupt="skip").collect()] == [3]


def test_nothing_written_by_a_failed_job_stays(spark, tmp_path):
    packed.register(spark)
    from pyspark.sql import functions as F

    bad = spark.range(20, numPartitions=4).select(F.when(F.col("id") == 19, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("packed_table").option("path", str(tmp_path)).mode("append").save()
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == [] and read(spark, tmp_path, "id long").collect() == []
    with pytest.raises(Exception, match="more than 32 bits"):
        spark.range(1).select(F.lit(1 << 40).alias("id")).write.format("packed_table").option("path", str(tmp_path)).mode("append").save()


def test_scene_files(spark, tmp_path):
    packed.register(spark)
    text = lambda s: struct.pack(">H", len(s)) + s

    def record(kind, name, body, key=1):
        tail = struct.pack(">H", key) + text(kind) + text(name) + body
        return struct.pack(">I", 4 + len(tail)) + tail

    inner = record(b"Group", b"in", struct.pack(">I", 1) + record(b"Leaf", b"l", struct.pack(">f", 2.5) + text(b"t")))
    whole = record(b"Group", b"top", struct.pack(">I", 2) + record(b"Odd", b"o", b"123") + inner)
    spark.createDataFrame([("a.scn", whole), ("b.scn", whole), ("c.scn", whole[:-3])], "name string, content binary").repartition(2).write.format("byte_files").option("path", str(tmp_path)).mode("append").save()
    assert sorted(os.listdir(tmp_path)) == ["a.scn", "b.scn", "c.scn"]
    reader = spark.read.format("scene_tree").option("path", str(tmp_path)).option("groups", "Group").option("types", "Leaf: f x, text t")
    found = sorted((r["file"][-5:], r["id"], r["parent_id"], r["path"], r["props"]) for r in reader.option("onCorrupt", "skip").load().collect())
    assert found == sorted((f, i, p, path, props) for f in ("a.scn", "b.scn") for i, p, path, props in [(0, None, "/top", {}), (1, 0, "/top/in", {}), (2, 1, "/top/in/l", {"x": "2.5", "t": "t"})])
    with pytest.raises(Exception, match="CorruptFile.*c.scn"):
        reader.option("onCorrupt", "fail").load().collect()
