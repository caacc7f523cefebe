"""Groups of equal texts in shards, ids of any type, and the tree against a plain one."""

import random
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import kd_shards

SCHEMA = "doc_id {}, text string, lang string, source string, n_chars long, kept string, crc string"


def documents(spark, rows, kind="long"):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "y") for i, t, lang, s in rows], SCHEMA.format(kind))


def test_small_groups_stay_together_and_large_ones_are_parted(spark):
    rnd = random.Random(4)
    texts = [f"t{k} " * rnd.randint(1, 12) for k in range(700)]
    rows = [(i, texts[rnd.randrange(700)], rnd.choice(["en", None]), rnd.choice("abc")) for i in range(1_500)]
    rows += [(2_000 + i, "many copies of this text", "en", rnd.choice("abc")) for i in range(800)] + [(3_000 + i, None if i % 2 else "", "fr", "a") for i in range(6)] + [(None, texts[0], "en", "a")]
    text = {i: t or "" for i, t, *_ in rows}
    got = kd_shards.shard(documents(spark, rows), 8).collect()
    sizes, places = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        places.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    mean = sum(sizes.values()) / 8
    assert len(got) == len(rows) and len(sizes) == 8 and max(abs(v - mean) for v in sizes.values()) <= kd_shards.GROUP_SHARE * mean
    weight = Counter(text[i] for i, *_ in rows)
    for t, n in weight.items():
        if n * (len(t.encode()) + 16) <= kd_shards.GROUP_SHARE * mean:
            assert len(places[t]) == 1, (t, n)
    assert len(places["many copies of this text"]) > 1


def test_ids_of_any_type(spark):
    rows = [(f"id-{i}" if i % 9 else None, f"text {i}", "en", "a") for i in range(200)]
    got = kd_shards.shard(documents(spark, rows, "string"), 4).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in rows)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 60


def test_tree_of_eight_leaves_equals_a_plain_one(spark):
    """Every node is cut where the lower part is nearest to its share, along its widest dimension; dimensions are far from equally wide."""
    rnd = random.Random(21)
    rows = [(k, rnd.randint(1, 9), rnd.uniform(0, 1000), rnd.uniform(0, 1) ** 3 * 200) for k in range(600)]
    df = spark.createDataFrame(rows, "place long, size long, a double, b double").withColumn("tie", F.lit(0).cast("long"))
    keyed = kd_shards.keyed(df, ["a", "b"])
    keys = {r["place"]: r["keys"] for r in keyed.collect()}
    weight = {k: w for k, w, *_ in rows}
    step = lambda key: key >> (kd_shards.BITS - kd_shards.RADIX_BITS)

    def cut_up(members, leaves, first, out):
        if leaves == 1:
            out.update(dict.fromkeys(members, first))
            return
        widths = [max(step(keys[m][d]) for m in members) - min(step(keys[m][d]) for m in members) for d in range(2)]
        dim = 0 if widths[0] >= widths[1] else 1
        order = sorted(members, key=lambda m: keys[m][dim])
        target = sum(weight[m] for m in members) * (leaves // 2) / leaves
        best = min(range(len(order) + 1), key=lambda n: abs(sum(weight[m] for m in order[:n]) - target))
        cut_up(order[:best], leaves // 2, first, out)
        cut_up(order[best:], leaves - leaves // 2, first + leaves // 2, out)

    want: dict = {}
    cut_up(list(keys), 8, 0, want)
    got = {r["place"]: r["node"] for r in kd_shards.grow(keyed, "size", 8).collect()}
    different = sum(got[k] != want[k] for k in want)
    assert different <= 12  # cuts lie within the tolerance of a leaf
