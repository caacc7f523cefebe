"""The pipeline against a plain version of its stages, and the registered queries."""

import random
import uuid
import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import queries
from millrace.llm.common import shared_dir


def write_tables(spark, root, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")


def test_stages_keep_what_they_should(spark, tmp_path):
    rnd = random.Random(12)
    words = [f"{a}{b}" for a in "the of and tion ing wh er on".split() for b in "st ou re ea nd".split()]
    good = [(i, " ".join(rnd.choice(words) for _ in range(80)) + ".", "en", f"s{i % 3}") for i in range(300)]
    copies = [(1000 + i, good[i % 20][1], "en", "s0") for i in range(60)]
    junk = [(2000 + i, "$$$ %%% " * rnd.randint(10, 40), "en", "s1") for i in range(80)]
    silent = [(3000 + i, None if i % 2 else "1234 5678 " * 9, "en", "s2") for i in range(6)]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in good + copies + junk + silent]
    root = f"file://{tmp_path}"
    write_tables(spark, root, rows, [(i, int(i < 2000), 0) for i, *_ in good + copies + junk])
    docs = spark.read.parquet(f"{root}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
        path = f"{shared_dir(spark)}/test-{name}-{uuid.uuid4().hex}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        after[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    quality = {r["doc_id"] for r in after["quality"].collect()}
    assert quality >= {i for i, *_ in good + copies} and not quality & {i for i, *_ in junk}
    assert {r["doc_id"] for r in after["language"].collect()} == quality - {i for i, *_ in silent}
    kept = [r["doc_id"] for r in after["near_duplicates"].collect()]
    assert sorted(kept) == sorted(i for i, *_ in good)
    copies_of = Counter(r["doc_id"] for r in after["mixing"].collect())
    assert set(copies_of) <= set(kept) and Counter(r["doc_id"] for r in after["encoding"].collect()) == copies_of
    assert 0.7 < sum(copies_of.values()) / len(kept) < 1.3


def test_pipeline_takes_empty_tables_and_rows_without_or_with_repeated_ids(spark, tmp_path):
    root = f"file://{tmp_path}/none"
    write_tables(spark, root, [], [])
    assert corpus_pipeline.run(spark, root).collect() == []
    rnd = random.Random(14)
    words = [f"{a}{b}" for a in "the of and tion ing wh er on".split() for b in "st ou re ea nd".split()]
    text = lambda: " ".join(rnd.choice(words) for _ in range(80)) + "."
    texts = [text() for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 9)] * 30 + [(5, t := text(), "en", "s", 9), (None, t, None, None, None), (None, text(), "en", "s", None), (None, None, None, None, None), (None, texts[9], "en", "s", 1)]
    root = f"file://{tmp_path}/odd"
    write_tables(spark, root, rows, [(i, 1, 0) for i in range(40)] + [(None, 0, None)])
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        path = f"{shared_dir(spark)}/test-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, root).write.parquet(path)
        docs = spark.read.parquet(path)
    kept = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in docs.collect())
    assert kept == sorted([(i, t) for i, t in enumerate(texts)] + [(5, t), (-1, rows[-3][1])])
    assert set(r["doc_id"] for r in corpus_pipeline.run(spark, root).collect()) <= {*range(40), None}


def test_registered_queries_run_on_tiny_tables(spark, tmp_path):
    root = f"file://{tmp_path}"
    write_tables(spark, root, [(i, f"text number {i} of the words " * 5, "en", "a", 10) for i in range(40)], [(i, i % 2, 0) for i in range(40)])
    for name in ("op2_interpolated_lm", "op4_factor_quality", "op5_kd_shards", "op6_simhash_dedup", "op7_segment_langid", "op8_piece_codec"):
        made = queries.QUERIES[name](spark, root)
        ids = [r["doc_id"] for r in made.select("doc_id").collect()]
        assert sorted(ids) == list(range(40)), name
    held = queries.QUERIES["op7_segment_langid"](spark, root).filter("held_out").select("doc_id").collect()
    assert {r["doc_id"] for r in held} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert queries.QUERIES["op10_poisson_mix"](spark, root).agg(F.count("doc_id")).first()[0] > 0
