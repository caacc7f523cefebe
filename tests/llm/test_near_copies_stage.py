"""The near-duplicate stage against brute force on five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import simhash_dedup


def test_stage_drops_copies_of_five_word_similarity(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(60)]
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 4):
            other = list(base)
            for at in rnd.sample(range(60), changes):
                other[at] = rnd.choice(vocabulary)
            texts.append(" ".join(other))
    texts += ["a b", "a b", "c d e", "", None]
    shingles = []
    for t in texts:
        w = (t or "").lower().split()
        shingles.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    prints = simhash_dedup.text_fingerprints([t or "" for t in texts], 3)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            similar = bool(a and b) and len(a & b) >= 0.8 * len(a | b)
            if similar or int(np.bitwise_count((prints[i] ^ prints[j]).view(np.uint64))) <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {find(i) for i in range(len(texts))}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == sorted(want)


def plain_links(sets, similarity):
    """{(i, j)} of all similar pairs."""
    return {(j, i) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}


def roots_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        x, y = sorted((find(i), find(j)))
        root[y] = x
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("block", "group"), [(1024, 32_000_000), (4, 2_000)])
def test_links_in_hot_buckets_and_split_components(spark, monkeypatch, block, group):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    monkeypatch.setattr(simhash_dedup, "GROUP_BYTES", group)
    rnd = random.Random(7)
    template = [f"t{i}" for i in range(50)]
    texts = []
    for k in range(40):  # a template in every text: some alike by it, others not
        texts.append(" ".join(template + [f"x{k}y{i}" for i in range(rnd.choice([2, 6, 9, 40, 120]))]))
    for k in range(30):
        base = [f"b{i}" for i in range(200)]
        for at in rnd.sample(range(200), 4):
            base[at] = f"c{k}"
        texts.append(" ".join(base))
    texts += [None, "", "t0", texts[3], texts[50].upper()]
    ids = [i if i % 7 else None for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "i long, t string")
    marked = simhash_dedup.cut(simhash_dedup.shingle_marks(docs, "i", "t", 3), "marks")
    prints = simhash_dedup.text_fingerprints([t or "" for t in texts], 3).tolist()
    shingles = []
    for t in texts:
        w = (t or "").lower().split()
        shingles.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    same = {(j, i) for i in range(len(texts)) for j in range(i) if prints[i] == prints[j]}
    want = roots_of(len(texts), plain_links(shingles, 0.8) | same)
    first = {p: i for i, p in reversed(list(enumerate(prints)))}
    links = [(first[r["a"]], first[r["b"]]) for r in simhash_dedup.similar_links(docs, marked, "i", "t", 0.8).collect()]
    assert roots_of(len(texts), {*links, *same}) == want and len(links) < 2 * len(texts)


def test_names_of_columns_cannot_clash(spark):
    rows = [(i, "the same text in a row of seven words or more" if i % 2 else f"text number {i}", "a", "b", "c", "d", "e", "f") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, __fp string, __root string, c0 string, id string, fp string")
    for similarity in (None, 0.8):
        kept = simhash_dedup.keep_one(docs, similarity=similarity)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 4, 6]
