"""Each operator on small hard cases, against brute force, the library it must equal, or an exact round trip."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from millrace.llm import common, factor_quality, interpolated_lm, kd_shards, piece_codec, pivot_topk, poisson_mix, prefix_forest, segment_langid, simhash_dedup, vector_blocks, warc_bundles

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, c0 string, t string, fp string"


def documents(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "y", "z") for i, t, lang, s in rows], DOCS)


HARD = [
    (1, "the cat sat on the mat", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "  \t\n ", "fr", "a"), (5, "Word " * 30_000, "en", "b"),
    (6, "the cat sat on the mat", "en", "a"), (6, "the cat sat on the mat", "en", "a"), (None, "le chat est sur la table", "fr", "b"), (None, None, None, "b"), (9, "x" * 5_000, "de", None), (10, "日本語 ﬁ ① é \x00", None, "c"),
]


def vectors(spark, rows, name="embedding"):
    return spark.createDataFrame(rows, f"vec_id long, {name} array<float>, id string, vec string")


def hard_vectors(n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=dim)], "a", "b") for i in range(n)]
    rows += [(n + i, rows[0][1], "a", "b") for i in range(30)]  # ties
    rows += [(1000, None, "", ""), (1001, [1.0, None] * (dim // 2), "", ""), (1002, [float("nan")] * dim, "", ""), (1003, [float("inf")] * dim, "", ""), (1004, [0.0] * dim, "", ""), (None, [1.0] * dim, "", ""), (1005, [1.0] * (dim + 1), "", ""), (5, rows[5][1], "a", "b"), (1006, [], "", "")]
    return rows


def usable_rows(rows, nonzero=False):
    """(id, vector) of the rows that take part; rows that repeat an id stay rows of their own, a missing id is the largest."""
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and (any(v) or not nonzero)
    return [(vector_blocks.NO_ID if i is None else i, v) for i, v, *_ in rows if fine(v)]


def found_rows(df):
    return sorted((q, r, vector_blocks.NO_ID if i is None else i, s) for q, r, i, s in df.collect())


def plain_top(rows, score, every):
    """The ten best of each query row among all other rows, as (query id, rank, id, score), smallest score first."""
    out = []
    for k, (q, v) in enumerate(rows):
        if q % every == 0:
            found = sorted((score(v, w), i) for j, (i, w) in enumerate(rows) if j != k and len(w) == len(v))[:10]
            out += [(q, r, i, s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_pivot_topk_is_exact(spark):
    rows = hard_vectors() + [(50, [3.0] * 8, "", ""), (50, [3.0] * 8, "", ""), (100, [-0.5] * 8, "", "")]
    ok = [(i, [int(math.floor(x * 1024)) for x in v]) for i, v in usable_rows(rows)]
    expected = plain_top(ok, lambda v, w: -sum(a * b for a, b in zip(v, w, strict=True)), 50)
    got = found_rows(pivot_topk.top_k(vectors(spark, rows), F.col("id") % 50 == 0))
    assert any(i == vector_blocks.NO_ID for _, _, i, _ in got)
    assert got == [(q, r, i, -s) for q, r, i, s in expected]


def test_pivot_topk_takes_large_components_exactly(spark):
    rnd = random.Random(21)
    rows = [(i, [float(rnd.choice((-1, 1)) * rnd.randint(2**19, 2**30)) for _ in range(4)], "", "") for i in range(120)]
    rows += [(i + 200, [float(np.float32(rnd.uniform(-3, 3))) for _ in range(4)], "", "") for i in range(80)]
    schema = "vec_id long, embedding array<double>, id string, vec string"
    ok = [(i, [math.floor(x * 1024) for x in v]) for i, v in usable_rows(rows)]
    expected = plain_top(ok, lambda v, w: -sum(a * b for a, b in zip(v, w, strict=True)), 10)
    fits = [e for e in expected if all(abs(x[3]) < 2**63 for x in expected if x[0] == e[0])]
    small = {e[0] for e in fits}
    assert len(small) > 5 and len(small) < len({e[0] for e in expected})
    got = pivot_topk.top_k(spark.createDataFrame(rows, schema), F.col("id").isin(sorted(small))).collect()
    assert sorted(map(tuple, got)) == [(q, r, i, -s) for q, r, i, s in fits]
    with pytest.raises(Exception, match="does not fit a long"):
        pivot_topk.top_k(spark.createDataFrame(rows, schema), F.col("id") % 10 == 0).collect()
    one = spark.createDataFrame([(100, [1.0], "", ""), (7, [2.0**22], "", "")], schema)
    assert [tuple(r) for r in pivot_topk.top_k(one, F.col("id") % 100 == 0).collect()] == [(100, 1, 7, 2**42)]


def test_pivot_elimination_stops_early():
    rng = np.random.default_rng(2)
    x = np.rint(np.concatenate([rng.normal(c, 3, (2_000, 6)) for c in (0, 1000, 2000)]))
    pivots = pivot_topk.choose_pivots(x, 8)
    q = x[-1]
    lower = np.abs(pivot_topk.distances(x, pivots) - pivot_topk.distances(q[None], pivots)).max(1)
    bound = ((x**2).sum(1) + (q**2).sum() - lower**2) / 2 + 1
    at, scores, wide, done = pivot_topk.evaluate(q, bound, x, np.ones(len(x), dtype=int), 5)
    true = sorted((-int(a @ q), i) for i, a in enumerate(x.astype(int)))[:5]
    assert sorted(zip((-scores).tolist(), at.tolist(), strict=True))[:5] == true and not wide.any()
    assert done <= 2_560  # of 6,000: the far clusters are never evaluated


def test_prefix_forest_measures_all_of_small_tables(spark):
    rows = hard_vectors(60) + [(50, [3.0] * 8, "", ""), (50, [3.0] * 8, "", "")]
    expected = plain_top(usable_rows(rows, nonzero=True), lambda v, w: float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), 10)
    got = found_rows(prefix_forest.neighbours(vectors(spark, rows), F.col("id") % 10 == 0, effort=9.0))
    assert any(i == vector_blocks.NO_ID for _, _, i, _ in got)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expected])


def recall(spark, table):
    """Recall at ten of the registered search over a whole table, against brute force."""
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in table.collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = {}
    for r in prefix_forest.neighbours(table, F.col("id") % 100 == 0).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hit = wanted = 0
    for k in np.flatnonzero(ids % 100 == 0).tolist():
        d = np.sqrt(((x - x[k]) ** 2).sum(1))
        d[k] = np.inf
        true = ids[np.lexsort((ids, d))[:10]].tolist()
        got = found[ids[k]]
        assert len(got) == 10 and all(s == pytest.approx(d[ids == i][0]) for i, s in got.items())
        hit, wanted = hit + len(set(true) & got.keys()), wanted + 10
    return hit / wanted


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_prefix_forest_recall_on_tables(spark, size):
    path = f"/root/testdata/{size}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("the tables are not here")
    assert recall(spark, spark.read.parquet(path)) >= 0.9


def test_prefix_forest_measures_a_falling_share():
    rng = np.random.default_rng(3)
    shares = []
    for n in (1_000, 8_000):
        x = rng.normal(size=(n, 64))
        hasher = prefix_forest.Hasher(64, x[:1000])
        forest = prefix_forest.Forest.frombytes(prefix_forest.Forest.build(hasher, x).tobytes(), n)
        strings = hasher(x[::100])
        assert (forest.descend(strings) == prefix_forest.BITS).all()  # each is its own longest match
        share = prefix_forest.EFFORT * n ** (prefix_forest.POWER - 1)
        stops = np.array([prefix_forest.stop(c, -n * math.log1p(-share)) for c in forest.counts(strings)])
        assert (stops[:, 0] > 0).all()
        shares.append(np.mean([len(places) for _, places in forest.candidates(strings, stops[:, 0], stops[:, 1])]) / n)
        assert shares[-1] == pytest.approx(share, rel=0.25)
    assert shares[1] < 0.8 * shares[0]


def test_vector_searches_take_empty_tables(spark):
    none = vectors(spark, [])
    assert pivot_topk.top_k(none, F.col("id") % 100 == 0).collect() == []
    assert prefix_forest.neighbours(none, F.col("id") % 100 == 0).collect() == []


def test_language_model_counts(spark):
    rnd = random.Random(4)
    rows = HARD + [(100 + i, " ".join(rnd.choice("a b c d Ä the of".split()) for _ in range(rnd.randint(0, 40))), "en", "a") for i in range(120)]
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    column = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = documents(spark, rows)
    got = interpolated_lm.score(docs, column % 7 != 2, F.floor(column / 7) % 8 == 3, ["doc_id", "text"]).collect()
    split = lambda t: [w for w in (t or "").encode().lower().split()] + [b" "]
    counts = Counter(w for i, t, *_ in rows if crc(i) % 7 != 2 for w in split(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        words = split(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    held = [r for r in got if crc(r["doc_id"]) % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    empty = interpolated_lm.score(documents(spark, []), column % 7 != 2, column % 8 == 3, ["doc_id"])
    assert empty.collect() == []


def plain_language_model(rows, kinds):
    """The log10 probability of each text: deleted interpolation by EM over single held-out tokens."""
    begin, end = "<s>", "</s>"
    split = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [end]

    def tables(kinds_in):
        one, two, three = Counter(), Counter(), Counter()
        for (_, t, *_), kind in zip(rows, kinds, strict=True):
            if kind in kinds_in:
                words = [begin, begin, *split(t)]
                one[begin] += 1
                two[begin, begin] += 1
                one.update(words[2:])
                two.update(zip(words[1:], words[2:], strict=False))
                three.update(zip(words, words[1:], words[2:], strict=False))
        n = sum(v for w, v in one.items() if w != begin)
        return one, two, three, n, sum(w != begin for w in one)

    def parts(text, table):
        one, two, three, n, v = table
        words = [begin, begin, *split(text)]
        level = lambda c: min(interpolated_lm.BINS - 1, 1 + int(math.log2(c))) if c else 0
        for u, x, w in zip(words, words[1:], words[2:], strict=False):
            long, short = two[u, x], one[x]
            yield (level(long), level(short)), (three[u, x, w] / max(1, long), two[x, w] / max(1, short), (one[w] + 1) / (n + v + 1))

    even = lambda b, x: [y / sum(z * u for z, u in zip(x, (b[0] > 0, b[1] > 0, True), strict=True)) * u for y, u in zip(x, (b[0] > 0, b[1] > 0, True), strict=True)]
    estimates = tables({1})
    seen = [p for (_, t, *_), kind in zip(rows, kinds, strict=True) if kind == 2 for p in parts(t, estimates)]
    start = (0.4, 0.3, 0.3)
    weights = {}
    for _ in range(interpolated_lm.EM_ROUNDS):
        mass = {}
        for b, p in seen:
            w = weights.get(b) or even(b, start)
            total = sum(x * y for x, y in zip(w, p, strict=True))
            for k in range(3):
                mass.setdefault(b, list(even(b, start)))[k] += w[k] * p[k] / total
        weights = {b: even(b, m) for b, m in mass.items()}
    whole = tables({1, 2})
    return [sum(math.log10(sum(x * y for x, y in zip(weights.get(b) or even(b, start), p, strict=True))) for b, p in parts(t, whole)) for _, t, *_ in rows]


def test_language_model_scores_equal_a_plain_model(spark, monkeypatch):
    rnd = random.Random(23)
    vocabulary = "a b c d e f g h Ä the of and Word".split()
    rows = HARD[:4] + [(100 + i, " ".join(rnd.choice(vocabulary[: rnd.randint(2, 13)]) for _ in range(rnd.randint(0, 60))), "en", "a") for i in range(200)] + [(7, "the same row", "en", "a")] * 50
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    kinds = [0 if crc(i) % 7 == 2 else 2 if crc(i) // 7 % 8 == 3 else 1 for i, *_ in rows]
    expected = Counter()
    for r, s in zip(rows, plain_language_model(rows, kinds), strict=True):
        expected[r[0], r[1]] = s
    column = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    for chars in (interpolated_lm.CHUNK_CHARS, 200):  # the second: many chunks, and the repeated rows' dealt anew
        monkeypatch.setattr(interpolated_lm, "CHUNK_CHARS", chars)
        monkeypatch.setattr(interpolated_lm, "BUCKET_CHARS", 2 * chars)
        got = interpolated_lm.score(documents(spark, rows), column % 7 != 2, F.floor(column / 7) % 8 == 3, ["doc_id", "text"]).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["score"] == pytest.approx(expected[r["doc_id"], r["text"]], rel=0.005), r


def test_language_model_words_and_messages():
    texts = ["The\tthe  Ähm", "", "x" * 5_000 + " " + "x" * 5_001, "the", " \x0b\x0c", "ähm"]
    hashes, numbers = common.word_hashes(pa.array(["cut off", *texts]).slice(1))
    assert numbers.tolist() == [len(t.encode().split()) for t in texts]
    words = [w for t in texts for w in t.encode().lower().split()]
    assert len(hashes) == len(words) and len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
    many = [f"{a}{i}" for i in range(200_000) for a in ("w", "ab")]
    assert len(np.unique(common.word_hashes(pa.array([" ".join(many)]))[0])) == len(many)
    parts = interpolated_lm.pack([(np.array([3, 9], "u8"), np.array([1, 2], "u4"), np.array([0, 7], "u4"))] * 3, True)
    again = interpolated_lm.unpack(parts, True)
    assert again[2][0].tolist() == [3, 9] and again[0][2].tolist() == [0, 7]


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é日本</p>" * 60_000
    rows = [(3, "http://a", "x" * 120), (1, "http://b\r\nX: y", "x" * 120), (2, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", long), (8, "u", long), (None, "u", "x" * 120), (9, "u", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    folder = f"file://{tmp_path}/warc"
    index = warc_bundles.write(pages, folder)
    got = warc_bundles.read(index, folder).collect()
    assert len(got) == len(rows)
    texts = Counter((i, (t or "").encode()) for i, _, t in rows)
    for r in got:
        same = [t for i, _, t in rows if i == r["page_id"]]
        raw = (same[0] or "").encode()
        assert r["payload_digest"] == hashlib.sha256(raw).hexdigest() and r["payload_bytes"] == len(raw)
        first = {120: 1, len(long.encode()): 7}.get(len(raw)) if len(raw) >= 100 else None
        if first is None or r["page_id"] == first or raw.startswith(b"WARC"):
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, raw)
        else:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", first, None)
    assert sum(texts.values()) == len(got)
    import glob

    import zstandard

    whole = b""
    for path in glob.glob(f"{tmp_path}/warc/*.warc.zst"):  # any Zstandard reader takes a bundle: it passes over the seek table
        reader = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True)
        whole += reader.read()
    assert whole.count(b"WARC-Record-ID") == len(rows)
    assert warc_bundles.read(warc_bundles.write(pages.limit(0), folder), folder).collect() == []


def test_warc_has_one_response_where_rows_share_the_smallest_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_bundles, "READ_FRAMES", 2)
    rows = [(1, "http://b", "x" * 150), (1, "http://a", "x" * 150), (1, None, "y" * 150), (2, "u", "x" * 150), (2, "u", "x" * 150), (3, "u", "z" * 99), (3, "u", "z" * 99)]
    rows += [(10 + i % 50, "u", f"{i % 50}" * 20_000) for i in range(200)]
    folder = f"file://{tmp_path}/warc"
    index = warc_bundles.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_bundles.read(index, folder).collect())
    expected = Counter({(1, 150, "response", None): 2, (1, 150, "revisit", 1): 1, (2, 150, "revisit", 1): 2, (3, 99, "response", None): 2})
    for i in range(50):
        size = 20_000 * len(str(i))
        expected.update({(10 + i, size, "response", None): 1, (10 + i, size, "revisit", 10 + i): 3})
    assert got == expected


def test_quality_learns_and_covers_hard_rows(spark):
    rnd = random.Random(5)
    words = "the of and to in is that for it was".split()
    good = [(1000 + i, " ".join(rnd.choice(words) for _ in range(60)) + ".", "en", "a") for i in range(150)]
    bad = [(2000 + i, "### $$$ " * rnd.randint(5, 60), "en", "a") for i in range(60)]
    docs = documents(spark, HARD + good + bad)
    labels = spark.createDataFrame([(i, int(i < 2000), 0) for i, *_ in good + bad] + [(None, 1, 0), (1, None, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    machine = factor_quality.fit(docs, labels)
    got = factor_quality.score(docs, machine, keep=["doc_id", "text"]).collect()
    assert len(got) == len(HARD) + 210 and all(0 <= r["quality_score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] and r["doc_id"] >= 1000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((r["quality_score"] >= 0.3) == (r["doc_id"] < 2000) for r in held) >= 0.95 * len(held)
    assert {r["quality_score"] for r in factor_quality.score(docs, factor_quality.fit(docs, labels.limit(0))).collect()} == {factor_quality.PRIOR}
    assert factor_quality.score(docs.limit(0), machine).collect() == []


def test_quality_sample_passes_over_what_does_not_fit(spark, monkeypatch):
    assert factor_quality.within([5, 30, 4, 1, 9], 10) == [True, False, True, True, False]
    monkeypatch.setattr(factor_quality, "MAX_CHARS", 30_000)
    good = [(i, "the of and to in is that " * 4, "en", "a") for i in range(120)] + [(7, "the of and", "en", "a")] * 300  # an id repeated with many rows
    bad = [(1000 + i, "### $$$ " * 6, "en", "a") for i in range(120)]
    for long in range(2000, 2012):  # texts that are longer than the bound, wherever they are in the order
        good.append((long, "the of and " * 4_000, "en", "a"))
    labels = spark.createDataFrame([(str(i), int(i < 1000 or i >= 2000)) for i, *_ in good + bad], "doc_id string, quality int")
    docs = documents(spark, good + bad).withColumn("doc_id", F.col("doc_id").cast("string"))  # ids need not be numbers
    got = {r["doc_id"]: r["quality_score"] for r in factor_quality.score(docs, factor_quality.fit(docs, labels), keep=["doc_id"]).collect()}
    low, high = max(got[str(1000 + i)] for i in range(120)), min(got[str(i)] for i in range(120) if i != 7)
    assert low < 0.3 < 0.5 < high


def plain_quality(machine, text, n_chars):
    """The score of one text by a sum over all pairs of features."""
    bins = Counter(zlib.crc32(w) % factor_quality.BINS for w in text.encode().lower().split())
    values = {b: math.log1p(n) for b, n in bins.items()}
    norm = math.sqrt(sum(v * v for v in values.values())) or 1.0
    raw = text.encode()
    stats = factor_quality.structure(text, raw, raw.lower().split(), len(bins), max(bins.values(), default=0), n_chars)
    x = {b: v / norm for b, v in values.items()}
    x |= {factor_quality.BINS + j: float(np.clip((s - m) / d, -4, 4) / 2) for j, (s, m, d) in enumerate(zip(stats, machine.mean, machine.scale, strict=True))}
    z = machine.w0 + sum(machine.w[i] * v for i, v in x.items())
    keys = sorted(x)
    z += sum(float(machine.v[a] @ machine.v[b]) * x[a] * x[b] for k, a in enumerate(keys) for b in keys[k + 1 :])
    return 1 / (1 + math.exp(-z))


def test_quality_scores_equal_a_sum_over_pairs(spark):
    rnd = random.Random(15)
    texts = [" ".join(rnd.choice("the of and $$$ Word word. x9".split()) for _ in range(rnd.randint(0, 30))) for _ in range(60)] + ["", "A\nA\n!!"]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int("$$$" not in t)) for i, t in enumerate(texts)], "doc_id long, quality int")
    machine = factor_quality.fit(docs, labels)
    assert machine.constant is None
    for r in factor_quality.score(docs, machine, keep=["doc_id"]).collect():
        assert r["quality_score"] == pytest.approx(plain_quality(machine, texts[r["doc_id"]], len(texts[r["doc_id"]])), rel=1e-6)


def test_factorisation_identity():
    rng = np.random.default_rng(6)
    m = factor_quality.Machine()
    m.constant, m.w, m.v = None, rng.normal(size=m.w.shape), rng.normal(size=m.v.shape)
    idx, x, counts = np.array([3, 7, 11, 2, 5]), rng.normal(size=5), np.array([3, 2])
    z, _ = m.logits(idx, x, counts)
    for k, part in enumerate((range(3), range(3, 5))):
        pairs = sum(m.v[idx[i]] @ m.v[idx[j]] * x[i] * x[j] for i in part for j in part if i < j)
        assert z[k] == pytest.approx(m.w0 + sum(m.w[idx[i]] * x[i] for i in part) + pairs)


def test_kd_shards_hold_everything_once(spark):
    rnd = random.Random(7)
    rows = HARD + [(100 + i, "w" * rnd.randint(0, 400), rnd.choice(["en", "fr", None]), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3_000)]
    docs = documents(spark, rows)
    got = kd_shards.shard(docs, 10).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(10))
    even = [(i, "w" * 50, "en", "a") for i in range(2_000)]
    even_sizes = Counter(r["shard"] for r in kd_shards.shard(documents(spark, even), 7).collect())
    assert max(even_sizes.values()) - min(even_sizes.values()) <= 12
    assert kd_shards.shard(documents(spark, []), 10).collect() == []


def test_kd_shards_part_equal_rows_evenly(spark):
    """300 equal rows among 598 others, and nothing but equal rows: every shard is within a row or two of the mean."""
    rnd = random.Random(17)
    rows = [(1, "x" * 200, "en", "a")] * 300 + [(10 + i, "y" * rnd.randint(0, 100), "en", "b") for i in range(598)]
    for some, shards in ((rows, 10), (rows[:300], 8), ([(None, None, None, None)] * 90, 4)):
        sizes = Counter()
        for r in kd_shards.shard(documents(spark, some), shards).collect():
            sizes[r["shard"]] += r["size"]
        mean = sum(sizes.values()) / shards
        assert len(sizes) == shards and max(abs(v - mean) for v in sizes.values()) <= 2 * 216


def test_kd_tree_splits_at_weighted_medians_of_the_widest_dimension(spark):
    """One split, against brute force: the widest dimension, and the place in it that is nearest to half the weight."""
    rnd = random.Random(18)
    rows = [(rnd.randint(1, 50), rnd.uniform(0, 1), rnd.uniform(0.4, 0.6) if k else 0.0, k) for k in range(500)]
    rows[1] = (5, 0.5, 1.0, 1)
    made = kd_shards.keyed(spark.createDataFrame([(w, a, b, 0, k) for w, a, b, k in rows], "size long, a double, b double, tie long, place long"), ["a", "b"])
    placed = kd_shards.grow(made, "size", 2).collect()
    low = {r["place"] for r in placed if r["node"] == 0}
    order = sorted(range(500), key=lambda k: (rows[k][1], k))
    prefix = set(order[: len(low)])
    assert low == prefix  # both are as wide at twelve bits; the first goes before
    half = sum(r[0] for r in rows) / 2
    assert abs(sum(rows[k][0] for k in low) - half) <= 50


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= 3 and root(a) != root(b):
                parent[root(b)] = root(a)
    return {v: root(v) for v in values}


def test_simhash_matches_brute_force(spark):
    rnd = random.Random(8)
    rows = list(HARD)
    for g in range(25):
        base = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(1, 120))]
        for k in range(rnd.randint(1, 8)):
            words = list(base)
            for _ in range(k % 3):
                words[rnd.randrange(len(words))] = "zz"
            rows.append((1000 + g * 10 + k, " ".join(words), "en", "a"))
    got = simhash_dedup.near_duplicates(documents(spark, rows)).collect()
    fp = {id(r): plain_fingerprint(r[1]) for r in rows}
    roots = plain_components(set(fp.values()))
    least = {}
    for r in rows:
        if r[0] is not None:
            k = roots[fp[id(r)]]
            least[k] = min(least.get(k, r[0]), r[0])
    expected = Counter((r[0], fp[id(r)], least.get(roots[fp[id(r)]])) for r in rows)
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == expected
    kept = Counter(roots[plain_fingerprint(r["text"])] for r in simhash_dedup.keep_one(documents(spark, rows)).collect())
    assert kept == Counter(set(roots.values()))
    assert simhash_dedup.near_duplicates(documents(spark, [])).collect() == []


def test_keep_one_goes_by_rows(spark):
    a, b, c = "one two three four five six", "alpha beta gamma delta", "uno dos tres cuatro"
    rows = [(5, a, "en", "s"), (7, a, "en", "s"), (3, b, "en", "s"), (5, b, "en", "s"), (None, c, "en", "s"), (None, c, "fr", "s"), (8, c, "en", "t"), (8, c, "en", "t"), (None, None, None, None), (9, "lone text of its own", "en", "s")]
    kept = simhash_dedup.keep_one(documents(spark, rows))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(5, a), (3, b), (8, c), (0, ""), (9, "lone text of its own")])
    assert kept.columns == documents(spark, rows).columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash_dedup.keep_one(documents(spark, rows), similarity=0.8).collect()) == sorted([(5, a), (3, b), (8, c), (0, ""), (9, "lone text of its own")])
    assert simhash_dedup.keep_one(documents(spark, [])).collect() == []


def test_links_connect_random_near_bits_and_large_buckets(spark, monkeypatch):
    rnd = random.Random(9)
    values = {0}
    for _ in range(60):
        base = rnd.getrandbits(64)
        values.add(base)
        for _ in range(rnd.randint(0, 6)):
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                base ^= 1 << b
            values.add(base)
    values |= {(1 << 40) * k for k in range(300)}  # one large bucket of the low half
    monkeypatch.setattr(simhash_dedup, "BLOCK", 32)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash_dedup.components(simhash_dedup.links(spark.createDataFrame(signed, "fp long"))).collect()}
    expected = plain_components(values)
    groups = lambda m: {frozenset(v for v in values if m(v) == k) for k in {m(v) for v in values}}
    assert groups(lambda v: roots.get(v, v)) == groups(expected.get)


def test_language_id(spark):
    rnd = random.Random(10)
    own = {"en": "the of and tion ing with".split(), "fr": "le de la que eaux ment".split(), "de": "der die und ung keit schaft".split()}
    rows = [(1000 + i, " ".join("".join(rnd.choices(own[lang], k=rnd.randint(1, 2))) for _ in range(30)), lang, "a") for i in range(240) for lang in [rnd.choice(list(own))]]
    docs = documents(spark, HARD + rows)
    languages = segment_langid.fit(docs, MODEL)
    assert languages.names == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in segment_langid.identify(docs, languages, ["doc_id", "text"]).collect() if r["doc_id"] is not None}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in held) >= 0.97 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0 for i in (2, 3, 4))
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    none = segment_langid.fit(documents(spark, []), MODEL)
    assert {r["lang_pred"] for r in segment_langid.identify(docs, none, ["doc_id"]).collect()} == {"und"}
    assert segment_langid.identify(docs.limit(0), languages, ["doc_id"]).collect() == []


def plain_segmentations(model, pieces, word):
    """(probability, pieces) of each segmentation of the word."""
    if not word:
        return [(1.0, [])]
    found = []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces or k == 1:
            p = model.theta[pieces.index(word[:k]), 0] if word[:k] in pieces else segment_langid.UNKNOWN
            found += [(p * q, [word[:k], *rest]) for q, rest in plain_segmentations(model, pieces, word[k:])]
    return found


def test_forward_sums_all_segmentations(monkeypatch):
    pieces = ["▁", "a", "b", "ab", "▁a", "bab"]
    words = ["abab", "bab", "aéb", "b", "abababab"]
    for rescale in (32, 2):
        monkeypatch.setattr(segment_langid, "RESCALE", rescale)
        model = segment_langid.Languages(pieces, ["x"])
        model.theta[:-1, 0] = np.arange(1, 7) / 30
        for w in words:
            assert model.log_words([w])[0, 0] == pytest.approx(math.log(sum(p for p, _ in plain_segmentations(model, pieces, "▁" + w))))
        expected = np.full(len(pieces), 1e-2)
        for w, n in zip(words, (3, 1, 2, 5, 4), strict=True):
            ways = plain_segmentations(model, pieces, "▁" + w)
            for p, parts in ways:
                for piece in parts:
                    if piece in pieces:
                        expected[pieces.index(piece)] += n * p / sum(q for q, _ in ways)
        model.fit(words, np.array([[3.0], [1], [2], [5], [4]]), iterations=1)
        assert model.theta[:-1, 0] == pytest.approx(expected / expected.sum())


def test_long_words_have_all_their_segmentations():
    """Words far beyond a double's range, against a recursion over logarithms; a piece may be of any length."""
    pieces = ["▁", "a", "b", "ab", "▁a", "bab", "abba" * 7]
    model = segment_langid.Languages(pieces, ["x"])
    model.theta[:-1, 0] = np.arange(1, 8) / 3_000
    rnd = random.Random(13)
    for word in ("abba" * 40, "".join(rnd.choice("ab") for _ in range(700)), "ab" * 2_000):
        text, log = "▁" + word, [0.0]
        for end in range(1, len(word) + 2):
            ways = [log[end - len(p)] + math.log(model.theta[i, 0]) for i, p in enumerate(pieces) if end >= len(p) and text[end - len(p) : end] == p]
            log.append(float(np.logaddexp.reduce(ways)))
        assert model.log_words([word])[0, 0] == pytest.approx(log[-1])


def test_words_are_letters_with_their_marks():
    assert segment_langid.words_of("½ ² ① 12 _ ، 3rd") == ["rd"]
    assert segment_langid.words_of("हिन्दी Don't l’été É́x ٣") == ["हिन्दी", "don't", "l’été", "é́x"]


def test_codec_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(11)
    pieces = [sp.id_to_piece(i) for i in range(259, 32_000)]
    texts = [t for _, t, *_ in HARD] + ["a" * 3_000, "ab" * 999, " " * 70 + "x" + " " * 33, "▁a ▁▁", "<0x0A></s>"] + ["".join(rnd.choices(pieces, k=20)).replace("▁", " ") for _ in range(300)] + ["".join(rnd.choices("ab  \n\té▁日𝒳thein<0>\x00　aaaa", k=rnd.randint(0, 60))) for _ in range(700)]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    got = {r["doc_id"]: r for r in piece_codec.digest_documents(docs, MODEL, ["doc_id"]).collect()}
    real = {r["doc_id"]: r for r in piece_codec.encode_documents(docs, MODEL, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        ids = [*sp.encode(t or ""), 2]
        assert (real[i]["ids"], real[i]["decoded"]) == (ids, sp.decode(ids))
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    codec = piece_codec.PieceCodec(piece_codec.read_model(MODEL))
    for _ in range(500):
        ids = [rnd.choice([rnd.randint(0, 31_999), rnd.randint(3, 258)]) for _ in range(rnd.randint(0, 8))]
        assert codec.decode(ids) == sp.decode(ids)


def test_long_units_equal_the_library_in_linear_time():
    """Units without spaces, of all kinds, against the library; rounds must not grow with the length."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = piece_codec.PieceCodec(piece_codec.read_model(MODEL))
    rnd = random.Random(19)
    pieces = [p for i in range(259, 32_000) if SPACE not in (p := sp.id_to_piece(i))]
    odd = [p for p in pieces if not codec.safe[codec.symbols[p]]]
    assert odd
    texts = ["".join(rnd.choices(letters, k=rnd.randint(49, 4_000))) for letters in ("etaoin", "abcdefghijklmnopqrstuvwxyz", "ab", "aab", "ABCabc0189+/", "的是不了人我", "é́日\x00x") for _ in range(30)]
    texts += ["".join(rnd.choices(pieces, k=rnd.randint(10, 400))) for _ in range(150)] + ["".join(rnd.choices(odd, k=rnd.randint(30, 300))) for _ in range(150)]
    texts += ["".join(rnd.choices(odd, k=rnd.randint(1, 4))) * rnd.randint(20, 80) for _ in range(300)] + [c * n for c in "a-=_ \n0é日" for n in (49, 50, 333, 2_048)]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == [*sp.encode(t), 2], t[:80]
    rounds = []
    for n in (4_000, 64_000):
        text, calls = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n)), []
        lowest = codec._lowest
        codec._lowest = lambda *a, calls=calls, lowest=lowest: calls.append(1) or lowest(*a)
        codec.merge_long([SPACE + text])
        codec._lowest = lowest
        rounds.append(len(calls) / 2)
    assert rounds[1] <= 2 * rounds[0] + 10


def test_mixing_meets_targets(spark, monkeypatch):
    rows = HARD + [(100 + i, "w" * 100, "en", "hot" if i % 3 else f"s{i % 5}") for i in range(6_000)]
    docs = documents(spark, rows)
    got = poisson_mix.mix(docs, {"hot": 1.0, "s0": 40.0, "s1": 1.0}, total=2.0)
    assert set(docs.columns) < set(got.columns)
    sizes = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum("n_chars").alias("n")).collect()}
    total = sum(len(t or "") for _, t, *_ in rows) * 2
    assert set(sizes) == {"hot", "s0", "s1"}
    for source, share in (("hot", 1 / 42), ("s0", 40 / 42), ("s1", 1 / 42)):
        assert sizes[source] == pytest.approx(total * share, rel=0.15)
    again = poisson_mix.mix(docs.repartition(7), {"hot": 1.0, "s0": 40.0, "s1": 1.0}, total=2.0)
    key = lambda d: Counter((r["doc_id"], r["mix_copy"]) for r in d.select("doc_id", "mix_copy").collect())
    assert key(got) == key(again)
    counts = Counter(r["doc_id"] for r in poisson_mix.mix(documents(spark, [(i, "w", "en", "a") for i in range(20_000)])).collect())
    for k in range(4):
        assert sum(counts.get(i, 0) == k for i in range(20_000)) / 20_000 == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.015)
    named = docs.select("doc_id", "source", "n_chars", *(F.lit(f"own {c}").alias(c) for c in ("rate", "src", "parts", "terms", "salt", "place", "copy", "key", "mix_key", "id_text", "a.b")))
    clash = poisson_mix.mix(named, {"hot": 1.0, "s0": 40.0, "s1": 1.0}, total=2.0)
    assert key(clash) == key(got) and set(named.columns) < set(clash.columns)
    assert {r["rate"] + r["src"] + r["salt"] + r["a.b"] for r in clash.collect()} == {"own rateown srcown saltown a.b"}
    monkeypatch.setattr(poisson_mix, "BROADCAST_SOURCES", 0)
    assert key(poisson_mix.mix(named, {"hot": 1.0, "s0": 40.0, "s1": 1.0}, total=2.0)) == key(got)
    assert poisson_mix.mix(documents(spark, [])).collect() == []
    assert poisson_mix.mix(documents(spark, [(1, None, None, None)])).collect() == []
