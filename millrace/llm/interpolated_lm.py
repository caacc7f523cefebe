"""Language-model scores by deleted interpolation of trigrams, bigrams and unigrams.

p(w | u v) = l3 * c(u v w)/c(u v) + l2 * c(v w)/c(v) + l1 * (c(w)+1)/(N+V+1), with weights l by the bucket of the context:
the binary logarithms of c(u v) and of c(v). Weights are learned by expectation-maximisation on held-out counts: a part of the
training documents (fold EM) is left out of the maximum-likelihood estimates while the weights are learned, and
counted with the others in the final model.

Counting and looking up are one round trip. Documents are dealt by a hash to chunks of about CHUNK_CHARS characters. A chunk sends the sorted
keys of its distinct n-grams, with their counts, to buckets of the key space; a bucket adds up the counts of all chunks and
answers each chunk with the totals of its keys in the order they came, so no key travels back. Scoring deals
the documents to the same chunks and reads the totals beside them. All n-grams of all documents are counted, none is
pruned; a key that every chunk holds is one key a chunk, so frequent words need no salting.

A word's key is a hash of 64 bits of its bytes, worked out for all words of a chunk at once; n words have n * n / 2**65 colliding pairs to be
expected, so counts of tokens, and with them n_known and base_score, are exact short of 10**9 distinct words. Keys of longer n-grams are most of
what is shuffled; they have as many bits as leave some dozens of colliding pairs to be expected among n n-grams (2 log2(n) - 6, at
most 64: from about 3 * 10**10 n-grams on more of them collide, each with few others). Weights are learned from the sums of held-out tokens in cells
of bucket and the octaves of the three probabilities; the README states how far scores are from those of an EM over single tokens.

A chunk that repeated rows make large (their ids and texts, and so their hashes, are the same) is dealt anew by places in a table of its rows. The
number of tasks follows the number of chunks and of buckets. Null texts are empty and score their end alone; repeated rows count and
score as often as they stand. With no training documents every score is that of N = V = 0.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, mix, segment_sums, word_hashes
from millrace.session import ship

CHUNK_CHARS = 6_000_000
#: A bucket of the key space gets the n-grams of about so many characters.
BUCKET_CHARS = 10_000_000
EM_ROUNDS = 40
#: A chunk of more than so many times CHUNK_CHARS is dealt anew.
HOT_CHUNK = 3
#: Numbers of such chunks that are broadcast at most.
BROADCAST_CHUNKS = 100_000
BEGIN, END = 1, 2  # word hashes are above them
BINS = 24


def _bits(bits: int, order: int) -> int:
    """Bits of the keys of an order, 0 for unigrams."""
    return bits if order else 64


class Grams:
    """The n-grams of some documents: keys of tokens, of bigrams and of trigrams, by position."""

    def __init__(self, texts: pa.Array, bits: int):
        found, lengths = word_hashes(texts)
        self.tokens = lengths + 1
        total = lengths + 3
        ends = np.cumsum(total)
        flat = np.zeros(int(total.sum()), dtype=np.uint64)
        flat[ends - total] = flat[ends - total + 1] = BEGIN
        flat[ends - 1] = END
        inner = np.ones(len(flat), dtype=bool)
        inner[np.r_[ends - total, ends - total + 1, ends - 1]] = False
        flat[inner] = found
        doc = np.repeat(np.arange(len(texts)), total)
        first = np.zeros(len(flat), dtype=bool)
        first[ends - total] = True
        token = ~first
        token[ends - total + 1] = False
        one = np.where(flat <= END, flat, np.maximum(flat >> np.uint64(64 - _bits(bits, 0)), END + 1))
        two = np.zeros(len(flat), dtype=np.uint64)
        two[1:] = mix(flat[:-1], flat[1:]) >> np.uint64(64 - bits)
        three = np.zeros(len(flat), dtype=np.uint64)
        three[2:] = mix(mix(flat[:-2], flat[1:-1]), flat[2:] + np.uint64(7)) >> np.uint64(64 - bits)
        # BEGIN counts once a document as the context of its first word, so of its two places one is left out.
        one_at = ~first
        self.at = np.flatnonzero(token)
        self.sets, self.inverse, self.doc = [], [], []
        for keys, where in ((one, one_at), (two, ~first), (three, token)):
            found, inverse = np.unique(keys[where], return_inverse=True)
            place = np.full(len(flat), -1)
            place[where] = inverse
            self.sets.append(found)
            self.inverse.append(place)
            self.doc.append(doc[where])
        self.where = [one_at, ~first, token]

    def counts(self, weight: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each distinct n-gram in documents of weight 1."""
        return [np.bincount(p[w], weight[d], len(s)).astype(np.uint32) for p, w, d, s in zip(self.inverse, self.where, self.doc, self.sets, strict=True)]

    def token_counts(self, totals: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """c(w), c(v), c(v w), c(u v), c(u v w) at each token."""
        one, two, three = self.inverse
        at = self.at
        return totals[0][one[at]], totals[0][one[at - 1]], totals[1][two[at]], totals[1][two[at - 1]], totals[2][three[at]]


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplane(raw: memoryview, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(kind).reshape(n)


def pack(parts: list[tuple[np.ndarray, ...]], keyed: bool) -> bytes:
    """Arrays of each order, keys (sorted) as differences, every array as byte planes, compressed."""
    out = [struct.pack(f"<{len(parts)}I", *(len(p[0]) for p in parts))]
    for part in parts:
        if keyed:
            out.append(_planes(np.diff(part[0], prepend=np.uint64(0))))
        out += [_planes(x.astype(np.uint32)) for x in part[keyed:]]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(raw: bytes, keyed: bool, arrays: int = 2) -> list[list[np.ndarray]]:
    plain = memoryview(zstandard.ZstdDecompressor().decompress(raw))
    sizes, at, out = struct.unpack_from("<3I", plain), 12, []
    for n in sizes:
        part = []
        if keyed:
            part.append(np.cumsum(_unplane(plain[at:], n, "u8"), dtype=np.uint64))
            at += 8 * n
        for _ in range(arrays):
            part.append(_unplane(plain[at:], n, "u4"))
            at += 4 * n
        out.append(part)
    return out


def _parts_by_bucket(counts: list[tuple[np.ndarray, ...]], buckets: int, bits: int):
    """(bucket, parts) of each bucket that has keys: the key space of each order, sorted, cut evenly by its top 32 bits."""
    cuts = []
    for k, part in enumerate(counts):
        of = ((part[0] >> np.uint64(_bits(bits, k) - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        found, first = np.unique(of, return_index=True)
        cuts.append(dict(zip(found.tolist(), zip(first.tolist(), np.r_[first[1:], len(of)].tolist(), strict=True), strict=True)))
    for b in sorted(set().union(*cuts)):
        yield b, [tuple(x[slice(*c.get(b, (0, 0)))] for x in part) for part, c in zip(counts, cuts, strict=True)]


def dealt(docs: DataFrame, id_col: str, text_col: str, training: Column, em: Column, keep: list[str]) -> tuple[DataFrame, int, int]:
    """(chunk, c0.. of keep, t, kind) of every row, the number of buckets and the bits of a key; kind 0 is scored only, 1 estimates, 2 is held out for the weights."""
    kind = F.when(training & em, 2).when(training, 1).otherwise(0)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(keep)), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"), kind.alias("kind"), F.col(f"`{id_col}`").alias("i"))
    chars = rows.agg(F.sum(F.length("t") + 1)).first()[0] or 0
    chunks = max(1, -(-chars // CHUNK_CHARS))
    h = F.xxhash64("i", F.crc32(F.col("t").cast("binary")))
    few = max(1, -(-chunks // 6))
    # A chunk has rows of one kind: its counts pack well, and the weights can be learned from the held-out ones alone.
    chunk = F.pmod(h, F.when(F.col("kind") == 1, chunks).otherwise(few)) * 3 + F.col("kind")
    bits = min(64, max(40, math.ceil(2 * math.log2(chars / 3 + 2)) - 6))
    columns = [*(f"c{j}" for j in range(len(keep))), "t", "kind"]
    rows = rows.select(chunk.cast("long").alias("chunk"), *columns)
    sizes = rows.groupBy("chunk").agg(F.sum(F.length("t") + 1).alias("chars"), F.count("t").alias("n")).filter((F.col("chars") > HOT_CHUNK * CHUNK_CHARS) & (F.col("n") > 1))
    hot = cut(sizes.select("chunk", F.ceil(F.col("chars") / CHUNK_CHARS).alias("parts")), "lm-hot-chunks")
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_CHUNKS else hot
        # Both times that the rows are read they must be dealt alike: their places are those in a table.
        apart = cut(rows.join(hot, "chunk").withColumn("place", F.monotonically_increasing_id()), "lm-hot-rows")
        anew = ((F.floor(F.col("chunk") / 3) + chunks * (1 + F.pmod(F.xxhash64("place"), "parts"))) * 3 + F.col("kind")).alias("chunk")
        rows = rows.join(hot, "chunk", "left_anti").unionAll(apart.select(anew, *columns))
    return rows, max(1, -(-chars // BUCKET_CHARS)), bits


def totals(rows: DataFrame, tasks: int, buckets: int, bits: int) -> DataFrame:
    """(chunk, bucket, payload, n, nt, v): each chunk's totals by bucket, and each bucket's tokens, estimating tokens and distinct tokens."""
    def ask(table: pa.Table) -> pa.Table:
        grams = Grams(table.column("t").combine_chunks(), bits)
        kind = table.column("kind").to_numpy()
        counts = list(zip(grams.sets, grams.counts((kind == 1).astype(float)), grams.counts((kind == 2).astype(float)), strict=True))
        where, payloads = [], []
        for b, parts in _parts_by_bucket(counts, buckets, bits):
            where.append(b)
            payloads.append(pack(parts, True))
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array(where, pa.int64()), "chunk": pa.array([chunk] * len(where), pa.int64()), "payload": pa.array(payloads, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpack(p.as_py(), True) for p in table.column("payload")]
        replies: list[list] = [[] for _ in asked]
        n = nt = v = 0
        for k in range(3):
            keys = np.concatenate([a[k][0] for a in asked])
            found, inverse = np.unique(keys, return_inverse=True)
            est = np.bincount(inverse, np.concatenate([a[k][1] for a in asked]), len(found))
            out = np.bincount(inverse, np.concatenate([a[k][2] for a in asked]), len(found))
            if k == 0:
                real = found != BEGIN
                n, nt, v = int((est + out)[real].sum()), int(est[real].sum()), int(((est + out)[real] > 0).sum())
            at = 0
            for a, r in zip(asked, replies, strict=True):
                mine = inverse[at : at + len(a[k][0])]
                at += len(a[k][0])
                r.append((est[mine], (est + out)[mine]))
        kinds = [chunk % 3 for chunk in table.column("chunk").to_pylist()]
        replies = [r if kind == 2 else [(every,) for _, every in r] for kind, r in zip(kinds, replies, strict=True)]
        m = len(asked)
        return pa.table({
            "chunk": table.column("chunk"), "bucket": table.column("bucket"), "payload": pa.array([pack(r, False) for r in replies], pa.binary()),
            "n": pa.array([n] + [0] * (m - 1), pa.int64()), "nt": pa.array([nt] + [0] * (m - 1), pa.int64()), "v": pa.array([v] + [0] * (m - 1), pa.int64()),
        })

    chunks = rows.select("chunk", "t", "kind").repartition(tasks, "chunk")
    asked = chunks.groupBy("chunk").applyInArrow(ask, "bucket long, chunk long, payload binary")
    return cut(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, payload binary, n long, nt long, v long"), "lm-totals")


def _read(table: pa.Table) -> list[list[np.ndarray]]:
    """Totals of each order, aligned with a chunk's sorted keys: all, and before them, for held-out chunks, the estimating ones."""
    arrays = 2 if table.column("chunk")[0].as_py() % 3 == 2 else 1
    got = sorted(zip(table.column("bucket").to_pylist(), table.column("payload"), strict=True), key=lambda x: x[0])
    parts = [unpack(p.as_py(), False, arrays) for _, p in got]
    return [[np.concatenate([p[k][j] for p in parts]).astype(np.float64) for k in range(3)] for j in range(arrays)]


def _bin(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(BINS - 1, 1 + np.floor(np.log2(np.maximum(c, 1)))), 0).astype(np.int64)


def _parts(counts: tuple[np.ndarray, ...], n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """p3, p2, p1 and the context bucket at each token."""
    w, ctx1, vw, ctx2, uvw = counts
    return uvw / np.maximum(ctx2, 1), vw / np.maximum(ctx1, 1), (w + 1) / (n + v + 1), _bin(ctx2) * BINS + _bin(ctx1)


def learn_weights(rows: DataFrame, answers: DataFrame, tasks: int, nt: int, v: int, bits: int) -> np.ndarray:
    """(BINS * BINS, 3) weights of p3, p2, p1 by bucket."""
    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["bucket", "q3", "q2", "q1", "n", "p3", "p2", "p1"]
        if not left.num_rows:
            return pa.table({x: pa.array([], pa.float64() if x[0] == "p" else pa.int64()) for x in names})
        grams = Grams(left.column("t").combine_chunks(), bits)
        p3, p2, p1, bucket = _parts(grams.token_counts(_read(right)[0]), nt, v)
        octave = lambda p: np.where(p > 0, np.floor(np.log2(np.maximum(p, 1e-300))), -10_000).astype(np.int64)
        found, inverse, n = np.unique(np.stack([bucket, octave(p3), octave(p2), octave(p1)]), axis=1, return_inverse=True, return_counts=True)
        sums = [np.bincount(inverse.reshape(-1), p, len(n)) for p in (p3, p2, p1)]
        return pa.table(dict(zip(names, [*map(pa.array, found), pa.array(n, pa.int64()), *map(pa.array, sums)], strict=True)))

    held = rows.filter("kind = 2").select("chunk", "t")
    schema = "bucket long, q3 long, q2 long, q1 long, n long, p3 double, p2 double, p1 double"
    # Cells are octaves of the three probabilities, so their number is bounded, whatever the corpus is; a cell stands for its means.
    tasks = max(1, -(-tasks // 6))
    made = held.repartition(tasks, "chunk").groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(cells, schema)
    found = made.groupBy("bucket", "q3", "q2", "q1").agg(*(F.sum(x).alias(x) for x in ("n", "p3", "p2", "p1"))).toPandas()
    start = np.array([0.4, 0.3, 0.3])
    weights = np.tile(start, (BINS * BINS, 1))
    usable = np.stack([np.arange(BINS * BINS) // BINS > 0, np.arange(BINS * BINS) % BINS > 0, np.ones(BINS * BINS, dtype=bool)], axis=1)
    weights = weights * usable / (weights * usable).sum(1, keepdims=True)
    if len(found):
        p = found[["p3", "p2", "p1"]].to_numpy() / found[["n"]].to_numpy()
        b, n = found["bucket"].to_numpy(), found["n"].to_numpy().astype(float)
        prior = weights.copy()
        for _ in range(EM_ROUNDS):
            part = weights[b] * p
            part *= (n / np.maximum(part.sum(1), 1e-300))[:, None]
            mass = np.stack([np.bincount(b, part[:, k], BINS * BINS) for k in range(3)], axis=1) + prior
            weights = mass * usable / (mass * usable).sum(1, keepdims=True)
    return weights


def score(docs: DataFrame, training: Column, em: Column, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns keep of every row with n_tokens, n_known, train_tokens, base_score and score (log10)."""
    ship(docs.sparkSession)
    rows, buckets, bits = dealt(docs, id_col, text_col, training, em, keep)
    tasks = -(-buckets * BUCKET_CHARS // CHUNK_CHARS)
    answers = totals(rows, tasks, buckets, bits)
    sums = answers.agg(F.sum("n").alias("n"), F.sum("nt").alias("nt"), F.sum("v").alias("v")).first()
    n, nt, v = sums["n"] or 0, sums["nt"] or 0, sums["v"] or 0
    answers = answers.select("chunk", "bucket", "payload")
    chosen = learn_weights(rows, answers.filter("chunk % 3 = 2"), tasks, nt, v, bits)
    held = docs.sparkSession.sparkContext.broadcast(chosen)  # BINS * BINS rows
    k = len(keep)
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select([f"c{j}" for j in range(k)]).append_column("n_tokens", pa.array([], pa.int64())).append_column("n_known", pa.array([], pa.int64())).append_column("base_score", pa.array([], pa.float64())).append_column("score", pa.array([], pa.float64()))
        grams = Grams(left.column("t").combine_chunks(), bits)
        counts = grams.token_counts(_read(right)[-1])
        p3, p2, p1, bucket = _parts(counts, n, v)
        weights = held.value[bucket]
        logs = np.log10(weights[:, 0] * p3 + weights[:, 1] * p2 + weights[:, 2] * p1)
        out = left.select([f"c{j}" for j in range(k)])
        for name, x in (("n_tokens", grams.tokens), ("n_known", segment_sums((counts[0] > 0).astype(np.int64), grams.tokens)), ("base_score", segment_sums(np.log10(p1), grams.tokens)), ("score", segment_sums(logs, grams.tokens))):
            out = out.append_column(name, pa.array(x))
        return out

    schema = ", ".join([*(f"c{j} {t}" for j, t in enumerate(kinds)), "n_tokens long, n_known long, base_score double, score double"])
    made = rows.drop("kind").repartition(tasks, "chunk").groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(scores, schema)
    return made.toDF(*keep, "n_tokens", "n_known", "base_score", "score").withColumn("train_tokens", F.lit(n).cast("long"))
