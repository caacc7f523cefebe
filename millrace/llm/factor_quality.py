"""Quality scores from a factorisation machine over hashed words, structure statistics and metadata.

Features of a document: its hashed words with x = log(1 + tf), scaled to length 1; STATS structure statistics of the
whole text, each standardised on the training rows and clipped; and the metadata column n_chars set against the text.
Score: sigmoid(w0 + w.x + 1/2 sum_f ((V_f.x)^2 - V_f^2.x^2)), the sum-of-squares identity, linear in the features.

The machine is fitted on the driver on a bounded sample: the labelled training rows of lowest hash, at most MAX_ROWS rows (repeats of
an id included), whose whole texts have at most MAX_CHARS characters together; a text that no longer fits is passed over, and
those behind it are still taken. Everything else covers all rows and whole texts.

Null texts score as empty ones. Without usable labels every score is PRIOR; with one class alone it is that class's
smoothed rate. A doc_id with several labels counts once with their mean, rounded half up.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, map_texts, segment_sums

BINS = 1 << 15
FACTORS = 8
MAX_ROWS = 5_000
MAX_CHARS = 40_000_000
PRIOR = 0.5
THRESHOLD = 0.3
#: Words whose bin a worker remembers.
REMEMBERED = 150_000
STATS = 18
_MARKS = re.compile(rb"[^\s\w\x80-\xff]")
_REPEATED_MARK = re.compile(rb"([!-/:-@\[-`{-~])\1")


def structure(text: str, raw: bytes, words: list[bytes], n_distinct: int, top: int, n_chars: float) -> list[float]:
    """STATS numbers of one whole text; all are 0 to about 1 or logarithms."""
    n, size = len(words), max(1, len(raw))
    upper = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = size - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    digits = size - len(raw.translate(None, b"0123456789"))
    spaces = size - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    marks = size - len(raw.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    stops = raw.count(b".") + raw.count(b",")
    odd = size - len(raw.translate(None, b"#$%&*|~<>{}[]\\^=+@_"))
    shouts = raw.count(b"!") + raw.count(b"?")
    doubled = len(_REPEATED_MARK.findall(raw))
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip()]
    alike = sum(a == b for a, b in zip(words, words[1:], strict=False))
    m = max(1, n)
    known = n_chars is not None and np.isfinite(n_chars)
    return [
        np.log1p(len(text)), np.log1p(n), len(raw) / m / 10, n_distinct / m, top / m, alike / m,
        upper / size, lower / size, digits / size, spaces / size, marks / size, stops / size,
        odd / size, shouts / size, doubled / m, 1 - len(set(full)) / max(1, len(full)), np.log1p(len(full)),
        float(np.log1p(max(0.0, n_chars)) - np.log1p(len(text))) if known else 0.0,
    ]


class Featurizer:
    """Word bins with their values, and statistics, of texts."""

    def __init__(self):
        self.bins: dict[bytes, int] = {}

    def __call__(self, texts: list[str], n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bins, values, number of bins of each text, statistics)."""
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        words = [r.lower().split() for r in raws]
        if len(self.bins) > REMEMBERED:
            self.bins.clear()
        bins = self.bins
        for w in set().union(*words) - bins.keys():
            bins[w] = zlib.crc32(w) % BINS
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.fromiter(map(bins.__getitem__, (w for ws in words for w in ws)), dtype=np.int64, count=int(lengths.sum()))
        key, tf = np.unique(np.repeat(np.arange(len(texts)), lengths) * BINS + flat, return_counts=True)
        doc = key // BINS
        counts = np.bincount(doc, minlength=len(texts))
        values = np.log1p(tf.astype(np.float64))
        norm = np.sqrt(segment_sums(values * values, counts))
        values = values / np.repeat(np.where(norm > 0, norm, 1.0), counts)
        top = np.zeros(len(texts), dtype=np.int64)
        np.maximum.at(top, doc, tf)
        stats = np.array([structure(t, r, w, int(d), int(m), c) for t, r, w, d, m, c in zip(texts, raws, words, counts, top, n_chars, strict=True)], dtype=np.float64).reshape(len(texts), STATS)
        return (key % BINS).astype(np.int32), values, counts, stats


class Machine:
    """A factorisation machine over BINS word features and STATS statistics."""

    def __init__(self, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(BINS + STATS)
        self.v = rng.normal(0, 0.02, (BINS + STATS, factors))
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)
        self.constant: float | None = PRIOR

    def rows(self, bins, values, counts, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature indices and values of all texts, flat, with each text's count."""
        x = np.clip((stats - self.mean) / self.scale, -4, 4) / 2
        ends = np.cumsum(counts)
        at = np.repeat(ends, STATS)
        idx = np.insert(bins.astype(np.int64), at, np.tile(np.arange(BINS, BINS + STATS), len(counts)))
        return idx, np.insert(values, at, x.reshape(-1)), counts + STATS

    def logits(self, idx, x, counts) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[idx] * x[:, None]
        sums = segment_sums(vx, counts)
        return self.w0 + segment_sums(self.w[idx] * x, counts) + 0.5 * (sums**2 - segment_sums(vx * vx, counts)).sum(1), sums

    def scores(self, bins, values, counts, stats) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(*self.rows(bins, values, counts, stats))[0], -30, 30)))

    def fit(self, bins, values, counts, stats, y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-4) -> Machine:
        """Minibatch Adagrad on the logistic loss; both classes weigh alike through the square root of their odds."""
        if not len(y):
            return self
        if y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return self
        self.constant = None
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
        idx, x, counts = self.rows(bins, values, counts, stats)
        ends = np.cumsum(counts)
        starts = ends - counts
        share = y.mean()
        self.w0 = float(np.log(share / (1 - share)))
        weight = np.where(y == 1, 1.0, np.sqrt(share / (1 - share)))
        g_w, g_v, g_0 = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), batch):
                take = order[k : k + batch]
                n = counts[take]
                at = np.repeat(starts[take] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                i, xi = idx[at], x[at]
                z, sums = self.logits(i, xi, n)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) * weight[take] / len(take)
                e = np.repeat(err, n)
                uniq, where = np.unique(i, return_inverse=True)
                d_w = np.bincount(where, e * xi, len(uniq)) + decay * self.w[uniq]
                part = e[:, None] * xi[:, None] * (np.repeat(sums, n, axis=0) - self.v[i] * xi[:, None])
                order_i = np.argsort(where, kind="stable")
                d_v = np.add.reduceat(part[order_i], np.r_[0, np.cumsum(np.bincount(where))[:-1]], axis=0) + decay * self.v[uniq]
                g_w[uniq] += d_w**2
                g_v[uniq] += d_v**2
                g_0 += err.sum() ** 2
                self.w[uniq] -= 5 * rate * d_w / np.sqrt(g_w[uniq])
                self.v[uniq] -= rate * d_v / np.sqrt(g_v[uniq])
                self.w0 -= 5 * rate * err.sum() / np.sqrt(g_0)
        return self


def within(sizes: list[int], most: int) -> list[bool]:
    """Which of sizes, in turn, are taken so that their sum stays within most; what does not fit is passed over."""
    held, out = 0, []
    for size in sizes:
        out.append(held + size <= most)
        held += size * out[-1]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, n_chars: str | None, label_col: str, folds: int) -> DataFrame:
    """(i, t, c, y, h, size) of the rows of docs that have one of the MAX_ROWS labels of lowest hash."""
    marked = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("double").alias("y")).filter("i IS NOT NULL AND y IS NOT NULL")
    marked = marked.filter(fold("i", folds) != 0).groupBy("i").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    chosen = marked.orderBy(F.xxhash64("i"), "i").limit(MAX_ROWS)
    meta = F.col(f"`{n_chars}`").cast("double") if n_chars else F.lit(None).cast("double")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), text.alias("t"), meta.alias("c")).join(F.broadcast(chosen), "i")  # at most MAX_ROWS pairs of numbers
    # A row is known by its hash; equal rows are one to the fit.
    return rows.withColumn("h", F.xxhash64("i", "t", "c")).withColumn("size", F.length("t"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars: str | None = "n_chars", label_col: str = "quality", folds: int = 5) -> Machine:
    """A machine fitted on labels whose id's fold is not 0."""
    rows = training_rows(docs, labels, id_col, text_col, n_chars, label_col, folds)
    sizes = rows.groupBy("h").agg(F.min(F.xxhash64("i")).alias("o"), F.max("size").alias("size")).orderBy("o", "h").limit(MAX_ROWS).collect()
    under = [(r["h"],) for r, fits in zip(sizes, within([r["size"] for r in sizes], MAX_CHARS), strict=True) if fits]
    if not under:
        return Machine()
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(under, "h long")), "h")  # at most MAX_ROWS numbers

    def maker():
        make = Featurizer()

        def work(texts, n):
            bins, values, counts, stats = make(texts, n)
            ends = np.cumsum(counts)
            cuts = list(zip(ends - counts, ends, strict=True))
            return [bins[a:b].tobytes() for a, b in cuts], [values[a:b].astype(np.float32).tobytes() for a, b in cuts], [x.tobytes() for x in stats]

        return work

    made = map_texts(rows, "t", ["h", "i", "y"], {"bins": "binary", "vals": "binary", "stats": "binary"}, maker, [F.col("c")])
    once = made.groupBy("h").agg(F.first("i").alias("i"), *(F.first(c).alias(c) for c in ("y", "bins", "vals", "stats")))
    found = list(once.withColumn("o", F.xxhash64("i")).toPandas().sort_values(["o", "h"], kind="stable").itertuples())
    if not found:
        return Machine()
    bins = [np.frombuffer(r.bins, dtype=np.int32) for r in found]
    values = np.concatenate([np.frombuffer(r.vals, dtype=np.float32) for r in found]).astype(np.float64)
    stats = np.stack([np.frombuffer(r.stats, dtype=np.float64) for r in found])
    return Machine().fit(np.concatenate(bins), values, np.array([len(b) for b in bins]), stats, np.array([r.y for r in found], dtype=np.float64))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", n_chars: str | None = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all, if None) of docs and `quality_score` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # BINS + STATS rows of FACTORS + 1 numbers
    meta = F.col(f"`{n_chars}`").cast("double") if n_chars else F.lit(None).cast("double")

    def maker():
        make, model = Featurizer(), held.value
        return lambda texts, n: [model.scores(*make(texts, n))]

    return map_texts(docs, text_col, docs.columns if keep is None else keep, {"quality_score": "double"}, maker, [meta])
