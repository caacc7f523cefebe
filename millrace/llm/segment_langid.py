"""Language identification by unigrams over pieces, marginalised over all segmentations.

The vocabulary is fixed and public (a SentencePiece model's pieces). For each learned language a piece has a probability;
a word's probability is the sum over all its segmentations of the products of its pieces' probabilities, by the forward
algorithm, run for all new words and all languages at once. A text scores the sum of its words' logarithms and a prior.

A word is "▁" + a run of letters (Unicode categories L, with the marks M after them, and apostrophes between) as they stand between other
characters, lower-cased. Words are of any length: every RESCALE characters the sums are divided by their largest, whose logarithm is kept, so
products stay in range. Single characters outside the vocabulary have a small fixed probability.

Probabilities are fitted by expectation-maximisation (forward-backward over the same lattices) on a bounded sample:
the ROWS_PER_LANGUAGE different training rows of lowest hash of each language, whole texts. A learned language is any non-null lang of a training row.

Null texts, texts without a letter and all texts where nothing could be learned are `und` with score 0.
The score is the posterior of the predicted language; ties go to the language first in order of code points.
"""

from __future__ import annotations

import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.common import fold, map_texts, segment_sums
from millrace.llm.piece_codec import SPACE, read_model

UNDETERMINED = "und"
ROWS_PER_LANGUAGE = 150
#: Parts of a language's rows among which its sample is looked for.
SAMPLE_PARTS = 16
RESCALE = 32
ITERATIONS = 4
#: Each character's factor, taken out again in the end, keeps products of RESCALE characters away from underflow.
SCALE = 300.0
UNKNOWN = 1e-6
REMEMBERED = 75_000
#: Lattice places that are worked on at once.
PLACES = 400_000
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+(?:['’]\p{L}[\p{L}\p{M}]*+)*+")
_PLAIN = re.compile(r"[a-z]+(?:'[a-z]+)*")


def words_of(text: str) -> list[str]:
    """The letter runs of text, lower-cased."""
    low = text.lower()
    return _PLAIN.findall(low) if low.isascii() else _LETTERS.findall(low)


class Lattice:
    """Which pieces lie where in words."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        size = 1 << 18
        self.mask = np.uint64(size - 1)
        self.hash = np.zeros(size, dtype=np.uint64)
        self.index = np.full(size, -1, dtype=np.int32)
        for i, p in enumerate(pieces):
            h = np.zeros(1, dtype=np.uint64)
            for c in p:
                h = self._longer(h, np.array([ord(c)], dtype=np.uint64))
            at = int(h[0] & self.mask)
            while self.index[at] >= 0:
                if self.hash[at] == h[0]:
                    raise ValueError("two pieces share a hash")
                at = (at + 1) % size
            self.hash[at], self.index[at] = h[0], i

    @staticmethod
    def _longer(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Hashes of strings that are one character longer than those that h has."""
        with np.errstate(over="ignore"):
            h = (h + codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            return h ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        out = np.where(self.hash[at] == h, self.index[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.index[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
            a = at[open_]
            out[open_] = np.where(self.hash[a] == h[open_], self.index[a], -1)
            open_ = open_[(out[open_] < 0) & (self.index[a] >= 0)]
        return out

    def groups(self, words: list[str]):
        """(places in words, codes with a row a character and a column a word) of words of one length, "▁" in front, about PLACES characters at once."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        for n in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == n)
            most = max(1, PLACES // n)
            for k in range(0, len(of), most):
                at = of[k : k + most]
                codes = np.frombuffer("".join(SPACE + words[j] for j in at.tolist()).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(at), n)
                yield at, np.ascontiguousarray(codes.T).astype(np.uint64)

    def spans(self, codes: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """For each start (length, piece of each word or -1) of the lengths that some word has a piece of; length 1 always."""
        n, words = codes.shape
        h, out = np.zeros((n, words), dtype=np.uint64), [[] for _ in range(n)]
        for k in range(min(self.longest, n)):
            h = self._longer(h[: n - k], codes[k:])
            found = self.find(h.reshape(-1)).reshape(n - k, words)
            for s in range(n) if k == 0 else np.flatnonzero((found >= 0).any(1)).tolist():
                out[s].append((k + 1, found[s]))
        return out


class Languages:
    """Piece probabilities of each language."""

    def __init__(self, pieces: list[str], names: list[str]):
        self.lattice, self.names = Lattice(pieces), names
        share = SCALE ** np.array([len(p) for p in pieces], dtype=np.float64)
        self.scale = np.append(share, SCALE)  # the last row is any single character outside the vocabulary
        self.theta = np.full((len(pieces) + 1, len(names)), 1.0 / max(1, len(pieces)))
        self.theta[-1] = UNKNOWN
        self.log_prior = np.zeros(len(names))

    @staticmethod
    def _rescaled(values: list, window: range) -> np.ndarray:
        """Divides values in window by the largest of each word and language, and gives the logarithm of these."""
        held = [t for t in window if values[t] is not None]
        top = np.maximum.reduce([values[t] for t in held])
        for t in held:
            values[t] = values[t] / top
        return np.log(top)

    def forward(self, spans, n: int, table: np.ndarray) -> tuple[list, list]:
        """(sums over all segmentations up to each place, logarithms of what they have been divided by)."""
        alpha, log, now = [np.ones((len(spans[0][0][1]), table.shape[1]))] + [None] * n, [], 0.0
        for s in range(n):
            log.append(now)
            for k, piece in spans[s]:
                step = alpha[s] * table[piece] if k == 1 else np.where((piece >= 0)[:, None], alpha[s] * table[piece], 0)  # -1 is the last row
                alpha[s + k] = step if alpha[s + k] is None else alpha[s + k] + step
            if s % RESCALE == RESCALE - 1:
                now = now + self._rescaled(alpha, range(s + 1, min(n, s + self.lattice.longest) + 1))
        return alpha, [*log, now]

    def backward(self, spans, n: int, table: np.ndarray) -> tuple[list, list]:
        """The same from the word's end."""
        beta, log, now = [None] * n + [np.ones((len(spans[0][0][1]), table.shape[1]))], [0.0] * (n + 1), 0.0
        for s in range(n - 1, -1, -1):
            steps = [beta[s + k] * table[piece] if k == 1 else np.where((piece >= 0)[:, None], beta[s + k] * table[piece], 0) for k, piece in spans[s]]
            beta[s], log[s] = sum(steps[1:], steps[0]), now
            if (n - s) % RESCALE == 0:
                window = range(s, min(n, s + self.lattice.longest - 1) + 1)
                more = self._rescaled(beta, window)
                now = now + more
                for t in window:
                    log[t] = log[t] + more
        return beta, log

    def log_words(self, words: list[str]) -> np.ndarray:
        """log P(word | language), a row a word."""
        out = np.empty((len(words), len(self.names)))
        table = self.theta * self.scale[:, None]
        for at, codes in self.lattice.groups(words):
            n = len(codes)
            alpha, log = self.forward(self.lattice.spans(codes), n, table)
            out[at] = np.log(alpha[n]) + log[n] - n * np.log(SCALE)
        return out

    def fit(self, words: list[str], counts: np.ndarray, iterations: int = ITERATIONS) -> Languages:
        """EM from even probabilities; counts has a row a word and a column a language."""
        held = [(at, len(codes), self.lattice.spans(codes)) for at, codes in self.lattice.groups(words)]
        for _ in range(iterations):
            table = self.theta * self.scale[:, None]
            expected = np.zeros_like(self.theta)
            for at, n, spans in held:
                (alpha, log), (beta, back) = self.forward(spans, n, table), self.backward(spans, n, table)
                share = counts[at] / alpha[n]
                pieces, posts = [], []
                for s in range(n):
                    for k, piece in spans[s]:
                        use = slice(None) if k == 1 else np.flatnonzero(piece >= 0)
                        post = (alpha[s] * beta[s + k] * share)[use] * table[piece[use]]
                        if n > RESCALE:
                            post = post * np.exp(np.broadcast_to(log[s] + back[s + k] - log[n], share.shape)[use])
                        pieces.append(piece[use])
                        posts.append(post)
                where, post = np.concatenate(pieces), np.concatenate(posts)
                where[where < 0] = len(expected) - 1
                for lang in range(post.shape[1]):
                    expected[:, lang] += np.bincount(where, post[:, lang], len(expected))
            expected[:-1] += 1e-2
            expected[-1] = 0
            self.theta = expected / np.maximum(expected.sum(0), 1e-300)
            self.theta[-1] = UNKNOWN
        return self

    def predict(self, texts: list[str], memory: dict[str, int], rows: list[np.ndarray]) -> tuple[list[str], list[float]]:
        """(language, posterior) of each text; memory and rows keep what is known of words between calls."""
        split = [words_of(t) for t in texts]
        if len(memory) > REMEMBERED:
            memory.clear()
            rows.clear()
        new = list(set().union(*split) - memory.keys())
        if new:
            made = self.log_words(new)
            start = len(memory)
            memory.update((w, start + k) for k, w in enumerate(new))
            rows[:] = [np.concatenate([*rows, made])]
        lengths = np.array([len(x) for x in split], dtype=np.int64)
        if not lengths.any() or not self.names:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        flat = np.fromiter(map(memory.__getitem__, (w for x in split for w in x)), dtype=np.int64, count=int(lengths.sum()))
        total = segment_sums(rows[0][flat], lengths) + self.log_prior
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.names[b] if n else UNDETERMINED for b, n in zip(best.tolist(), lengths.tolist(), strict=True)], [s if n else 0.0 for s, n in zip(score.tolist(), lengths.tolist(), strict=True)]


def fit(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> Languages:
    """Languages fitted on rows whose id's fold is not 0 and whose language is known."""
    model = read_model(model_path)
    pieces = [p for p, k in zip(model["pieces"], model["kinds"], strict=True) if k == "n"]
    known = docs.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t")).filter("l IS NOT NULL").filter(fold("i", folds) != 0)
    # The sample is chosen by hashes alone, so that only its texts are moved; rows repeated alike are one to it.
    marked = known.withColumn("h", F.xxhash64("i")).withColumn("g", F.xxhash64("i", "l", "t"))
    # A language may hold a third of all rows: the first of each of its parts are chosen before the first of them all.
    rows = marked.select("l", "h", "g", F.pmod("g", F.lit(SAMPLE_PARTS)).alias("part")).distinct()
    lowest = lambda d, *by: d.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("h", "g"))).filter(F.col("r") <= ROWS_PER_LANGUAGE)
    chosen = lowest(lowest(rows, "l", "part"), "l").select("l", "g")
    names = sorted(r["l"] for r in known.select("l").distinct().collect())
    sample = marked.join(F.broadcast(chosen), ["l", "g"])  # ROWS_PER_LANGUAGE pairs a language

    def make():
        return lambda texts: [["\n".join(words_of(t)) for t in texts]]

    counts: dict[str, np.ndarray] = {}
    split = map_texts(sample, "t", ["l", "g"], {"w": "string"}, make).groupBy("l", "g").agg(F.first("w").alias("w"))
    for row in split.orderBy("l", "g").toLocalIterator():
        at = names.index(row["l"])
        for w in row["w"].split("\n") if row["w"] else []:
            if w not in counts:
                counts[w] = np.zeros(len(names))
            counts[w][at] += 1
    languages = Languages(pieces, names)
    words = sorted(counts)
    return languages.fit(words, np.stack([counts[w] for w in words])) if words else languages


def identify(docs: DataFrame, languages: Languages, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep with lang_pred and lang_score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(languages)  # a number a piece and language

    def make():
        model, memory, rows = held.value, {}, []
        return lambda texts: model.predict(texts, memory, rows)

    return map_texts(docs, text_col, keep, {"lang_pred": "string", "lang_score": "double"}, make)
