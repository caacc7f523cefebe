"""Approximate nearest neighbours by a forest of hash prefixes.

A tree gives each vector a string of BITS bits, one a random projection against a threshold. The forest spans the whole table:
its sorted arrays are kept in blocks, each with the strings of its vectors in every tree, and what a prefix holds is the sum of what it holds in
the blocks. A query descends in every tree of every block, by binary search, to its longest matching prefix; from the longest of all, all trees
ascend together, one bit a step, and the blocks count what each step would give. The sums over all blocks say at which depth the
whole forest has enough candidates, and how many trees take the last step, so that little more than enough is measured.
Then each block measures its vectors below those prefixes, exactly, on the original vectors.

Enough is `effort` * n**POWER different candidates of n vectors in the forest, so the measured share falls as the table grows. Trees that meet
the same vector count it again: n * -ln(1 - share) finds with repeats give a share of n different ones. Equal vectors of a block are
one entry of the forest, so a vector repeated over the table does not use up other queries' candidates.

Every row is indexed. Only the thresholds are fitted, on a bounded sample: the medians of the projections of the SAMPLE
vectors of lowest hash. Recall against brute force is measured in the tests and stated in the README. Vectors of different dimensions
don't meet; null and zero vectors, and those with null or non-finite components, take no part. Rows that repeat an id are
candidates and queries of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm import vector_blocks
from millrace.llm.common import cut

TREES = 128
BITS = 32
SAMPLE = 2_048
ROWS = 8_192
EFFORT = 3.0
POWER = 0.8


class Hasher:
    """The projections and thresholds of one dimension."""

    def __init__(self, dim: int, sample: np.ndarray, trees: int = TREES, seed: int = 5):
        self.planes = np.random.default_rng(seed + dim).normal(size=(dim, trees * BITS))
        self.cut = np.median(sample @ self.planes, axis=0) if len(sample) else np.zeros(trees * BITS)
        self.trees = trees

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows) of uint32, the first bit highest."""
        out = np.empty((self.trees, len(x)), dtype=np.uint32)
        for k in range(0, len(x), 2_048):
            bits = (x[k : k + 2_048] @ self.planes > self.cut).reshape(-1, self.trees, BITS)
            out[:, k : k + 2_048] = np.packbits(bits, axis=2).view(">u4")[:, :, 0].T
        return out


class Forest:
    """The sorted arrays of all trees over one block; they are built once and kept with it."""

    def __init__(self, codes: np.ndarray, order: np.ndarray):
        self.codes, self.order, self.n = codes, order, codes.shape[1]

    @classmethod
    def build(cls, hasher: Hasher, x: np.ndarray) -> Forest:
        codes = hasher(x)
        order = np.argsort(codes, axis=1, kind="stable").astype("<u2")  # a block has at most ROWS vectors
        return cls(np.take_along_axis(codes, order.astype(np.int64), axis=1), order)

    def tobytes(self) -> bytes:
        return self.codes.astype("<u4").tobytes() + self.order.tobytes()

    @classmethod
    def frombytes(cls, raw: bytes, n: int) -> Forest:
        trees = len(raw) // (6 * n)
        return cls(np.frombuffer(raw, "<u4", trees * n).reshape(trees, n), np.frombuffer(raw, "<u2", offset=4 * trees * n).reshape(trees, n))

    def descend(self, strings: np.ndarray) -> np.ndarray:
        """The length of the longest prefix that each tree shares with each string; (trees, queries)."""
        out = np.zeros(strings.shape, dtype=np.int64)
        for t, (codes, s) in enumerate(zip(self.codes, strings, strict=True)):
            at = np.searchsorted(codes, s)
            for other in (np.maximum(at - 1, 0), np.minimum(at, self.n - 1)):  # the longest match is a neighbour in the sorted array
                differs = (codes[other] ^ s).astype(np.float64)
                out[t] = np.maximum(out[t], BITS - np.frexp(differs)[1])
        return out

    def ranges(self, strings: np.ndarray, depth: int, trees: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) places in each tree of what shares `depth` bits with each string; (trees, queries)."""
        if not depth:
            shape = strings[trees].shape
            return np.zeros(shape, dtype=np.int64), np.full(shape, self.n, dtype=np.int64)
        low = strings[trees] >> np.uint32(BITS - depth) << np.uint32(BITS - depth)
        high = low | np.uint32((1 << (BITS - depth)) - 1)
        first = np.stack([np.searchsorted(c, s, "left") for c, s in zip(self.codes[trees], low, strict=True)])
        return first, np.stack([np.searchsorted(c, s, "right") for c, s in zip(self.codes[trees], high, strict=True)])

    def counts(self, strings: np.ndarray) -> np.ndarray:
        """(queries, BITS + 1): how often all trees together meet a vector at each depth, ascending from the longest match."""
        out = np.zeros((strings.shape[1], BITS + 1), dtype=np.int64)
        for depth in range(int(self.descend(strings).max(initial=0)), -1, -1):
            first, last = self.ranges(strings, depth)
            out[:, depth] = (last - first).sum(0)
        return out

    def candidates(self, strings: np.ndarray, depth: np.ndarray, trees: np.ndarray):
        """For each query the places of what its first `trees` trees hold at `depth` and the others one bit deeper."""
        for d in np.unique(depth).tolist():
            of = np.flatnonzero(depth == d)
            upper = self.ranges(strings[:, of], d)
            deeper = self.ranges(strings[:, of], d + 1) if d < BITS else tuple(np.zeros_like(v) for v in upper)
            for j, q in enumerate(of.tolist()):
                found = np.zeros(self.n, dtype=bool)
                for t in range(len(self.codes)):
                    first, last = upper if t < trees[q] else deeper
                    found[self.order[t, first[t, j] : last[t, j]]] = True
                yield q, np.flatnonzero(found)


def stop(sums: np.ndarray, wanted: float, trees: int = TREES) -> tuple[int, int]:
    """(depth, trees) where an ascent has met `wanted` vectors: all trees are one bit below depth, and that many ascended to it."""
    if math.isinf(wanted):
        return 0, trees
    enough = np.flatnonzero(sums >= wanted)
    depth = int(enough.max(initial=0))
    if depth == BITS:
        return depth, trees
    step = sums[depth] - sums[depth + 1]
    return depth, max(1, min(trees, math.ceil(trees * (wanted - sums[depth + 1]) / step))) if step > 0 else trees


def nearest(q: np.ndarray, rows: np.ndarray, norms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact distances) of all rows that may be among q's k nearest."""
    rough = norms + (q @ q) - 2 * (rows @ q)
    at = np.arange(len(rough))
    if len(rough) > k:
        k_th = np.partition(rough, k - 1)[k - 1]
        at = np.flatnonzero(~(rough > k_th + 1e-9 * (1 + np.abs(norms).max() + q @ q)))
    return at, np.sqrt(((rows[at] - q) ** 2).sum(1))


def neighbours(vectors: DataFrame, is_query, k: int = 10, effort: float = EFFORT, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each query row among all other rows, ties to the smaller id. is_query is over `id`."""
    x = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec")).filter(F.exists("vec", lambda v: v != 0))
    ready = vector_blocks.usable(x, "id", "vec")
    sample = [r["vec"] for r in ready.orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE).select("vec").collect()]
    held = vectors.sparkSession.sparkContext.broadcast({d: np.array([v for v in sample if len(v) == d]) for d in {len(v) for v in sample}})

    def hasher_of():
        made: dict[int, Hasher] = {}

        def of(dim: int) -> Hasher:
            if dim not in made:
                made[dim] = Hasher(dim, held.value.get(dim, np.zeros((0, dim))))
            return made[dim]

        return of

    def index():
        of = hasher_of()
        return lambda v: Forest.build(of(v.shape[1]), v).tobytes()

    def of_query():
        of = hasher_of()
        return lambda v: of(v.shape[1])(v).astype("<u4").tobytes()

    def strings_of(q):
        return np.frombuffer(q.aux, "<u4").reshape(-1, len(q.vecs))

    def count():
        def counted(extra, q, c):
            sums = Forest.frombytes(c.aux, len(c.vecs)).counts(strings_of(q))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), extra["qb"])), pa.array(np.arange(len(sums), dtype=np.int32)), *(pa.array(v) for v in sums.T)], names=["qb", "at", *(f"s{d}" for d in range(BITS + 1))])

        return counted

    def searcher():
        def find(extra, q, c):
            forest, norms = Forest.frombytes(c.aux, len(c.vecs)), (c.vecs**2).sum(1)
            stops = np.array([stop(np.array(s), extra["wanted"]) for s in extra["sums"]])
            made: list = [None] * len(q.vecs)
            for j, places in forest.candidates(strings_of(q), stops[:, 0], stops[:, 1]):
                at, score = nearest(q.vecs[j], c.vecs[places], norms[places], k + 1) if len(places) else (np.zeros(0, dtype=np.int64), np.zeros(0))
                members, which = c.expand(places[at], k + 1)
                made[j] = c.ids[members], c.rows[members], score[which], np.zeros(len(members), dtype=np.int32)
            yield vector_blocks.best_batch(q, (m for m, n in zip(made, q.sizes.tolist(), strict=True) for _ in range(n)), k, False, pa.float64())

        return find

    queries = vector_blocks.query_blocks(ready, is_query, of_query)
    blocks = vector_blocks.candidate_blocks(ready, ROWS, index)
    depths = [f"s{d}" for d in range(BITS + 1)]
    counts = vector_blocks.each_pair(queries, blocks, ", ".join(["qb long", "at int", *(f"{d} long" for d in depths)]), count)
    summed = counts.groupBy("qb", "at").agg(*(F.sum(d).alias(d) for d in depths))
    sums = summed.groupBy("qb").agg(F.array_sort(F.collect_list(F.struct("at", F.array(*depths).alias("s")))).alias("s"))  # QUERY_ROWS at most
    share = F.lit(float(effort)) * F.pow(F.sum("u").cast("double"), F.lit(POWER - 1))
    wanted = blocks.groupBy("dim").agg(F.when(share < 1, -F.sum("u") * F.log1p(-share)).otherwise(float("inf")).alias("wanted"))
    planned = cut(queries.join(sums.select("qb", F.col("s.s").alias("sums")), "qb").join(wanted, "dim"), "query-plans")
    found = vector_blocks.each_pair(planned, blocks, "query_id long, query_row long, vec_id long, wide int, score double", searcher, ["sums", "wanted"])
    order = W.partitionBy("query_row").orderBy("score", "vec_id")
    return vector_blocks.named(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
