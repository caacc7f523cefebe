"""Exact top-k inner products by pivot-table elimination.

Vectors are taken as integers, floor(scale * x). A table holds each candidate's distances to PIVOTS pivots. For a query q
and candidate x every pivot p gives |d(q,p) - d(x,p)| <= d(q,x); the largest of them, L, bounds the inner product from above:
q.x = (|q|^2 + |x|^2 - d(q,x)^2) / 2 <= (|q|^2 + |x|^2 - L^2) / 2. Candidates are evaluated in order of this bound,
STEP at a time, until the next bound lies below the k-th best score, so the result is exact; on vectors without
structure the bound stops late, and nearly all candidates are evaluated.

Pivots are far-apart rows of a bounded sample: the PIVOT_SAMPLE vectors of lowest hash, of the dimension most of them have
(vectors of other dimensions are evaluated without bounds). Vectors of different dimensions don't meet. Rows that repeat an id are
candidates, and queries, of their own; a query row leaves out itself alone.

Scores are exact whatever the components: where no partial sum can leave the exact range of a double, doubles multiply; else 64-bit
integers where those are wide enough; else whole numbers without limit. A result whose score does not fit a long is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm import vector_blocks

PIVOTS = 32
PIVOT_SAMPLE = 2_048
ROWS = 8_192
STEP = 512


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each the one farthest from those before it, from the one farthest from the mean."""
    if not len(x):
        return x
    nearest = ((x - x.mean(0)) ** 2).sum(1)
    chosen = []
    for _ in range(min(n, len(x))):
        at = int(nearest.argmax())
        chosen.append(at)
        d = ((x - x[at]) ** 2).sum(1)
        nearest = d if len(chosen) == 1 else np.minimum(nearest, d)
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of x's rows to the pivots."""
    squares = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def products(rows: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exact integer inner products, wide): wide is 1 or -1 where a product lies above or below the longs, and the product is then their end."""
    wide = np.zeros(len(rows), dtype=np.int32)
    if not len(rows):
        return np.zeros(0, dtype=np.int64), wide
    most = np.abs(rows).max(1) * np.abs(q).max() * len(q)
    if most.max() < 2**53:
        return (rows @ q).astype(np.int64), wide
    out = np.zeros(len(rows), dtype=np.int64)
    fits = most < 2**62
    if fits.any():
        out[fits] = np.where(np.abs(rows[fits]) < 2**62, rows[fits], 0).astype(np.int64) @ np.where(np.abs(q) < 2**62, q, 0).astype(np.int64)
    whole = [int(v) for v in q]
    for j in np.flatnonzero(~fits).tolist():
        value = sum(int(a) * b for a, b in zip(rows[j], whole, strict=True))
        wide[j] = (value > 2**63 - 1) - (value < -(2**63))
        out[j] = min(max(value, -(2**63)), 2**63 - 1)
    return out, wide


def evaluate(q: np.ndarray, bound: np.ndarray, rows: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places, scores, wide, evaluated) of the rows that hold q's best k, all ties with the k-th included; a row counts `weight` times."""
    order = np.argsort(-bound, kind="stable")
    at, got, wide = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    done, least = 0, None
    while done < len(order):
        if least is not None and bound[order[done]] < least:
            break
        take = order[done : done + STEP]
        done += len(take)
        made, far = products(rows[take], q)
        at, got, wide = np.r_[at, take], np.r_[got, made], np.r_[wide, far]
        best = np.lexsort((-(got // 2), -wide))  # halves cannot overflow; the two scores of one half stay together
        held = np.cumsum(weight[at[best]])
        if held[-1] >= k:
            edge = best[np.searchsorted(held, k)]
            half, least = got[edge] // 2, float(got[edge]) - 1
            stays = (wide > wide[edge]) | ((wide == wide[edge]) & (got // 2 >= half))
            at, got, wide = at[stays], got[stays], wide[stays]
    return at, got, wide, done


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query row with all other rows, ties to the smaller id. is_query is over `id`."""
    # A double from 2**53 on is whole; floor would turn it into a long.
    floored = lambda v: F.when(F.abs(v) < float(2**53), F.floor(v).cast("double")).otherwise(v)
    whole = vectors.select(F.col(f"`{id_col}`").alias("id"), F.transform(F.col(f"`{vec_col}`").cast("array<double>"), lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), floored(v * float(scale)))).alias("vec"))
    # A finite component that leaves the doubles when scaled cannot be scored; it is no reason to leave the row out.
    checked = F.transform("vec", lambda v: F.when(F.abs(v) == float("inf"), F.raise_error(F.lit("a component is too large for the scale"))).otherwise(v))
    ready = vector_blocks.usable(whole.withColumn("vec", checked), "id", "vec")
    sample = [r["vec"] for r in ready.orderBy(F.xxhash64("id"), "id", "vec").limit(PIVOT_SAMPLE).select("vec").collect()]
    dims = [len(v) for v in sample]
    dim = max(set(dims), key=lambda d: (dims.count(d), d), default=0)
    pivots = choose_pivots(np.array([v for v in sample if len(v) == dim], dtype=np.float64), PIVOTS)
    held = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def index():
        pivots = held.value
        return lambda x: distances(x, pivots).T.tobytes() if len(pivots) and x.shape[1] == pivots.shape[1] else b""

    def searcher():
        def find(q, c):
            c_norm, q_norm = (c.vecs**2).sum(1), (q.vecs**2).sum(1)
            d_c, d_q = np.frombuffer(c.aux).reshape(-1, len(c.vecs)), np.frombuffer(q.aux).reshape(-1, len(q.vecs))
            weight = np.minimum(c.sizes, k + 1)
            for j in range(len(q.vecs)):
                lower = np.zeros(len(c.vecs))
                for p in range(len(d_c)):
                    np.maximum(lower, np.abs(d_c[p] - d_q[p, j]), out=lower)
                # room for the rounding of roots and squares
                bound = (c_norm + q_norm[j] - lower**2) / 2 + 1 + 1e-9 * (c_norm + q_norm[j])
                at, scores, wide, _ = evaluate(q.vecs[j], np.where(np.isnan(bound), np.inf, bound), c.vecs, weight, k + 1)
                places, which = c.expand(at, k + 1)
                for _ in range(q.sizes[j]):
                    yield c.ids[places], c.rows[places], scores[which], wide[which]

        return lambda extra, q, c: iter([vector_blocks.best_batch(q, find(q, c), k, True, pa.int64())])

    queries = vector_blocks.query_blocks(ready, is_query, index)
    found = vector_blocks.each_pair(queries, vector_blocks.candidate_blocks(ready, ROWS, index), "query_id long, query_row long, vec_id long, wide int, score long", searcher)
    order = W.partitionBy("query_row").orderBy(F.col("wide").desc(), F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    score = F.when(F.col("wide") != 0, F.raise_error(F.lit("a score does not fit a long"))).otherwise(F.col("score"))
    return vector_blocks.named(ranked.select("query_id", "rank", "vec_id", score.cast("long").alias("score")))
