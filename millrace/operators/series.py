"""Ordered series of any length, worked on in pieces: numbering, running sums, splines, folds of logs.

Rows are numbered by ranges: range-partitioned by key and order, so that a key's rows spread over many tasks, and offset by what earlier
partitions hold. Rows PIECE * k to PIECE * (k + 1) - 1 of a key are a piece. Pieces are what one task holds; between pieces go only their sums,
boundary values or maps, a few rows each.

write(df, name) makes a table in the folder that all executors share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import scalar as S
from millrace.session import ship

PIECE = 4096
_PLACE_BITS = 33


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], write, name: str = "pos") -> DataFrame:
    """df with `name`, the place from 0 of each row among those of its keys; rows that tie in order may be parted anywhere. Null keys are a key."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order, F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(*keys, *order)
    at = F.monotonically_increasing_id()
    placed = write(ranged.withColumn("__at", at).withColumns({"__part": F.shiftrightunsigned("__at", _PLACE_BITS), "__r": F.col("__at").bitwiseAND((1 << _PLACE_BITS) - 1)}).drop("__at"), "numbered")
    runs = placed.groupBy(*keys, "__part").agg(F.min("__r").alias("__r0"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    # A row of runs for each key, and one more for each partition that begins within a key.
    runs = runs.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), (before - F.col("__r0")).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(runs, same).withColumn(name, F.col("__r") + F.col("__before")).select(*df.columns, name)


def _pieces(df: DataFrame, pos: str) -> DataFrame:
    """df with __piece and __own: each row in its piece, and a piece's first and last row also in the piece beside it."""
    piece, at = F.floor(F.col(pos) / PIECE).cast("long"), F.col(pos) % PIECE
    beside = F.when(at == 0, piece - 1).when(at == PIECE - 1, piece + 1)
    both = F.filter(F.array(piece, beside), lambda p: p >= 0)
    return df.withColumn("__home", piece).withColumn("__piece", F.explode(both)).withColumn("__own", F.col("__piece") == F.col("__home")).drop("__home")


def running_sum(df: DataFrame, keys: list[str], pos: str, value: str, name: str, total: str) -> DataFrame:
    """df (numbered by pos) with the sum of value up to each row of its keys as `name`, and the keys' whole sum as `total`."""
    rows = df.withColumn("__piece", F.floor(F.col(pos) / PIECE).cast("long"))
    sums = rows.groupBy(*keys, "__piece").agg(F.sum(value).alias("__s"))
    own = W.partitionBy(*keys)
    sums = sums.withColumn("__before", F.sum("__s").over(own.orderBy("__piece").rowsBetween(W.unboundedPreceding, 0)) - F.col("__s")).withColumn(total, F.sum("__s").over(own)).drop("__s")
    within = F.sum(value).over(W.partitionBy(*keys, "__piece").orderBy(pos).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__w", within).join(sums, [*keys, "__piece"]).withColumn(name, F.col("__w") + F.col("__before")).drop("__piece", "__w", "__before")


def chord_length(df: DataFrame, by: list[str], order: str, point: list[str], write, name: str = "u") -> DataFrame:
    """Length of the path up to each point, as a share of the whole; null where the whole has none. Keys are not null."""
    placed = _pieces(numbered(df, by, [order], write, "__pos"), "__pos")
    w = W.partitionBy(*by, "__piece").orderBy("__pos")
    step = F.coalesce(F.sqrt(S.squared_distance([F.col(p) for p in point], [F.lag(p).over(w) for p in point])), F.lit(0.0))
    steps = write(placed.withColumn("__d", step).filter("__own").drop("__piece", "__own"), "steps")
    run = running_sum(steps, by, "__pos", "__d", "__s", "__t")
    return run.withColumn(name, F.col("__s") / F.nullif(F.col("__t"), F.lit(0.0))).drop("__d", "__s", "__t", "__pos")


def tridiagonal(low: np.ndarray, diagonal: np.ndarray, high: np.ndarray, right: np.ndarray, tiny: float) -> np.ndarray:
    """x of low[i] x[i-1] + diagonal[i] x[i] + high[i] x[i+1] = right[i] for each column of right, x outside being 0; pivots under `tiny` count as `tiny`."""
    n, diagonal, right = len(diagonal), diagonal.astype(float), right.astype(float)
    for i in range(n):
        if i:
            f = low[i] / diagonal[i - 1]
            diagonal[i] -= f * high[i - 1]
            right[i] -= f * right[i - 1]
        if abs(diagonal[i]) < tiny:
            diagonal[i] = tiny
    for i in range(n - 1, -1, -1):
        right[i] = (right[i] - (high[i] * right[i + 1] if i + 1 < n else 0)) / diagonal[i]
    return right


def _piece_solved(u: np.ndarray, y: np.ndarray, tiny: float) -> np.ndarray:
    """Of the inner points of (u, y): [m if both ends were 0, what 1 at the left end takes off, what 1 at the right end takes off]."""
    h = np.diff(u)
    d = np.where(np.abs(h) < tiny, 0, np.diff(y) / np.where(np.abs(h) < tiny, 1, h))
    right = np.zeros((len(u) - 2, 3))
    right[:, 0] = np.diff(d)
    right[0, 1], right[-1, 2] = h[0], h[-1]
    return tridiagonal(h[:-1], 2 * (h[:-1] + h[1:]), h[1:], right, tiny)


def _coupled(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values left and right of each piece, from ends[piece] = the rows of the piece's first and last inner point (as _piece_solved gives them).

    first[p] + v last[p-1] + w first[p+1] = y, and the same for last[p]: a block tridiagonal system of two unknowns a piece."""
    n = len(ends)
    factors, rights = np.zeros((n, 2)), np.zeros((n, 2))  # (first, last)[p] = rights[p] - factors[p] * first[p+1]
    for p in range(n):
        y, v, w = ends[p, :, 0], ends[p, :, 1], ends[p, :, 2]
        if p:  # last[p-1] = rights - factors * first[p]
            a = np.array([[1 - v[0] * factors[p - 1, 1], 0.0], [-v[1] * factors[p - 1, 1], 1.0]])
            y = y - v * rights[p - 1, 1]
        else:
            a = np.eye(2)
        rights[p], factors[p] = np.linalg.solve(a, y), np.linalg.solve(a, w)
    found = np.zeros((n, 2))
    for p in range(n - 1, -1, -1):
        found[p] = rights[p] - (factors[p] * found[p + 1, 0] if p + 1 < n else 0)
    return np.r_[0.0, found[:-1, 1]], np.r_[found[1:, 0], 0.0]


def natural_spline(df: DataFrame, by: str, u: str, y: str, write, tiny: float = 1e-4) -> DataFrame:
    """(by, u, y, m) with the second-order coefficients of the natural cubic through each series in order of u, 0 at both ends; spans under `tiny` count as flat.

    Each piece is solved for itself and for 1 at either end; the values at the ends come from a system of two unknowns a piece, which one task
    solves for each series. Points with a null in u or y are left out."""
    ship(df.sparkSession)
    kind = df.schema[by].dataType.simpleString()
    points = df.select(F.col(by).alias("k"), F.col(u).cast("double").alias("u"), F.col(y).cast("double").alias("y")).filter("u IS NOT NULL AND y IS NOT NULL")
    placed = write(_pieces(numbered(points, ["k"], ["u", "y"], write), "pos"), "spline-pieces")

    def solved(g: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """The group in order, which of its points are inner ones of the piece's system, and their solution."""
        g = g.sort_values("pos", kind="stable")
        inner = np.ones(len(g), dtype=bool)
        # The first and the last point of all are no unknowns; points of the pieces beside are not this piece's.
        inner[[0, -1]] = False
        made = _piece_solved(g["u"].to_numpy(), g["y"].to_numpy(), tiny) if len(g) > 2 else np.zeros((0, 3))
        return g, inner, made

    def ends(g: pd.DataFrame) -> pd.DataFrame:
        g, _, made = solved(g)
        if not len(made):
            return pd.DataFrame(columns=["k", "piece", "ends"])
        return pd.DataFrame({"k": [g["k"].iloc[0]], "piece": [g["__piece"].iloc[0]], "ends": [made[[0, -1]].ravel().tolist()]})

    def between(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("piece")
        left, right = _coupled(np.array(g["ends"].tolist()).reshape(len(g), 2, 3))
        return pd.DataFrame({"k": g["k"], "piece": g["piece"], "left": left, "right": right})

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        g, inner, made = solved(g)
        m = np.zeros(len(g))
        if len(made):
            m[inner] = made[:, 0] - made[:, 1] * g["left"].iloc[0] - made[:, 2] * g["right"].iloc[0]
        return g.assign(m=m)[g["__own"].to_numpy()][["k", "u", "y", "m"]]

    found = placed.groupBy("k", "__piece").applyInPandas(ends, f"k {kind}, piece long, ends array<double>")
    values = write(found.groupBy("k").applyInPandas(between, f"k {kind}, piece long, left double, right double"), "spline-ends")
    joined = placed.join(values, placed["k"].eqNullSafe(values["k"]) & (placed["__piece"] == values["piece"]), "left").drop(values["k"])
    return joined.groupBy("k", "__piece").applyInPandas(whole, f"k {kind}, u double, y double, m double").toDF(by, u, y, "m")


#: Maps of pieces that are put together to one.
MAPS = 64


def claimed(log: DataFrame, key: str, owner: str, order: str, write) -> DataFrame:
    """(key, owner) of the claims held after a log of claim and release (`op`): a claim of a key that another holds is refused, a release counts for
    its holder alone.

    A piece of a key's log is a map from the holder before it to the one after it: it has an entry for nobody and one for each owner that it lets release;
    all others hold on. Maps of pieces are put together, MAPS at a time, until a key has few."""
    ship(log.sparkSession)
    kind = log.schema[key].dataType.simpleString()
    rows = log.select(F.col(key).alias("k"), F.col(owner).cast("string").alias("who"), "op", F.col(order).alias("o")).filter("k IS NOT NULL AND who IS NOT NULL AND op IN ('claim', 'release')")
    placed = numbered(rows, ["k"], ["o"], write).withColumn("piece", F.floor(F.col("pos") / PIECE).cast("long"))
    schema = f"k {kind}, piece long, before string, after string"

    def map_of(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos", kind="stable")
        # Who holds the key now, and the holders before the piece from which that has come; an owner is traced from its first release on.
        now, traced = {None: [None]}, set()
        for who, op in zip(g["who"], g["op"], strict=True):
            moved, to = (now.pop(None, []), who) if op == "claim" else (now.pop(who, []), None)
            if op == "release" and who not in traced:
                traced.add(who)
                moved.append(who)
            there = now.get(to, [])
            small, large = sorted((there, moved), key=len)
            large.extend(small)
            now[to] = large
        entries = {start: holder for holder, starts in now.items() for start in starts}
        return pd.DataFrame({"k": g["k"].iloc[0], "piece": g["piece"].iloc[0], "before": list(entries), "after": list(entries.values())})

    def together(g: pd.DataFrame) -> pd.DataFrame:
        maps = [dict(zip(x["before"].where(x["before"].notna(), None), x["after"].where(x["after"].notna(), None), strict=True)) for _, x in g.sort_values("piece", kind="stable").groupby("piece")]
        out = {}
        for start in {None}.union(*maps):
            now = start
            for m in maps:
                now = m.get(now, now)
            out[start] = now
        return pd.DataFrame({"k": g["k"].iloc[0], "piece": g["piece"].iloc[0] // MAPS, "before": list(out), "after": list(out.values())})

    maps = write(placed.groupBy("k", "piece").applyInPandas(map_of, schema), "claim-maps")
    while (maps.agg(F.max("piece")).first()[0] or 0) > 0:
        maps = write(maps.groupBy("k", F.floor(F.col("piece") / MAPS)).applyInPandas(together, schema), "claim-maps")
    return maps.filter("before IS NULL AND after IS NOT NULL").select(F.col("k").alias(key), F.col("after").alias(owner))
