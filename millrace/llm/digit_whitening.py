"""Whitening of embeddings with a covariance that is exact: digit-slice matrix products.

Components become whole numbers, x = floor(scale * c). Over the fit list (each distinct x once) n and the sums S are taken, then
the products of the centred y = n * x - S. y is split into signed digits of DIGIT_BITS bits; the product of two digit
slices of at most SLICE_ROWS rows stays below 2**53, so float64 BLAS gives it exactly, in whatever order it adds. Digit products are
put together as big integers, emitted by each task as digits of 32 bits and summed by Spark with partial aggregation, so totals depend
neither on partitions nor on order. Only they, dimension**2 numbers, reach the driver, which divides once (correctly
rounded) and decomposes. Python integers take over where a number passes 62 bits.

Defined results: rows whose vector is null, empty, or holds null, NaN or infinite entries are left out; null and repeated ids
stay rows of their own. Vectors of each length are a table of their own, with their own fit list (the lengths in a table are
expected to be few). A component whose eigenvalue is zero to double precision (fewer distinct vectors than dimensions, say) has
`whitened` null; `explained` is null where the trace is 0; `identity_error` goes over the other components and is null where there is none.
A scaled entry or a deviation that fits no long is an error. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, discard
from millrace.session import ship

#: A digit lies in [-2**19, 2**19), so 2**12 products of two sum up to 2**50 at most.
DIGIT_BITS, SLICE_ROWS = 20, 1 << 12
#: Bits of the digits in which tasks hand on their totals; longs hold the sum of 2**31 of them.
SUM_BITS = 32
_LONG = 1 << 63


def digits(numbers: np.ndarray, bits: int) -> list[np.ndarray]:
    """Signed digits of whole numbers, lowest first, as int64: numbers = sum of digits[k] << bits * k."""
    half, out = 1 << (bits - 1), []
    while True:
        low = ((numbers + half) & (2 * half - 1)) - half
        out.append(low.astype(np.int64))
        numbers = (numbers - low) >> bits
        if not np.any(numbers):
            return out


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y.T @ y as Python integers, by products of digit slices."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for start in range(0, len(y), SLICE_ROWS):
        slices = [d.astype(np.float64) for d in digits(y[start : start + SLICE_ROWS], DIGIT_BITS)]
        for a, left in enumerate(slices):
            for b in range(a, len(slices)):
                product = (left.T @ slices[b]).astype(np.int64).astype(object)
                total += (product if a == b else product + product.T) << (DIGIT_BITS * (a + b))
    return total


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: int64 where that holds it with room for a digit's half, else Python integers."""
    largest = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if largest < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of int64) of the vectors of each length."""
    ends = vectors.offsets.to_numpy()
    flat, sizes = vectors.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[ends[at][:, None] + np.arange(size)]


def exact_totals(vectors: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> dict[int, list[int]]:
    """By length, the exact sums over all batches of what work makes of a matrix of vectors: a flat array of whole numbers."""
    ship(vectors.sparkSession)

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                made = work(x)
                totals[x.shape[1]] = totals[x.shape[1]] + made if x.shape[1] in totals else made
        for size, total in totals.items():
            for k, digit in enumerate(digits(total, SUM_BITS)):
                at = np.flatnonzero(digit)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size)), pa.array(at), pa.array(np.full(len(at), k)), pa.array(digit[at])], names=["size", "at", "k", "v"])
            if not np.any(total):
                yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([0]), pa.array([0]), pa.array([0])], names=["size", "at", "k", "v"])

    found = vectors.select("x").mapInArrow(run, "size long, at long, k long, v long").groupBy("size", "at", "k").agg(F.sum("v").alias("v"))
    out: dict[int, dict[int, int]] = {}
    for r in found.collect():
        places = out.setdefault(r["size"], {})
        places[r["at"]] = places.get(r["at"], 0) + (r["v"] << (SUM_BITS * r["k"]))
    return {size: [places.get(i, 0) for i in range(max(places) + 1)] for size, places in out.items()}


def decomposed(n: int, products: np.ndarray, components: int) -> tuple[np.ndarray, list[float | None], list[float | None]]:
    """(unit eigenvectors as columns, n * sqrt(eigenvalue) or None, eigenvalue / trace or None) of the largest eigenvalues, from the sums of centred products."""
    dims, cube = len(products), n**3
    values, vectors = np.linalg.eigh(np.array([[int(v) / cube for v in row] for row in products]))
    order = np.argsort(-values, kind="stable")[: min(components, dims)]
    trace = sum(int(products[i][i]) for i in range(dims)) / cube
    vectors = vectors[:, order] * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)[order]
    real = [float(e) if e > trace * dims * 2.0**-52 else 0.0 for e in values[order]]
    return vectors, [n * e**0.5 if e else None for e in real], [e / trace if trace else None for e in real]


def _whitened(rows: DataFrame, model: dict) -> DataFrame:
    """(id, n, deviation, whitened array, explained array, identity_error, size) of each row (id, x)."""
    ship(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n", "deviation", "whitened", "explained", "identity_error", "size"]

    def run(batches):
        for batch in batches:
            for at, x in by_length(batch.column(1)):
                n, sums, vectors, scales, explained, error = model[x.shape[1]]
                y = centred(x, n, sums)
                if x.shape[1] * int(max(y.max(), -y.min())) ** 2 < _LONG:
                    deviation = (y * y).sum(axis=1)
                else:
                    deviation = (y.astype(object) ** 2).sum(axis=1)
                    if deviation.max() >= _LONG:
                        raise ValueError("a deviation does not fit a long")
                w = y.astype(np.float64) @ (vectors / np.array([s or np.nan for s in scales]))
                w = pa.array([None if v != v else v for v in w.ravel().tolist()], type=pa.float64())
                rows_of = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(scales), type=pa.int32()), values)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), n)), pa.array(deviation.tolist(), type=pa.int64()), rows_of(w), rows_of(pa.array(explained * len(at), type=pa.float64())),
                     pa.array([error] * len(at), type=pa.float64()), pa.array(np.full(len(at), x.shape[1]))], names=names)

    return rows.select("id", "x").mapInArrow(run, f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double, size long")


def identity_errors(fit: DataFrame, model: dict, components: int) -> dict[int, float | None]:
    """By length, the largest absolute entry of the covariance of the whitened fit list minus the identity; centred before multiplying."""
    w = [F.get("whitened", F.lit(i)) for i in range(components)]
    listed = cut(_whitened(fit.withColumn("id", F.lit(None).cast("long")), model).select("size", *(c.alias(f"w{i}") for i, c in enumerate(w))), "whitened-fit")
    means = listed.groupBy("size").agg(*(F.avg(f"w{i}").alias(f"m{i}") for i in range(components)))
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    # The table of means has a row for each length.
    apart = listed.join(F.broadcast(means), "size").groupBy("size").agg(*(F.avg((F.col(f"w{i}") - F.col(f"m{i}")) * (F.col(f"w{j}") - F.col(f"m{j}"))).alias(f"v{i}_{j}") for i, j in pairs))
    out = {r["size"]: max((abs(r[f"v{i}_{j}"] - (i == j)) for i, j in pairs if r[f"v{i}_{j}"] is not None), default=None) for r in apart.collect()}
    discard(listed)
    return out


def whiten(embeddings: DataFrame, components: int = 4, scale: int = 256, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each usable row and component: (id_col, component, n, deviation, whitened, explained, identity_error)."""
    vec, bad = F.col(f"`{vec_col}`").cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    whole = lambda v: F.when(F.abs(v * float(scale)) >= 2.0**63, F.raise_error(F.lit("a scaled entry does not fit a long")).cast("long")).otherwise(F.floor(v * float(scale)))
    rows = embeddings.select(F.col(f"`{id_col}`").alias("id"), vec.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    rows = rows.select("id", F.transform("v", whole).alias("x"))
    # Copies meet before the shuffle and after it; a group of copies is one row of each task.
    fit = cut(rows.select("x").distinct(), "whitening-fit")
    heads = exact_totals(fit, lambda x: np.concatenate([[len(x)], x.astype(object).sum(axis=0)]))
    known = {size: (t[0], [*t[1:], *[0] * (size + 1 - len(t))]) for size, t in heads.items()}
    upper = {size: np.triu_indices(size) for size in known}
    products = exact_totals(fit, lambda x: exact_gram(centred(x, *known[x.shape[1]]))[upper[x.shape[1]]])
    model = {}
    for size, (n, sums) in known.items():
        matrix = np.zeros((size, size), dtype=object)
        flat = products[size]
        matrix[upper[size]] = [*flat, *[0] * (len(upper[size][0]) - len(flat))]
        matrix = matrix + np.triu(matrix, 1).T
        model[size] = (n, sums, *decomposed(n, matrix, components), None)
    errors = identity_errors(fit, model, components) if model else {}
    discard(fit)
    model = {size: (*m[:-1], errors[size]) for size, m in model.items()}
    found = _whitened(rows, model).select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")))
    return found.select(F.col("id").alias(id_col), (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("col.whitened").alias("whitened"), F.col("col.explained").alias("explained"), "identity_error")
