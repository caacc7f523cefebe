"""Searches of a stated query set against all rows of a table of vectors, block by block.

Candidates are packed into blocks of up to `rows` vectors where they lie and stay there; equal vectors of a block are one
entry with a list of members, so a vector that a third of the table repeats is measured once a block. Queries, a small share of the rows,
are packed into full blocks of QUERY_ROWS and brought to the candidates: as a broadcast while their measured size is at most
BROADCAST_BYTES, else by a join on slots, into which the candidate blocks are dealt once and the query blocks copied.

Every row with a usable vector takes part and has a number of its own, so rows that repeat an id are rows like any other, and a query
row leaves out itself alone. Vectors that are null, empty or hold null or non-finite components take no part. Rows without an id are
candidates like others, after all ids in ties; NO_ID stands for theirs on the way. They are queries only where is_query says so of null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut
from millrace.session import ship

QUERY_ROWS = 512
BROADCAST_BYTES = 32 << 20
#: Candidate blocks in a slot, where queries are too many to be broadcast.
BLOCKS_A_SLOT = 8
#: What stands for a missing id; an id of this number would be taken for a missing one.
NO_ID = 2**63 - 1
_FIELDS = "dim int, u int, n int, vecs binary, sizes binary, ids binary, rows binary, aux binary"


@dataclass
class Block:
    """u different vectors; the members of vector j are the next sizes[j] of ids (ascending in each) and row numbers."""

    vecs: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    aux: bytes

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray, vecs: np.ndarray) -> Block:
        found, inverse, sizes = np.unique(vecs, axis=0, return_inverse=True, return_counts=True)
        order = np.lexsort((rows, ids, inverse.reshape(-1)))
        return cls(found, sizes, ids[order], rows[order], b"")

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def expand(self, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(places among members, index into at) of the first `most` members of each vector in at."""
        n = np.minimum(self.sizes[at], most)
        which = np.repeat(np.arange(len(at)), n)
        return self.starts[at][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), which


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, vec array<double>, row long) of the vectors that take part, as a table; row numbers it."""
    x = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return cut(x.filter("vec IS NOT NULL AND size(vec) > 0").filter(finite).withColumn("row", F.monotonically_increasing_id()), "vectors")


def pack(x: DataFrame, rows: int, prepare: Callable[[], Callable[[np.ndarray], bytes]]) -> DataFrame:
    """Blocks of x (id, vec, row); aux is what prepare()(different vectors) makes of a block, prepare() called once a task."""
    ship(x.sparkSession)

    def one(dim, got, make):
        b = Block.of(*(np.concatenate(c) for c in got))
        raw = (np.ascontiguousarray(v).tobytes() for v in (b.vecs.astype("<f8"), b.sizes.astype("<i4"), b.ids.astype("<i8"), b.rows.astype("<i8")))
        values = [pa.array([v], pa.int32()) for v in (dim, len(b.vecs), len(b.ids))] + [pa.array([v], pa.binary()) for v in (*raw, make(b.vecs))]
        return pa.RecordBatch.from_arrays(values, names=["dim", "u", "n", "vecs", "sizes", "ids", "rows", "aux"])

    def blocks(batches):
        held: dict[int, tuple[list, list, list]] = {}
        make = prepare()
        for batch in batches:
            ids, vecs, row = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            flat, dims = vecs.flatten().to_numpy(zero_copy_only=False), np.diff(vecs.offsets.to_numpy())
            at = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                for k in range(0, len(of), rows):
                    some = of[k : k + rows]
                    got = held.setdefault(dim, ([], [], []))
                    if sum(map(len, got[0])) + len(some) > rows:
                        yield one(dim, held.pop(dim), make)
                        got = held.setdefault(dim, ([], [], []))
                    for g, v in zip(got, (ids[some], row[some], flat[at[some][:, None] + np.arange(dim)]), strict=True):
                        g.append(v)
        for dim, got in held.items():
            yield one(dim, got, make)

    return x.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "vec", "row").mapInArrow(blocks, _FIELDS)


def named(found: DataFrame) -> DataFrame:
    """found (query_id, rank, vec_id, score) with null for the ids that are missing."""
    none = F.lit(NO_ID)
    return found.select(F.nullif("query_id", none).alias("query_id"), "rank", F.nullif("vec_id", none).alias("vec_id"), "score")


def query_blocks(ready: DataFrame, is_query: Column, prepare: Callable) -> DataFrame:
    """Full blocks of the query rows, as a table with a number qb."""
    chosen = ready.filter(is_query)
    parts = max(1, -(-chosen.count() // (8 * QUERY_ROWS)))
    return cut(pack(chosen.repartition(parts), QUERY_ROWS, prepare).withColumn("qb", F.monotonically_increasing_id()), "query-blocks")


def candidate_blocks(ready: DataFrame, rows: int, prepare: Callable) -> DataFrame:
    return cut(pack(ready, rows, prepare).withColumn("cb", F.monotonically_increasing_id()), "vector-blocks")


def each_pair(queries: DataFrame, blocks: DataFrame, schema: str, work: Callable[[], Callable[[dict, Block, Block], Iterator[pa.RecordBatch]]], more: list[str] = []) -> DataFrame:  # noqa: B006
    """What work()(extra, query block, candidate block) yields over all pairs of blocks of one dimension. extra holds `qb` and the columns `more` of queries."""
    names = ["dim", "vecs", "sizes", "ids", "rows", "aux"]
    left = queries.select("dim", *(F.col(c).alias(f"q_{c}") for c in ("qb", *names[1:], *more)))
    size = queries.agg(F.sum(F.octet_length("vecs") + F.octet_length("aux") + F.col("n") * 24)).first()[0] or 0
    right = blocks.select("dim", *(F.col(c).alias(f"c_{c}") for c in names[1:]), "cb")
    if size <= BROADCAST_BYTES:
        pairs = right.join(F.broadcast(left), "dim")
    else:
        slots = max(1, -(-blocks.count() // BLOCKS_A_SLOT))
        copied = left.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        pairs = right.withColumn("slot", F.pmod(F.xxhash64("cb"), F.lit(slots)).cast("int")).join(copied, ["dim", "slot"])
    columns = ["dim", *(f"q_{c}" for c in names[1:]), *(f"c_{c}" for c in names[1:]), "q_qb", *(f"q_{c}" for c in more)]

    def block(dim, vecs, sizes, ids, rows, aux):
        return Block(np.frombuffer(vecs, "<f8").reshape(-1, dim), np.frombuffer(sizes, "<i4"), np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8"), aux)

    def run(batches):
        do = work()
        for batch in batches:
            for j in range(batch.num_rows):
                v = [batch.column(c)[j].as_py() for c in range(len(columns))]
                yield from do(dict(zip(["qb", *more], v[11:], strict=True)), block(v[0], *v[1:6]), block(v[0], *v[6:11]))

    return pairs.select(*columns).mapInArrow(run, schema)


def best_batch(queries: Block, found: Iterator[tuple[np.ndarray, ...]], k: int, descending: bool, kind: pa.DataType) -> pa.RecordBatch:
    """(query_id, query_row, vec_id, wide, score): the best k of what was found for each query row in turn: (member ids, member rows, scores, wide).

    wide is -1, 0 or 1: a score below, in or above the range that `kind` can hold.
    """
    out: list[list] = [[] for _ in range(5)]
    for own, row, (ids, rows, scores, wide) in zip(queries.ids.tolist(), queries.rows.tolist(), found, strict=True):
        other = rows != row
        ids, scores, wide = ids[other], scores[other], wide[other]
        key = scores if not descending else np.where(scores == np.iinfo(np.int64).min, np.iinfo(np.int64).max, -np.maximum(scores, -np.iinfo(np.int64).max))
        best = np.lexsort((ids, key, -wide))[:k]
        for o, v in zip(out, (np.full(len(best), own), np.full(len(best), row), ids[best], wide[best], scores[best]), strict=True):
            o.append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), kind)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], type=t) for v, t in zip(out, kinds, strict=True)], names=["query_id", "query_row", "vec_id", "wide", "score"])
