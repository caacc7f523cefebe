"""What the operators of this package share: scratch tables, column defaults, text batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import discard, ship
from millrace.session import shared_folder as shared_dir
from millrace.session import written as cut

__all__ = ["cut", "discard", "fold", "give_back", "lower_words", "map_texts", "mix", "segment_sums", "shared_dir", "text_runs", "word_hashes"]

#: Texts are worked on in runs of about this many bytes, so a worker's memory does not follow the batch.
RUN_CHARS = 1_000_000


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def text_runs(texts: pa.Array, most: int = RUN_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) over consecutive whole texts of about `most` bytes together; null counts as empty. One run at a time leaves Arrow."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, [t or "" for t in texts.slice(start, stop - start).to_pylist()]
        start = stop


def lower_words(text: str) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of text as UTF-8, A-Z lowered; bytes.lower and bytes.split know ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two arrays of hashes, place by place."""
    with np.errstate(over="ignore"):
        h = (a ^ (a >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + b * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32))


#: Word hashes are at least this; smaller numbers are free for other tokens.
LEAST_HASH = 3
_BYTE, _PLACE = np.random.default_rng(29).integers(1, 2**64, (2, 1 << 12), dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words `[^\\x20\\x09-\\x0D]+` of texts, A-Z lowered, in turn; number of words of each text).

    A word's hash sums, over its bytes, a random number of the byte times one of its place, and mixes the sum with the word's length.
    """
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    inner = ~_IS_SPACE[raw]
    opens = inner.copy()
    opens[1:] &= ~inner[:-1]
    edges = (bounds - bounds[0])[:-1]
    edges = edges[edges < len(raw)]
    opens[edges] = inner[edges]  # a text's end ends its last word
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    numbers = np.diff(np.searchsorted(starts, bounds - bounds[0]))
    first = np.flatnonzero(opens[inner])
    sizes = np.diff(np.r_[first, np.count_nonzero(inner)])
    place = np.arange(sizes.sum(), dtype=np.int64) - np.repeat(first, sizes)
    if (most := int(sizes.max())) <= len(_PLACE):
        factor = _PLACE[place]
    else:
        factor = np.r_[_PLACE, mix(np.arange(len(_PLACE), most, dtype=np.uint64), _PLACE[:1])][place]
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[:256][_LOWER[raw[inner]]] * factor, first)
    return np.maximum(mix(sums, sizes.astype(np.uint64)), np.uint64(LEAST_HASH)), numbers


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of values' rows; an empty segment sums to zero."""
    lengths = np.asarray(lengths, dtype=np.int64)
    out = np.zeros((len(lengths), *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else values.dtype)
    full = np.flatnonzero(lengths)
    if len(full):
        ends = np.cumsum(lengths)
        out[full] = np.add.reduceat(values, (ends - lengths)[full], axis=0)
    return out


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def give_back() -> None:
    """Returns what a task has freed to the system: a worker goes on to other tasks, and its memory counts on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(docs: DataFrame, text_col: str, keep: Sequence[str], outputs: dict[str, str], make: Callable[[], Callable], inputs: Sequence[Column] = ()) -> DataFrame:
    """Columns `keep` of docs, passed on untouched, and `outputs` (name to type), made from each row's text and inputs.

    make() is called once a task; what it returns gets (texts, *inputs) of a run of rows, as lists, and returns a
    list of values for each output. Columns are passed by place, so no name in docs can clash; an output's name
    takes the place of a column of that name.
    """
    ship(docs.sparkSession)
    keep = [c for c in keep if c not in outputs]
    k, more = len(keep), len(inputs)
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    arrow = [_ARROW[t] for t in outputs.values()]

    def run(batches):
        work = make()
        for batch in batches:
            for start, texts in text_runs(batch.column(k)):
                part = batch.slice(start, len(texts))
                made = work(texts, *(part.column(k + 1 + j).to_pylist() for j in range(more)))
                columns = [*part.columns[:k], *(pa.array(v, type=t) for v, t in zip(made, arrow, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{j}" for j in range(len(columns))])
        del work
        give_back()

    placed = docs.select(*(F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(keep)), F.col(f"`{text_col}`").alias("t"), *(x.alias(f"x{j}") for j, x in enumerate(inputs)))
    schema = ", ".join(f"c{j} {t}" for j, t in enumerate([*kinds, *outputs.values()]))
    return placed.mapInArrow(run, schema).toDF(*keep, *outputs)
