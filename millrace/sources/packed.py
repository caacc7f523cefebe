"""Data sources for Spark over big-endian binary files: self-describing tables (read and written), scene trees (read), files of bytes (written).

    register(spark)
    df.write.format("packed_table").option("path", folder).mode("append").save()
    spark.read.format("packed_table").option("path", folder).schema("id long, price float").load()

Files are reached through pyarrow.fs (local paths, file://, s3://, gs://, hdfs://) from the tasks. A table's columns have no names, only hashes of
names: a schema that is given names the columns and says how each is read (long: masked and shifted; boolean: masked; int, float and double,
string: the whole field), and no other column is decoded. Without one the schema comes from the header of the first file, with the names of
option `names` and hash_<hex> for the others. A column that a file lacks is null.

Large files are read in ranges of rows of about `splitBytes`, smaller ones whole, each a partition. A file whose header or length contradicts
itself is an error that names it, or, with option onCorrupt=skip, passed over. Files are written under a hidden name and renamed
when the job commits, so lost and repeated tasks leave none behind.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from millrace.session import ship
from millrace.sources.binary import Cursor, field_hash, scene_rows

# Fixed values of the layout: header (rows, fields, data offset, row stride), field (name hash, mask, offset, shift, type), type codes.
HEAD, FIELD = struct.Struct(">iiiI"), struct.Struct(">IIHBB")
TYPES = {0: LongType(), 1: StringType(), 2: FloatType(), 3: LongType(), 4: LongType(), 5: LongType()}
SPLIT_BYTES = 32 << 20
#: Rows that are decoded, and held, at once.
BATCH_ROWS = 50_000
#: Rows of a file that a task writes at most.
FILE_ROWS = 500_000


class CorruptFile(ValueError):
    """A file that contradicts its own layout."""


@dataclass
class Table:
    """A table file's header."""

    rows: int
    start: int
    stride: int
    fields: dict[int, tuple[int, int, int, int]]


@dataclass
class Range(InputPartition):
    """Rows first..first+count of a file; all if count is None."""

    path: str
    first: int = 0
    count: int | None = None

    def __init__(self, path: str, first: int = 0, count: int | None = None) -> None:
        self.path, self.first, self.count = path, first, count


def files_below(path: str) -> tuple[pafs.FileSystem, str, list[pafs.FileInfo]]:
    """(file system, folder or file, files below it by path), hidden ones and those of hidden folders left out."""
    fs, root = pafs.FileSystem.from_uri(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    seen = lambda f: not any(p.startswith((".", "_")) for p in f.path.removeprefix(root).split("/") if p)
    return fs, root, sorted((f for f in found if f.is_file and seen(f)), key=lambda f: f.path)


def header_of(file: pa.NativeFile, path: str, size: int) -> Table:
    """The header of an open table file of `size` bytes, checked."""
    raw = file.read_at(HEAD.size, 0)
    if len(raw) < HEAD.size:
        raise CorruptFile(f"{path}: {len(raw)} bytes are no header")
    rows, fields, start, stride = HEAD.unpack(raw)
    if rows < 0 or fields < 0 or start < HEAD.size + FIELD.size * fields:
        raise CorruptFile(f"{path}: {rows} rows, {fields} fields, data at {start}")
    if size < start + rows * stride:
        raise CorruptFile(f"{path}: {rows} rows of {stride} bytes end after the file's {size} bytes")
    described = file.read_at(FIELD.size * fields, HEAD.size)
    found: dict[int, tuple[int, int, int, int]] = {}
    for h, mask, offset, shift, kind in FIELD.iter_unpack(described):
        if offset + (1 if kind == 1 else 4) > stride:
            raise CorruptFile(f"{path}: a field at {offset} of a row of {stride} bytes")
        found.setdefault(h, (mask, offset, shift, kind))
    return Table(rows, start, stride, found)


def decoded(raw: bytes, table: Table, schema: StructType) -> pa.RecordBatch:
    """The columns of schema, of whole rows."""
    rows = np.frombuffer(raw, np.uint8).reshape(-1, table.stride) if table.stride else np.zeros((0, 0), np.uint8)
    columns, kinds = [], []
    for field in schema.fields:
        kind = {LongType: pa.int64(), IntegerType: pa.int32(), BooleanType: pa.bool_(), FloatType: pa.float32(), DoubleType: pa.float64(), StringType: pa.string()}[type(field.dataType)]
        kinds.append(pa.field(field.name, kind))
        if (described := table.fields.get(field_hash(field.name))) is None and field.name.startswith("hash_"):
            described = table.fields.get(int(field.name[5:], 16))
        if described is None:
            columns.append(pa.nulls(len(rows), kind))
            continue
        mask, offset, shift, _ = described
        if pa.types.is_string(kind):
            columns.append(pa.array([r.tobytes().split(b"\0", 1)[0].decode("shift_jis", "replace") for r in rows[:, offset:]], kind))
            continue
        cells = np.ascontiguousarray(rows[:, offset : offset + 4]).reshape(-1).view({pa.int32(): ">i4", pa.float32(): ">f4", pa.float64(): ">f4"}.get(kind, ">u4"))
        if kind in (pa.int64(), pa.bool_()):
            cells = cells.astype(np.int64) & mask
            cells = cells != 0 if kind == pa.bool_() else cells >> shift
        columns.append(pa.array(cells.astype(cells.dtype.newbyteorder("="))).cast(kind))
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds))


class TableReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int, skips: bool) -> None:
        self.path, self.schema, self.split, self.skips = path, schema, split, skips

    def partitions(self) -> list[Range]:
        fs, _, files = files_below(self.path)
        out = []
        for f in files:
            if f.size <= self.split:
                out.append(Range(f.path))
                continue
            try:
                with fs.open_input_file(f.path) as file:
                    table = header_of(file, f.path, f.size)
            except CorruptFile:
                out.append(Range(f.path))  # its task says so, or passes over it
                continue
            step = max(1, self.split // max(1, table.stride))
            out += [Range(f.path, at, min(step, table.rows - at)) for at in range(0, max(1, table.rows), step)]
        return out or [Range("")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as file:
            try:
                table = header_of(file, partition.path, file.size())
            except CorruptFile:
                if self.skips:
                    return
                raise
            last = table.rows if partition.count is None else partition.first + partition.count
            for at in range(partition.first, last, BATCH_ROWS):
                n = min(BATCH_ROWS, last - at)
                raw = file.read_at(n * table.stride, table.start + at * table.stride)
                if len(raw) < n * table.stride:
                    raise CorruptFile(f"{partition.path}: it ends within row {at + len(raw) // table.stride}")
                yield decoded(raw, table, self.schema)


def encoded(batch: pa.RecordBatch, schema: StructType) -> bytes:
    """Cells of 4 bytes a column: long and boolean as unsigned numbers, int, float and double as such; null is 0."""
    cells = np.zeros((batch.num_rows, len(schema.fields)), ">u4")
    for i, field in enumerate(schema.fields):
        values = batch.column(i)
        if isinstance(field.dataType, (FloatType, DoubleType)):
            cells[:, i] = values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).astype(">f4").view(">u4")
        else:
            values = values.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            low, high = (-(1 << 31), 1 << 31) if isinstance(field.dataType, IntegerType) else (0, 1 << 32)
            if len(values) and (values.min() < low or values.max() >= high):
                raise ValueError(f"{field.name}: a value takes more than 32 bits")
            cells[:, i] = (values & 0xFFFFFFFF).astype(">u4")
    return cells.tobytes()


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class HiddenFiles(DataSourceArrowWriter):
    """A writer whose tasks write files below <path>/.<job>/, which commit moves to <path>."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, f".{uuid.uuid4().hex}"

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{root}/{self.job}", recursive=True)
        attempt, paths = uuid.uuid4().hex, []
        for name, parts in self.files(iterator):
            hidden = f"{root}/{self.job}/{attempt}-{name}"
            with fs.open_output_stream(hidden, compression=None) as out:
                for part in parts:
                    out.write(part)
            paths.append(hidden)
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for f in files_below(self.path)[2] if fs.get_file_info(root).type != pafs.FileType.NotFound else []:
                fs.delete_file(f.path)
        for path in (p for m in messages if m for p in m.paths):
            fs.move(path, f"{root}/{path.rsplit('/', 1)[1].split('-', 1)[1]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{root}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.job}")


class TableWriter(HiddenFiles):
    def __init__(self, path: str, overwrite: bool, schema: StructType) -> None:
        super().__init__(path, overwrite)
        self.schema = schema

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
        fields = [FIELD.pack(field_hash(f.name), 0xFFFFFFFF, 4 * i, 0, 2 if isinstance(f.dataType, (FloatType, DoubleType)) else 0) for i, f in enumerate(self.schema.fields)]
        head = lambda rows: HEAD.pack(rows, len(fields), HEAD.size + FIELD.size * len(fields), 4 * len(fields)) + b"".join(fields)
        parts, rows = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, FILE_ROWS):
                some = batch.slice(start, FILE_ROWS)
                if rows + some.num_rows > FILE_ROWS:
                    yield f"{uuid.uuid4().hex}.tbl", [head(rows), *parts]
                    parts, rows = [], 0
                parts.append(encoded(some, self.schema))
                rows += some.num_rows
        if rows:
            yield f"{uuid.uuid4().hex}.tbl", [head(rows), *parts]


class BytesWriter(HiddenFiles):
    """A file for each row (name string, content binary)."""

    def files(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), [batch.column(1)[i].as_py() or b""]


class PackedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_table"

    def schema(self) -> StructType:
        fs, _, files = files_below(self.options["path"])
        known = {field_hash(n.strip()): n.strip() for n in self.options.get("names", "").split(",") if n.strip()}
        for f in files:
            with fs.open_input_file(f.path) as file:
                table = header_of(file, f.path, f.size)
            return StructType([StructField(known.get(h, f"hash_{h:x}"), TYPES.get(kind, LongType())) for h, (_, _, _, kind) in table.fields.items()])
        return StructType([])

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(self.options["path"], schema, int(self.options.get("splitBytes", SPLIT_BYTES)), self.options.get("onCorrupt", "fail") == "skip")

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        return TableWriter(self.options["path"], overwrite, schema)


class ByteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> BytesWriter:
        return BytesWriter(self.options["path"], overwrite)


def bodies_of(described: str) -> dict[str, Callable[[Cursor], dict]]:
    """Readers of record bodies from "Type: kind name, kind name; Type: ...", kinds being letters of struct or `text`."""

    def reader(fields: list[list[str]]) -> Callable[[Cursor], dict]:
        return lambda cur: {name: cur.text() if kind == "text" else cur.number(kind) for kind, name in fields}

    pairs = (part.split(":", 1) for part in described.split(";") if ":" in part)
    return {kind.strip(): reader([f.split() for f in fields.split(",") if f.strip()]) for kind, fields in pairs}


class SceneReader(DataSourceReader):
    def __init__(self, path: str, groups: set[str], types: str, skips: bool) -> None:
        self.path, self.groups, self.types, self.skips = path, groups, types, skips

    def partitions(self) -> list[Range]:
        return [Range(f.path) for f in files_below(self.path)[2]] or [Range("")]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as file:
            data = file.read()
        try:
            # A skipped file gives nothing, not what stands before its fault.
            rows = scene_rows(data, bodies_of(self.types), self.groups)
            for r in list(rows) if self.skips else rows:
                yield (partition.path, r["id"], r["parent_id"], r["path"], r["type"], r["key"], r["name"], r["props"])
        except (ValueError, RecursionError) as error:
            if not self.skips:
                raise CorruptFile(f"{partition.path}: {error}") from error


class SceneTree(DataSource):
    """Options: groups (names of types whose bodies are records, by commas), types (see bodies_of). A file is a partition; ids count in pre-order within it."""

    @classmethod
    def name(cls) -> str:
        return "scene_tree"

    def schema(self) -> str:
        return "file string, id long, parent_id long, path string, type string, key int, name string, props map<string,string>"

    def reader(self, schema: StructType) -> SceneReader:
        groups = {g.strip() for g in self.options.get("groups", "").split(",") if g.strip()}
        return SceneReader(self.options["path"], groups, self.options.get("types", ""), self.options.get("onCorrupt", "fail") == "skip")


def register(spark: SparkSession) -> None:
    """Makes the formats packed_table, scene_tree and byte_files known to a session."""
    ship(spark)
    for source in (PackedTable, SceneTree, ByteFiles):
        spark.dataSource.register(source)
