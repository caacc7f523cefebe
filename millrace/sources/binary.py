"""Decoders of big-endian binary layouts and readers over Spark's binaryFile source.

Fixed values of the layouts (magic numbers, field widths, type codes) are stated where they are used. Short or broken input raises ValueError
with its place, except where a layout defines an answer for it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from millrace.session import ship


class Cursor:
    """Typed reads over bytes. A short read gives what is left and marks the end; a seek clears the mark."""

    def __init__(self, data: bytes):
        self.data, self.at, self.ended = data, 0, False

    def raw(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        self.ended |= len(out) < n
        return out

    def number(self, kind: str):
        """kind: one letter of struct, big-endian."""
        raw = self.raw(struct.calcsize(">" + kind))
        if self.ended:
            raise ValueError(f"the data end at {self.at}")
        return struct.unpack(">" + kind, raw)[0]

    def text(self, room: int | None = None) -> str:
        """A length in 16 bits and the bytes; with `room`, at most room - 1 of them are kept and the rest passed over."""
        raw = self.raw(self.number("H"))
        return (raw if room is None else raw[: room - 1]).decode("shift_jis", "replace")

    def skip(self, n: int) -> None:
        self.raw(n)

    def align(self, n: int) -> None:
        self.skip(-self.at % n)

    def peek(self, n: int) -> bytes:
        at, ended = self.at, self.ended
        out = self.raw(n)
        self.at, self.ended = at, ended
        return out

    def seek(self, to: int) -> int:
        """The distance moved; the place is kept within the data."""
        was, self.at, self.ended = self.at, min(max(to, 0), len(self.data)), False
        return self.at - was


class Writer:
    """Typed writes of big-endian values, the other side of Cursor."""

    def __init__(self):
        self.data = bytearray()

    def raw(self, data: bytes) -> Writer:
        self.data += data
        return self

    def number(self, kind: str, value) -> Writer:
        return self.raw(struct.pack(">" + kind, value))

    def text(self, value: str) -> Writer:
        raw = value.encode("shift_jis", "replace")
        return self.number("H", len(raw)).raw(raw)

    def skip(self, n: int, value: int = 0) -> Writer:
        """n bytes of one value."""
        return self.raw(bytes([value]) * n)

    def align(self, n: int, value: int = 0) -> Writer:
        return self.skip(-len(self.data) % n, value)


def field_hash(name: str) -> int:
    """The hash by which table columns are named: times 256, modulo 0x1FFFFD9."""
    h = 0
    for b in name.encode():
        h = (h * 256 + b) % 0x1FFFFD9
    return h


def table_rows(data: bytes, columns: dict[str, str]) -> Iterator[dict]:
    """Rows of a self-describing table. columns: name to u32, s32, bool, f32 or str; a column that the table lacks is None.

    Header: rows, fields, data offset, row stride. A field: name hash, bit mask, byte offset, shift, type (the caller's type counts)."""
    if not data:
        return
    rows, fields, start, stride = struct.unpack_from(">iiiI", data)
    found = {}
    for i in range(fields):
        h, mask, offset, shift, _ = struct.unpack_from(">IIHBB", data, 16 + 12 * i)
        found.setdefault(h, (mask, offset, shift))
    for r in range(rows):
        out = {}
        for name, kind in columns.items():
            if (f := found.get(field_hash(name))) is None:
                out[name] = None
                continue
            mask, offset, shift = f
            at = start + r * stride + offset
            if kind == "str":
                out[name] = data[at : start + (r + 1) * stride].split(b"\0", 1)[0].decode("shift_jis", "replace")
            elif kind in ("u32", "bool"):
                v = struct.unpack_from(">I", data, at)[0] & mask
                out[name] = v != 0 if kind == "bool" else v >> shift
            else:
                out[name] = struct.unpack_from(">i" if kind == "s32" else ">f", data, at)[0]
        yield out


def table_bytes(columns: dict[str, str], rows: list[dict]) -> bytes:
    """A table of 4-byte columns (u32, s32, bool, f32), as table_rows reads it."""
    head = struct.pack(">iiiI", len(rows), len(columns), 16 + 12 * len(columns), 4 * len(columns))
    fields = b"".join(struct.pack(">IIHBB", field_hash(n), 0xFFFFFFFF, 4 * i, 0, 0) for i, n in enumerate(columns))
    cells = b"".join(struct.pack({"f32": ">f", "s32": ">i"}.get(k, ">I"), r[n]) for r in rows for n, k in columns.items())
    return head + fields + cells


def scene_rows(data: bytes, bodies: dict[str, Callable[[Cursor], dict]], groups: set[str]) -> Iterator[dict]:
    """Records of a tree in pre-order: id, parent_id, path, type, key, name, props. Record: size (itself included), key, type, then the name and
    the body; a group's body is a count and that many records. A type that neither knows is passed over by its size."""
    counter = iter(range(1 << 62))

    def record(cur: Cursor, parent: int | None, path: str) -> Iterator[dict]:
        begin = cur.at
        size, key = cur.number("I"), cur.number("H")
        if size < 8 or begin + size > len(data):
            raise ValueError(f"a record of {size} bytes at {begin} of {len(data)}")
        kind = cur.text()
        if kind in groups or kind in bodies:
            own = next(counter)
            name = cur.text()
            here = f"{path}/{name}"
            yield {"id": own, "parent_id": parent, "path": here, "type": kind, "key": key, "name": name, "props": {k: str(v) for k, v in bodies[kind](cur).items()} if kind in bodies else {}}
            if kind in groups:
                for _ in range(cur.number("I")):
                    yield from record(cur, own, here)
        cur.seek(begin + size)

    if data:
        yield from record(Cursor(data), None, "")


def array_rows(data: bytes, body: Callable[[Cursor], dict]) -> Iterator[dict]:
    """A count and that many records of one type; their names are dropped."""
    cur = Cursor(data)
    for _ in range(cur.number("I")):
        begin, size = cur.at, cur.number("I")
        cur.number("H")
        cur.text()
        cur.text()
        yield body(cur)
        cur.seek(begin + size)


def codec_of(data: bytes) -> str:
    return {b"Yaz0": "Yaz0", b"Yay0": "Yay0"}.get(bytes(data[:4]), "NONE")


def decompress(data: bytes, start: int = 0, most: int | None = None) -> bytes:
    """Plain bytes from `start`, at most `most`, of a Yaz0 or Yay0 block; other data as they are.

    A match has a distance of 12 bits (plus 1) and a length of 4 bits (plus 2); a length of 0 takes a byte more (plus 18)."""
    codec = codec_of(data)
    if codec == "NONE":
        plain = bytes(data)
    else:
        size = struct.unpack_from(">I", data, 4)[0]
        out = bytearray()
        if codec == "Yaz0":
            flags_at = link_at = byte_at = 16
        else:
            link_at, byte_at = struct.unpack_from(">II", data, 8)
            flags_at = 16
        one = codec == "Yaz0"
        bits = left = 0
        at = flags_at
        while len(out) < size:
            if not left:
                bits, left = (data[at], 8) if one else (struct.unpack_from(">I", data, at)[0], 32)
                at += 1 if one else 4
            left -= 1
            if bits >> left & 1:
                if one:
                    out.append(data[at])
                    at += 1
                else:
                    out.append(data[byte_at])
                    byte_at += 1
                continue
            pair = struct.unpack_from(">H", data, at if one else link_at)[0]
            at, link_at = (at + 2, link_at) if one else (at, link_at + 2)
            n, back = pair >> 12, (pair & 0xFFF) + 1
            if n:
                n += 2
            elif one:
                n, at = data[at] + 18, at + 1
            else:
                n, byte_at = data[byte_at] + 18, byte_at + 1
            if back > len(out):
                raise ValueError(f"a match at {len(out)} goes back {back}")
            for _ in range(n):
                out.append(out[-back])
        plain = bytes(out[:size])
    return plain[start : None if most is None else start + most]


def compress_literal(data: bytes) -> bytes:
    """A valid Yaz0 block of literals and of matches with the byte before."""
    out, at = bytearray(b"Yaz0" + struct.pack(">I8x", len(data))), 0
    while at < len(data):
        flags, body = 0, bytearray()
        for bit in range(7, -1, -1):
            if at >= len(data):
                break
            run = 0
            while at and run < 273 and at + run < len(data) and data[at + run] == data[at - 1]:
                run += 1
            if run >= 18:
                body += struct.pack(">HB", 0, run - 18)
                at += run
            else:
                flags |= 1 << bit
                body.append(data[at])
                at += 1
        out.append(flags)
        out += body
    return bytes(out)


def compress_split(data: bytes) -> bytes:
    """A valid Yay0 block of literals and of matches with what stood up to 4096 bytes before: flags, matches and bytes lie in three tables."""
    flags, links, loose, at = [], bytearray(), bytearray(), 0
    seen: dict[bytes, int] = {}
    while at < len(data):
        back = seen.get(data[at : at + 3], -1)
        n = 0
        if back >= 0 and at - back <= 4096:
            while n < 273 and at + n < len(data) and data[back + n] == data[at + n]:
                n += 1
        if n >= 3:
            links += struct.pack(">H", (n - 2 << 12 if n < 18 else 0) | (at - back - 1))
            if n >= 18:
                loose.append(n - 18)
        else:
            n = 1
            loose.append(data[at])
        flags.append(n == 1)
        for k in range(at, at + n):
            seen[data[k : k + 3]] = k
        at += n
    words = [sum(f << (31 - i) for i, f in enumerate(flags[k : k + 32])) for k in range(0, len(flags), 32)]
    link_at = 16 + 4 * len(words)
    return b"Yay0" + struct.pack(">III", len(data), link_at, link_at + len(links)) + struct.pack(f">{len(words)}I", *words) + bytes(links) + bytes(loose)


def array_bytes(bodies: list[bytes]) -> bytes:
    """A count and one record a body, without names, as array_rows reads them."""
    out = Writer().number("I", len(bodies))
    for body in bodies:
        out.number("I", 10 + len(body)).number("H", 0).text("").text("").raw(body)
    return bytes(out.data)


def message_bytes(texts: list[str]) -> bytes:
    """A table of messages, as message_rows reads it."""
    stored, offsets = bytearray(), []
    for t in texts:
        offsets.append(len(stored))
        stored += t.encode("shift_jis", "replace") + b"\0"
    info = struct.pack(">4sIHH4x", b"INF1", 16 + 4 * len(texts), len(texts), 4) + struct.pack(f">{len(texts)}I", *offsets)
    return bytes(32) + info + struct.pack(">4sI", b"DAT1", 8 + len(stored)) + bytes(stored)


def message_rows(data: bytes) -> Iterator[dict]:
    """Messages of tagged blocks INF1 (count, row size, offsets) and DAT1 (texts): id (16 bits), offset, text. Block: tag, size, body; the file's header is 32 bytes."""
    at, info, texts = 32, None, b""
    while at + 8 <= len(data):
        tag, size = struct.unpack_from(">4sI", data, at)
        if tag == b"INF1":
            n, stride = struct.unpack_from(">HH", data, at + 8)
            info = [struct.unpack_from(">I", data, at + 16 + i * stride)[0] for i in range(n)]
        elif tag == b"DAT1":
            texts = data[at + 8 : at + size]
        at += max(size, 8)
    for i, offset in enumerate(info or []):
        yield {"id": i & 0xFFFF, "offset": offset, "text": texts[offset:].split(b"\0", 1)[0].decode("shift_jis", "replace")}


SNAPSHOT_MAGIC, BOOLS, INTS = 4, 512, 512


def snapshot_bytes(time: int, saves: int, shines: int, bools: list[bool], ints: list[int]) -> bytes:
    """Magic, time, padding, saves + 1, shines, padding, the flag bits, the whole numbers; each save counts itself."""
    packed = bytearray(BOOLS // 8)
    for i, b in enumerate(bools):
        packed[i // 8] |= bool(b) << (i % 8)
    padded = [*ints, *[0] * (INTS - len(ints))]
    return struct.pack(">IqQIHH64x", SNAPSHOT_MAGIC, time, 0, saves + 1, shines, 0) + bytes(packed) + struct.pack(f">{INTS}i", *padded)


def read_snapshot(data: bytes) -> dict:
    """The snapshot, with shines counted anew from the first 120 bits; another magic number gives the empty state."""
    if len(data) < 4 or struct.unpack_from(">I", data)[0] != SNAPSHOT_MAGIC:
        return {"valid": False, "time": 0, "saves": 0, "shines": 0, "bools": [], "ints": []}
    _, time, _, saves, _, _ = struct.unpack_from(">IqQIHH", data)
    at = struct.calcsize(">IqQIHH64x")
    bits = [i for i in range(BOOLS) if data[at + i // 8] >> (i % 8) & 1]
    ints = list(struct.unpack_from(f">{INTS}i", data, at + BOOLS // 8))
    return {"valid": True, "time": time, "saves": saves, "shines": sum(b < 120 for b in bits), "bools": bits, "ints": ints}


def read_files(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[dict]], schema: str, recursive: bool = True) -> DataFrame:
    """Rows that `decode` gives for each file below path, with `path`; blocks are decompressed first. schema: the rows' columns."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")
    names = [x.strip().split(" ")[0] for x in schema.replace("array<", "array_").split(",")]

    def run(batches):
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                rows = list(decode(decompress(bytes(content))))
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=names).assign(path=p)[["path", *names]]

    return files.mapInPandas(run, f"path string, {schema}")
