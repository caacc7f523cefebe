"""WARC archives as seekable Zstandard bundles.

Each row becomes a WARC/1.1 record. Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest id is
a response and the others revisit it; smaller payloads are all responses. A task groups its records into frames of
about FRAME_BYTES, each an independent Zstandard frame, and frames into bundles of about BUNDLE_BYTES; a bundle ends with
a seek table in a skippable frame (the format's own: frame sizes, frame count, a descriptor, its magic number). Bundles are
files in a folder that all executors share, written under a name of their own and then renamed; only the files named in
the index count, so files of lost or repeated tasks do no harm. The index maps a record to its bundle, frame and offset in the frame.

Reading takes the index by bundle, opens the bundle at its footer, decompresses the frames that are asked for alone,
and parses records at their offsets.

Null payloads are empty. Ids are written in the record id; null ids and repeated ids are records like any other. Where several rows with
one payload have its smallest id, one of them (of the smallest URL) is the response and the others revisit it, under the id that they share.
Where equal payloads have no id but null, they are all responses.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, shared_dir
from millrace.session import ship

MIN_REVISIT = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
#: Frames of a bundle that one reading row takes, and plain bytes that one reading task takes.
READ_FRAMES = 16
READ_BYTES = 1 << 24
LEVEL = 3
# Fixed values of the Zstandard formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has no block of its own."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = payload if refers_to is None else b""
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes | memoryview) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record that raw begins with."""
    raw = bytes(raw)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle; frames: (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of each frame of an open bundle."""
    file.seek(size - 9)
    n, descriptor, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC or descriptor & 0x7F:
        raise ValueError("not a seekable bundle")
    width = 12 if descriptor & 0x80 else 8
    file.seek(size - 9 - n * width)
    table, start, out = file.read(n * width), 0, []
    for k in range(n):
        packed, plain = struct.unpack_from("<II", table, k * width)
        out.append((start, packed, plain))
        start += packed
    return out


def marked(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None) -> DataFrame:
    """(page_id, url, payload binary, digest, refers_to) of every row."""
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8")
    url = F.col(f"`{url_col}`").cast("string") if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Groups are counted before anything is dealt out by digest, so a payload that a third of the rows hold is one row.
    large = rows.filter(F.octet_length("payload") >= MIN_REVISIT).select("digest", "page_id")
    per_id = large.groupBy("digest", "page_id").agg(F.count("digest").alias("n"))
    firsts = per_id.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("n"), F.min_by("n", "page_id").alias("n_first")).filter("n > 1 AND first IS NOT NULL")
    firsts = cut(firsts.select(F.col("digest").alias("d"), "first", "n_first"), "warc-firsts")
    # Payloads too small to be revisited meet nothing, and are dealt by a hash of their own instead of by their few digests.
    key = F.when(F.octet_length("payload") >= MIN_REVISIT, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("key", key).join(firsts, F.col("key") == F.col("d"), "left")  # a hot digest is one that the join can split
    columns = ["page_id", "url", "payload", "digest"]
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    if not firsts.filter("n_first > 1").limit(1).count():
        return joined.select(*columns, F.when(is_first, None).otherwise(F.col("first")).alias("refers_to"))
    # Rows that share the smallest id are numbered in a table of their own; of each payload the lowest of them is the response.
    shared = F.coalesce(is_first & (F.col("n_first") > 1), F.lit(False))
    alike = cut(joined.filter(shared).select(*columns, "d", "first", F.monotonically_increasing_id().alias("place")), "warc-shared-ids")
    lowest = F.min(F.struct(F.coalesce("url", F.lit("")).alias("u"), "place"))
    chosen = alike.groupBy("d").agg(lowest.alias("low")).select(F.col("d").alias("cd"), F.col("low.place").alias("chosen"))
    alike = alike.join(chosen, F.col("d") == F.col("cd")).select(*columns, F.when(F.col("place") == F.col("chosen"), None).otherwise(F.col("first")).alias("refers_to"))
    return joined.filter(~shared).select(*columns, F.when(is_first, None).otherwise(F.col("first")).alias("refers_to")).unionAll(alike)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """Writes the archives and returns the index: (page_id, bundle, frame, offset, length), a table in the shared folder."""
    ship(pages.sparkSession)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL)
        state: dict = {}

        def open_bundle():
            name = f"bundle-{uuid.uuid4().hex}.warc.zst"
            state.update(name=name, out=fs.open_output_stream(f"{root}/.{name}", compression=None), frames=[], size=0, held=[], plain=0, rows=[])

        def end_frame():
            if state["held"]:
                packed = packer.compress(b"".join(state["held"]))
                state["out"].write(packed)
                state["frames"].append((len(packed), state["plain"]))
                state.update(held=[], plain=0, size=state["size"] + len(packed))

        def end_bundle():
            end_frame()
            state["out"].write(seek_table(state["frames"]))
            state["out"].close()
            fs.move(f"{root}/.{state['name']}", f"{root}/{state['name']}")
            ids, frames, offsets, lengths = zip(*state["rows"], strict=True)
            name, n = state["name"], len(ids)
            state.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * n, pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["page_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not state:
                    open_bundle()
                raw = record(page_id, url, payload, digest, refers_to)
                state["rows"].append((page_id, len(state["frames"]), state["plain"], len(raw)))
                state["held"].append(raw)
                state["plain"] += len(raw)
                if state["plain"] >= FRAME_BYTES:
                    end_frame()
                    if state["size"] >= BUNDLE_BYTES:
                        yield end_bundle()
        if state:
            yield end_bundle()

    return cut(marked(pages, id_col, payload_col, url_col).mapInArrow(run, "page_id long, bundle string, frame int, offset long, length long"), "warc-index")


def read_records(fs, root: str, bundle: str, wanted: list[tuple[int, int, int]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each wanted (frame, offset, length) of one bundle, frames in order; each frame is read once."""
    path = f"{root}/{bundle}"
    opener = zstandard.ZstdDecompressor()
    with fs.open_input_file(path) as file:
        frames = read_seek_table(file, file.size())
        now, plain = -1, b""
        for frame, offset, length in wanted:
            if frame != now:
                start, packed, size = frames[frame]
                file.seek(start)
                plain, now = opener.decompress(file.read(packed), max_output_size=size), frame
            yield parse(memoryview(plain)[offset : offset + length])


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, payload) of the index's records, read back from the
    bundles; payload is null for revisits, and for all where payloads is false.

    A response's digest and length are those of what was read, held against its header; a revisit's are its header's.
    """
    ship(index.sparkSession)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for bundle, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entries.sort(key=lambda e: (e["frame"], e["offset"]))
                out: list[list] = [[] for _ in range(6)]
                found = read_records(fs, root, bundle, [(e["frame"], e["offset"], e["length"]) for e in entries])
                for e, (headers, block) in zip(entries, found, strict=True):
                    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["WARC-Payload-Length"])
                    if headers["WARC-Type"] == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != size):
                        raise ValueError(f"record {e['page_id']} of {bundle} differs from its digest")
                    refers = headers.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
                    if headers["WARC-Record-ID"] != f"<urn:page:{'' if e['page_id'] is None else e['page_id']}>":
                        raise ValueError(f"the index leads to {headers['WARC-Record-ID']} instead of {e['page_id']}")
                    for x, v in zip(out, (e["page_id"], headers["WARC-Type"], int(refers) if refers else None, size, digest, block if payloads and headers["WARC-Type"] == "response" else None), strict=True):
                        x.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    # The index is small beside what it leads to, so the number of tasks follows the bytes to be read.
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    stretches = index.withColumn("stretch", F.floor(F.col("frame") / READ_FRAMES)).repartition(tasks, "bundle", "stretch")
    read = stretches.groupBy("bundle", "stretch").agg(F.collect_list(F.struct("page_id", "frame", "offset", "length")).alias("entries"))
    return read.select("bundle", "entries").mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive_folder(spark) -> str:
    """A new folder for bundles, below the shared one."""
    shared = shared_dir(spark)
    if shared.startswith("file:/") and not shared.startswith("file://"):
        shared = "file://" + shared.removeprefix("file:")
    return f"{shared if '://' in shared else 'file://' + shared}/warc-{uuid.uuid4().hex}"
