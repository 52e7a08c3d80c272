"""Media columns: payloads in archives, read back through a Spark data source.

Writers pack members (8-bit greyscale PNG images, rows of ``ROW`` samples) into ZIP archives of
bounded size in a directory that all executors share. The data source plans byte ranges over the
directory's archives from their sizes alone; the task of a range reads the archive's member table,
takes the members that start in its range, fetches their bytes in one read and streams them in Arrow
batches. A member whose bytes fail its checksum is read again by its own offset, up to ``TRIES``
times, without touching the others; one that stays unreadable gives a row with ``error`` set.

A task writes its archives under names that follow from its partition, each put in place by one move,
so a task that is run again replaces what it wrote.

Defined results: null text counts as empty; an empty text is one row of spaces; a null id stays null;
repeated rows are members of their own, and equal texts have equal stored forms; a very long text is one member,
in an archive of its own if it fills one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from watchloom.llm.common import materialize, shared_path

ROW = 192
PAD = b" "
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TRIES = 3
MAGIC = b"\x89PNG\r\n\x1a\n"


def file_system(uri: str):
    """The file system and path of a URI, as Arrow knows them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_image(raw: bytes) -> bytes:
    """A PNG whose samples are ``raw``, padded with spaces to whole rows; its length is kept beside."""
    payload = raw + PAD * (-len(raw) % ROW if raw else ROW)
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of :func:`encode_image`'s bytes."""
    if media[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, data, n, width = 8, [], None, ROW
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk fails its checksum")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n = int(body[8:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    return rows[:, 1:].tobytes(), n if n is not None else rows.shape[0] * width


def features(payload: bytes) -> str:
    """Size, mean, deviation, entropy and contrast of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(x))
    dev = float(np.sqrt(max(0.0, (counts * values * values).sum() / len(x) - mean * mean)))
    return f"rows={len(x) // ROW};mean={mean:.6f};dev={dev:.6f};entropy={float(-(p * np.log2(p)).sum()):.6f};distinct={int((counts > 0).sum())}"


def _pack(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = file_system(uri)
        part, written = TaskContext.get().partitionId(), []
        state: dict = {}

        def start() -> None:
            state["buffer"] = io.BytesIO()
            state["zip"] = zipfile.ZipFile(state["buffer"], "w", zipfile.ZIP_STORED, allowZip64=True)
            state["n"] = 0

        def finish() -> None:
            state["zip"].close()
            name, own = f"{root}/part-{part:06d}-{len(written):04d}.zip", f"{root}/.{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(own) as f:
                f.write(state["buffer"].getbuffer())
            fs.move(own, name)
            written.append((name.rpartition("/")[2], state["n"], state["buffer"].tell()))

        start()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                entry = zipfile.ZipInfo(f"{state['n']:08d}_{'null' if doc_id is None else doc_id}.png", (1980, 1, 1, 0, 0, 0))
                state["zip"].writestr(entry, encode_image((text or "").encode("utf-8", "surrogatepass")))
                state["n"] += 1
                if state["buffer"].tell() >= ARCHIVE_BYTES:
                    finish()
                    start()
        if state["n"]:
            finish()
        names, members, sizes = zip(*written, strict=True) if written else ((), (), ())
        yield pa.RecordBatch.from_pydict({"archive": pa.array(names, pa.string()), "members": pa.array(members, pa.int64()), "bytes": pa.array(sizes, pa.int64())})

    return run


def write_archives(docs: DataFrame, uri: str) -> DataFrame:
    """Pack ``docs``' (doc_id, text) into archives under ``uri``; returns the manifest (archive, members, bytes)."""
    fs, root = file_system(uri)
    fs.create_dir(root, recursive=True)
    return materialize(docs.select("doc_id", "text").mapInArrow(_pack(uri), "archive string, members long, bytes long"), "manifest")


#: What reading a damaged or unreachable archive may raise.
FAILURES = (OSError, EOFError, ValueError, struct.error, zlib.error, zipfile.BadZipFile)


def again(work, tries: int):
    """``work()``, tried up to ``tries`` times."""
    for k in range(tries):
        try:
            return work()
        except FAILURES:
            if k == tries - 1:
                raise


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, stop: int):
        self.archive, self.start, self.stop = archive, start, stop


def read_member(f, info: zipfile.ZipInfo, buffer: bytes | None = None, base: int = 0) -> bytes:
    """A member's bytes, from ``buffer`` (which starts at ``base``) or by its own offset; checked."""

    def take(at: int, n: int) -> bytes:
        if buffer is not None:
            return bytes(buffer[at - base : at - base + n])
        f.seek(at)
        return f.read(n)

    head = take(info.header_offset, 30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise OSError(f"no member at {info.header_offset}")
    name, extra = struct.unpack("<HH", head[26:30])
    data = take(info.header_offset + 30 + name + extra, info.compress_size)
    if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
        raise OSError(f"member {info.filename} fails its checksum")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchBytes", BATCH_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs as pafs

        fs, root = file_system(self.uri)
        files = [x for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.endswith(".zip")]
        return [ByteRange(x.path, a, min(a + self.range_bytes, x.size)) for x in sorted(files, key=lambda x: x.path) for a in range(0, x.size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = file_system(self.uri)
        rows: list[tuple] = []
        held = 0
        with fs.open_input_file(partition.archive) as f:
            try:
                directory = again(lambda: zipfile.ZipFile(f).infolist(), self.tries)
            except FAILURES as e:  # the archive's directory can't be read: one row says so
                if partition.start == 0:
                    yield _batch([(partition.archive.rpartition("/")[2], None, None, None, f"directory: {e}")])
                return
            members = sorted((m for m in directory if partition.start <= m.header_offset < partition.stop), key=lambda m: m.header_offset)
            at = 0
            while at < len(members):  # members of a batch are fetched in one read
                some, size = [], 0
                while at < len(members) and (not some or size < self.batch_bytes):
                    some.append(members[at])
                    size += members[at].compress_size
                    at += 1
                base, last = some[0].header_offset, some[-1]
                try:
                    f.seek(base)
                    buffer = memoryview(f.read(last.header_offset + 30 + 2 * len(last.filename) + 64 + last.compress_size - base))
                except OSError:
                    buffer = None  # each member is then read by itself
                for m in some:
                    media, error = None, None
                    for k in range(self.tries):
                        try:
                            media, error = read_member(f, m, None if k else buffer, base), None
                            break
                        except FAILURES as e:
                            error = str(e)
                    rows.append((partition.archive.rpartition("/")[2], m.filename, m.header_offset, media, error))
                    held += len(media or b"")
                yield _batch(rows)
                rows, held = [], 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["archive", "member", "offset", "media", "error"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(directory)``: archive, member, offset, media, error."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary, error string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, uri: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**options).load(uri)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for member, media, error in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist(), batch.column("error").to_pylist(), strict=True):
            doc = (member or "").rpartition("_")[2].removesuffix(".png")
            doc_id = int(doc) if doc.lstrip("-").isdigit() else None
            try:
                payload, n = decode_image(media) if media is not None else (None, None)
            except FAILURES as e:
                payload, error = None, f"{member}: {e}"
            if payload is None:
                out.append((doc_id, None, None, None, None, None, None, None, error))
                continue
            out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload), None))
        ints, text = pa.int64(), pa.string()
        columns = list(zip(*out, strict=True)) or [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (ints, ints, ints, text, ints, ints, text, text, text), strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def describe(archives: DataFrame) -> DataFrame:
    """Features of the members that :func:`read_archives` gives."""
    return archives.select("member", "media", "error").mapInArrow(_describe, SCHEMA)


def media_columns(docs: DataFrame) -> DataFrame:
    """Each text of ``docs`` stored as media, read back and described."""
    spark = docs.sparkSession
    uri = shared_path(spark, "media")
    write_archives(docs, uri)
    return describe(read_archives(spark, uri))
