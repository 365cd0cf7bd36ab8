"""Media columns: payloads in archives, read through a data source of our own.

An archive is a file of members one after the other, then a directory of their offsets, then a trailer that points at
the directory. Each member is a PNG of 8-bit grey samples. Tasks write one archive each; a commit lists the archives of the
tasks that ended well, so that what a lost or doubled attempt left is never read. Reading plans ranges of bytes over all
listed archives; a range's task takes the members that begin in it, streams them as Arrow batches, and tries each member
again by its own offset where a read or its checksum fails. Files are opened through `pyarrow.fs`, by the URI of the folder.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import shared_dir, table
from .memory import lean

WIDTH = 576
TAIL = 32
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TRIES = 4
MEMBER = struct.Struct("<4sB3xqQIQ")  # mark, has an id, id, bytes of the source, CRC-32 of the media, its length
TRAILER = struct.Struct("<QQ8s")  # directory's offset, members, mark
MARK, END = b"MEMB", b"MEDIAEND"
MANIFEST = ".committed.json"
ROWS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURES_SQL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of WIDTH."""
    return raw + b"\xff" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def _block(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """Rows of WIDTH grey samples, none of them filtered."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _block(b"IHDR", head) + _block(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _block(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that to_png made; checks marks, checksums and size."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, rows = 8, [], 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, part = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a block's checksum differs")
        if kind == b"IHDR":
            _, rows = struct.unpack_from(">II", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(rows, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean sample in thousandths, and a 64-bit mean hash over an 8 by 8 grid of the samples in order."""
    x = np.frombuffer(payload, dtype=np.uint8)
    cells = np.add.reduceat(x.astype(np.int64), np.arange(64) * (len(x) // 64))
    sizes = np.diff(np.append(np.arange(64) * (len(x) // 64), len(x)))
    total = int(cells.sum())
    bright = cells * len(x) > total * sizes
    return f"{len(x) // WIDTH}:{total * 1000 // len(x)}:{np.packbits(bright).tobytes().hex()}"


def _manifests(files, root: str) -> list[str]:
    """The folder's manifests, one for each commit that added to it."""
    found = files.get_file_info(fs.FileSelector(root))
    return sorted(x.path for x in found if x.is_file and x.path.endswith(MANIFEST))


def _listed(files, path: str) -> list[dict]:
    with files.open_input_stream(path) as source:
        return json.loads(source.read())


@dataclass
class Committed(WriterCommitMessage):
    file: str | None
    size: int
    members: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        name, offsets, at, sink = f"{uuid.uuid4().hex}.archive", [], 0, None
        for batch in iterator:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                sink = sink or files.open_output_stream(f"{root}/{name}")
                doc, raw = doc.as_py(), (text.as_py() or "").encode()
                media = to_png(padded(raw))
                offsets.append(at)
                at += sink.write(MEMBER.pack(MARK, doc is not None, doc or 0, len(raw), zlib.crc32(media), len(media)))
                at += sink.write(media)
        if sink is None:
            return Committed(None, 0, 0)
        with sink:
            sink.write(np.array(offsets, dtype="<u8").tobytes())
            sink.write(TRAILER.pack(at, len(offsets), END))
        return Committed(name, at, len(offsets))

    def commit(self, messages: list) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        before = _manifests(files, root) if self.overwrite else []
        listed = [{"file": m.file, "size": m.size, "members": m.members} for m in messages if m is not None and m.file]
        with files.open_output_stream(f"{root}/{uuid.uuid4().hex}{MANIFEST}") as sink:
            sink.write(json.dumps(sorted(listed, key=lambda x: x["file"])).encode())
        for path in before:
            own = _listed(files, path)
            files.delete_file(path)
            for x in own:
                files.delete_file(f"{root}/{x['file']}")

    def abort(self, messages: list) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.file:
                files.delete_file(f"{root}/{m.file}")


@dataclass
class Range(InputPartition):
    file: str
    first: int
    last: int

    def __init__(self, file: str, first: int, last: int):
        super().__init__((file, first, last))
        self.file, self.first, self.last = file, first, last


class Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        files, root = fs.FileSystem.from_uri(self.path)
        listed = [x for path in _manifests(files, root) for x in _listed(files, path)]
        found = [Range(x["file"], a, min(a + self.range_bytes, x["size"])) for x in listed for a in range(0, x["size"], self.range_bytes)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files, root = fs.FileSystem.from_uri(self.path)
        path = f"{root}/{partition.file}"
        offsets = _again(lambda: _directory(files, path))
        rows, size = [], 0
        for at in offsets[(offsets >= partition.first) & (offsets < partition.last)].tolist():
            rows.append(_again(lambda at=at: _member(files, path, at)))
            size += len(rows[-1][2])
            if size >= BATCH_BYTES:
                yield _rows(rows)
                rows, size = [], 0
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)


def _again(read, tries: int = TRIES, wait: float = 0.2):
    """What read() gives; tried again, each time after a longer wait, where it fails."""
    for k in range(tries):
        try:
            return read()
        except (OSError, ValueError, struct.error, zlib.error):
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)


_OPEN: dict[str, object] = {}


def _source(files, path: str):
    """An open file, kept for the next member."""
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = files.open_input_file(path)
    return _OPEN[path]


def _at(files, path: str, at: int, n: int) -> bytes:
    try:
        raw = _source(files, path).read_at(n, at)
    except OSError:
        _OPEN.pop(path, None)
        raise
    if len(raw) != n:
        _OPEN.pop(path, None)
        raise OSError(f"{path}: {len(raw)} bytes of {n} at {at}")
    return raw


def _directory(files, path: str) -> np.ndarray:
    size = files.get_file_info(path).size
    start, members, mark = TRAILER.unpack(_at(files, path, size - TRAILER.size, TRAILER.size))
    if mark != END:
        raise ValueError(f"{path} has no end mark")
    return np.frombuffer(_at(files, path, start, 8 * members), dtype="<u8")


def _member(files, path: str, at: int) -> tuple:
    mark, has, doc, n_bytes, crc, size = MEMBER.unpack(_at(files, path, at, MEMBER.size))
    if mark != MARK:
        raise ValueError(f"{path}: no member at {at}")
    media = _at(files, path, at + MEMBER.size, size)
    if zlib.crc32(media) != crc:
        raise ValueError(f"{path}: the checksum of the member at {at} differs")
    return (doc if has else None), n_bytes, media


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaArchive)


def write_media(docs: DataFrame, path: str) -> None:
    """Archives of docs (doc_id, text; others unread) in a folder. Null texts are empty ones; null ids stay null."""
    register(docs.sparkSession)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).write.format("media_archive").mode("append").save(path)


def read_media(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, media: one row per member of a folder's committed archives; none for an empty table."""
    register(spark)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).load(path)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, n, media in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "media")), strict=True):
            media = media.as_py()
            payload = from_png(media)
            rows.append((doc.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(FEATURES), FEATURES, strict=True)], schema=FEATURES)


def media_features(docs: DataFrame) -> DataFrame:
    """Each row's text as stored media, read back: sizes, hashes and a feature. Equal texts get equal values.

    Archives go to a new folder of the cluster's shared one. Rows that repeat are members of their own.
    """
    path = f"{shared_dir(docs.sparkSession)}/media"
    write_media(docs, path)
    return read_media(docs.sparkSession, path).mapInArrow(lean(_describe), FEATURES_SQL)


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
