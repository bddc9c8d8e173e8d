"""Media columns: payloads as grey 8-bit pictures in archives, written and read by a Spark data source of its own.

An archive is a ZIP file of stored members; its directory, at the end, has the offset of each. A partition of the reader is a range of bytes
of one archive and reads the members that begin in it. It streams them in Arrow batches; a member that can't be read, or whose
checksum is wrong, is read again by its offset, on its own, some times before the task fails.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from orewright.llm.pieces import slices

SCHEMA = "name string, archive string, offset long, content binary"
WIDTH = 64
_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_picture(data: bytes) -> bytes:
    """A PNG file, 64 grey 8-bit samples wide, whose samples are the padded data in order; a private chunk has the number of bytes before padding."""
    payload = np.frombuffer(pad(data), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(payload), WIDTH + 1), np.uint8)  # each line starts with its filter, none
    lines[:, 1:] = payload
    return b"".join([_PNG, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(payload), 8, 0, 0, 0, 0)), _chunk(b"orLn", struct.pack(">Q", len(data))), _chunk(b"IDAT", zlib.compress(lines, 1)), _chunk(b"IEND", b"")])


def from_picture(png: bytes) -> tuple[bytes, int]:
    """The samples and the number of bytes before padding of a picture that :func:`to_picture` made. Raises ValueError if a checksum or the form is wrong."""
    if png[:8] != _PNG:
        raise ValueError("not a PNG file")
    at, found = 8, {}
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        data = png[at + 8 : at + 8 + n]
        if struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("a checksum is wrong")
        found[kind] = found.get(kind, b"") + data
        at += 12 + n
    width, height = struct.unpack(">II", found[b"IHDR"][:8])
    lines = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if width != WIDTH or lines[:, 0].any():
        raise ValueError("not one of these pictures")
    return np.ascontiguousarray(lines[:, 1:]).tobytes(), struct.unpack(">Q", found[b"orLn"])[0]


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archive: str
    members: int
    size: int


def _manifest(root: str) -> list[dict]:
    """The archives that committed writes have left in a folder."""
    fs, base = pafs.FileSystem.from_uri(root)
    out = []
    for info in sorted(fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)), key=lambda x: x.path):
        if info.base_name.startswith("commit-"):
            with fs.open_input_stream(info.path) as f:
                out += json.loads(f.read())
    return out


class MediaArchives(DataSource):
    """``format("media_archives")``: rows ``name, archive, offset, content`` of the archives in a folder.

    Options: ``path``, a URI that both driver and executors reach; ``rangeBytes`` of a partition (8 MiB); ``batchBytes`` of an Arrow batch (4 MiB);
    ``retries`` of a member (3). Writing takes ``name`` and ``content`` and adds archives; only those of committed jobs are read.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are added, not replaced; use mode append")
        return _Writer(self.options["path"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = pafs.FileSystem.from_uri(self.root)
        fs.create_dir(base)
        name, n = f"{uuid.uuid4().hex}.zip", 0
        with fs.open_output_stream(f"{base}/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
            for batch in iterator:
                for member, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                    z.writestr(zipfile.ZipInfo(member), content.as_py() or b"")
                    n += 1
        return Written(name, n, fs.get_file_info(f"{base}/{name}").size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.root)
        fs.create_dir(base)
        with fs.open_output_stream(f"{base}/commit-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([m.__dict__ for m in messages if m and m.members]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Archives of a failed job have no commit file, so nobody reads them."""


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.range, self.batch, self.retries = int(options.get("rangebytes", options.get("rangeBytes", 8 << 20))), int(options.get("batchbytes", options.get("batchBytes", 4 << 20))), int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(m["archive"], a, min(a + self.range, m["size"])) for m in _manifest(self.root) for a in range(0, m["size"], self.range)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, base = pafs.FileSystem.from_uri(self.root)
        path = f"{base}/{partition.archive}"
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            members = [m for m in z.infolist() if partition.start <= m.header_offset < partition.end]
        held, size = [], 0
        for m in sorted(members, key=lambda m: m.header_offset):
            held.append((m.filename, m.header_offset, self.member(fs, path, m)))
            size += m.file_size
            if size >= self.batch:
                yield self.rows(partition, held)
                held, size = [], 0
        if held:
            yield self.rows(partition, held)

    def rows(self, partition: ByteRange, held: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"name": [x[0] for x in held], "archive": [partition.archive] * len(held), "offset": pa.array([x[1] for x in held], pa.int64()), "content": pa.array([x[2] for x in held], pa.binary())})

    def member(self, fs: pafs.FileSystem, path: str, m: zipfile.ZipInfo) -> bytes:
        """The bytes of the member at one offset; read again, with a file of its own each time, if that fails."""
        for left in range(self.retries, -1, -1):
            try:
                with fs.open_input_file(path) as f:
                    f.seek(m.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise OSError("no member begins here")
                    f.seek(m.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                    data = f.read(m.file_size)
                if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
                    raise OSError("the member is damaged")
                return data
            except OSError as e:
                if not left:
                    raise OSError(f"{path} at {m.header_offset}: {e}") from e
                time.sleep(0.05 * (self.retries - left + 1))
        raise AssertionError


def to_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``name`` (the id, or ``null``) and ``content`` (a picture of the text's UTF-8; a null text is empty) of each row."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", 4_000_000):
                texts = pc.fill_null(piece.column("text"), "").cast(pa.binary())
                yield pa.RecordBatch.from_pydict({"name": piece.column("name"), "content": pa.array([to_picture(t.as_py()) for t in texts], pa.binary())})

    return docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("name"), F.col(text).alias("text")).mapInArrow(run, "name string, content binary")


def write_archives(media: DataFrame, root: str) -> None:
    """Add an archive for each partition of ``media`` (``name``, ``content``) to the folder ``root``."""
    media.sparkSession.dataSource.register(MediaArchives)
    media.write.format("media_archives").mode("append").option("path", root).save()


def read_archives(spark: SparkSession, root: str, **options: int) -> DataFrame:
    """All members of the folder's committed archives."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(path=root, **options).load()


def features(samples: np.ndarray) -> str:
    """Mean and deviation of the samples, their entropy in bits, the mean step between neighbours, and the share of each sixteenth of the range."""
    count = np.bincount(samples, minlength=256)
    p = count / len(samples)
    level = np.arange(256)
    mean = float(p @ level)
    some = p[p > 0]
    step = float(np.abs(np.diff(samples.astype(np.int16))).mean())
    shares = " ".join(f"{v:.4f}" for v in count.reshape(16, 16).sum(1) / len(samples))
    return f"mean={mean:.4f} deviation={float(np.sqrt(max(p @ level**2 - mean**2, 0))):.4f} entropy={float(-(some * np.log2(some)).sum()):.4f} step={step:.4f} shares={shares}"


def media_features(media: DataFrame) -> DataFrame:
    """What the stored members hold, for each: sizes, hashes of payload and picture, and :func:`features`. A member that isn't such a picture fails the job."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                png = content.as_py()
                payload, n = from_picture(png)
                own = (None if name == "null" else int(name), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), features(np.frombuffer(payload, np.uint8)))
                for k, v in zip(out, own, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, v in out.items()})

    return media.select("name", "content").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
