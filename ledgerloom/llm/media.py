"""Operator 2, media columns: content-addressed payloads in tar shards.

A payload is stored under its digest as a PNG of 8-bit gray samples (rows of WIDTH) in a tar shard in the shared folder; the last member of
a shard, INDEX, says where in it each digest lies, and rows carry digest, shard, offset and length. Header-only range reads (HEADER bytes an object) fill the metadata columns; full range reads return the
samples. Neither texts nor media are shuffled: a task stores each of its payloads once, where it reads it, and the catalog, which is
small, names one place for each digest. A payload that several tasks hold has a copy from each; moving all media to spare those would cost more.

A task writes shards under names of its attempt and reports them only when they are closed, so a lost or repeated attempt
leaves an unused file at most. Shards are written with Arrow's file systems: local, HDFS, S3 or GCS, whatever spark.checkpoint.dir names.

Defined cases: a null or empty text is one row of padding; equal texts share one object; an empty table gives an empty result;
repeated rows and extra columns don't matter. Text of any length is one object (PNG allows 2 ** 31 - 1 rows).
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import body
from ledgerloom.session import cut, shared_path

WIDTH = 576
FILL = 255
SHARD_BYTES = 256 << 20
PACK_BYTES = 1 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33
#: Member of a shard with a JSON line (digest, offset, length) for each of its objects.
INDEX = "index.jsonl"
CATALOG = "digest string, shard string, offset long, length long"


def padded(data: bytes) -> bytes:
    return data + bytes([FILL]) * (-len(data) % WIDTH if data else WIDTH)


def payload(text: Column) -> Column:
    data = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    return F.concat(data, F.unhex(F.repeat(F.lit(f"{FILL:02x}"), F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(-n, F.lit(WIDTH))))))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    filtered[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(filtered, 6)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """Samples of a PNG of this operator; raises ValueError on any other or damaged file."""
    width, _, depth, *kind = png_header(media)
    at, data = 8, []
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        name, part = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(name + part):
            raise ValueError("damaged PNG")
        if name == b"IDAT":
            data.append(part)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if depth != 8 or any(kind) or rows[:, 0].any():
        raise ValueError("not stored by this operator")
    return rows[:, 1:].tobytes()


def png_header(start: bytes) -> tuple[int, ...]:
    """width, height, bit depth, colour type, compression, filter, interlace from the first HEADER bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBBBBB", start[16:29])


class Shard:
    """Tar files whose members are packs of objects, PACK_BYTES or one object each: a header and padding per object would cost as much as
    a small object itself. An object is found by its offset in the file, which the index at the file's end gives for its digest."""

    def __init__(self, fs: pafs.FileSystem, path: str, stem: str):
        self.fs, self.path, self.stem, self.files, self.out, self.name = fs, path, stem, 0, None, ""
        self.at, self.pack, self.held, self.index = 0, [], 0, []

    def add(self, digest: str, data: bytes) -> tuple[str, int]:
        """File and offset of the object."""
        if self.held and self.held + len(data) > PACK_BYTES:
            self.flush()
        if self.out is None:
            self.name = f"{self.stem}-{self.files:04d}.tar"
            self.out, self.at, self.files = self.fs.open_output_stream(f"{self.path}/{self.name}"), 0, self.files + 1
        place = self.at + 512 + self.held
        self.pack.append(data)
        self.held += len(data)
        self.index.append((digest, place, len(data)))
        return self.name, place

    def flush(self) -> None:
        if not self.pack:
            return
        self.member(f"{self.stem}-{self.at:012d}.pngs", self.pack, self.held)
        self.pack, self.held = [], 0
        if self.at >= SHARD_BYTES:
            self.close()

    def member(self, name: str, parts: list[bytes], size: int) -> None:
        info = tarfile.TarInfo(name)
        info.size = size
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
        for data in parts:
            self.out.write(data)
        self.out.write(bytes(-size % 512))
        self.at += 512 + size + -size % 512

    def close(self) -> None:
        if self.pack:
            self.flush()
        if self.out is not None:
            lines = [json.dumps({"digest": d, "offset": a, "length": n}).encode() + b"\n" for d, a, n in self.index]
            self.member(INDEX, lines, sum(map(len, lines)))
            self.index = []
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path for a folder as Spark names it."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest, shard, offset, length of each distinct payload. The shards are written when this returns."""
    spark = docs.sparkSession
    base = shared_path(spark, "media")
    pafs_fs, pafs_path = file_system(base)
    pafs_fs.create_dir(pafs_path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(base)
        task = TaskContext.get()
        rows: list[tuple[str, str, int, int]] = []
        seen: set[bytes] = set()
        shard = Shard(fs, path, f"shard-{task.partitionId():05d}-{task.taskAttemptId()}")
        for batch in batches:
            for value in batch.column(0):
                samples = padded((value.as_py() or "").encode())
                key = hashlib.sha256(samples)
                if key.digest() not in seen:
                    seen.add(key.digest())
                    data = encode_png(samples)
                    rows.append((key.hexdigest(), *shard.add(key.hexdigest(), data), len(data)))
        shard.close()
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["digest", "shard", "offset", "length"])

    places = cut(docs.select(F.col(text).alias("text")).mapInArrow(write, CATALOG), "catalog")
    catalog = places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    # ranges of a shard are read one after the other
    return catalog.withColumn("shard", F.concat(F.lit(f"{base}/"), "shard")).repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def _ranges(batches: Iterator[pa.RecordBatch], header_only: bool) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    opened, name = None, None
    for batch in batches:
        # keep at most some MB of objects at once, however many rows a batch has
        at, sizes = 0, [HEADER if header_only else x for x in batch.column("length").to_pylist()]
        while at < batch.num_rows:
            to, held = at, 0
            while to < batch.num_rows and (to == at or held + sizes[to] <= 8 << 20):
                held += sizes[to]
                to += 1
            part, data = batch.slice(at, to - at), []
            for shard, offset, length in zip(*(part.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if opened is not None:
                        opened.close()
                    fs, path = file_system(shard)
                    opened, name = fs.open_input_file(path), shard
                data.append(opened.read_at(min(length, HEADER) if header_only else length, offset))
            yield part, data
            at = to
    if opened is not None:
        opened.close()


def with_headers(catalog: DataFrame) -> DataFrame:
    """The catalog with width, height and depth, from range reads of HEADER bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in _ranges(batches, True):
            heads = [png_header(x)[:3] for x in data]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([h[i] for h in heads], pa.int32()) for i in range(3))], names=[*part.schema.names, "width", "height", "depth"])

    return catalog.select("digest", "shard", "offset", "length").mapInArrow(run, CATALOG + ", width int, height int, depth int")


def with_features(catalog: DataFrame) -> DataFrame:
    """The catalog with metadata, and digests and features of what the shards hold."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in _ranges(batches, False):
            rows = []
            for media, width, height in zip(data, part.column("width").to_pylist(), part.column("height").to_pylist(), strict=True):
                samples = decode_png(media)
                values = np.frombuffer(samples, np.uint8)
                count = np.bincount(values >> 4, minlength=16)
                feature = f"{width}x{height} mean={int(values.sum(dtype=np.int64)) / len(values):.3f} " + "".join(f"{min(255, int(c) * 256 // len(values)):02x}" for c in count)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*part.schema.names, *names])

    return with_headers(catalog).mapInArrow(run, CATALOG + ", width int, height int, depth int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def columns(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, and where and what the stored payload of each row is."""
    objects = with_features(store(docs, text)).withColumn("_digest", F.unhex("digest"))
    rows = docs.select(F.col(id_col), F.octet_length(body(text)).cast("long").alias("n_bytes"), F.unhex(F.sha2(payload(body(text)), 256)).alias("_digest"))
    return rows.join(objects, "_digest").drop("_digest")
