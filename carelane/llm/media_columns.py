"""Media columns: content-addressed payloads in tar shards, rows with digest, shard, offset and length.

Payloads are stored as 8-bit greyscale PNG members of tar files, named by the SHA-256 of the payload.
Each task writes its own shards and stores a payload once; where several tasks met the same payload, all
rows are pointed to the first copy (smallest shard name), so equal payloads share one address; the other
tasks' copies stay in their shards without one. A task remembers the digests of its own input alone.
Header-only range reads (``HEAD_BYTES`` at a member's offset) fill width, height and bit depth.

Defined results: a null text is an empty payload, padded like any other; repeated rows share an address;
null ids stay; an empty table gives no rows and no shards; other columns are not read. Shards appear under
their names only when complete; a task that runs again replaces them by equal ones.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import encode, materialise, shards_of, shared_dir, table
from .files import Ranges, Replaced

#: Payload unit (also the picture's width), padding byte, bytes after which a new shard begins.
UNIT, PAD, SHARD_BYTES = 576, b"\xff", 256_000_000
#: Signature and first chunk of a PNG: all that metadata needs.
HEAD_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None, unit: int = UNIT) -> bytes:
    """UTF-8 of a text with padding to a positive multiple of the unit."""
    data = encode(text)
    return data + PAD * (max(1, -(-len(data) // unit)) * unit - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = UNIT) -> bytes:
    """Lossless 8-bit greyscale picture with the payload's bytes as samples, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first ``HEAD_BYTES`` bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a picture made by ``to_png``."""
    width, height, _ = png_header(data)
    at, parts = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected filter")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Average hash: which of 64 equal stretches are brighter than the mean, then the mean in 256ths."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    cuts = np.arange(65) * len(x) // 64
    sums = np.add.reduceat(x, cuts[:-1])
    bits = sums * len(x) > x.sum() * np.diff(cuts)
    return f"{int(np.packbits(bits).tobytes().hex(), 16):016x}-{int(x.sum() * 256 // len(x)):05x}"


def store(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the payloads of ``docs`` (doc_id, text); returns, materialised, doc_id, n_bytes, digest, shard, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        stored: dict[bytes, tuple[str, int, int]] = {}
        out, name, made = None, "", 0

        def finish() -> None:
            if out is not None:
                out.write(b"\0" * 1024)  # the end of a tar file
                out.close()

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                at = stored.get(digest)
                if at is None:
                    if out is None or out.size >= shard_bytes:
                        finish()
                        name, made = f"media-{task:06d}-{made:04d}.tar", made + 1
                        out = Replaced(folder, name, attempt)
                    data = to_png(payload)
                    info = tarfile.TarInfo(digest.hex() + ".png")
                    info.size = len(data)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT))
                    at = stored[digest] = (name, out.size, len(data))
                    out.write(data + b"\0" * (-len(data) % 512))
                rows.append((doc_id, len(encode(text)), digest, *at))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finish()

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(wanted.mapInArrow(run, "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"))


def addresses(catalog: DataFrame, partitions: int) -> DataFrame:
    """One row for each distinct payload: digest, shard, offset, length of its first copy, near to far."""
    one = catalog.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    return one.repartitionByRange(partitions, "shard", "offset").sortWithinPartitions("shard", "offset")


def fill_metadata(rows: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bit_depth to rows with shard and offset, by header-only range reads."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges(folder)
        for batch in batches:
            shard, offset = (batch.column(names.index(c)).to_pylist() for c in ("shard", "offset"))
            heads = [png_header(files.read(s, o, HEAD_BYTES)) for s, o in zip(shard, offset, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([h[i] for h in heads], pa.int32()) for i in range(3))], names=[*names, "width", "height", "bit_depth"])
        files.close()

    schema = StructType(list(rows.schema.fields))
    for c in ("width", "height", "bit_depth"):
        schema = schema.add(c, "integer")
    return rows.mapInArrow(run, schema)


def read_features(rows: DataFrame, folder: str) -> DataFrame:
    """Reads each stored payload back: digest, payload and media sizes and sums, feature, and the metadata."""
    names = rows.columns
    schema = "digest binary, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges(folder)
        for batch in batches:
            shard, offset, length = (batch.column(names.index(c)).to_pylist() for c in ("shard", "offset", "length"))
            made = []
            for s, o, n in zip(shard, offset, length, strict=True):
                media = files.read(s, o, n)
                payload = from_png(media)
                made.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), n, hashlib.sha256(media).hexdigest(), feature_of(payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)] if made else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in ("digest", "width", "height")), *columns], names=[x.split()[0] for x in schema.split(", ")])
        files.close()

    return rows.mapInArrow(run, schema)


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, sizes and sums of its payload and stored form, read back, and its feature."""
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    catalog = store(docs, folder)
    read = read_features(fill_metadata(addresses(catalog, shards_of(docs)), folder), folder)
    out = catalog.select("doc_id", "n_bytes", "digest").join(read, "digest")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
