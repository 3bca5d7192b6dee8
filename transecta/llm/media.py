"""Media columns: content-addressed payloads in tar shards, and range reads by digest, offset and length.

A payload is stored as an eight-bit grey PNG of fixed width, whose samples are the payload's
bytes, so that its first 33 bytes say all that the metadata columns need. Shards lie in a folder
that driver and executors share and are named once for each task attempt: what a lost attempt
has written is never referred to.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, on_workers, run_dir, slices, texts, written

WIDTH = 192
HEADER = 33  # signature and IHDR
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SHARD_BYTES = 256 << 20


def payload_of(text: str, width: int = WIDTH) -> tuple[bytes, int]:
    """The text's bytes, filled up with spaces to a positive multiple of width, and their number before that."""
    raw = text.encode()
    return raw + b" " * (-len(raw) % width if raw else width), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # a line starts with its filter, 0: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(media: bytes) -> bytes:
    """The samples of what encode_png() returns."""
    width, height, _, _ = read_header(media[:HEADER])
    (size,) = struct.unpack(">I", media[HEADER : HEADER + 4])
    lines = np.frombuffer(zlib.decompress(media[HEADER + 8 : HEADER + 8 + size]), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that encode_png() does not use")
    return lines[:, 1:].tobytes()


class ShardWriter:
    """Members of a task, by digest; each digest is written once."""

    def __init__(self, folder: str, shard_bytes: int = SHARD_BYTES):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.shard_bytes, self.seen, self.out, self.name, self.at = shard_bytes, set(), None, "", 0

    def add(self, digest: str, make) -> tuple[str, int, int] | None:
        """Shard, offset and length of a new member; None where the task has it already. make() gives its bytes."""
        if digest in self.seen:
            return None
        self.seen.add(digest)
        media = make()
        if self.out and self.at + len(media) > self.shard_bytes:
            self.close()
        if not self.out:
            self.name, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
        info.size = len(media)
        self.out.write(head := info.tobuf(tarfile.USTAR_FORMAT))
        self.out.write(media + bytes(-len(media) % 512))
        found = self.name, self.at + len(head), len(media)
        self.at += len(head) + len(media) + -len(media) % 512
        return found

    def close(self) -> None:
        if self.out:
            self.out.write(bytes(2 * 512))
            self.out.close()
            self.out = None


def _store(batches, folder, width, level):
    shards = ShardWriter(folder)
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for text in texts(part):
                payload, n = payload_of(text, width)
                digest = hashlib.sha256(payload).hexdigest()
                place = shards.add(digest, lambda p=payload: encode_png(p, width, level)) or (None, None, None)
                rows.append((n, len(payload), digest, *place))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            cols = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*columns(part, "doc_id"), *cols], ["doc_id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
    shards.close()


def store(docs: DataFrame, folder: str, width: int = WIDTH, level: int = 1) -> tuple[DataFrame, DataFrame]:
    """Store the texts of docs(doc_id, text): rows (doc_id, n_bytes, payload_bytes, digest), index (digest, shard, offset, length).

    The index has one row for each digest. Equal texts have one digest; a task writes it once,
    and where several tasks have written it the index refers to the first by shard name. A null
    text is an empty one; both are one line of spaces.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long"
    done = written(rows.mapInArrow(on_workers(_store, folder, width, level), schema), "media")
    index = done.where("shard is not null").groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    return done.select("doc_id", "n_bytes", "payload_bytes", "digest"), index


def features(payload: bytes) -> str:
    """Mean and standard deviation of the samples and the shares of 16 equal ranges of values, rounded."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(float)
    values, n = np.arange(256), max(1, len(payload))
    mean = (counts * values).sum() / n
    spread = max(0.0, (counts * values * values).sum() / n - mean * mean) ** 0.5
    return f"{mean:.4f};{spread:.4f};" + ",".join(f"{x:.4f}" for x in counts.reshape(16, 16).sum(1) / n)


def _open(batches, folder, whole):
    fs, base = pafs.FileSystem.from_uri(folder)
    name, file = "", None
    for batch in batches:
        out = []
        for shard, offset, length in zip(*(c.to_pylist() for c in columns(batch, "shard", "offset", "length"))):
            if shard != name:
                if file:
                    file.close()
                name, file = shard, fs.open_input_file(f"{base}/{shard}")
            width, height, depth, colour = read_header(file.read_at(HEADER, offset))
            row = (width, height, depth, colour)
            if whole:
                media = file.read_at(length, offset)
                payload = decode_png(media)
                row += (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(media).hexdigest(), features(payload))
            out.append(row)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.string(), pa.string()] * whole
        names = ["width", "height", "bit_depth", "colour_type", *["payload_sha256", "tail_crc32", "media_sha256", "feature"] * whole]
        cols = [pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])
    if file:
        file.close()


def read(index: DataFrame, folder: str, whole: bool = True) -> DataFrame:
    """index with metadata columns from range reads of the headers alone and, if whole, digests and features of the stored bytes.

    Shards are read in order of offset, each by one task.
    """
    found = index.select("digest", "shard", "offset", "length").repartition("shard").sortWithinPartitions("shard", "offset")
    schema = "digest string, shard string, offset long, length long, width long, height long, bit_depth long, colour_type long"
    more = ", payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"
    return found.mapInArrow(on_workers(_open, folder, whole), schema + more * whole)


def media_columns(docs: DataFrame, folder: str | None = None, width: int = WIDTH, level: int = 1) -> DataFrame:
    """doc_id with digest, shard, offset and length of its payload, metadata columns and features read back, for every row."""
    folder = folder or f"{run_dir(docs.sparkSession)}/media/{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    rows, index = store(docs, folder, width, level)
    return rows.join(read(index, folder), "digest").withColumnRenamed("length", "media_bytes")
