"""Media columns: payloads in tar shards, addressed by content, and metadata from ranges of header bytes.

A payload is stored as an 8-bit greyscale PNG, 64 samples wide. The tasks that read the rows write the shards to a
shared folder, each payload once a shard, and return digest, shard, offset and length; no payload is shuffled. What
a failed or repeated attempt wrote is named by no row. Of the copies that several shards hold, all rows take the
first; the shards are read back in order, the header of every payload by a range of its own.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keyed, scratch, text_of, written
from ._words import lean

WIDTH = 64
#: A shard is closed at this size; a payload is never split.
SHARD_BYTES = 256 << 20
#: Signature, and the header chunk with width, height and depth.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_LEVEL = 3


def payload_of(text: bytes) -> bytes:
    """The bytes, and zeros up to a positive multiple of WIDTH."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), _LEVEL)) + _chunk(b"IEND", b"")


def header_of(start: bytes) -> tuple[int, int, int]:
    """Width, height and depth from the first HEADER_BYTES."""
    if start[:8] != _SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", start[16:25])


def from_png(media: bytes) -> bytes:
    """The samples; chunks are checked by their CRC."""
    width, height, _ = header_of(media)
    at, data = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("chunk does not match its CRC")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


class _Shard:
    """A tar file that is being written; each digest once."""

    def __init__(self, folder: str) -> None:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        self.name = f"shard-{uuid.uuid4().hex}.tar"
        self.out, self.size, self.known = fs.open_output_stream(f"{path}/{self.name}"), 0, {}

    def put(self, digest: str, payload: bytes) -> tuple[int, int]:
        if digest not in self.known:
            media = to_png(payload)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT if info.size < 8 << 30 else tarfile.GNU_FORMAT)
            self.known[digest] = self.size + len(head), len(media)
            body = head + media + b"\0" * (-len(media) % 512)
            self.out.write(body)
            self.size += len(body)
        return self.known[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def store(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the payloads of all rows to ``folder``: doc_id, n_bytes, digest (of the payload), shard, offset, length. Run once; write the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        try:
            for batch in batches:
                rows = []
                for text in batch.column("text"):
                    raw = text.as_buffer().to_pybytes()
                    payload = payload_of(raw)
                    digest = hashlib.sha256(payload).hexdigest()
                    if shard is None or shard.size >= shard_bytes:
                        if shard is not None:
                            shard.close()
                        shard = _Shard(folder)
                    offset, length = shard.put(digest, payload)
                    rows.append((len(raw), digest, shard.name, offset, length))
                n, digests, names, offsets, lengths = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    ["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
                )
        finally:
            if shard is not None:
                shard.close()

    return text_of(docs).mapInArrow(lean(run), "doc_id long, n_bytes long, digest string, shard string, offset long, length long")


def _dealt(places: DataFrame) -> DataFrame:
    """Places in the order of shards, so that a task opens each of its shards once."""
    return places.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def _ranges(places: DataFrame, folder: str, fields: str, row: callable) -> DataFrame:
    """The columns of places, in their order, and ``row(read, length)`` of each; read(n) gives the first n bytes there."""
    names = [f.split()[0] for f in fields.split(", ")]
    kept = [c for c in places.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        name, shard = None, None
        for batch in batches:
            rows = []
            for own, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if own != name:
                    if shard is not None:
                        shard.close()
                    name, shard = own, fs.open_input_file(f"{path}/{own}")

                def read(n: int, shard=shard, offset=offset) -> bytes:
                    shard.seek(offset)
                    return shard.read(n)

                rows.append(row(read, length))
            types = {"long": pa.int64(), "string": pa.string()}
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, types[f.split()[1]]) for c, f in zip(columns, fields.split(", "), strict=True))], [*kept, *names])

    schema = ", ".join([*(f"{c} {places.schema[c].dataType.simpleString()}" for c in kept), fields])
    return places.select(*kept).mapInArrow(lean(run), schema)


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """``places`` with width, height, depth from ranges of HEADER_BYTES alone; no payload is read."""
    return _ranges(places, folder, "width long, height long, depth long", lambda read, length: header_of(read(HEADER_BYTES)))


def _read_back(read, length: int) -> tuple:
    width, height, depth = header_of(read(HEADER_BYTES))
    media = read(length)
    payload = from_png(media)
    samples = np.frombuffer(payload, np.uint8)
    feature = f"{width}x{height}x{depth} min={samples.min()} max={samples.max()} sum={int(samples.sum(dtype=np.int64))} changes={int(np.count_nonzero(samples[1:] != samples[:-1]))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature


_BACK = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def first_places(stored: DataFrame) -> DataFrame:
    """digest, the first shard, offset and length at which it is stored, and its rows."""
    first = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"), F.count(F.lit(1)).alias("rows"))
    return first.select("digest", "p.shard", "p.offset", "p.length", "rows")


def media_columns(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height, depth, digest.

    All but doc_id and n_bytes come from the stored bytes; width, height and depth from the header's range alone. Null and empty texts are one row of zeros; equal texts, and
    texts that differ in zeros at their end only, share a payload; repeated rows and null ids come out as they are; an
    empty table gives no rows and no shards. Columns other than doc_id and text are not looked at.
    """
    folder = folder or scratch(docs.sparkSession, "media")
    stored = written(store(docs, folder, shard_bytes), "media-rows")
    # headers and payloads are read by the same tasks, one after the other, so that places are shuffled once
    headers = metadata(_dealt(first_places(stored)), folder)
    described = written(_ranges(headers, folder, _BACK, _read_back).drop("shard", "offset", "length"), "media-back")
    found = keyed(stored.select("doc_id", "n_bytes", "digest"), described, ["digest"], "rows", stored.count())
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth", "digest")
