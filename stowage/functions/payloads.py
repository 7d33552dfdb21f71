"""What a store holds of an object, as columns, for objects that fit a value: packing, and telling the content by its hash.

Larger objects go through ``operators.content`` as paths, by the same rules.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.content import MOST_BYTES, Corrupt, unpacked, verified
from .scalars import ZSTD_MAGIC, codec_of


def packed(content: Column, codec: Column) -> Column:
    """The bytes to store under a codec ('' and none as they are, zstd compressed); null for null and for unknown codecs."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packer = zstandard.ZstdCompressor()
        for values in batches:
            yield values.map(lambda v: None if v is None else packer.compress(v))

    own = codec_of(codec)
    zstd = F.pandas_udf(run, "binary")(F.when(own == "zstd", content))
    return F.when(own == "none", content).otherwise(zstd)


def _told(payload: bytes | None, digest: str | None, most: int) -> tuple[str | None, bool, int | None, str | None]:
    if payload is None:
        return None, False, None, "missing"
    size = lambda blocks: sum(len(b) for b in verified(blocks, digest, most))
    if payload[:4] == bytes.fromhex(ZSTD_MAGIC):
        try:
            return "zstd", True, size(unpacked(io.BytesIO(payload))), None
        except (zstandard.ZstdError, Corrupt):
            pass
    try:
        return "none", True, size(iter([payload])), None
    except Corrupt as e:
        return None, False, None, str(e)


def told(payload: Column, digest: Column, most: int = MOST_BYTES) -> Column:
    """codec, ok, size, error of a payload that should hold the object of this SHA3-256.

    The hash decides: what begins like zstd is tried as zstd and, where that fails or hashes to something else, as it
    is, for an object may itself begin so. Content larger than ``most`` is not ok. A null payload is missing.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for payloads, digests in batches:
            rows = [_told(p, d, most) for p, d in zip(payloads, digests, strict=True)]
            yield pd.DataFrame({"codec": [r[0] for r in rows], "ok": [r[1] for r in rows], "size": pd.array([r[2] for r in rows], dtype="Int64"), "error": [r[3] for r in rows]})

    return F.pandas_udf(run, "codec string, ok boolean, size long, error string")(payload, digest)


def content_of(payload: Column, digest: Column, most: int = MOST_BYTES) -> Column:
    """The object of this SHA3-256 that a payload holds, plain or packed; null where it holds none."""

    def opened(payload: bytes | None, digest: str | None) -> bytes | None:
        if payload is None:
            return None
        tries = [lambda: b"".join(verified(iter([payload]), digest, most))]
        if payload[:4] == bytes.fromhex(ZSTD_MAGIC):
            tries.insert(0, lambda: b"".join(verified(unpacked(io.BytesIO(payload)), digest, most)))
        for t in tries:
            try:
                return t()
            except (zstandard.ZstdError, Corrupt):
                continue
        return None

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for payloads, digests in batches:
            yield pd.Series([opened(p, d) for p, d in zip(payloads, digests, strict=True)], dtype=object)

    return F.pandas_udf(run, "binary")(payload, digest)
