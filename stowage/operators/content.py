"""Objects between stores: verify, compress, fan out, decode, restore, repair.

Work lists are DataFrames of hashes and paths; bytes are read and written inside tasks, in blocks, and never become
a column, for an object may be larger than a value can be. Every object ends as one row with an outcome.
"""

from __future__ import annotations

import hashlib
import os
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ZSTD_MAGIC

BLOCK = 1 << 20
#: Largest object, in bytes of content.
MOST_BYTES = 4 << 30


@dataclass(frozen=True)
class Store:
    """A target: its name, the root of its tree (a path every task reaches), its codec, and whether it is write-once."""

    name: str
    root: str
    codec: str = "none"
    worm: bool = False

    def path(self, digest: str) -> str:
        return os.path.join(self.root, digest[:2], digest[2:4], digest) if len(digest) >= 4 else os.path.join(self.root, digest)


class Corrupt(Exception):
    """The bytes aren't those of the hash."""


class SourceGone(OSError):
    """The source says that it doesn't have the object and won't."""


def verified(blocks: Iterator[bytes], digest: str, most: int = MOST_BYTES) -> Iterator[bytes]:
    """The blocks; raises at the end where they hash to something else, and on the way where they are too many."""
    seen, size = hashlib.sha3_256(), 0
    for block in blocks:
        size += len(block)
        if size > most:
            raise Corrupt("larger than an object may be")
        seen.update(block)
        yield block
    if seen.hexdigest() != digest:
        raise Corrupt("content doesn't match its hash")


def blocks_of(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            yield block


def blocks_from(url: str, timeout_s: float = 1800) -> Iterator[bytes]:
    """Content from a file path or over HTTP; 404 and 410 are final, everything else may be tried again."""
    if not url.startswith(("http://", "https://")):
        yield from blocks_of(url)
        return
    try:
        with urllib.request.urlopen(url, timeout=timeout_s) as f:
            while block := f.read(BLOCK):
                yield block
    except urllib.error.HTTPError as e:
        raise (SourceGone if e.code in (404, 410) else OSError)(f"{url}: {e.code}") from e


def circuit_counts(aborted: bool, stream_verified: bool, deadline: bool) -> bool:
    """Whether a transfer's failures say something about the targets: an aborted one only if the content was right and time ran out."""
    return not aborted or (stream_verified and deadline)


def unpacked(f: BinaryIO) -> Iterator[bytes]:
    with zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as reader:
        while block := reader.read(BLOCK):
            yield block


def _decompressed(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        yield from unpacked(f)


def decoded(path: str, digest: str, sink: Callable[[Iterator[bytes]], None], most: int = MOST_BYTES) -> str:
    """Feeds the content to ``sink`` and returns the codec that the hash confirms.

    Bytes that begin like zstd are tried as zstd and, where that fails, as they are: an object may itself begin so.
    ``sink`` must start afresh each time. I/O errors are raised as they come.
    """
    with open(path, "rb") as f:
        magic = f.read(4) == bytes.fromhex(ZSTD_MAGIC)
    if magic:
        try:
            sink(verified(_decompressed(path), digest, most))
            return "zstd"
        except (zstandard.ZstdError, Corrupt):
            pass
    sink(verified(blocks_of(path), digest, most))
    return "none"


def commit(path: str, blocks: Iterator[bytes]) -> int:
    """Writes beside the path, syncs and renames: the path holds all of the content or doesn't exist. Returns the bytes written."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    try:
        with open(own, "wb") as f:
            for block in blocks:
                f.write(block)
                size += len(block)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(own, 0o644)
        os.replace(own, path)
    except BaseException:
        if os.path.exists(own):
            os.unlink(own)
        raise
    return size


def _drain(blocks: Iterator[bytes]) -> None:
    for _ in blocks:
        pass


class _Target:
    """One object on its way to one store; a failure here stays here."""

    def __init__(self, store: Store, digest: str) -> None:
        self.store, self.final, self.error, self.size = store, store.path(digest), None, 0
        self.own = f"{self.final}.{uuid.uuid4().hex}.tmp"
        self.packer = zstandard.ZstdCompressor().compressobj() if store.codec == "zstd" else None
        self.file = self._try(self._open)

    def _open(self):
        os.makedirs(os.path.dirname(self.final), exist_ok=True)
        return open(self.own, "wb")

    def _try(self, step: Callable):
        try:
            return step() if self.error is None else None
        except OSError as e:
            self.error = str(e)
            return None

    def put(self, block: bytes) -> None:
        packed = self.packer.compress(block) if self.packer else block
        self._try(lambda: self.file.write(packed))
        self.size += len(packed)

    def finish(self) -> None:
        rest = self.packer.flush() if self.packer else b""
        self.size += len(rest)

        def step() -> None:
            self.file.write(rest)
            self.file.flush()
            os.fsync(self.file.fileno())
            self.file.close()
            os.chmod(self.own, 0o644)
            os.replace(self.own, self.final)

        self._try(step)

    def drop(self, reason: str) -> None:
        self.error = self.error or reason
        if self.file is not None:
            self.file.close()
        if os.path.exists(self.own):
            os.unlink(self.own)


def fan_out(digest: str, blocks: Iterator[bytes], stores: Sequence[Store]) -> list[tuple[str, str, int, str | None]]:
    """Reads the source once and writes every store; (store, state, bytes, error) of each. Nothing is committed on a wrong hash."""
    targets = [_Target(s, digest) for s in stores]
    try:
        for block in verified(blocks, digest):
            for t in targets:
                t.put(block)
    except (OSError, Corrupt) as e:
        for t in targets:
            t.drop(f"source: {e}")
    for t in targets:
        if t.error is None:
            t.finish()
        if t.error is not None:
            t.drop(t.error)
    return [(t.store.name, "failed" if t.error else "stored", 0 if t.error else t.size, t.error) for t in targets]


def backup(items: DataFrame, stores: Sequence[Store]) -> DataFrame:
    """external_id, target, state, stored_bytes, error of every pending target of items (external_id, path, pending)."""
    by_name = {s.name: s for s in stores}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for digest, path, pending in zip(batch["external_id"], batch["path"], batch["pending"], strict=True):
                rows = [(digest, *r) for r in fan_out(digest, blocks_from(path), [by_name[p] for p in pending])]
                yield pd.DataFrame(rows, columns=["external_id", "target", "state", "stored_bytes", "error"])

    return items.select("external_id", "path", "pending").mapInPandas(run, "external_id string, target string, state string, stored_bytes long, error string")


def verify(items: DataFrame, store: Store) -> DataFrame:
    """external_id, ok, codec, error of every object as the store holds it; nothing is written."""
    return _each(items, lambda digest: decoded(store.path(digest), digest, _drain), "verified")


def restore(items: DataFrame, store: Store, folder: str) -> DataFrame:
    """Objects as plain files in ``folder``; one that is there and intact is skipped, one that is there and corrupt is replaced."""

    def one(digest: str) -> str:
        to = os.path.join(folder, digest)
        if os.path.exists(to):
            try:
                _drain(verified(blocks_of(to), digest))
                return "skipped"
            except Corrupt:
                pass
        decoded(store.path(digest), digest, lambda blocks: commit(to, blocks))
        return "restored"

    return _each(items, one, None)


def drill(items: DataFrame, store: Store, folder: str) -> DataFrame:
    """Restores each object to scratch space, verifies it and removes it again."""

    def one(digest: str) -> str:
        to = os.path.join(folder, f"{digest}.{uuid.uuid4().hex}")
        try:
            decoded(store.path(digest), digest, lambda blocks: commit(to, blocks))
            _drain(verified(blocks_of(to), digest))
        finally:
            if os.path.exists(to):
                os.unlink(to)
        return "passed"

    return _each(items, one, None)


def repair(gaps: DataFrame, stores: Sequence[Store]) -> DataFrame:
    """Gaps (external_id, stored_on, sources in the order of trying) filled from the first source that decodes.

    external_id, target, state, stored_bytes, error of every absent target; where no source decodes all of them fail.
    """
    by_name = {s.name: s for s in stores}

    def content(store: Store, digest: str) -> Iterator[bytes]:
        codec = decoded(store.path(digest), digest, _drain)
        return _decompressed(store.path(digest)) if codec == "zstd" else blocks_of(store.path(digest))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for digest, held, sources in zip(batch["external_id"], batch["stored_on"], batch["sources"], strict=True):
                absent, error, found = [s for s in stores if s.name not in set(held)], "no source", None
                for name in sources:
                    try:
                        found = content(by_name[name], digest)
                        break
                    except (OSError, Corrupt, zstandard.ZstdError) as e:
                        error = f"{name}: {e}"
                rows = [(digest, *r) for r in fan_out(digest, found, absent)] if found is not None else [(digest, s.name, "failed", 0, error) for s in absent]
                yield pd.DataFrame(rows, columns=["external_id", "target", "state", "stored_bytes", "error"])

    return gaps.select("external_id", "stored_on", "sources").mapInPandas(run, "external_id string, target string, state string, stored_bytes long, error string")


def _each(items: DataFrame, one: Callable[[str], str], good: str | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest in batch["external_id"]:
                try:
                    said = one(digest)
                    rows.append((digest, good or said, said if good else None, None))
                except (OSError, Corrupt, zstandard.ZstdError) as e:
                    rows.append((digest, "missing" if isinstance(e, FileNotFoundError) else "failed", None, str(e)))
            yield pd.DataFrame(rows, columns=["external_id", "outcome", "codec", "error"])

    return items.select("external_id").mapInPandas(run, "external_id string, outcome string, codec string, error string")


def tally(outcomes: DataFrame) -> DataFrame:
    """Rows by outcome."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def sweep_passes(kind: str, counts: dict[str, int]) -> bool:
    """Whether a run counts as a success: nothing failed; a repair must leave nothing skipped, a restore or drill must have had something to do."""
    if counts.get("failed", 0) or counts.get("missing", 0):
        return False
    if kind == "reconcile":
        return not counts.get("skipped", 0)
    if kind in ("restore", "drill"):
        return sum(counts.values()) > 0
    return True
