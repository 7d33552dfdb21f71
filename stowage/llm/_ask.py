"""Questions of chunks of text about keys, answered where all chunks' equal keys meet.

A chunk is one row of a written table. It asks about sorted codes, each once: the high bits of a code are the range in
which it is answered, its low 40 bits tell it from others there. Packed arrays of codes, with what comes along, are
shuffled by range; a range's task sorts what it got and gives every code of every chunk a number in return. These are
shuffled back by the chunks' partition and saved as one file for each, under a name that follows from the partition, so
that an attempt that is run again writes the same file. Whoever reads the chunks next opens the file of their partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import settings
from ._words import U, lean
from .kneser_ney import _pack, _unpack

#: Low bits of a code; the range's number stands above them.
BITS = 40
LOW = U((1 << BITS) - 1)
#: A chunk's number has the partition that wrote it above these bits.
PART = 33
#: Settings while rows of chunks are read: few at once, since each holds a few MB.
CONF = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.parquet.columnarReaderBatchSize": "8",
    "spark.sql.files.openCostInBytes": "1m",
}


def codes_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Codes of 64-bit hashes: the range by the high half, and the low 40 bits."""
    return (((hashes >> U(32)) * U(ranges)) >> U(32)) << U(BITS) | hashes & LOW


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by keys, where in it each group begins, and every row's group."""
    n = len(keys[0])
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for k in keys:
        k = k[order]
        fresh[1:] |= k[1:] != k[:-1]
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(fresh) - 1
    return order, np.flatnonzero(fresh), group


def reduced(ufunc: np.ufunc, values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """ufunc over each group's values."""
    return ufunc.reduceat(values[order], first) if len(first) else values[:0]


@dataclass
class Replies:
    folder: str
    label: str
    kind: str

    def of(self, chunk: int) -> np.ndarray:
        """The numbers for a chunk's codes, in their order."""
        part = chunk >> PART
        if _READ.get("at") != (self.folder, part):
            _READ.clear()
            _READ["at"] = self.folder, part
        if self.label not in _READ:
            _READ[self.label] = _load(self.folder, f"{self.label}-{part}")
        packed = _READ[self.label].get(chunk)
        return np.zeros(0, self.kind) if packed is None else np.frombuffer(zstandard.decompress(packed), self.kind)


#: What a worker has read for the partition it is at, by label.
_READ: dict[str, Any] = {}


def _save(folder: str, name: str, chunks: list[int], replies: list[bytes]) -> None:
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(np.array([len(chunks), *chunks, *map(len, replies)], np.int64).tobytes())
        out.writelines(replies)
    if fs.get_file_info(f"{path}/{name}").type == pa.fs.FileType.NotFound:
        fs.move(own, f"{path}/{name}")
    else:  # another attempt's, which is the same
        fs.delete_file(own)


def _load(folder: str, name: str) -> dict[int, bytes]:
    fs, path = pa.fs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{path}/{name}").type == pa.fs.FileType.NotFound:
        return {}
    with fs.open_input_stream(f"{path}/{name}") as f:
        body = f.read()
    n = int(np.frombuffer(body, np.int64, 1)[0])
    chunks, sizes = np.frombuffer(body, np.int64, 2 * n, 8).reshape(2, n)
    ends = np.cumsum(sizes) + 8 + 16 * n
    return {c: body[e - s : e] for c, s, e in zip(chunks.tolist(), sizes.tolist(), ends.tolist(), strict=True)}


def asked(
    chunks: DataFrame, folder: str, label: str, ranges: int, question: Callable[[dict], tuple[np.ndarray, ...]], answer: Callable[..., np.ndarray], kind: str = "u1"
) -> tuple[Replies, int]:
    """Replies to the codes of all chunks (a column chunk and what ``question`` reads), and how many are not 0.

    question: a chunk's row to ascending distinct codes and unsigned arrays that come along; answer: the chunk of each
    (by number), low bits of the codes and the arrays, of one range, to a number of this kind each.
    """

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes, *more = question(row)
                edges = np.searchsorted(codes >> U(BITS), np.arange(ranges + 1, dtype=U))
                rows = [(r, _pack(np.diff(codes[a:b] & LOW, prepend=U(0)), *(m[a:b] for m in more))) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _ in rows], pa.int64()), pa.array([row["chunk"]] * len(rows), pa.int64()), pa.array([p for _, p in rows], pa.binary())], ["range", "chunk", "packed"]
                )

    def reply(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")  # whatever order the rows came in
        parts = [_unpack(p.as_py()) for p in table.column("packed")]
        sizes = [len(p[0]) for p in parts]
        own = [np.concatenate(x) for x in zip(*([np.cumsum(p[0], dtype=U), *p[1:]] for p in parts), strict=True)]
        said = answer(np.repeat(np.arange(len(sizes)), sizes), *own).astype(kind)
        ends = np.cumsum(sizes)
        chunk = table.column("chunk").to_numpy()
        packed = [zstandard.compress(said[e - s : e].tobytes(), 1) for s, e in zip(sizes, ends, strict=True)]
        return pa.table({"part": chunk >> PART, "chunk": chunk, "range": table.column("range"), "reply": pa.array(packed, pa.binary())})

    def keep(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chunk", "ascending"), ("range", "ascending")])
        chunk, replies, whole, yes = table.column("chunk").to_numpy(), table.column("reply"), [], 0
        begins = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])).tolist()
        for a, b in zip(begins, [*begins[1:], len(chunk)], strict=True):
            own = b"".join(zstandard.decompress(r.as_py()) for r in replies[a:b])
            yes += int(np.count_nonzero(np.frombuffer(own, kind)))
            whole.append(zstandard.compress(own, 1))
        part = table.column("part")[0].as_py()
        _save(folder, f"{label}-{part}", chunk[begins].tolist(), whole)
        return pa.table({"part": [part], "yes": [yes]})

    with settings(chunks.sparkSession, CONF):
        packed = chunks.mapInArrow(lean(send), "range long, chunk long, packed binary")
        replies = packed.groupBy("range").applyInArrow(reply, "part long, chunk long, range long, reply binary")
        yes = replies.groupBy("part").applyInArrow(keep, "part long, yes long").agg(F.sum("yes")).first()[0] or 0
    return Replies(folder, label, kind), yes
