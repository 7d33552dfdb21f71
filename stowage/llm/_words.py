"""Words of whole Arrow batches as 64-bit hashes, without a Python object per word.

A word's hash adds up, modulo 2^64, a spread number for every byte and its place in the word, and is then mixed. Unlike
a polynomial modulo a power of two it has no family of words that collide for every choice of constants; two given
words collide with about 2^-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text worked on at once; a longer text is cut at a separator.
PIECE = 1 << 19

#: White space of the word rule: 0x20 and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_PLAIN = np.arange(256, dtype=np.int64)
#: A-Z count as a-z.
FOLDED = _PLAIN.copy()
FOLDED[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Places in a word whose numbers are looked up; those of later places are worked out.
_PLACES = 64
_NUMBERS = mix(np.arange(1, _PLACES * 256 + 1, dtype=U))


def _numbers(codes: np.ndarray) -> np.ndarray:
    """The spread numbers of codes place * 256 + byte."""
    found = np.take(_NUMBERS, codes, mode="clip")
    late = np.flatnonzero(codes >= len(_NUMBERS))
    found[late] = mix(codes[late].astype(U) + U(1))
    return found


def places(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... of every run of these lengths, concatenated."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (long) of a string column; null as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray, seps: np.ndarray = SPACES, folded: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in text order, and the row offsets into them."""
    at, end = int(offsets[0]), int(offsets[-1])
    hashes, starts_at = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    while at < end:
        cut = min(at + PIECE, end)
        if cut < end:
            row_end = int(offsets[np.searchsorted(offsets, cut)])
            while cut < row_end and not seps[data[cut]]:
                cut += 1
        piece = data[at:cut]
        inner = ~seps[piece]
        fresh = np.ones(len(piece) + 1, bool)
        fresh[1:-1] = ~inner[:-1]
        lo, hi = np.searchsorted(offsets, [at, cut])
        fresh[offsets[lo:hi] - at] = True
        starts = np.flatnonzero(inner & fresh[:-1])
        follows = np.empty(len(piece), bool)
        follows[:-1] = ~inner[1:] | fresh[1:-1]
        follows[-1] = True
        ends = np.flatnonzero(inner & follows)
        if len(starts):
            lengths = ends - starts + 1
            numbers = _numbers(folded[piece[inner]] + 256 * places(lengths))
            hashes.append(mix(np.add.reduceat(numbers, np.cumsum(lengths) - lengths) + lengths.astype(U)))
        starts_at.append(starts + at)
        at = cut
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), offsets).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, size: int = 2 * PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of text at most; a longer text stands alone."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_C = ctypes.CDLL(None)


def give_back() -> None:
    """Returns to the system what this process has allocated and freed again."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task``, after which the worker, which Spark keeps for the next one, gives back the memory it no longer uses."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        give_back()

    return run
