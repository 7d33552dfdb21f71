"""An interpolated modified Kneser-Ney model of any order, counted in Spark and scored from memory-mapped arrays.

Words are 64-bit hashes. A first shuffle adds up the words by ranges of hashes: each range becomes a sorted hash array
with counts, and a word's number is its place among all ranges. A second shuffle adds up the n-grams of the highest
order, as numbers of words. Whoever adds up the n-grams of an order knows how many different words come before each
n-gram one shorter, which is what the next shuffle adds up, down to single words; n-grams that begin a text have no word
before them and keep their counts. All of this is one job; only sizes and counts of counts reach the driver.

N-grams are dealt by the last word of their context, so that those of one context, and most that share all but the first
word, meet in one task. Words with more than half a range's share of all tokens have theirs dealt by the whole context,
over as many ranges as their share asks for, and a context of none but such words is dealt by its followers too; what its
parts say about it is added up by the next shuffle.

A range of an order is one file in the shared folder: hashes in order, cut into buckets by their high bits of which the
next 32 are kept (an n-gram that doesn't occur is taken for one that does with about 4e-9 a look-up, at any size), counts,
and the same for contexts with what follows them. A file's name follows from order and range, and whichever attempt is
first to write it whole writes what the others would, so tasks need no list of names. Scoring tasks map the files, so that
a host holds one copy where the folder is mounted; from another store a worker fetches those it needs, once.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import local_path, scratch, text_of
from ._words import U, buffers, lean, mix, slices, word_hashes

#: Tokens that a task counts or scores at once.
TOKENS = 1_500_000
#: Ranges for each shuffle partition, at least, and bytes of text for each range, at most: a range is one task's group.
RANGES, RANGE_BYTES = 2, 16 << 20
HELD_OUT = 10
END, START = U(1), U(2)
#: Numbers of words, and the low half of a hash.
N, LOW = np.uint32, U(0xFFFFFFFF)
ADDED = 0.1
#: A word's number has 32 bits up to so many words, 64 beyond; the highest stands for unknown words.
MOST_WORDS = (1 << 32) - 1
#: Words of an n-gram of the highest order.
ORDER = 3
#: Files that a worker keeps mapped.
MOST_MAPPED = 20_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(False))


def _pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays of equal length; bytes of equal place together, since the high ones hardly vary."""
    n, widths = len(arrays[0]), bytes(a.dtype.itemsize for a in arrays)
    body = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(n, w).T).tobytes() for a, w in zip(arrays, widths, strict=True))
    return n.to_bytes(8, "little") + bytes([len(widths)]) + widths + zstandard.compress(body, 1)


def _unpack(packed: bytes) -> list[np.ndarray]:
    n, k = int.from_bytes(packed[:8], "little"), packed[8]
    body, at, found = np.frombuffer(zstandard.decompress(packed[9 + k :]), np.uint8), 0, []
    for w in packed[9 : 9 + k]:
        own = np.ascontiguousarray(body[at : at + n * w].reshape(w, n).T)
        found.append(own.view(f"u{w}").reshape(n))
        at += n * w
    return found


def _totals(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    values = tuple(v.astype(np.int64) for v in values)
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(ranges)) >> U(32)


def _in_order(ranges: np.ndarray) -> np.ndarray:
    """The stable order of small numbers, by counting where 16 bits hold them."""
    return np.argsort(ranges.astype(np.uint16) if len(ranges) and ranges.max() < 1 << 16 else ranges, kind="stable")


def _by_range(ranges: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers in an ascending array."""
    edges = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]])) if len(ranges) else []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(ranges[lo]), slice(int(lo), int(hi))


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def _bytes(values: np.ndarray) -> list[np.ndarray]:
    """Values in a byte each, and the places and values of those for which 255 stands."""
    far = np.flatnonzero(values >= 255)
    return [np.minimum(values, 255).astype(np.uint8), far.astype(N), _narrow(values[far])]


def _values(own: np.ndarray, far: np.ndarray, more: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What ``_bytes`` keeps at places."""
    found = own[at].astype(np.int64)
    wide = np.flatnonzero(found == 255)
    found[wide] = more[np.searchsorted(far, at[wide])]
    return found


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Writes unsigned arrays as a file of this name in the shared folder, whole or not at all; another attempt writes the same."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64).tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
    if fs.get_file_info(f"{path}/{name}").type == pa.fs.FileType.NotFound:
        fs.move(own, f"{path}/{name}")
    else:
        fs.delete_file(own)
    return name


def _mapped(folder: str, name: str) -> list[np.ndarray]:
    """Saved arrays, mapped; from a store that can't be mapped they are fetched to a local file first, which goes at once."""
    local = local_path(folder)
    if local is not None:
        with open(f"{local}/{name}", "rb") as f:
            body = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    else:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{path}/{name}") as f, tempfile.TemporaryFile() as own:
            while block := f.read(1 << 24):
                own.write(block)
            own.flush()
            body = mmap.mmap(own.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    k = int(np.frombuffer(body, np.int64, 1)[0])
    at, found = 8 + 16 * k, []
    for width, n in np.frombuffer(body, np.int64, 2 * k, 8).reshape(k, 2).tolist():
        found.append(np.frombuffer(body, f"u{width}", n, at))
        at += -(-n * width // 8) * 8
    return found


def _table(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of distinct hashes, where each bucket of their high bits begins, and the 32 bits after these."""
    bits = max(0, len(hashes).bit_length() - 4)
    kept = hashes >> U(32 - bits)
    order = np.argsort(kept)
    kept = kept[order]
    return order, np.searchsorted(kept >> U(32), np.arange((1 << bits) + 1, dtype=U)).astype(N), (kept & LOW).astype(N)


def _find(begins: np.ndarray, low: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of hashes in a table, -1 where they aren't in it."""
    if not len(low):
        return np.full(len(hashes), -1, np.int64)
    kept = hashes >> U(32 - ((len(begins) - 1).bit_length() - 1))
    bucket, own = (kept >> U(32)).astype(np.int64), (kept & LOW).astype(N)
    lo, end = begins[bucket].astype(np.int64), begins[bucket + 1].astype(np.int64)
    hi = end
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        less = low[np.minimum(mid, len(low) - 1)] < own
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return np.where((lo < end) & (low[np.minimum(lo, len(low) - 1)] == own), lo, -1)


class _Chunk:
    """Tokens of some texts: each with the one before it, texts end with END and start after START."""

    def __init__(self, columns: list[pa.RecordBatch]) -> None:
        tokens, ends, at = [], [], 0
        for part in columns:
            words, rows = word_hashes(*buffers(part.column("text")))
            n = len(rows) - 1
            own = np.full(len(words) + n, END, U)
            own[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(rows))] = words
            tokens.append(own)
            ends.append(at + rows[1:] + np.arange(1, n + 1))
            at += len(own)
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, U)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], _Chunk]]:
    waiting, size = [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            waiting.append(part)
            size += part.column("text").nbytes
            if size >= 6 * TOKENS:
                yield waiting, _Chunk(waiting)
                waiting, size = [], 0
    if waiting:
        yield waiting, _Chunk(waiting)


@dataclass
class Words:
    """The vocabulary: ranges of sorted hashes with counts, and the number at which each begins. All that grows with it lies in files."""

    folder: str
    size: int  #: distinct tokens, START aside
    tokens: int
    kind: type  #: of words' numbers, wider where there are more than MOST_WORDS; its highest stands for unknown words

    def _part(self, i: int) -> np.ndarray:
        return _cached(self.folder, "vocabulary")[i]

    @property
    def begins(self) -> np.ndarray:
        """By range, and the end."""
        return self._part(0).view(np.int64)

    @property
    def frequent(self) -> np.ndarray:
        """Numbers of words with a large share of all tokens, ascending."""
        return self._part(1)

    @property
    def over(self) -> np.ndarray:
        """Of each of these, the ranges over which its n-grams are dealt."""
        return self._part(2)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of ascending hashes, -1 where unknown."""
        found = np.full(len(hashes), -1, np.int64)
        for r, own in _by_range(_range_of(hashes, len(self.begins) - 1).astype(np.int64)):
            if (file := _cached(self.folder, f"words-{r}")) is not None:
                known = file[0]
                at = np.minimum(np.searchsorted(known, hashes[own]), len(known) - 1)
                found[own] = np.where(known[at] == hashes[own], at + self.begins[r], -1)
        return found

    def ranges_of(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, numbers.astype(np.int64), side="right") - 1

    def of_numbers(self, label: str, i: int, numbers: np.ndarray) -> np.ndarray:
        """Values saved for ranges under a label, of numbers in ascending order; 0 for -1."""
        values = np.zeros(len(numbers), np.int64)
        for r, own in _by_range(self.ranges_of(numbers)):
            if r >= 0 and (file := _cached(self.folder, f"{label}-{r}")) is not None:
                values[own] = file[i][numbers[own] - self.begins[r]]
        return values

    def dealt_over(self, numbers: np.ndarray) -> np.ndarray:
        """Over how many ranges the n-grams of words are dealt: 1 but for frequent ones."""
        if not len(self.frequent):
            return np.ones(len(numbers), U)
        at = np.minimum(np.searchsorted(self.frequent, numbers), len(self.frequent) - 1)
        return np.where(self.frequent[at] == numbers, self.over[at], U(1))

    def deal(self, gram: list[np.ndarray], about: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of n-grams, and over how many their whole context is dealt; ``about`` is the context's hash."""
        over = [self.dealt_over(c) for c in gram[:-1]]
        whole = np.minimum.reduce(over)
        return (_hash([gram[0], about % over[0], mix(gram[-1].astype(U)) % whole]) % U(ranges)).astype(np.int64), whole


_OPEN: dict[tuple[str, str], list[np.ndarray] | None] = {}


def _cached(folder: str, name: str) -> list[np.ndarray] | None:
    """A file's arrays, None where a range has none. Maps stay open for the worker's model, up to a number; another model's are let go."""
    if _OPEN and (len(_OPEN) >= MOST_MAPPED or next(iter(_OPEN))[0] != folder):
        _OPEN.clear()
    if (folder, name) not in _OPEN:
        try:
            _OPEN[folder, name] = _mapped(folder, name)
        except FileNotFoundError:
            _OPEN[folder, name] = None
    return _OPEN[folder, name]


def count_words(texts: DataFrame, folder: str, ranges: int) -> Words:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in _chunks(batches):
            words, counts = np.unique(np.append(chunk.tokens, START), return_counts=True)
            counts[words == START] = 0
            rows = [(r, _pack(words[own], _narrow(counts[own]))) for r, own in _by_range(_range_of(words, ranges).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows]), pa.array([p for _, p in rows], pa.binary())], ["range", "packed"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [_unpack(p.as_py()) for p in table.column("packed")]
        words, counts = _totals(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        top = np.argsort(-counts)[:32]
        r = table.column("range")[0].as_py()
        _save(folder, f"words-{r}", words, counts.view(U))
        return pa.table(
            {
                "range": [r], "size": [len(words)], "tokens": [int(counts.sum())],
                "top": pa.array([top.tolist()], pa.list_(pa.int64())), "top_n": pa.array([counts[top].tolist()], pa.list_(pa.int64())),
            }
        )

    schema = "range long, size long, tokens long, top array<long>, top_n array<long>"
    found = sorted(texts.mapInArrow(lean(count), "range long, packed binary").groupBy("range").applyInArrow(merge, schema).collect(), key=lambda r: r["range"])
    sizes = np.zeros(ranges, np.int64)
    for r in found:
        sizes[r["range"]] = r["size"]
    begins, tokens = np.concatenate([[0], np.cumsum(sizes)]), sum(r["tokens"] for r in found)
    kind = N if begins[-1] <= MOST_WORDS else U
    # at most 2 * ranges words have such a share; START stands before as many words as END does
    top = {int(begins[r["range"]]) + at: n for r in found for at, n in zip(r["top"], r["top_n"], strict=True)}
    if found:
        end, start = (int(begins[0]) + at for at in (0, 1))
        top[start] = top.get(end, 0)
    frequent = sorted((at, 1 + n * 2 * ranges // tokens) for at, n in top.items() if n * 2 * ranges > tokens)
    _save(folder, "vocabulary", begins.view(U), np.array([a for a, _ in frequent], kind), np.array([n for _, n in frequent], U))
    return Words(folder, max(0, int(begins[-1]) - 1), tokens, kind)


def _hash(columns: list[np.ndarray], after: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the rows of columns, or of such hashes followed by more columns."""
    found = np.zeros(len(columns[0]), U) if after is None else after
    for c in columns:
        found = mix(found * U(0x9E3779B97F4A7C15) + c.astype(U) + U(1))
    return found


def _summed(gram: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order of their columns, and the sums of their counts."""
    if not len(counts):
        return gram, counts
    if gram[0].dtype == N:  # two numbers are one key
        keys = [(gram[i - 1].astype(U) << U(32) | gram[i]) if i else gram[0].astype(U) for i in range(len(gram) - 1, -1, -2)]
    else:
        keys = gram[::-1]
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys)
    fresh = np.zeros(len(counts), bool)
    fresh[0] = True
    for key in keys:
        key = key[order]
        fresh[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(fresh)
    return [c[order[first]] for c in gram], np.add.reduceat(counts[order], first)


def _kinds(counts: np.ndarray) -> list[np.ndarray]:
    """For each count whether it is 1, 2, or 3 or more."""
    return [(counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts >= 3).astype(np.int64)]


def _parted(gram: list[np.ndarray], counts: np.ndarray, ranges: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """N-grams packed by range; the nearest word of the context, first in order, as differences."""
    order = _in_order(ranges)
    for r, own in _by_range(ranges[order]):
        near, *more = (c[order[own]] for c in gram)
        yield r, _pack(np.diff(near, prepend=near.dtype.type(0)), *more, _narrow(counts[order[own]]))


def _whole(packed: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """What ``_parted`` packed, of several tasks."""
    parts = [_unpack(p) for p in packed]
    near = [np.cumsum(p[0], dtype=p[0].dtype) for p in parts]
    gram = [np.concatenate(near), *(np.concatenate([p[i] for p in parts]) for i in range(1, len(parts[0]) - 1))]
    return gram, np.concatenate([p[-1].astype(np.int64) for p in parts])


def _discounts(n: np.ndarray) -> np.ndarray:
    """For counts 1, 2 and 3 or more, from the numbers of things counted 1, 2, 3 and 4 times."""
    n = np.maximum(np.asarray(n, float), 1e-9)
    y = n[0] / (n[0] + 2 * n[1])
    own = np.array([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    # tables too small to tell keep at least a tenth of a count in either place
    return np.clip(own, 0.1, np.array([0.9, 1.9, 2.9]))


# what a range reports: 0 for n-grams or 1 for contexts dealt over several ranges; order; range; counts of counts 1, 2, 3, 4; 3 or more; kinds.
ROW = "own long, packed binary"


def _rows(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"own": pa.array([r for r, _ in rows], pa.int64()), "packed": pa.array([p for _, p in rows], pa.binary())})


@dataclass
class Model:
    order: int
    words: Words
    ranges: int
    discounts: dict[int, np.ndarray]  #: by order, for counts 0, 1, 2 and 3 or more
    kinds: int  #: distinct n-grams of two words
    spare: float  #: the mass of single words for the uniform distribution

    def score(self, chunk: _Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: log10 probability, log10 of the add-0.1 unigrams, and known tokens."""
        words = self.words
        kinds, at = np.unique(np.append(chunk.tokens, START), return_inverse=True)
        start, at = at[-1], at[:-1]
        numbers = words.numbers(kinds)
        order = np.argsort(numbers, kind="stable")

        def of(label: str, i: int) -> np.ndarray:
            values = np.zeros(len(kinds), np.int64)
            values[order] = words.of_numbers(label, i, numbers[order])
            return values.astype(float)

        counts, before = of("words", 1), of("0-1", 0)
        uniform = 1 / (words.size + 1)
        low = np.maximum(before - self.discounts[1][np.clip(before, 0, 3).astype(np.int64)], 0) / max(1, self.kinds) + self.spare * uniform
        p = (low if self.kinds else np.full(len(kinds), uniform))[at]
        own, first = numbers.astype(words.kind), np.repeat(chunk.starts, np.diff(np.append(chunk.starts, len(at))))
        token, place = own[at], np.arange(len(at))
        near = [np.where(place - j >= first, token[np.maximum(place - j, 0)], own[start]) for j in range(1, self.order)]
        for k in range(2, self.order + 1):
            p = self._of_order(k, [*near[: k - 1], token], p)
        base = np.log10((counts + ADDED) / (words.tokens + ADDED * (words.size + 1)))
        sums = lambda x: np.add.reduceat(x, chunk.starts)
        return sums(np.log10(p)), sums(base[at]), sums((counts[at] > 0).astype(np.int64))

    def _of_order(self, k: int, gram: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
        """Probabilities of the last words of n-grams, given those of one order lower."""
        about = _hash(gram[:-1])
        hashes, at = _hash(gram[-1:], about), slice(None)
        if k == 2:  # longer ones hardly repeat within a chunk
            hashes, first, at = np.unique(hashes, return_index=True, return_inverse=True)
            about, gram = about[first], [c[first] for c in gram]
        ranges, over = self.words.deal(gram, about, self.ranges)
        counts, total, loose = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes))

        def follow(which: np.ndarray, begins: np.ndarray, low: np.ndarray, *rows: np.ndarray) -> None:
            found = _find(begins, low, about[which])
            which, found = which[found >= 0], rows[3].reshape(-1, 4)[_values(*rows[:3], found[found >= 0])]
            total[which], loose[which] = found[:, 0], found[:, 1:] @ self.discounts[k][1:]

        order = _in_order(ranges)
        for r, own in _by_range(ranges[order]):
            if (file := _cached(self.words.folder, f"0-{k}-{r}")) is not None:
                begins, low, *n = file
                mine = order[own]
                found = _find(begins, low, hashes[mine])
                counts[mine[found >= 0]] = _values(*n[:3], found[found >= 0])
                follow(mine[over[mine] == 1], *n[3:])
        wide = np.flatnonzero(over > 1)
        ranges = (about[wide] % U(self.ranges)).astype(np.int64)
        order = _in_order(ranges)
        for r, own in _by_range(ranges[order]):
            if (file := _cached(self.words.folder, f"1-{k}-{r}")) is not None:
                follow(wide[order[own]], *file)
        taken = np.maximum(counts - self.discounts[k][np.minimum(counts, 3)], 0) / np.maximum(total, 1)
        return taken[at] + np.where(total > 0, loose / np.maximum(total, 1), 1.0)[at] * lower


def _contexts(hashes: np.ndarray, followers: list[np.ndarray]) -> list[np.ndarray]:
    """A table of contexts: hashes, for each the row of what follows it, and the distinct rows, frequent ones first."""
    order, begins, low = _table(hashes)
    if not len(hashes):
        return [begins, low, *_bytes(np.zeros(0, np.int64)), np.zeros(0, U)]
    _, first, at, n = np.unique(_hash(followers)[order], return_index=True, return_inverse=True, return_counts=True)
    by = np.argsort(-n, kind="stable")
    return [begins, low, *_bytes(np.argsort(by)[at]), np.stack(followers, 1)[order[first[by]]].astype(U).reshape(-1)]


def _adder(words: Words, k: int, ranges: int) -> Callable[[pa.Table], pa.Table]:
    """Adds up one group: n-grams of order k, contexts of order k + 1, or reports, which only pass."""

    def report(which: int, order: int, r: int, counts: np.ndarray, *arrays: np.ndarray) -> tuple[int, bytes]:
        _save(words.folder, f"{which}-{order}-{r}", *arrays)
        n = [*(int((counts == c).sum()) for c in (1, 2, 3, 4)), int((counts >= 3).sum()), len(counts)]
        return 2 * ranges + r, np.array([which, order, r, *n], np.int64).tobytes()

    def add(table: pa.Table) -> pa.Table:
        r = table.column("own")[0].as_py()
        if r >= 2 * ranges:
            return table.select(["own", "packed"])
        packed = [p.as_py() for p in table.column("packed")]
        if r >= ranges:
            parts = [_unpack(p) for p in packed]
            keys, *followers = _totals(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return _rows([report(1, k + 1, r - ranges, followers[0][:0], *_contexts(keys, followers))])
        gram, counts = _summed(*_whole(packed))
        if k == 1:
            before = np.zeros(int(words.begins[r + 1] - words.begins[r]), np.int64)
            before[gram[0].astype(np.int64) - words.begins[r]] = counts
            return _rows([report(0, 1, r, counts, _narrow(before))])
        about = _hash(gram[:-1])
        edge = np.flatnonzero(np.append(True, about[1:] != about[:-1]))
        followers = [np.add.reduceat(x, edge) for x in (counts, *_kinds(counts))]
        contexts, over = about[edge], np.minimum.reduce([words.dealt_over(c[edge]) for c in gram[:-1]])
        order, begins, low = _table(_hash(gram[-1:], about))
        own = over == 1
        rows = [report(0, k, r, counts, begins, low, *_bytes(counts[order]), *_contexts(contexts[own], [x[own] for x in followers]))]
        wide = np.flatnonzero(~own)
        to = (contexts[wide] % U(ranges)).astype(np.int64)
        by = _in_order(to)
        rows += [(ranges + i, _pack(contexts[wide[by[s]]], *(_narrow(x[wide[by[s]]]) for x in followers))) for i, s in _by_range(to[by])]
        # an n-gram one shorter has a word before it for each of these, or begins a text and keeps its count
        shorter, begin = [*gram[: k - 2], gram[-1]], words.numbers(np.array([START]))[0]
        shorter, before = _summed(shorter, np.where(shorter[-2] == begin, counts, 1) if k > 2 else np.ones(len(counts), np.int64))
        to = words.deal(shorter, _hash(shorter[:-1]), ranges)[0] if k > 2 else words.ranges_of(shorter[0])
        return _rows(rows + list(_parted(shorter, before, to)))

    return add


def fit(texts: DataFrame, folder: str | None = None, order: int = ORDER) -> Model:
    """Counts the model over the texts (column text), all of them; n-grams have up to ``order`` words, 2 at least."""
    if order < 2:
        raise ValueError("the order of a model is 2 at least")
    spark = texts.sparkSession
    folder = f"{folder}/model-{uuid.uuid4().hex}" if folder else scratch(spark, "kneser-ney")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(RANGES * max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-size // RANGE_BYTES))
    words = count_words(texts, folder, ranges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in _chunks(batches):
            kinds, at = np.unique(np.append(chunk.tokens, START), return_inverse=True)
            numbers = words.numbers(kinds)[at].astype(words.kind)
            token, place = numbers[:-1], np.arange(len(numbers) - 1)
            first = np.repeat(chunk.starts, np.diff(np.append(chunk.starts, len(token))))
            near = [np.where(place - j >= first, token[np.maximum(place - j, 0)], numbers[-1]) for j in range(1, order)]
            gram, counts = _summed([*near, token], np.ones(len(token), np.int64))
            rows = list(_parted(gram, counts, words.deal(gram, _hash(gram[:-1]), ranges)[0]))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], ["own", "packed"])

    rows = texts.mapInArrow(lean(count), ROW)
    for k in range(order, 0, -1):
        rows = rows.groupBy("own").applyInArrow(_adder(words, k, ranges), ROW)
    n = np.zeros((order + 1, 6), np.int64)
    for row in rows.toLocalIterator():
        _, k, _, *own = np.frombuffer(bytes(row["packed"]), np.int64).tolist()
        n[k] += own
    discounts = {k: np.append(0, _discounts(n[k, :4])) for k in range(1, order + 1)}
    kinds = int(n[2, 5])
    spare = float((discounts[1][1:] * n[1, [0, 1, 4]]).sum() / max(1, kinds))
    return Model(order, words, ranges, discounts, kinds, spare)


def score(docs: DataFrame, folder: str | None = None, order: int = ORDER) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the rows that aren't held out (a null id isn't). Null and empty texts are one token, the end. Without
    rows to learn from all scores are those of the uniform distribution over no words, 0. Rows are scored one by one,
    so repeated rows and null ids come out as they are, though each counts as text; an empty table gives no rows.
    Columns other than doc_id and text are not looked at.
    """
    rows = text_of(docs).withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(rows.where(~F.col("held_out")).select("text"), folder, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, chunk in _chunks(batches):
            p, base, known = model.score(chunk)
            n = chunk.ends - chunk.starts
            ids, held = (pa.concat_arrays([x.column(c) for x in parts]) for c in ("doc_id", "held_out"))
            yield pa.RecordBatch.from_arrays(
                [ids, held, pa.array(n), pa.array(known), pa.array(np.full(len(n), model.words.tokens)), pa.array(base), pa.array(p), pa.array(10 ** (-p / n))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
