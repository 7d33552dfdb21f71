"""Byte-level BPE encoding and decoding.

Texts are cut into pieces by the public pattern, by array operations on code points. A distinct piece is encoded
once a batch and remembered by its characters: a segment tree over its byte positions keeps, at every node, the leftmost of the smallest ranks of
adjacent pairs; a merge reads the root, joins two live neighbours and updates the points whose pair changed, each at
a logarithmic cost. Trees of many short pieces are kept in one array and step together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import text_of
from ._words import U, lean, mix, places, slices

NONE = np.int64(1 << 30)
#: Pieces up to so many bytes step together; longer ones have a tree each.
LONGEST_TOGETHER = 64
#: Distinct pieces that a task remembers; beyond, it forgets all and goes on.
REMEMBERED = 100_000
#: Bytes of text that a task works on at once.
AT_ONCE = 1 << 18


class Vocabulary:
    """Ranks of byte strings, from a rank file of base64 strings and numbers."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        strings = [b""] * size
        for s, i in self.ranks.items():
            strings[i] = s
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes_at, self.bytes_flat = _packed(strings)
        self.digits_at, self.digits_flat = _packed([b"%d," % i for i in range(size)])
        pairs: dict[int, int] = {}
        for s, rank in self.ranks.items():
            for cut in range(1, len(s)):
                left, right = self.ranks.get(s[:cut]), self.ranks.get(s[cut:])
                if left is not None and right is not None:
                    pairs[left << 24 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)


def _packed(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64), np.frombuffer(b"".join(strings), np.uint8)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_piece(piece: bytes, vocab: Vocabulary) -> list[int]:
    """Ids of one piece, by a segment tree of its own."""
    if (whole := vocab.ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    ids = vocab.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    size = 1 << max(0, n - 2).bit_length()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none, pairs = int(NONE), vocab.pairs
    # rank and position as one number, so that the smaller is also the leftmost of equals
    tree = [none << 32] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = pairs.get(ids[i] << 24 | ids[i + 1], none) << 32 | i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, rank: int) -> None:
        at = size + i
        tree[at] = rank << 32 | i
        while at > 1:
            at >>= 1
            now = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == now:
                break
            tree[at] = now

    while n > 1 and (top := tree[1]) >> 32 < none:
        i, rank = top & 0xFFFFFFFF, top >> 32
        gone = after[i]
        ids[i], after[i] = rank, after[gone]
        if gone < size:
            put(gone, none)
        if after[i] < n:
            before[after[i]] = i
            put(i, pairs.get(rank << 24 | ids[after[i]], none))
        else:
            put(i, none)
        if before[i] >= 0:
            put(before[i], pairs.get(ids[before[i]] << 24 | rank, none))
    found, i = [], 0
    while i < n:
        found.append(ids[i])
        i = after[i]
    return found


def _encode_together(pieces: list[bytes], width: int, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of 2 to ``width`` bytes (a power of two), concatenated, and their counts: one segment tree per row of an array."""
    m = len(pieces)
    lengths = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
    place = np.arange(width)
    ids = vocab.byte_ids[raw]
    after, before = np.tile(place + 1, (m, 1)), np.tile(place - 1, (m, 1))
    tree = np.full((m, 2 * width), NONE << 32, np.int64)
    ranks = vocab.rank_of(ids[:, :-1], ids[:, 1:])
    ranks[place[None, 1:] >= lengths[:, None]] = NONE
    tree[:, width : 2 * width - 1] = ranks << 32 | place[:-1]
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    alive = np.ones((m, width), bool)
    alive[place[None, :] >= lengths[:, None]] = False

    def put(row: np.ndarray, i: np.ndarray, rank: np.ndarray) -> None:
        at = width + i
        tree[row, at] = rank << 32 | i
        at >>= 1
        while at.size and at[0]:
            tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
            at >>= 1

    row = np.flatnonzero(tree[:, 1] >> 32 < NONE)
    while row.size:
        top = tree[row, 1]
        i, rank = top & 0xFFFFFFFF, top >> 32
        gone = after[row, i]
        ids[row, i], alive[row, gone] = rank, False
        then = after[row, gone]
        after[row, i] = then
        put(row, gone, np.full(row.size, NONE))
        more = then < lengths[row]
        r, t = row[more], then[more]
        before[r, t] = i[more]
        fresh = np.full(row.size, NONE)
        fresh[more] = vocab.rank_of(rank[more], ids[r, t])
        put(row, i, fresh)
        prev = before[row, i]
        has = prev >= 0
        r, p = row[has], prev[has]
        put(r, p, vocab.rank_of(ids[r, p], rank[has]))
        row = row[tree[row, 1] >> 32 < NONE]
    return ids[alive], alive.sum(axis=1)


def encode_pieces(pieces: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, concatenated, and the offsets of each piece in them."""
    counts, found, at_width = np.zeros(len(pieces), np.int64), {}, {}
    for n, piece in enumerate(pieces):
        if (whole := vocab.ranks.get(piece)) is not None:
            found[n] = np.array([whole])
        elif len(piece) > LONGEST_TOGETHER:
            found[n] = np.array(encode_piece(piece, vocab))
        else:
            at_width.setdefault(max(8, 1 << (len(piece) - 1).bit_length()), []).append(n)
    for n, ids in found.items():
        counts[n] = len(ids)
    groups = []
    for width, own in at_width.items():
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            flat, sizes = _encode_together([pieces[n] for n in part], width, vocab)
            counts[part] = sizes
            groups.append((np.array(part), flat))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(offsets[-1], np.int64)
    for part, flat in groups:
        out[spread(offsets[part], counts[part])] = flat
    for n, ids in found.items():
        out[offsets[n] : offsets[n + 1]] = ids
    return out, offsets


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, concatenated."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0


@cache
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\p{White_Space}")):
        kinds[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    return kinds


_QUOTE = ord("'")
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def piece_starts(points: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """Where the pattern's matches start among the code points of texts that begin at ``row_starts``.

    Matches: 's 't 're 've 'm 'll 'd; letters, numbers or others, each with one space (0x20) before; white space
    without its last code point where something else follows; white space.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[row_starts] = True
    first[n] = True
    starts = first[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # the last white space before something else is a piece of its own, or, if 0x20, starts the piece that follows
    before_other = np.zeros(n, bool)
    before_other[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    starts |= before_other
    joins = np.flatnonzero(before_other & (points == 0x20))
    starts[joins + 1] = False
    # a quote that starts a piece may be an ending
    quotes = np.flatnonzero((points == _QUOTE) & starts[:n])
    if quotes.size:
        row_end = np.unique(np.append(row_starts, n))
        room = row_end[np.searchsorted(row_end, quotes, side="right")] - quotes - 1
        padded = np.append(points, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        length = np.zeros(quotes.size, np.int64)
        for ending in _ENDINGS:
            fits = (one == ord(ending[0])) & (room >= len(ending))
            if len(ending) == 2:
                fits &= two == ord(ending[1])
            length[fits & (length == 0)] = len(ending)
        hit = length > 0
        starts[quotes[hit] + 1] = False
        after = quotes[hit] + 1 + length[hit]
        after = after[after < n]
        starts[after[~(space[after - 1])]] = True
    return np.flatnonzero(starts)


class Encoder:
    """Encodes batches of texts; remembers the pieces it has met."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and each text's offsets in them."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        row_at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        starts = piece_starts(points, np.unique(row_at[:-1][row_at[:-1] < len(points)]))
        ends = np.append(starts[1:], len(points))
        first, which = _kinds(points, starts, ends)
        if len(self.known) > REMEMBERED:
            self.forget()
        slots, fresh = np.zeros(len(first), np.int64), []
        for n, (lo, hi) in enumerate(zip(starts[first].tolist(), ends[first].tolist(), strict=True)):
            piece = joined[lo:hi]
            if (slot := self.known.get(piece)) is None:
                slot = self.known[piece] = len(self.known)
                fresh.append(piece.encode())
            slots[n] = slot
        if fresh:
            ids, offsets = encode_pieces(fresh, self.vocab)
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
            self.ids = np.concatenate([self.ids, ids])
        slot = slots[which]
        counts = self.offsets[slot + 1] - self.offsets[slot]
        flat = self.ids[spread(self.offsets[slot], counts)]
        piece_at = np.concatenate([[0], np.cumsum(counts)])
        return flat, piece_at[np.searchsorted(starts, row_at)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, concatenated, and each id's offsets in them."""
        return _looked_up(ids, self.vocab.bytes_at, self.vocab.bytes_flat)

    def digits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in decimal, a comma after each, and each id's offsets in them."""
        return _looked_up(ids, self.vocab.digits_at, self.vocab.digits_flat)


def _looked_up(ids: np.ndarray, at: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = at[ids + 1] - at[ids]
    return flat[spread(at[ids], lengths)], np.concatenate([[0], np.cumsum(lengths)])


def _run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every piece; the pieces follow each other without a gap."""
    spread_numbers = mix((points | places(ends - starts) << 21).astype(U) + U(1))
    return mix(np.add.reduceat(spread_numbers, starts))


def _kinds(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the distinct pieces the first place of each, and which of them every piece is; equal hashes are told apart by the code points."""
    keys, first, which = np.unique(_run_hashes(points, starts, ends), return_index=True, return_inverse=True)
    lengths, like = ends - starts, starts[first][which]
    same = lengths == lengths[first][which]
    at = np.flatnonzero(same)
    differ = points[spread(starts[at], lengths[at])] != points[spread(like[at], lengths[at])]
    if differ.any():
        same[np.repeat(at, lengths[at])[differ]] = False
    own = np.flatnonzero(~same)
    which[own] = len(keys) + np.arange(len(own))
    return np.concatenate([first, own]), which


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids (array of long) of the whole text of every row; null as empty, which has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_path)
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                ids, at = encoder.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return text_of(docs).mapInArrow(lean(run), "doc_id long, ids array<long>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, bytes (binary) of every row of doc_id, ids; null as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_path)
        for batch in batches:
            rows = []
            for ids in batch.column("ids").to_pylist():
                rows.append(encoder.decode(np.array(ids or [], np.int64))[0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes of every row: texts are encoded whole, and the ids decoded.

    ids_sha256 is of the decimal ids joined by commas. Null and empty texts have no ids. Rows are independent, so ties,
    repeated rows and null ids come out as they are; an empty table gives no rows. Columns other than doc_id and text
    are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_path)
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                ids, at = encoder.encode(part.column("text").to_pylist())
                (plain, plain_at), (digits, digits_at) = encoder.decode(ids), encoder.digits(ids)
                own, text = [], []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own.append(hashlib.sha256(digits[digits_at[lo] : max(digits_at[lo], digits_at[hi] - 1)]).hexdigest())
                    text.append(hashlib.sha256(plain[plain_at[lo] : plain_at[hi]]).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.array(own), pa.array(text), pa.array(plain_at[at[1:]] - plain_at[at[:-1]])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
                )

    return text_of(docs).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
