"""Bytes that repeat an earlier document's, by distributed prefix doubling over sampled positions.

Positions are named by the bytes that follow them: first by HEAD bytes, then by pairs of names at growing offsets, until
they are unique or the pair covers the threshold. Spark sorts the names of all documents; whatever turns out to be
unique is not looked at again.

To sort a name for every byte would shuffle several times the text, so positions are sampled first. Of the positions in
a window of ``threshold`` bytes the one whose HEAD bytes hash least stands for the window; equal windows choose it at the
same offset, so two equal windows always meet. Consecutive windows with one such position are one segment. The rounds:

1. positions, by the name of their HEAD bytes: a position whose name no other document has drops out, with its windows;
2. segments, by the names of all their bytes: a segment that a smaller document holds too is covered whole, and a segment
   of which no other form exists drops out;
3. the windows of what is left, by pairs of names at offsets HEAD, 2 HEAD, ... up to the threshold: unique ones drop out
   after each round, and what the smallest document holding it has in common with later ones is covered in those.

Every round asks about each name once for each chunk of a few MB of text, so a name that a third of all documents hold
is as many rows as there are chunks, and gets one byte back. Texts never move; they are written once, compressed, in
chunks. Names are hashes; those that decide anything are told by 88 bits and the range they are sorted in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ask import CONF, LOW, Replies, asked, codes_of, grouped, reduced
from ._common import dropped, scratch, settings, text_of, written
from ._words import U, buffers, lean, mix, slices

THRESHOLD = 50
#: Bytes of text of a chunk, unless one text is longer; of what is hashed at once; of text for each range, at most.
CHUNK, SLICE, RANGE_BYTES = 2 << 20, 1 << 17, 16 << 20
#: Of a second name these bits are compared besides the code.
MORE = U((1 << 48) - 1)
_ODD, _SEED = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)
_TOP = np.int64(-(1 << 63))


def head_of(threshold: int) -> int:
    """Bytes of the first names: the threshold halved until it is at most 32."""
    head = threshold
    while head > 32:
        head = -(-head // 2)
    return head


def _offsets(size: int) -> list[int]:
    """Where the words of 8 bytes lie that make up so many bytes."""
    return [*range(0, size - 8, 8), size - 8]


def _words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    rows = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    return np.ascontiguousarray(rows[at]).view("<u8").reshape(-1)


def names_at(data: np.ndarray, at: np.ndarray, head: int) -> np.ndarray:
    """Names of the ``head`` bytes at some positions."""
    found = np.full(len(at), _SEED, U)
    for o in _offsets(head) if len(at) else []:
        found = mix(found * _ODD + _words_at(data, at + o))
    return found


def _names(data: np.ndarray, head: int) -> np.ndarray:
    """Names of the ``head`` bytes at all positions."""
    n = len(data) - 7
    words = np.empty(n, U)
    for o in range(8):
        k = len(range(o, n, 8))
        words[o::8] = np.frombuffer(data[o : o + 8 * k].tobytes(), "<u8")
    n = len(data) - head + 1
    found = np.full(n, _SEED, U)
    for o in _offsets(head):
        found = mix(found * _ODD + words[o : o + n])
    return found


class Segments:
    """Of a chunk, all runs of windows that one position stands for: first and last window, document, and the position's name."""

    def __init__(self, row: dict, threshold: int) -> None:
        self.threshold, self.head = threshold, head_of(threshold)
        self.data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
        self.ids, self.ends = np.array(row["ids"], np.int64), np.array(row["ends"], np.int64)
        parts = [self._slice(x) for x in range(0, len(self.data) - threshold + 1, SLICE)]
        whole = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U)]
        self.lo, self.hi, self.doc, self.name = whole

    def _slice(self, x: int) -> tuple[np.ndarray, ...]:
        data = self.data[x : x + SLICE + self.threshold - 1]
        names, reach = _names(data, self.head), self.threshold - self.head + 1
        least = names & ~U(0xFFFFFFFF) | np.arange(len(names), dtype=U)
        span = 1
        while 2 * span <= reach:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < reach:
            least = np.minimum(least[: len(least) - reach + span], least[reach - span :])
        starts = np.arange(x, x + len(least))
        doc = np.searchsorted(self.ends, [x, x + len(least) - 1], side="right")
        doc = np.repeat(np.arange(doc[0], doc[1] + 1), np.diff(np.concatenate([[x], self.ends[doc[0] : doc[1]], [x + len(least)]])))
        inside = np.flatnonzero(starts + self.threshold <= self.ends[doc])
        if not len(inside):
            return starts[:0], starts[:0], doc[:0], names[:0]
        chosen, doc = (least[inside] & U(0xFFFFFFFF)).astype(np.int64), doc[inside]
        fresh = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])))
        last = np.append(fresh[1:], len(inside)) - 1
        # chosen names are small ones: mixed again, so that they are dealt evenly
        return inside[fresh] + x, inside[last] + x, doc[fresh], mix(names[chosen[fresh]] ^ _SEED)

    def __getitem__(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        return self.lo[which], self.hi[which], self.doc[which], self.name[which]

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Names of all bytes of segments."""
        size, found = hi + self.threshold - lo, mix((hi - lo).astype(U) + _SEED)
        last = hi + self.threshold - self.head
        for k in range(-(-int(size.max(initial=0)) // self.head)):
            found = mix(found * _ODD + names_at(self.data, np.minimum(lo + k * self.head, last), self.head))
        return found

    def doubled(self, at: np.ndarray, size: int) -> np.ndarray:
        """Names of ``size`` bytes: pairs of names of at least half as many."""
        if size == self.head:
            return names_at(self.data, at, size)
        half = -(-size // 2)
        return mix(self.doubled(at, half) * _ODD ^ mix(self.doubled(at + size - half, half) + _SEED))


def _sizes(threshold: int) -> list[int]:
    """Lengths of names after each doubling, the threshold last."""
    found = [threshold]
    while found[0] > head_of(threshold):
        found.insert(0, -(-found[0] // 2))
    return found[1:]


def _asked_once(ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys' first rows, their smallest and largest id, and every row's key."""
    order, first, group = grouped(*keys)
    return order[first], reduced(np.minimum, ids, order, first), reduced(np.maximum, ids, order, first), group


def _plain(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers of the same order."""
    return (ids ^ _TOP).view(U)


def _shared(chunk: np.ndarray, code: np.ndarray, several: np.ndarray) -> np.ndarray:
    """1 for codes that another document has, too."""
    order, first, group = grouped(code)
    n = np.diff(np.append(first, len(code)))
    return ((n > 1) | (reduced(np.maximum, several, order, first) > 0))[group].astype(np.uint8)


def _covered(chunk: np.ndarray, code: np.ndarray, more: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bit 0: a smaller document has it; bit 1: another name with this code exists."""
    order, first, group = grouped(code, more)
    least = reduced(np.minimum, ids, order, first)[group]
    heads = code[order][first]
    _, begins, own = grouped(heads)
    forms = np.diff(np.append(begins, len(heads)))[own][group]
    return ((ids > least) | (forms > 1).astype(np.uint8) << 1).astype(np.uint8)


class Rounds:
    """What a task knows of a chunk after the rounds so far; every round adds its replies."""

    def __init__(self, threshold: int, ranges: int) -> None:
        self.threshold, self.ranges, self.replies = threshold, ranges, []

    def positions(self, row: dict) -> tuple[np.ndarray, ...]:
        seg = Segments(row, self.threshold)
        first, low, high, _ = _asked_once(seg.ids[seg.doc], codes := codes_of(seg.name, self.ranges))
        return codes[first], (low != high).astype(np.uint8)

    def _alive(self, row: dict) -> tuple[Segments, tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
        seg = Segments(row, self.threshold)
        codes = codes_of(seg.name, self.ranges)
        *_, group = _asked_once(seg.ids[seg.doc], codes)
        own = seg[alive := np.flatnonzero(self.replies[0].of(row["chunk"])[group])] if len(codes) else seg[np.zeros(0, np.int64)]
        return seg, own, codes[alive] if len(codes) else codes, seg.digests(own[0], own[1])

    def segments(self, row: dict) -> tuple[np.ndarray, ...]:
        seg, (_, _, doc, _), codes, digests = self._alive(row)
        first, low, _, _ = _asked_once(seg.ids[doc], codes, digests)
        return codes[first], digests[first], _plain(low)

    def _open(self, row: dict) -> tuple[Segments, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segments that are covered whole (first, last window), and the windows yet to tell with their documents."""
        seg, (lo, hi, doc, _), codes, digests = self._alive(row)
        if not len(lo):
            return seg, lo, hi, lo, doc
        _, low, _, group = _asked_once(seg.ids[doc], codes, digests)
        said = self.replies[1].of(row["chunk"])[group]
        whole = (said & 1 > 0) | (seg.ids[doc] > low[group])
        rest = np.flatnonzero(~whole & (said & 2 > 0))
        n = hi[rest] - lo[rest] + 1
        at = np.repeat(lo[rest] + n - np.cumsum(n), n) + np.arange(int(n.sum()))
        return seg, lo[whole], hi[whole], at, np.repeat(doc[rest], n)

    def _windows(self, row: dict, done: int) -> tuple[Segments, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``_open`` after ``done`` doublings."""
        seg, lo, hi, at, doc = self._open(row)
        for k, size in enumerate(_sizes(self.threshold)[:done]):
            *_, group = self._named(seg, at, doc, size)
            shared = self.replies[2 + k].of(row["chunk"])[group] > 0 if len(at) else np.zeros(0, bool)
            at, doc = at[shared], doc[shared]
        return seg, lo, hi, at, doc

    def _named(self, seg: Segments, at: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        names = seg.doubled(at, size)
        more = mix(names_at(seg.data, at, seg.head) ^ names_at(seg.data, at + size - seg.head, seg.head) * _ODD) & MORE
        codes = codes_of(names, self.ranges)
        first, low, high, group = _asked_once(seg.ids[doc], codes, more)
        return codes[first], more[first], low, high, group

    def shared(self, done: int):
        """The question of a doubling that doesn't reach the threshold: whether another document has the names."""

        def ask(row: dict) -> tuple[np.ndarray, ...]:
            seg, _, _, at, doc = self._windows(row, done)
            codes, more, low, high, _ = self._named(seg, at, doc, _sizes(self.threshold)[done])
            return codes, more, (low != high).astype(np.uint8)

        return ask

    def last(self, row: dict) -> tuple[np.ndarray, ...]:
        seg, _, _, at, doc = self._windows(row, len(_sizes(self.threshold)) - 1)
        codes, more, low, _, _ = self._named(seg, at, doc, self.threshold)
        return codes, more, _plain(low)

    def runs(self, row: dict) -> tuple[Segments, np.ndarray, np.ndarray, np.ndarray]:
        """Maximal removed runs of a chunk: begin, end, document."""
        seg, lo, hi, at, doc = self._windows(row, len(_sizes(self.threshold)) - 1)
        if len(at):
            _, _, low, _, group = self._named(seg, at, doc, self.threshold)
            at = at[(self.replies[-1].of(row["chunk"])[group] & 1 > 0) | (seg.ids[doc] > low[group])]
        begin, end = np.concatenate([lo, at]), np.concatenate([hi, at]) + self.threshold
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order])
        doc = np.searchsorted(seg.ends, begin, side="right")
        fresh = np.ones(len(begin), bool)
        fresh[1:] = (begin[1:] > end[:-1]) | (doc[1:] != doc[:-1])
        fresh = np.flatnonzero(fresh)
        return seg, begin[fresh], end[np.append(fresh[1:], len(begin)) - 1] if len(begin) else end, doc[fresh]


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _chunked(docs: DataFrame) -> DataFrame:
    """Texts in rows of about CHUNK bytes: ids (null as the least long), whether they are null, ends of texts, and all bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends, texts, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            known = [int(_TOP) if i is None else i for i in ids]
            body = zstandard.compress(b"".join(texts), 1)
            return pa.RecordBatch.from_arrays(
                [pa.array([known], pa.list_(pa.int64())), pa.array([[i is None for i in ids]], pa.list_(pa.bool_())), pa.array([ends], pa.list_(pa.int64())), pa.array([body], pa.binary())],
                ["ids", "unknown", "ends", "data"],
            )

        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                data, at = buffers(part.column("text"))
                for i, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if ids and size + b - a > CHUNK:
                        yield row()
                        ids, ends, texts, size = [], [], [], 0
                    size += b - a
                    ids.append(i)
                    ends.append(size)
                    texts.append(data[a:b].tobytes())
        if ids:
            yield row()

    packed = text_of(docs).mapInArrow(lean(pack), "ids array<long>, unknown array<boolean>, ends array<long>, data binary")
    with settings(docs.sparkSession, CONF | {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}):
        return written(packed.withColumn("chunk", F.monotonically_increasing_id()), "substring-chunks")


def repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, after bytes that repeat are removed.

    Removed is every byte that a string of ``threshold`` bytes (16 at least) covers which also starts in a row with a
    smaller doc_id; overlaps count, strings of several documents don't, and all are judged on the input. Null texts are
    empty; a null doc_id is the smallest, and rows that share one don't count for each other. Repeated rows come out as
    they are; an empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    if threshold < 16:
        raise ValueError("a threshold is 16 bytes at least")
    spark = docs.sparkSession
    chunks, folder = _chunked(docs), scratch(spark, "substring-replies")
    size = chunks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    rounds = Rounds(threshold, ranges)

    def ask(label: str, question, answer) -> None:
        rounds.replies.append(asked(chunks, folder, label, ranges, question, answer)[0])

    ask("positions", rounds.positions, _shared)
    ask("segments", rounds.segments, _covered)
    for k in range(len(_sizes(threshold)) - 1):
        ask(f"doubling-{k}", rounds.shared(k), lambda chunk, code, more, several: _shared_names(code, more, several))
    ask("windows", rounds.last, _covered)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _kept(row, rounds)

    with settings(spark, CONF):
        found = written(chunks.mapInArrow(lean(cut), _RESULT), "substring-kept")
    dropped(chunks)
    return found


def _shared_names(code: np.ndarray, more: np.ndarray, several: np.ndarray) -> np.ndarray:
    order, first, group = grouped(code, more)
    n = np.diff(np.append(first, len(code)))
    return ((n > 1) | (reduced(np.maximum, several, order, first) > 0))[group].astype(np.uint8)


def _kept(row: dict, rounds: Rounds) -> pa.RecordBatch:
    seg, begin, end, doc = rounds.runs(row)
    n = len(seg.ids)
    spans, removed = np.bincount(doc, minlength=n), np.bincount(doc, end - begin, minlength=n).astype(np.int64)
    starts, digests, at = np.append(0, seg.ends[:-1]).tolist(), [], 0
    begin, end = begin.tolist(), end.tolist()
    for a, b, k in zip(starts, seg.ends.tolist(), spans.tolist(), strict=True):
        digest = hashlib.sha256()
        for i in range(at, at + k):
            digest.update(seg.data[a : begin[i]])
            a = end[i]
        digest.update(seg.data[a:b])
        digests.append(digest.hexdigest())
        at += k
    ids = pa.array([None if u else i for i, u in zip(row["ids"], row["unknown"], strict=True)], pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(seg.ends, prepend=0)), pa.array(removed), pa.array(spans.astype(np.int64)), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d)),
hit AS (SELECT r, p FROM w JOIN (SELECT g, min(doc_id) AS least FROM w GROUP BY g) USING (g) WHERE least < doc_id),
marked AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 50, true) AS fresh FROM hit),
numbered AS (SELECT r, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY r ORDER BY p) AS span FROM marked),
span AS (SELECT r, span, min(p) AS lo, max(p) + 50 AS hi FROM numbered GROUP BY r, span),
cut AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS done FROM span),
gone AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS tail, string_agg(substr(h, 2 * done + 1, 2 * (lo - done)), '' ORDER BY lo) AS kept
         FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || substr(h, 2 * tail + 1), h))) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
