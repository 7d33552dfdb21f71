"""Conversation structure repair by a shortest path whose weights are single big integers.

A conversation's rows, in order, pass an automaton of the roles that may follow each other (``(s?(ua)+)?``). Nodes of the
graph are (row, state); an edge keeps, reroles or deletes a row, or inserts one. A path's weight is one integer: its high
digits are the cost, its low digits, of a fixed width and zero at the end, are the letters of its edits from the first on,
so the least integer is the cheapest path with the ASCII-least audit. Digits are octal: D 1, I 2, K 3, R 4.

Equal rows are added up first, then rows are dealt by ranges of (conversation, turn), so a conversation of any length
is spread over as many tasks as it needs. A task solves the conversations that it has whole. What lies at the edges of
a task, or is long, becomes a table of least weights from state to state, block by block; tables of one conversation
are chained in order, which gives every part its piece of the audit. Texts of such conversations are then hashed in
order, as a stream: SHA-256 is sequential, so one conversation is hashed by one task, with no more than a row in memory.

Tables may be chained because no cheapest path inserts: leaving out the inserted row's partner costs 2 instead of 5, or
both rows of ``s`` and partner are reroled for 2 at most. So all cheapest paths have one letter a row, and of two
of them that meet in a state the lesser stays the lesser whatever follows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small, written
from ._words import lean

#: Rows of one table of weights, and of a conversation that is solved at once; bytes of its texts.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
SPACE = " \t\n\x0b\x0c\r"
# Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: Octal digits of the edits, in the order of their letters.
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
D, I, K, R = LETTERS.values()
#: States: nothing yet, after the system's turn, after the user's, after the assistant's; where each role leads.
STATES = 4
FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GIVEN = {0: "u", 1: "u", 2: "a", 3: "u"}
ACCEPTED = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Faults of a row as numbers: it must be deleted, or counts as truncated.
FINE, BLANK, DUPLICATE, CUT = range(4)
MOST = (1 << 63) - 1

Weights = list[int | None]


def width(rows: int) -> int:
    """Octal digits of an audit of so many rows, with two insertions in every gap at most: more never change the state."""
    return 3 * rows + 2


def _before(weight: int | None, digit: int, cost: int, digits: int) -> int | None:
    """The weight of an edit that is followed by a path of this weight."""
    if weight is None:
        return None
    shift = 3 * digits
    return ((weight >> shift) + cost << shift) | (digit << shift - 3) | ((weight & (1 << shift) - 1) >> 3)


def _least(*weights: int | None) -> int | None:
    return min((w for w in weights if w is not None), default=None)


def _inserted(weights: Weights, digits: int) -> Weights:
    """Weights with up to two rows inserted first."""
    more = weights
    for _ in range(2):
        more = [_least(weights[s], _before(more[FOLLOWS[s, GIVEN[s]]], I, INSERT, digits)) for s in range(STATES)]
    return more


def solve(rows: list[tuple[str, int]], ends: tuple[int, ...]) -> Weights:
    """The least weights from every state over rows (role's initial, fault) to one of the states ``ends``."""
    digits = width(len(rows))
    weights = _inserted([0 if s in ends else None for s in range(STATES)], digits)
    for initial, fault in reversed(rows):
        now, more = [], TRUNCATED if fault == CUT else 0
        for s in range(STATES):
            found = [_before(weights[s], D, DELETE, digits)]
            if fault not in (BLANK, DUPLICATE):
                if (s, initial) in FOLLOWS:
                    found.append(_before(weights[FOLLOWS[s, initial]], K, KEEP + more, digits))
                found.append(_before(weights[FOLLOWS[s, GIVEN[s]]], R, REROLE + more, digits))
            now.append(_least(*found))
        weights = _inserted(now, digits)
    return weights


def table(rows: list[tuple[str, int]]) -> list[Weights]:
    """Least weights from state to state."""
    return [list(w) for w in zip(*(solve(rows, (end,)) for end in range(STATES)), strict=True)]


def chained(first: Weights, digits: int, then: list[Weights], more: int) -> Weights:
    """Least weights to every state over two parts that follow each other; their digits follow each other too."""
    low = (1 << 3 * digits) - 1

    def both(a: int | None, b: int | None) -> int | None:
        if a is None or b is None:
            return None
        cost = (a >> 3 * digits) + (b >> 3 * more)
        return (cost << 3 * (digits + more)) | ((a & low) << 3 * more) | (b & (1 << 3 * more) - 1)

    return [_least(*(both(first[mid], then[mid][end]) for mid in range(STATES))) for end in range(STATES)]


def told(weight: int, digits: int) -> tuple[int, str]:
    """Cost and audit of a weight."""
    audit = format(weight & (1 << 3 * digits) - 1, "o").zfill(digits)
    return weight >> 3 * digits, audit.replace("0", "").translate({ord(str(n)): c for c, n in LETTERS.items()})


class Repaired:
    """The hash of a conversation's repaired rows, which come one by one with their edits."""

    def __init__(self) -> None:
        self.hash, self.state, self.any = hashlib.sha256(), 0, False

    def _add(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def edit(self, letter: str, role: str, text: str) -> None:
        if letter == "D":
            return
        initial = role[:1] if letter == "K" else GIVEN[self.state]
        self._add(role if letter == "K" else NAMES[initial], "" if letter == "I" else text)
        self.state = FOLLOWS[self.state, initial]


class Part:
    """Consecutive rows of one conversation, as figures that add up in order, and its weights."""

    def __init__(self) -> None:
        self.n = self.blank = self.duplicate = self.cut = self.illegal = self.turns = self.digits = 0
        self.first = self.last = self.low = self.high = None
        self.paths: list[Weights] | None = None  # least weights from each state to each, of the blocks so far
        self.waiting: list[tuple[str, int]] = []

    def add(self, initial: str, fault: int, turn: int | None) -> None:
        if self.n:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.n, self.last = self.n + 1, initial
        self.blank, self.duplicate, self.cut = self.blank + (fault == BLANK), self.duplicate + (fault == DUPLICATE), self.cut + (fault == CUT)
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        self.waiting.append((initial, fault))
        if len(self.waiting) >= BLOCK:
            self.close()

    def close(self) -> None:
        """Chains what waits to the weights."""
        own, digits = table(self.waiting), width(len(self.waiting))
        self.paths = own if self.paths is None else [chained(w, self.digits, own, digits) for w in self.paths]
        self.digits += digits
        self.waiting = []

    def summary(self) -> bytes:
        if self.waiting or self.paths is None:
            self.close()
        names = ("n", "blank", "duplicate", "cut", "illegal", "turns", "digits", "first", "last", "low", "high")
        return json.dumps({k: getattr(self, k) for k in names} | {"paths": [[None if w is None else format(w, "x") for w in row] for row in self.paths]}).encode()


#: What is returned of each conversation besides its id.
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_FINAL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_EMPTY = hashlib.sha256().hexdigest()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, MOST)


def _rows(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows: results of whole conversations, and of the parts that may not be whole their summary."""
    schema = f"{_FINAL}, part long, summary binary"
    conv, expected, edge, size, at, part, held, out = None, None, True, 0, None, None, [], []

    def ended(edge: bool) -> None:
        if part is None:
            return
        if edge or part.paths is not None or size > BLOCK_BYTES:
            out.append((conv, *[None] * 8, at, part.summary()))
            return
        cost, audit = told(solve(part.waiting, ACCEPTED)[0], width(part.n))
        done = Repaired()
        edits = iter(audit)
        for role, text, n in held:
            for _ in range(n):
                while (letter := next(edits)) == "I":
                    done.edit("I", "", "")
                done.edit(letter, role, text)
        for letter in edits:
            done.edit(letter, "", "")
        out.append((conv, _gaps(part.low, part.high, part.turns), part.blank, part.duplicate, part.cut, part.illegal, cost, audit, done.hash.hexdigest(), None, None))

    for batch in batches:
        for own, place, turn, role, text, fault, n in _rows(batch, "conv_id", "place", "turn", "role", "text", "fault", "n"):
            if place != expected or part is None or own != conv:
                ended(edge or place != expected)
                edge = place != expected
                conv, at, part, held, size = own, place, Part(), [], 0
            expected = place + 1
            size += len(text)
            if size <= BLOCK_BYTES and part.paths is None:
                held.append((role, text, n))
            else:
                held = []
            for copy in range(n):
                part.add(role[:1], fault if fault == BLANK or not copy else DUPLICATE, turn)
        if len(out) >= 1000:
            yield _batch(out, schema)
            out = []
    ended(True)
    yield _batch(out, schema)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries in order: each part's piece of the audit, and with the first part the conversation's figures."""
    conv, whole, sizes, weights, digits, out = None, None, [], None, 0, []

    def ended() -> None:
        if whole is None:
            return
        weight = _least(*(weights[s] for s in ACCEPTED))
        cost, audit = told(weight, digits)
        figures, at = json.dumps([_gaps(whole["low"], whole["high"], whole["turns"]), *(whole[k] for k in ("blank", "duplicate", "cut", "illegal")), cost]), 0
        for k, (place, n) in enumerate(sizes):
            out.append((conv, place, -1, audit[at : at + n], None if k else figures, None, None, None))
            at += n

    for batch in batches:
        for own, place, summary in _rows(batch, "conv_id", "part", "summary"):
            x = json.loads(summary)
            paths = [[None if w is None else int(w, 16) for w in row] for row in x["paths"]]
            if whole is None or own != conv:
                ended()
                conv, whole, sizes, weights, digits = own, x, [], paths[0], x["digits"]
            else:
                weights, digits = chained(weights, digits, paths, x["digits"]), digits + x["digits"]
                whole["turns"] += x["turns"] - (x["low"] is not None and x["low"] == whole["high"])
                whole["illegal"] += x["illegal"] + (bool(whole["n"]) and bool(x["n"]) and whole["last"] + x["first"] not in LEGAL)
                for k in ("n", "blank", "duplicate", "cut"):
                    whole[k] += x[k]
                if x["n"]:
                    whole["last"] = x["last"]
                if x["low"] is not None:
                    whole["low"], whole["high"] = x["low"] if whole["low"] is None else whole["low"], x["high"]
            sizes.append((place, x["n"]))
        if len(out) >= 1000:
            yield _batch(out, _PIECES)
            out = []
    ended()
    yield _batch(out, _PIECES)


_PIECES = "conv_id long, place long, n long, piece string, figures string, role string, text string, fault long"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, each followed by its rows: the results."""
    conv, figures, audit, done, edits, out = None, None, [], None, iter(""), []

    def ended() -> None:
        if done is not None:
            out.append((conv, *json.loads(figures), "".join(audit), done.hash.hexdigest()))

    for batch in batches:
        for own, n, piece, first, role, text in _rows(batch, "conv_id", "n", "piece", "figures", "role", "text"):
            if n < 0:
                if first is not None:
                    ended()
                    conv, figures, audit, done = own, first, [], Repaired()
                audit.append(piece)
                edits = iter(piece)
            else:
                for _ in range(n):
                    done.edit(next(edits), role, text)
        if len(out) >= 1000:
            yield _batch(out, _FINAL)
            out = []
    ended()
    yield _batch(out, _FINAL)


def _known(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and how often (n) each row is there after damage by its key; a dropped row stays with n = 0, role and text empty, turn null."""
    kind = F.crc32(F.concat(_known(F.col("conv_id")), F.lit(":"), _known(F.col("turn")))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _known(F.col("role")).alias("role"), _known(F.col("text")).alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies (n) and the fault of the first copy."""
    once = written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")), "conversation-rows")
    key = F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256).alias("key")
    again = once.where("n > 0").select(key, F.struct("turn").alias("at")).groupBy("key").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key", "first_at")
    bare = F.rtrim("text", F.lit(SPACE))
    last = F.right(bare, F.lit(1))
    fault = F.when(bare == "", BLANK).when(~F.col("first_at.turn").eqNullSafe(F.col("turn")) & F.col("first_at").isNotNull(), DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    return once.withColumn("key", key).join(again, "key", "left").select("conv_id", "turn", "role", "text", "n", fault.cast("long").alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, n as ``damaged`` returns): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first, those of one turn by role and text; equal rows follow each other. A role counts
    by its first character; a role without one, or with another than s, u and a, can't be kept. A null conv_id is one
    conversation. Conversations with n = 0 alone are zeros, an empty audit and the hash of nothing; an empty table gives
    no rows. More gaps than a long can hold are its largest value.
    """
    order = ["conv_id", "turn", "role", "text"]
    placed = written(_faults(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "conversation-order")
    scanned = written(placed.mapInArrow(lean(_scan), f"{_FINAL}, part long, summary binary"), "conversation-parts")
    whole = scanned.where("summary is null").select("conv_id", *FIGURES)
    parts = scanned.where("summary is not null").select("conv_id", "part", "summary")
    pieces = written(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(lean(_chain), _PIECES), "conversation-pieces")
    ids = pieces.where("figures is not null").select("conv_id")
    split = small(ids, ids.count())
    again = placed.join(split, placed["conv_id"].eqNullSafe(split["conv_id"]), "left_semi")
    again = again.select("conv_id", "place", "n", F.lit(None).cast("string").alias("piece"), F.lit(None).cast("string").alias("figures"), "role", "text", "fault")
    dealt = pieces.unionByName(again).repartition("conv_id").sortWithinPartitions("conv_id", "place", "n")
    return whole.unionByName(dealt.mapInArrow(lean(_hashed), _FINAL))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of all conversations after damage. Null conv_id, turn, role and text count as one space in the damage's key and, but for the turn, in the row; other columns are not looked at."""
    return repair(damaged(conversations))
