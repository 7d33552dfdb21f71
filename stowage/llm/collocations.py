"""Phrases that score as collocations, counted over a prefix-free parse.

A text is cut at words whose hash meets a condition, so that equal passages are cut alike wherever they lie. A chunk runs
from one cut to the next and three words on; n-grams that begin before the next cut are its own, those that begin in the
overlap belong to the next chunk, so each is assigned once. The distinct chunks of a language are the dictionary and how
often each occurs is its frequency in the parse: n-grams are counted inside the dictionary, weighted by it.

Text is read as words once: a packed row of the dictionary holds its words as numbers, and each number's hash and
spelling. Counting goes from one word to four. A phrase can't occur often unless both phrases one word shorter do, so
each round asks only about such. Inside a row phrases are told by the numbers of their words and asked about once; among
rows they are hashes, told by 88 bits and the range they are dealt to. Of each frequent phrase one row is told the count,
and gives the phrase itself; whatever follows (parts, scores, containment, ranks) are joins and groupings of these few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._ask import CONF, asked, codes_of, grouped, reduced
from ._common import scratch, settings, written
from ._words import FOLDED, U, buffers, lean, mix, places, slices, word_hashes
from .kneser_ney import _pack, _unpack

LONGEST, LEAST, TOP = 4, 30, 2000
SHARE, SCALE = 80, 2_000_000
#: A cut every so many words, about; bytes of a packed row of the dictionary, and of it for each range, at most.
EVERY, PACK, RANGE_BYTES = 16, 4 << 20, 16 << 20
OTHER = "und"
MORE = U((1 << 48) - 1)
_ODD = U(0x9E3779B97F4A7C15)
#: What separates pieces, and words within them.
HARD, SEPS = np.zeros(256, bool), np.zeros(256, bool)
HARD[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPS[[*b".,;:!?", *range(0x09, 0x0E), 0x20]] = True


def _word_bounds(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the piece it is in; ``rows`` are ascending offsets at which texts begin, and the end."""
    fresh = np.zeros(len(data) + 1, bool)
    fresh[rows] = True
    inner = ~SEPS[data]
    edge = np.append(True, ~inner)[:-1] | fresh[:-1]
    begin = np.flatnonzero(inner & edge)
    stop = np.append(~inner | fresh[:-1], True)[1:]
    end = np.flatnonzero(inner & stop) + 1
    piece = np.cumsum(HARD[data] | fresh[:-1])[begin] if len(begin) else begin
    return begin, end, piece


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the parse: lang, body (bytes from a cut to the end of the overlap), words that are its own."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, rows = buffers(part.column("text"))
            data, rows = FOLDED.astype(np.uint8)[data[rows[0] : rows[-1]]], rows - rows[0]
            begin, end, _ = _word_bounds(data, rows)
            if not len(begin):
                continue
            hashes, first = word_hashes(data, rows, SEPS, np.arange(256))
            text = np.repeat(np.arange(len(rows) - 1), np.diff(first))
            cut = (hashes % U(EVERY) == 0) | np.append(True, text[1:] != text[:-1])
            at = np.flatnonzero(cut)
            to = np.append(at[1:], len(begin))
            last = np.minimum(to + LONGEST - 1, first[text[at] + 1]) - 1
            lo, hi = begin[at], end[last]
            sizes = hi - lo
            ends = np.cumsum(sizes)
            body = data[np.arange(int(ends[-1])) - np.repeat(ends - sizes - lo, sizes)]
            bodies = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(body)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(text[at])), bodies, pa.array((to - at).astype(np.int64))], ["lang", "body", "own"])


def dictionary(docs: DataFrame) -> DataFrame:
    """lang, body, own and how often (freq) of every distinct chunk of the parse."""
    text = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(OTHER)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return text.mapInArrow(lean(_parsed), "lang string, body binary, own long").groupBy("lang", "body", "own").agg(F.count(F.lit(1)).alias("freq"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The dictionary in rows of about PACK bytes: langs; of every chunk its language's number, frequency, own words and words; of every word its number in the row and how many words follow it; of every number its hash, length and spelling."""
    waiting, size = [], 0

    def row() -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting)
        langs = table.column("lang").combine_chunks().dictionary_encode()
        lang, freq, own = (x.to_numpy().astype(np.int64) for x in (langs.indices, table.column("freq"), table.column("own")))
        bodies = [buffers_of(b.column("body")) for b in waiting]
        data = np.concatenate([d[at[0] : at[-1]] for d, at in bodies])
        rows = np.append(0, np.cumsum(np.concatenate([np.diff(at) for _, at in bodies])))
        begin, end, piece = _word_bounds(data, rows)
        hashes, first = word_hashes(data, rows, SEPS, np.arange(256))
        count = np.diff(first)
        chunk = np.repeat(np.arange(len(count)), count)
        seeds = np.array([int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in langs.dictionary.to_pylist()], U)
        numbers = pa.array(mix(hashes + seeds[lang[chunk]])).dictionary_encode()
        ids, n = numbers.indices.to_numpy(), len(hashes)
        # of every word, how many words follow it in its piece of the chunk, itself included; more than LONGEST + 1 are as many
        edge = np.flatnonzero(np.append((piece[1:] != piece[:-1]) | (chunk[1:] != chunk[:-1]), True)) + 1
        left = np.minimum(np.repeat(edge, np.diff(np.append(0, edge))) - np.arange(n), LONGEST + 1)
        at = _first_places(ids, len(numbers.dictionary))
        lengths = (end - begin)[at]
        spelled = data[np.repeat(begin[at], lengths) + places(lengths)]
        packed = [
            _pack(*(x.astype(U) for x in (lang, freq, own, count))), _pack(ids.astype(np.uint32), left.astype(np.uint8)),
            _pack(numbers.dictionary.to_numpy(), lengths.astype(np.uint32)), zstandard.compress(spelled.tobytes(), 1),
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([langs.dictionary.to_pylist()], pa.list_(pa.string())), *(pa.array([x], pa.binary()) for x in packed), pa.array([len(data)], pa.int64())], ["langs", "chunks", "words", "hashes", "spelled", "size"]
        )

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.column("body").nbytes
        if size >= PACK:
            yield row()
            waiting, size = [], 0
    if waiting:
        yield row()


def _first_places(numbers: np.ndarray, n: int) -> np.ndarray:
    """Where each of the numbers below n comes first; all do."""
    at = np.empty(n, np.int64)
    at[numbers[::-1]] = np.arange(len(numbers))[::-1]
    return at


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key comes first, and every place's number of its key, in the order of keys."""
    n, bits = len(keys), U(len(keys).bit_length())
    if int(keys.max(initial=0)).bit_length() + int(bits) > 64:
        order, first, group = grouped(keys)
        return order[first], group
    # a sort of keys with their places below them takes a fraction of an argsort's time
    both = np.sort(keys << bits | np.arange(n, dtype=U))
    order, keys = (both & ((U(1) << bits) - U(1))).astype(np.int64), both >> bits
    fresh = np.ones(n, bool)
    fresh[1:] = keys[1:] != keys[:-1]
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(fresh) - 1
    return order[fresh], group


def buffers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


class Words:
    """Words of a packed row of the dictionary: their numbers, the numbers' hashes with the language, how many words follow, and weights (0 in an overlap)."""

    def __init__(self, row: dict) -> None:
        self.lang, self.freq, self.own, self.count = (x.astype(np.int64) for x in _unpack(row["chunks"]))
        self.ids, self.left = _unpack(row["words"])
        self.hashes, self.lengths = _unpack(row["hashes"])
        self.weight = np.repeat(self.freq, self.count) * (places(self.count) < np.repeat(self.own, self.count))

    def grams(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the n words from positions on."""
        a = b = np.full(len(at), U(n))
        for k in range(n):
            h = self.hashes[self.ids[at + k]]
            a, b = mix(a * _ODD + h), mix((b ^ h) * _ODD + U(k + 1))
        return a, b & MORE


class Counting:
    """The rounds: replies are the count for the row that gives the phrase, -1 for others that have it, 0 where it is rare."""

    def __init__(self, ranges: int, least: int) -> None:
        self.ranges, self.least, self.replies = ranges, least, []

    def _asks(self, words: Words, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the n-grams at positions, each once: codes and more in order, and that order."""
        a, b = words.grams(n, at)
        codes = codes_of(a, self.ranges)
        order = np.argsort(codes)
        if len(order) and (np.diff(codes[order]) == 0).any():  # which the order of equal ones must not depend on
            order = np.lexsort((b, codes))
        return codes[order], b[order], order

    def _upto(self, row: dict, n: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, list]:
        """Words of a row, the positions at which n-grams begin that may be frequent, own or in an overlap, where among them each n-gram comes first, and their numbers; of each shorter round first positions and replies."""
        words, told = Words(row), []
        at, grams, first = np.arange(len(words.ids)), words.ids, _first_places(words.ids, len(words.hashes))
        for k in range(1, n):
            *_, order = self._asks(words, k, at[first])
            said = np.empty(len(order), np.int64)
            said[order] = self.replies[k - 1].of(row["chunk"])
            told.append((at[first], said))
            # a number of every position's k words, and whether they are frequent
            number, often = np.zeros(len(words.ids), U), np.zeros(len(words.ids) + 1, bool)
            number[at], often[at] = grams, (said != 0)[grams]
            at = at[often[at] & often[at + 1] & (words.left[at] > k)]
            first, grams = _numbered(number[at] * U(len(words.hashes)) + words.ids[at + k])
        return words, at, first, grams, told

    def question(self, n: int):
        def ask(row: dict) -> tuple[np.ndarray, ...]:
            words, at, first, grams, _ = self._upto(row, n)
            codes, more, order = self._asks(words, n, at[first])
            # n-grams that begin in an overlap are asked about, since longer ones need to know, but count nothing here
            counts = np.zeros(len(order), np.int64)
            np.add.at(counts, grams, words.weight[at])
            return codes, more, counts[order].astype(U)

        return ask

    def answer(self, chunk: np.ndarray, code: np.ndarray, more: np.ndarray, counts: np.ndarray) -> np.ndarray:
        order, first, group = grouped(code, more)
        total = reduced(np.add, counts.astype(np.int64), order, first)
        found = np.where(total >= self.least, -1, 0)[group]
        own = order[first]  # a stable order: the first chunk that asks
        found[own] = np.where(total >= self.least, total, 0)
        return found

    def phrases(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frequent phrases with their counts: lang, phrase, size in words, a. Of every row and language the number of words, with size 0."""
        for batch in batches:
            for row in batch.to_pylist():
                words, *_, told = self._upto(row, LONGEST + 1)
                langs, spelled = row["langs"], zstandard.decompress(row["spelled"])
                n, ends, stops = np.zeros(len(langs), np.int64), np.cumsum(words.count), np.cumsum(words.lengths, dtype=np.int64)
                np.add.at(n, words.lang, words.own * words.freq)
                out = [(lang, "", 0, c) for lang, c in zip(langs, n.tolist(), strict=True)]
                for k, (at, said) in enumerate(told, 1):
                    at, said = at[said > 0], said[said > 0]
                    chunk = np.searchsorted(ends, at, side="right")
                    for p, lang, c in zip(at.tolist(), words.lang[chunk].tolist(), said.tolist(), strict=True):
                        spoken = b" ".join(spelled[stops[i] - words.lengths[i] : stops[i]] for i in words.ids[p : p + k].tolist())
                        out.append((langs[lang], spoken.decode(), k, c))
                lang, phrase, size, a = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(phrase), pa.array(size, pa.int64()), pa.array(a, pa.int64())], ["lang", "phrase", "size", "a"])


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase (words joined by a space), size, a of every phrase of up to LONGEST words that occurs ``least`` times in its language; and of each language its words, with size 0 and phrase empty."""
    spark = docs.sparkSession
    with settings(spark, CONF | {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}):
        packed = dictionary(docs).mapInArrow(lean(_packed), "langs array<string>, chunks binary, words binary, hashes binary, spelled binary, size long")
        chunks = written(packed.withColumn("chunk", F.monotonically_increasing_id()), "phrase-dictionary")
    folder = scratch(spark, "phrase-replies")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    counting = Counting(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)), least)
    for n in range(1, LONGEST + 1):
        replies, _ = asked(chunks.drop("langs", "spelled"), folder, f"words-{n}", counting.ranges, counting.question(n), counting.answer, "i8")
        counting.replies.append(replies)
    with settings(spark, CONF):
        return written(chunks.mapInArrow(lean(counting.phrases), "lang string, phrase string, size long, a long"), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Of every language its ``top`` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at space and tab. A candidate has 2 to LONGEST
    words and occurs a >= ``least`` times; of its cuts into l and r the one with the least SCALE * a / (l + r), rounded
    down, counts, and of equal ones that with fewest words before it. Candidates whose words lie in a longer one that
    occurs SHARE percent as often or more are dropped. Order is by score and a descending, then by the phrase's bytes. A
    null lang is ``und``, and one with the language of that name; null and empty texts have no words; repeated rows count
    each; an empty table gives no rows. Columns other than text and lang are not looked at.
    """
    found = frequent(docs, least)
    n = found.where("size = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    phrases = found.where("size > 0").select("lang", "phrase", "a", "size")
    parts = phrases.where(f"size < {LONGEST}").select("lang", "phrase", F.col("a").alias("f"))
    words = F.split("phrase", " ")
    some = lambda first, count: F.array_join(F.slice(words, first, count), " ")
    cuts = phrases.where("size > 1").select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), (F.col("size") - 1).cast("int"))).alias("k"))
    cuts = cuts.withColumns({"head": some(1, F.col("k")), "tail": some(F.col("k") + 1, (F.col("size") - F.col("k")).cast("int"))})
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr(f"({SCALE} * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))").cast("long")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "size").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = phrases.where("size > 2").select("lang", F.col("a").alias("more"), "size", F.explode(F.sequence(F.lit(2), (F.col("size") - 1).cast("int"))).alias("k"), "phrase")
    longer = longer.select("lang", "more", "k", "phrase", F.explode(F.sequence(F.lit(1), (F.col("size") - F.col("k") + 1).cast("int"))).alias("at"))
    within = longer.select("lang", some(F.col("at"), F.col("k")).alias("phrase"), "more").groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.col("more").isNull() | (100 * wide("more") < SHARE * wide("a")))
    order = [F.desc("cut.score"), F.desc("a"), F.col("phrase")]
    # a language's candidates are first ranked in as many parts as there are tasks, of which no more than the first go on
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def _gram(n: int) -> str:
    return f"SELECT lang, list_aggregate(list_slice(ws, i, i + {n - 1}), 'string_agg', ' ') AS phrase, {n} AS size FROM (SELECT lang, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM p)"


ORACLE_SQL = f"""
WITH t AS (SELECT coalesce(lang, '{OTHER}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\n-\\r]')) AS piece FROM t)),
f AS (SELECT lang, phrase, size, count(*) AS a FROM ({' UNION ALL '.join(_gram(n) for n in range(1, LONGEST + 1))}) GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
cut AS (SELECT lang, phrase, a, k, list_aggregate(list_slice(ws, 1, k), 'string_agg', ' ') AS head, list_aggregate(list_slice(ws, k + 1, size), 'string_agg', ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST(CAST({SCALE} AS HUGEINT) * c.a // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.size > len(string_split(b.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= {SHARE} * b.a))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {TOP}
"""
