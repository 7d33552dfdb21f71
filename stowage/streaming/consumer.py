"""Draining the queue as a stream.

The stream's checkpoint takes the place of claims: one query owns the queue, and a micro-batch that was not
committed is run again. What a batch writes is therefore named by its number, and a ledger row is keyed by hash and
target, so that a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import BACKOFF_BASE_S, BACKOFF_MOST_POWER, BACKOFF_MOST_S
from ..operators import ledger, queue
from . import run


def drain(stream: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs ``work`` on the pending rows of each micro-batch and writes the attempts it returns to folder/attempts/batch=N.

    ``every`` is a processing-time interval; without it the query ends when what is available is done.
    """

    def batch(rows: DataFrame, number: int) -> None:
        pending = rows.where("status = 'pending'").dropDuplicates(["id"])
        work(pending).write.mode("overwrite").parquet(f"{folder}/attempts/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drained(table: DataFrame, work: Callable[[DataFrame], DataFrame], files: int | None = None) -> DataFrame:
    """The attempts that ``work`` returned when a queue that is staged from ``table`` has been drained, ``files`` files a micro-batch."""
    spark, folder = table.sparkSession, run.shared_folder(table.sparkSession)
    table.write.parquet(f"{folder}/queue")
    reader = spark.readStream.schema(table.schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{folder}/queue")
    drain(stream, work, folder, f"{folder}/checkpoint").awaitTermination()
    shape = work(table.limit(0))
    shape.limit(0).write.parquet(f"{folder}/attempts/batch=-1")
    return spark.read.schema(shape.schema).parquet(f"{folder}/attempts/batch=*")


def statuses(attempts: DataFrame) -> DataFrame:
    """The ledger's status after the attempts of all batches, in the order of batch and seq."""
    return ledger.fold_status(attempts)


def backlog_by_window(stream: DataFrame, late: str = "1 hour", width: str = "15 minutes") -> DataFrame:
    """Rows and failed attempts by the window of created_date; windows close when rows are no longer expected."""
    return (
        stream.withWatermark("created_date", late).groupBy(F.window("created_date", width), "status")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce("attempts", F.lit(0)).cast("long")).alias("attempts"))
    )


#: Parts that the ids of a stream are dealt to, each with one value of state: 36 million rows are 35,000 a bucket.
BUCKETS = 1024
#: The bucket of rows without an id, which are one id.
_NO_ID = -1
_STATE = "held binary, known binary"


def _ms(us: np.ndarray) -> np.ndarray:
    return us // 1000


def _rows(state: bytes, width: int) -> np.ndarray:
    return np.frombuffer(state, np.int64).reshape(-1, width)


def _first_of_each(ids: np.ndarray) -> np.ndarray:
    """Where a new id begins in sorted ids."""
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return first


def _sorted(rows: np.ndarray) -> np.ndarray:
    """Rows by their columns from left to right."""
    return rows[np.lexsort(rows.T[::-1])]


class _Bucket:
    """The ids of one bucket, stepped together: rows are held until the watermark has passed their time, whatever file they came in.

    All of it is 64-bit integers: held rows begin with id and time, what is known of ids with the id, one row each.
    """

    fields: tuple[str, ...]
    width: int
    out: tuple[str, ...]

    def passed(self, bucket: int, ready: np.ndarray, known: np.ndarray, now_us: int) -> tuple[np.ndarray, pd.DataFrame, int | None]:
        """The watermark is at ``now_us`` and ``ready`` (sorted) before it; returns what is known then, what to give out, and the millisecond from which there is more."""
        raise NotImplementedError

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, known = (_rows(x, w) for x, w in zip(state.get, (len(self.fields), self.width), strict=True)) if state.exists else (_rows(b"", len(self.fields)), _rows(b"", self.width))
        if not state.hasTimedOut:
            held = np.concatenate([held, *(batch[list(self.fields)].to_numpy(np.int64) for batch in batches)])
        now = state.getCurrentWatermarkMs()
        is_ready = _ms(held[:, 1]) <= now
        held, ready = held[~is_ready], _sorted(held[is_ready])
        known, given, again = self.passed(key[0], ready, known, now * 1000)
        state.update((held.tobytes(), known.tobytes()))
        wanted = [*([] if again is None else [again]), *([int(_ms(held[:, 1]).min())] if len(held) else [])]
        if wanted:  # a timeout is over when the watermark is beyond it
            state.setTimeoutTimestamp(max(min(wanted) - 1, now, 1))
        if key[0] == _NO_ID:
            given["id"] = pd.array([None] * len(given), "Int64")
        yield given[list(self.out)]


def _bucketed(rows: DataFrame, step: _Bucket, buckets: int, schema: str) -> DataFrame:
    """``step`` over the ids of each of ``buckets`` buckets; a bucket's part of the state is one value, and is in memory while it is stepped."""
    bucket = F.when(F.col("id").isNull(), _NO_ID).otherwise(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    own = rows.withColumns({"bucket": bucket, "id": F.coalesce("id", F.lit(0)).cast("long")})
    return own.groupBy("bucket").applyInPandasWithState(step.__call__, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


class _Claims(_Bucket):
    fields, width = ("id", "at_us", "seq", "claimed"), 4  # known: id, deliveries, and of the open claim seq and since (-1: no open claim)
    out = ("id", "seq", "deliveries", "status")

    def __init__(self, ttl_us: int, most: int) -> None:
        self.ttl_us, self.most = ttl_us, most

    def passed(self, bucket: int, ready: np.ndarray, known: np.ndarray, now_us: int) -> tuple[np.ndarray, pd.DataFrame, int | None]:
        # an id's open claim goes before its events; an id that is only known has a row that is no claim
        before = np.column_stack([known[:, 0], np.zeros(len(known), np.int64), known[:, 3], known[:, 2], known[:, 3] >= 0])
        after = np.column_stack([ready[:, 0], np.ones(len(ready), np.int64), ready[:, 1:]])
        steps = np.concatenate([before, after])
        steps = steps[np.lexsort((np.arange(len(steps)), steps[:, 1], steps[:, 0]))]
        ids, at, seq, claimed = steps[:, 0], steps[:, 2], steps[:, 3], steps[:, 4] == 1
        first = _first_of_each(ids)
        last = np.roll(first, -1) if len(ids) else first
        until = np.where(last, now_us, np.roll(at, -1))
        up = claimed & (until - at > self.ttl_us)
        group = np.cumsum(first) - 1
        had = np.zeros(group[-1] + 1 if len(ids) else 0, np.int64)
        had[np.searchsorted(ids[first], known[:, 0])] = known[:, 1]
        total = np.cumsum(up)
        deliveries = had[group] + total - (total - up)[first][group]
        open_ = claimed & ~up
        known = np.column_stack([ids, deliveries, np.where(open_, seq, -1), np.where(open_, at, -1)])[last]
        given = pd.DataFrame({"id": ids[up], "seq": seq[up], "deliveries": deliveries[up], "status": np.where(deliveries[up] >= self.most, "dead_letter", "pending")})
        waits = known[known[:, 3] >= 0, 3]
        return known, given, int(_ms(waits.min() + self.ttl_us)) + 1 if len(waits) else None


def redeliver(stream: DataFrame, ttl_s: int = queue.STALE_S, most: int = queue.MAX_DELIVERIES, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """From a stream of id, seq, event ('claimed' or 'settled') and at: every claim that had no outcome within ``ttl_s`` of its own time.

    id, seq (of the claim), deliveries, status: pending to be delivered again, or dead_letter. Only such a claim adds to
    deliveries, and nothing resets them. An id's events count in the order of at and seq. They may come in any order by
    ``late`` of event time: they are held until the watermark has passed them, and what comes later than that is left
    out. An outcome after the time is up, or a new claim, doesn't undo that it was; a claim that nothing follows is up
    when the watermark has passed its time. Rows without an id are one id, an event without a time is none. The ids are
    stepped in ``buckets`` buckets by their hash, which a checkpoint keeps.
    """
    events = stream.withWatermark("at", late).where("at is not null")
    rows = events.select("id", F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("event") == "claimed", F.lit(False)).cast("long").alias("claimed"), F.unix_micros("at").alias("at_us"), "at")
    return _bucketed(rows, _Claims(ttl_s * 1_000_000, most), buckets, "id long, seq long, deliveries long, status string")


class _Retries(_Bucket):
    fields, width = ("id", "at_us", "attempts"), 3  # known: id, attempts, due (-1: done or given up)
    out = ("id", "attempt", "at_us", "status", "due_us")

    def __init__(self, work: Callable[[int, int], bool], most: int) -> None:
        self.work, self.most = work, most

    def passed(self, bucket: int, ready: np.ndarray, known: np.ndarray, now_us: int) -> tuple[np.ndarray, pd.DataFrame, int | None]:
        # a row that comes again is known
        new = ready[_first_of_each(ready[:, 0]) & ~np.isin(ready[:, 0], known[:, 0])]
        known = np.concatenate([known, new[:, [0, 2, 1]]])
        found = []
        while len(tried := np.flatnonzero((known[:, 2] >= 0) & (_ms(known[:, 2]) * 1000 <= now_us))):
            ids, attempts, at = known[tried].T
            attempts = attempts + 1
            told = [None] * len(ids) if bucket == _NO_ID else ids.tolist()
            ok = np.fromiter((self.work(i, n) for i, n in zip(told, attempts.tolist(), strict=True)), bool, len(ids))
            status = np.where(ok, "done", np.where(attempts >= self.most, "dead_letter", "pending"))
            numbers, which = np.unique(attempts, return_inverse=True)
            due = np.where(status == "pending", at + np.array([backoff_us(n - 1) for n in numbers.tolist()])[which], -1)
            known[tried, 1], known[tried, 2] = attempts, due
            found.append(pd.DataFrame({"id": ids, "attempt": attempts, "at_us": at, "status": status, "due_us": pd.Series(due, dtype="Int64").mask(due < 0)}))
        given = pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: [] for c in self.out})
        waits = known[known[:, 2] >= 0, 2]
        return known, given, int(_ms(waits.min())) if len(waits) else None


def backoff_us(attempts: int) -> int:
    """The wait after a failure, by the attempts before it, as ``functions.scalars.backoff_s`` says."""
    return min(BACKOFF_BASE_S << min(attempts, BACKOFF_MOST_POWER), BACKOFF_MOST_S) * 1_000_000


def retried(stream: DataFrame, work: Callable[[int, int], bool], most: int = queue.MAX_ATTEMPTS, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """From a stream of queue rows (id, attempts, due, a time that none of them may lack): every attempt until a row is done or given up.

    id, attempt, at, status after it, visible_at (when it is due again). ``work`` tells from id and number of the attempt
    whether it succeeds, inside the task that holds the row's state. A row is tried when the watermark has passed its
    time, and after each failure again when its backoff is over, by a timer. Rows may come in any order by ``late`` of
    event time, and a row that comes twice is one. The ids are stepped in ``buckets`` buckets by their hash, which a
    checkpoint keeps.
    """
    rows = stream.withWatermark("due", late).select("id", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), F.unix_micros("due").alias("at_us"), "due")
    found = _bucketed(rows, _Retries(work, most), buckets, "id long, attempt long, at_us long, status string, due_us long")
    return found.select("id", "attempt", F.timestamp_micros("at_us").alias("at"), "status", F.timestamp_micros("due_us").alias("visible_at"))


def due(as_of: Column) -> Column:
    """Rows of a snapshot that are visible again."""
    return queue.visible(as_of)
