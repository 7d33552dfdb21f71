"""The work queue: what to claim, what is behind, and the transitions of claimed rows.

Transitions are DataFrame to DataFrame: rows that aren't in progress come out as they were. Time is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import age_s, backoff_s, defer_s, later

MAX_ATTEMPTS, MAX_DELIVERIES, STALE_S = 10, 50, 3600
# Fixed value: the reason that a claim which is reaped too often is given up for.
CRASH_LOOP = "crash-loop: exceeded max deliveries"
OUTCOMES = ("done", "released", "skipped", "deferred", "failed")


def visible(as_of: Column) -> Column:
    return (F.col("status") == "pending") & (F.col("visible_at").isNull() | (F.col("visible_at") <= as_of))


def claim_ids(queue: DataFrame, n: int, as_of: Column) -> DataFrame:
    """The next n visible rows: highest priority first (unknown before all), then oldest (unknown last), then id."""
    return queue.where(visible(as_of)).orderBy(F.desc_nulls_first("priority"), F.asc_nulls_last("created_date"), "id").limit(n)


def claim(queue: DataFrame, n: int, as_of: Column) -> DataFrame:
    """The claimed rows, in progress as of now."""
    return claim_ids(queue, n, as_of).withColumns({"status": F.lit("in_progress"), "claimed_at": as_of})


def claimed_queue(queue: DataFrame, n: int, as_of: Column) -> DataFrame:
    """The whole queue after a claim; the claimed ids are at most n and are joined, not collected."""
    ids = claim_ids(queue, n, as_of).select("id", F.lit(True).alias("took"))
    took = F.coalesce("took", F.lit(False))
    marked = queue.join(ids, "id", "left")
    return marked.withColumns({"status": F.when(took, "in_progress").otherwise(F.col("status")), "claimed_at": F.when(took, as_of).otherwise(F.col("claimed_at"))}).drop("took")


def backlog(queue: DataFrame, as_of: Column) -> DataFrame:
    """One row: fresh rows and retries that are due (not what was deferred), and the oldest one's age in seconds."""
    due = F.col("visible_at").isNull() | ((F.col("visible_at") <= as_of) & (F.coalesce("attempts", F.lit(0)) > 0))
    behind = queue.where((F.col("status") == "pending") & due)
    return behind.agg(F.count(F.lit(1)).alias("pending"), F.coalesce(age_s(as_of, F.min("created_date")), F.lit(0.0)).alias("oldest_s"))


def stale(as_of: Column, ttl_s: int = STALE_S) -> Column:
    return (F.col("status") == "in_progress") & (F.col("claimed_at").isNull() | (age_s(as_of, F.col("claimed_at")) > ttl_s))


def _has(queue: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in queue.columns else F.lit(None).cast(kind)


def _move(queue: DataFrame, rows: Column, changes: dict[str, Column]) -> DataFrame:
    """``queue`` with changes in these rows; every value is worked out from the row as it was, and all other rows stay as they are."""
    old = {c: _has(queue, c, "timestamp" if c in ("claimed_at", "visible_at") else "string") for c in changes}
    moved = F.coalesce(rows, F.lit(False))
    return queue.withColumns({c: F.when(moved, v).otherwise(old[c]) for c, v in changes.items()})


def _held() -> Column:
    return F.col("status") == "in_progress"


def _never() -> Column:
    return F.lit(None).cast("timestamp")


def mark_done(queue: DataFrame) -> DataFrame:
    """Done; the time of the claim stays, as the row's last."""
    return _move(queue, _held(), {"status": F.lit("done")})


def release(queue: DataFrame) -> DataFrame:
    """Back to pending at once, without an attempt."""
    return _move(queue, _held(), {"status": F.lit("pending"), "claimed_at": _never(), "visible_at": _never()})


def skip(queue: DataFrame) -> DataFrame:
    return _move(queue, _held(), {"status": F.lit("skipped"), "claimed_at": _never()})


def defer(queue: DataFrame, as_of: Column, jitter: Column | None = None) -> DataFrame:
    """Back to pending in two to four minutes, attempts at 0, so that it is told from a retry."""
    jitter = F.rand() if jitter is None else jitter
    return _move(queue, _held(), {"status": F.lit("pending"), "claimed_at": _never(), "attempts": F.lit(0), "visible_at": later(as_of, defer_s(jitter))})


def fail(queue: DataFrame, as_of: Column, reason: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """One attempt more: back to pending after the backoff, or to dead_letter at ``most``."""
    n = F.coalesce("attempts", F.lit(0)) + 1
    status = F.when(n >= most, "dead_letter").otherwise("pending")
    return _move(queue, _held(), {"status": status, "attempts": n, "last_error": reason, "claimed_at": _never(), "visible_at": later(as_of, backoff_s(F.col("attempts")))})


def reap_stale(queue: DataFrame, as_of: Column, ttl_s: int = STALE_S, most: int = MAX_DELIVERIES) -> DataFrame:
    """Claims without an outcome for longer than the limit: one delivery more, and pending again or dead_letter. An earlier error stays unless the row is given up."""
    gone, n = F.coalesce(stale(as_of, ttl_s), F.lit(False)), F.coalesce("deliveries", F.lit(0)) + 1
    error = F.when(n >= most, CRASH_LOOP).otherwise(_has(queue, "last_error", "string"))
    marked = queue.withColumn("reaped", gone)
    return _move(marked, F.col("reaped"), {"status": F.when(n >= most, "dead_letter").otherwise("pending"), "deliveries": n, "last_error": error, "claimed_at": _never()})


def dead_lettered(reaped: DataFrame) -> DataFrame:
    """One row: claims that were reaped, and those of them that are given up."""
    return reaped.where("reaped").agg(F.count(F.lit(1)).alias("reaped"), F.count(F.when(F.col("status") == "dead_letter", 1)).alias("dead_lettered"))


def outcome(ok: Column, shutdown: Column, gone: Column, deferred: Column) -> Column:
    """How a claimed row is settled; the first that holds."""
    return F.when(ok, "done").when(shutdown, "released").when(gone, "skipped").when(deferred, "deferred").otherwise("failed")


def settle(queue: DataFrame, results: DataFrame, as_of: Column, jitter: Column | None = None, most: int = MAX_ATTEMPTS) -> DataFrame:
    """The queue after the outcomes of results (id, outcome, reason); rows without one come out as they were.

    A claim is settled once: of several results for one id the first of OUTCOMES counts, with the least of its reasons.
    """
    rank = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))
    first = results.where(F.col("outcome").isin(*OUTCOMES)).groupBy("id").agg(F.min(F.struct(rank.alias("rank"), "outcome", "reason")).alias("settled"))
    joined = queue.join(first, "id", "left")
    said, n = F.col("settled.outcome"), F.coalesce("attempts", F.lit(0)) + 1
    jitter, failed = F.rand() if jitter is None else jitter, said == "failed"
    status = F.when(said.isin("done", "skipped"), said).when(failed & (n >= most), "dead_letter").otherwise("pending")
    due = F.when(said == "deferred", later(as_of, defer_s(jitter))).when(failed, later(as_of, backoff_s(F.col("attempts")))).when(said != "released", F.col("visible_at"))
    changes = {
        "status": status, "visible_at": due, "attempts": F.when(said == "deferred", 0).when(failed, n).otherwise(F.col("attempts")),
        "last_error": F.when(failed, F.col("settled.reason")).otherwise(_has(queue, "last_error", "string")), "claimed_at": F.when(said == "done", _has(queue, "claimed_at", "timestamp")),
    }
    return _move(joined, _held() & said.isNotNull(), changes).drop("settled")
