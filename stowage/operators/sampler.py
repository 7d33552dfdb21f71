"""Gauges over time: backlog, its oldest row, and the age of every target's last verification, at regular ticks.

A row of the queue is open over a run of ticks, a verification counts from its tick on. Such a run is cut into blocks of
2^k ticks, two for each k at most, which are added up by block; a tick then looks at the blocks that it lies in, one for
each k. So no task needs all rows or all ticks in order, and a row costs the logarithm of the number of ticks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ledger

_MERGED = {"sum": F.sum, "min": F.min, "max": F.max}
#: Rows of blocks up to which they are broadcast to the ticks.
BROADCAST_ROWS = 500_000


def over_ticks(runs: DataFrame, ticks: int, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """keys, tick and each value, added up ('sum', 'min' or 'max') over the runs (lo, hi, keys, values) with lo <= tick < hi; ticks that no run covers have no row."""
    levels = max(1, (ticks - 1).bit_length()) + 1
    merged = [_MERGED[how](c).alias(c) for c, how in values.items()]
    inside = runs.withColumns({"lo": F.greatest("lo", F.lit(0)).cast("long"), "hi": F.least("hi", F.lit(ticks)).cast("long")}).where("lo < hi")
    once = inside.groupBy(*keys, "lo", "hi").agg(*merged)
    level = once.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("k"))
    # the run in units of 2^k: what sticks out on the left and on the right is a block of its own
    level = level.withColumns({"a": F.expr("shiftright(lo + shiftleft(1L, k) - 1, k)"), "b": F.expr("shiftright(hi, k)")}).where("a < b")
    blocks = level.select(*keys, *values, "k", F.explode(F.array_compact(F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1)))).alias("block"))
    blocks = blocks.groupBy(*keys, "k", "block").agg(*merged)
    # at most 2 * ticks blocks of every key
    n_keys = once.select(*keys).distinct().count() if keys else 1
    blocks = F.broadcast(blocks) if 2 * ticks * n_keys <= BROADCAST_ROWS else blocks
    every = runs.sparkSession.range(ticks).select(F.col("id").alias("tick"), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("k"))
    return every.withColumn("block", F.expr("shiftright(tick, k)")).join(blocks, ["k", "block"]).groupBy(*keys, "tick").agg(*merged)


def _tick(at: Column, start: Column, every_s: int) -> Column:
    """The first tick at or after a time."""
    return F.ceil((F.unix_micros(at) - F.unix_micros(start)) / F.lit(every_s * 1_000_000)).cast("long")


def history(queue: DataFrame, verified: DataFrame, targets: Sequence[str], start: Column, every_s: int, ticks: int) -> DataFrame:
    """A row for each tick: at, pending, oldest_s, never_verified, stalest_s, ok.

    queue: opened, closed (null: still open); a row is pending at a tick from opened on and before closed, and one whose
    opening is unknown from the beginning on, without an age. verified: target, verified_at. stalest_s is the age of the
    last verification of the configured target for which it is longest ago, 0 while there is none (ok is false then);
    what was verified stays known until something newer is.
    """
    rows = queue.select(
        F.coalesce(_tick(F.col("opened"), start, every_s), F.lit(0)).alias("lo"), F.coalesce(_tick(F.col("closed"), start, every_s), F.lit(ticks)).alias("hi"),
        F.lit(1).cast("long").alias("pending"), F.unix_micros("opened").alias("oldest"),
    )
    backlog = over_ticks(rows, ticks, [], {"pending": "sum", "oldest": "min"})
    marks = verified.where(F.col("target").isin(list(targets)) & F.col("verified_at").isNotNull())
    marks = marks.groupBy("target", F.greatest(_tick(F.col("verified_at"), start, every_s), F.lit(0)).alias("lo")).agg(F.max(F.unix_micros("verified_at")).alias("last"))
    last = over_ticks(marks.withColumn("hi", F.lit(ticks)), ticks, ["target"], {"last": "max"})
    every = queue.sparkSession.range(ticks).select(F.col("id").alias("tick"), F.unix_micros(start).alias("start"))
    every = every.select("tick", (F.col("start") + F.col("tick") * every_s * 1_000_000).alias("now"))
    per_target = last.groupBy("tick").agg(F.min("last").alias("stalest"), F.count(F.lit(1)).alias("known"))
    seconds = lambda c: F.coalesce((F.col("now") - F.col(c)) / F.lit(1e6), F.lit(0.0))
    known = F.coalesce("known", F.lit(0))
    return every.join(backlog, "tick", "left").join(per_target, "tick", "left").select(
        F.timestamp_micros("now").alias("at"), F.coalesce("pending", F.lit(0)).cast("long").alias("pending"), seconds("oldest").alias("oldest_s"),
        (F.lit(len(targets)) - known).cast("long").alias("never_verified"), seconds("stalest").alias("stalest_s"), (known > 0).alias("ok"),
    )


def coverage_by_batch(status: DataFrame, batch: str, targets: Sequence[str]) -> DataFrame:
    """For each number in column ``batch``: objects and gaps of everything recorded in batches up to it (external_id, target, state).

    An object counts from the batch that first has it; the batch in which the last configured target stores it closes its
    gap. Two counts a batch are added up, so a batch needs nothing of the ones before it but their totals.
    """
    first = status.groupBy("external_id").agg(F.min(batch).alias("opened"))
    held = status.where(ledger.on_targets(targets)).groupBy("external_id", "target").agg(F.min(batch).alias("since")).groupBy("external_id").agg(F.max("since").alias("closed"), F.count(F.lit(1)).alias("n"))
    closed = held.where(F.col("n") == len(targets)).select(F.col("closed").alias(batch), F.lit(0).alias("objects"), F.lit(1).alias("covered"))
    changes = first.select(F.col("opened").alias(batch), F.lit(1).alias("objects"), F.lit(0).alias("covered")).unionByName(closed)
    sums = status.select(batch).distinct().join(changes.groupBy(batch).agg(F.sum("objects").alias("o"), F.sum("covered").alias("c")), batch, "left")
    so_far = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a batch
    total = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0)).cast("long")
    return sums.select(batch, total("o").alias("objects"), total("c").alias("covered"), (total("o") - total("c")).alias("gaps"))
