"""Circuit breakers of whole histories, as scans over blocks of outcomes.

A circuit is one sequence of states, but its steps need not be taken one by one. An epoch begins at the start or after a
success that closed the circuit; it trips at the first failure with ``threshold`` failures among the last 2 * threshold
outcomes of the epoch. Call a failure dense if it and the threshold - 1 failures before it lie that close together: then
an epoch that begins at e trips at the first dense failure whose earliest companion is at e or later. So every dense
failure has one successor, the trip of the epoch after the next success, and the trips of a target are the chain from
its first dense failure on. Pointer doubling finds the chain; running sums over blocks turn it into states. Blocks are
of bounded size, so that a target with all outcomes is as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Outcomes of a block.
SPAN = 20_000
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)
_EARLIER = (Window.unboundedPreceding, -1)


def _total(column: Column) -> Column:
    """The sum over the rows of a window before this one; 0 at first."""
    return F.coalesce(column, F.lit(0))


def _indexed(outcomes: DataFrame) -> DataFrame:
    """target, seq, at, ok, i (0, 1, ... in the order of seq), r (failures so far), closes (i of the first success after this outcome)."""
    rows = outcomes.select("target", "seq", "at", F.coalesce("ok", F.lit(False)).alias("ok"))
    placed = written(rows.repartitionByRange("target", "seq").sortWithinPartitions("target", "seq", "at", "ok").withColumn("place", F.monotonically_increasing_id()), "circuit-order")
    # a part is what one task wrote, or SPAN rows of it
    placed = placed.withColumn("part", F.floor(F.col("place") / SPAN))
    within = Window.partitionBy("target", "part")
    numbered = placed.withColumns(
        {"n": F.row_number().over(within.orderBy("place")), "fails": F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(within.orderBy("place").rowsBetween(*_SO_FAR))}
    ).withColumn("next_ok", F.last(F.when(F.col("ok"), F.col("n")), ignorenulls=True).over(within.orderBy(F.desc("place")).rowsBetween(*_EARLIER)))
    numbered = written(numbered, "circuit-parts")
    parts = numbered.groupBy("target", "part").agg(F.max("n").alias("size"), F.max("fails").alias("failed"), F.min(F.when(F.col("ok"), F.col("n"))).alias("first_ok"))
    before, after = (Window.partitionBy("target").orderBy(o).rowsBetween(*_EARLIER) for o in ("part", F.desc("part")))
    parts = parts.withColumns({"n0": _total(F.sum("size").over(before)), "r0": _total(F.sum("failed").over(before))})
    parts = parts.withColumn("later_ok", F.last(F.col("n0") + F.col("first_ok") - 1, ignorenulls=True).over(after)).select("target", "part", "n0", "r0", "later_ok")
    found = numbered.join(parts, ["target", "part"])
    return found.select(
        "target", "seq", "at", "ok", (F.col("n0") + F.col("n") - 1).alias("i"), (F.col("r0") + F.col("fails")).alias("r"), F.coalesce(F.col("n0") + F.col("next_ok") - 1, "later_ok").alias("closes")
    )


def _links(dense: DataFrame) -> DataFrame:
    """Of every dense failure i (with its earliest companion at s) the trip of the epoch after its success: target, i, then."""
    nodes = dense.select("target", F.col("s").alias("pos"), F.lit(1).alias("kind"), "i", F.lit(None).cast("long").alias("of"))
    asks = dense.where("closes is not null").select("target", (F.col("closes") + 1).alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("i"), F.col("i").alias("of"))
    events = nodes.unionByName(asks).withColumn("block", F.floor(F.col("pos") / SPAN))
    # later positions first; a node at the very position counts
    near = F.last("i", ignorenulls=True).over(Window.partitionBy("target", "block").orderBy(F.desc("pos"), F.desc("kind")).rowsBetween(*_SO_FAR))
    blocks = events.groupBy("target", "block").agg(F.min("i").alias("first"))
    blocks = blocks.select("target", "block", F.last("first", ignorenulls=True).over(Window.partitionBy("target").orderBy(F.desc("block")).rowsBetween(*_EARLIER)).alias("later"))
    asked = events.withColumn("near", near).where("kind = 0").join(blocks, ["target", "block"])
    return asked.select("target", F.col("of").alias("i"), F.coalesce("near", "later").alias("then")).where("then is not null")


def _chain(dense: DataFrame) -> DataFrame:
    """target, i of all trips: what the first dense failure reaches, by links of 1, 2, 4, ... steps."""
    found = written(dense.groupBy("target").agg(F.min("i").alias("i")), "circuit-trips")
    jump = written(_links(dense), "circuit-links")
    while True:
        more = written(found.join(jump, ["target", "i"]).select("target", F.col("then").alias("i")), "circuit-trips")
        if more.isEmpty():
            return found
        found = written(found.unionByName(more), "circuit-trips")
        jump = written(jump.join(jump.select("target", F.col("i").alias("then"), F.col("then").alias("far")), ["target", "then"]).select("target", "i", F.col("far").alias("then")), "circuit-links")


def states(outcomes: DataFrame, threshold: int = 5, cooldown_s: float = 60.0) -> DataFrame:
    """The circuit of every target after each of its outcomes (target, seq, at, ok): target, seq, open, until, trips.

    Outcomes count in the order of seq. A circuit opens when ``threshold`` of the last 2 * threshold outcomes failed, and
    every failure while it is open starts the cooldown again (until: when a probe is let through); any success while it
    is open closes it and clears what it remembers. A null ok is a failure; an empty table gives no rows.
    """
    threshold = max(threshold, 1)
    base = written(_indexed(outcomes), "circuit-outcomes")
    fails = base.where("not ok").select("target", "r", "i", "closes")
    earliest = fails.select("target", (F.col("r") + threshold - 1).alias("r"), F.col("i").alias("s"))
    dense = written(fails.join(earliest, ["target", "r"]).where(F.col("i") - F.col("s") < 2 * threshold).select("target", "i", "s", "closes"), "circuit-dense")
    trips = _chain(dense).join(dense, ["target", "i"]).select("target", "i", "closes")
    events = trips.select("target", "i", F.lit(1).alias("trip"), F.lit(0).alias("close")).unionByName(trips.where("closes is not null").select("target", F.col("closes").alias("i"), F.lit(0).alias("trip"), F.lit(1).alias("close")))
    events = written(events, "circuit-events")
    blocks = base.select("target", F.floor(F.col("i") / SPAN).alias("block")).distinct()
    sums = events.groupBy("target", F.floor(F.col("i") / SPAN).alias("block")).agg(F.sum("trip").alias("trip"), F.sum("close").alias("close"))
    before = Window.partitionBy("target").orderBy("block").rowsBetween(*_EARLIER)
    offsets = blocks.join(sums, ["target", "block"], "left").select("target", "block", _total(F.sum("trip").over(before)).alias("trips0"), _total(F.sum("close").over(before)).alias("closes0"))
    so_far = Window.partitionBy("target", "block").orderBy("i").rowsBetween(*_SO_FAR)
    rows = base.join(events, ["target", "i"], "left").withColumn("block", F.floor(F.col("i") / SPAN))
    rows = rows.withColumns({"t": _total(F.sum("trip").over(so_far)), "c": _total(F.sum("close").over(so_far))}).join(offsets, ["target", "block"])
    trips_so_far = (F.col("trips0") + F.col("t")).cast("long")
    is_open = trips_so_far > F.col("closes0") + F.col("c")
    return rows.select("target", "seq", is_open.alias("open"), F.when(is_open, F.timestamp_micros(F.unix_micros("at") + F.lit(round(cooldown_s * 1_000_000)))).alias("until"), trips_so_far.alias("trips"))
