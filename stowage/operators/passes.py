"""Whole passes over a corpus: backup, repair, what they record, and whether a run counts as a success.

Transfers are done elsewhere (``content.backup``) and come in as rows; what to send, how each object ends and what the
ledger holds afterwards are joins and groupings on the content hash. Files of equal content are one object.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ledger

RECORD = "array<struct<target: string, state: string, bytes: bigint>>"
#: Outcomes with which a run fails, and those of which it must have at least one, by its kind.
FAILS = {"backup": ("failed",), "repair": ("failed", "skipped"), "restore": ("failed", "missing"), "drill": ("failed", "missing")}
NEEDS_WORK = ("restore", "drill")


def _names(targets: Sequence[str]) -> Column:
    return F.array(*map(F.lit, targets)).cast("array<string>")


def corpus_items(files: DataFrame) -> DataFrame:
    """external_id, size (the largest stated), files of every object that the corpus refers to."""
    return ledger.corpus_scan(files).groupBy("external_id").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("files"))


def _with_transfers(planned: DataFrame, transfers: DataFrame) -> DataFrame:
    """planned with tried, the transfers to pending targets, and gone; an object has a row a target, so no group is large."""
    result = F.struct("target", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("stored_bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("down", F.lit(False)).alias("down"))
    flag = lambda c: F.bool_or(F.coalesce(c, F.lit(False))).alias(c) if c in transfers.columns else F.lit(False).alias(c)
    sent = transfers.groupBy("external_id").agg(F.sort_array(F.collect_set(result)).alias("results"), flag("gone"), flag("aborted"))
    found = planned.join(sent, "external_id", "left")
    return found.withColumns({"tried": F.coalesce(F.filter("results", lambda r: F.array_contains("pending", r["target"])), F.array().cast("array<struct<target: string, ok: boolean, bytes: bigint, down: boolean>>")), "gone": F.coalesce("gone", F.lit(False)), "aborted": F.coalesce("aborted", F.lit(False))})


def _judged(found: DataFrame) -> DataFrame:
    """healthy_failed, all_stored, unread (the source gave no transfer to some pending target, or the transfer was aborted) and the statuses to record.

    What was stored is recorded even if the transfer was aborted or told of some targets only; failures of an aborted
    transfer are not.
    """
    unread = (F.size("tried") < F.size("pending")) | F.col("aborted")
    noted = F.filter("tried", lambda r: r["ok"] | (~r["down"] & ~F.col("aborted")))
    statuses = F.transform(noted, lambda r: F.struct(r["target"].alias("target"), F.when(r["ok"], "stored").otherwise("failed").alias("state"), F.when(r["ok"], r["bytes"]).otherwise(0).alias("bytes")))
    return found.withColumns(
        {"unread": unread, "healthy_failed": F.exists("tried", lambda r: ~r["ok"] & ~r["down"]), "all_stored": F.forall("tried", lambda r: r["ok"]), "statuses": F.when(F.col("ok") & ~F.col("gone"), statuses).otherwise(F.array().cast(RECORD))}
    )


def backup_outcomes(files: DataFrame, status: DataFrame, transfers: DataFrame, targets: Sequence[str], down: Sequence[str] = ()) -> DataFrame:
    """How the backup of every object of the corpus ends: external_id, files, pending, held, deduplicated, outcome, statuses to record.

    transfers: external_id, target, ok, stored_bytes, gone (the source says that it has no such object), down (the
    target was found to be down meanwhile), aborted (the object's time was up or the run ends; may be absent); one row a
    hash and target, null flags count as false. What isn't pending is not looked at. Refused hashes, sources that
    couldn't be read, aborted transfers and failures of healthy targets are failed; sources that are gone are skipped; what only lacks targets that are down is deferred; everything else is backed.
    An empty corpus gives no rows.
    """
    planned = ledger.pending_targets(corpus_items(files), status, targets, down)
    found = _judged(_with_transfers(planned, transfers))
    outcome = (
        F.when(~F.col("ok"), "failed").when(F.size("pending") == 0, F.when(F.col("skipped_down"), "deferred").otherwise("backed"))
        .when(F.col("gone"), "skipped").when(F.col("unread") | F.col("healthy_failed"), "failed").when(F.col("all_stored") & ~F.col("skipped_down"), "backed").otherwise("deferred")
    )
    return found.select("external_id", "files", "pending", "held", "deduplicated", outcome.alias("outcome"), "statuses")


def repair_outcomes(gaps: DataFrame, readable: DataFrame, transfers: DataFrame, targets: Sequence[str], down: Sequence[str] = ()) -> DataFrame:
    """How the repair of every gap ends: external_id, source, pending, outcome, statuses to record.

    gaps: external_id, stored_on and sources in the order of trying (``ledger.repair_sources``); readable: external_id,
    target of every copy that decodes to its hash. The first readable source is taken. No holder: skipped, which needs
    the primary store. No readable one, or a target still not written: failed. Else repaired.
    """
    good = readable.groupBy("external_id").agg(F.collect_set("target").alias("good"))
    absent = F.array_except(F.array_except(_names(targets), "stored_on"), _names(down))
    missed = F.size(F.array_intersect(F.array_except(_names(targets), "stored_on"), _names(down))) > 0
    source = F.try_element_at(F.filter("sources", lambda s: F.coalesce(F.array_contains("good", s), F.lit(False))), F.lit(1))
    first = gaps.join(good, "external_id", "left").withColumn("source", source)
    planned = first.select("external_id", "sources", "source", absent.alias("pending"), missed.alias("skipped_down"), F.col("source").isNotNull().alias("ok"))
    found = _judged(_with_transfers(planned, transfers))
    whole = F.col("all_stored") & ~F.col("unread") & ~F.col("skipped_down") & ~F.col("gone")
    outcome = F.when(F.size("sources") == 0, "skipped").when(F.col("source").isNotNull() & whole, "repaired").otherwise("failed")
    return found.select("external_id", "source", "pending", outcome.alias("outcome"), "statuses")


def attempts(outcomes: DataFrame, at: Column) -> DataFrame:
    """What a pass recorded, as attempts for ``ledger.fold_status``."""
    return outcomes.select("external_id", F.inline("statuses")).select("external_id", "target", "state", F.col("bytes").alias("stored_bytes"), at.alias("happened_at"), F.lit(1).cast("long").alias("seq"))


def recorded(outcomes: DataFrame, before: DataFrame, at: Column) -> DataFrame:
    """The ledger's status after a pass: what it recorded, folded over what was there."""
    return ledger.fold_status(attempts(outcomes, at), before)


def record_set(records: DataFrame) -> DataFrame:
    """Rows (external_id, target, state, bytes) of the JSON arrays in column statuses; null and empty arrays have none, absent fields are null, unknown ones are left out."""
    return records.select("external_id", F.inline(F.from_json("statuses", RECORD)))


def run_result(outcomes: DataFrame, kind: str) -> DataFrame:
    """One row: objects, those that make a run of this kind fail, and whether it passes; a restore or drill of nothing doesn't."""
    fails = F.count(F.when(F.col("outcome").isin(*FAILS[kind]), 1))
    n = F.count(F.lit(1))
    return outcomes.agg(n.alias("objects"), fails.alias("failed"), ((fails == 0) & ((n > 0) if kind in NEEDS_WORK else F.lit(True))).alias("passed"))


def target_counts(outcomes: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Of every configured target, in one backup pass: objects stored, failed and already there, and bytes stored."""
    there = F.transform("held", lambda t: F.struct(t.alias("target"), F.lit("there").alias("state"), F.lit(0).cast("long").alias("bytes")))
    rows = outcomes.select(F.inline(F.concat("statuses", there)))
    count = lambda s: F.count(F.when(F.col("state") == s, 1))
    found = rows.groupBy("target").agg(count("stored").alias("stored"), count("failed").alias("failed"), count("there").alias("deduplicated"), F.sum("bytes").alias("bytes"))
    every = ledger.target_rows(outcomes, targets).join(found, "target", "left")
    return every.select("target", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("stored", "failed", "deduplicated", "bytes")))
