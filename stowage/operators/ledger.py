"""Questions to the ledger: what is stored where, what is missing, how old, and how new results are folded in.

objects has one row per content hash (external_id, size, ...), status one per hash and target (external_id, target,
state, stored_bytes, verified_at). Targets are a short list given by the caller; the tables may be of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import age_s, is_content_hash


def on_targets(targets: Sequence[str], prefix: str = "") -> Column:
    """Stored on a configured target: the one predicate that gaps and coverage share."""
    return F.coalesce((F.col(f"{prefix}state") == "stored") & F.col(f"{prefix}target").isin(list(targets)), F.lit(False))


def target_rows(status: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row per configured target."""
    return status.sparkSession.createDataFrame([(t,) for t in targets], "target string")


def corpus_scan(files: DataFrame) -> DataFrame:
    """Files that should be backed up: not temporary (unknown counts as not), with a hash; unknown sizes are 0."""
    wanted = ~F.coalesce("temporary_location", F.lit(False)) & F.col("external_id").isNotNull() & (F.col("external_id") != "")
    return files.where(wanted).select("id", "external_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def file_by_id(files: DataFrame, file_id: int) -> DataFrame:
    return files.where(F.col("id") == file_id).select("id", "external_id", "updated_date").limit(1)


def stored_objects(objects: DataFrame, status: DataFrame, target: str) -> DataFrame:
    """Objects stored on one target, with what the ledger knows of them."""
    held = status.where((F.col("target") == target) & (F.col("state") == "stored")).select("external_id", "stored_bytes", "verified_at")
    return objects.join(held, "external_id")


def stored_ids(status: DataFrame, target: str) -> DataFrame:
    return status.where((F.col("target") == target) & (F.col("state") == "stored")).select("external_id")


def stored_count_by_target(status: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Every configured target, with 0 where nothing is stored."""
    counts = status.where(on_targets(targets)).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return target_rows(status, targets).join(counts, "target", "left").select("target", F.coalesce("n", F.lit(0)).cast("long").alias("stored"))


def replication_gaps(objects: DataFrame, status: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Objects on fewer than all targets, with those that hold them, sorted; no targets, no rows."""
    held = status.where(on_targets(targets)).groupBy("external_id").agg(F.sort_array(F.collect_set("target")).alias("stored_on"))
    found = objects.select("external_id").join(held, "external_id", "left")
    found = found.withColumn("stored_on", F.coalesce("stored_on", F.array().cast("array<string>")))
    return found.where(F.size("stored_on") < len(targets))


def coverage(objects: DataFrame, status: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row: objects, those on all targets, and the rest; without targets there are no gaps."""
    held = status.where(on_targets(targets)).select("external_id", "target").distinct().groupBy("external_id").agg(F.count(F.lit(1)).alias("n"))
    found = objects.select("external_id").join(held, "external_id", "left")
    covered = F.count(F.when(F.col("n") == len(targets), 1))
    gaps = F.count(F.lit(1)) - covered if targets else F.lit(0).cast("long")
    return found.agg(F.count(F.lit(1)).alias("objects"), covered.alias("covered"), gaps.alias("gaps"))


def rpo_lag(status: DataFrame, targets: Sequence[str], as_of: Column) -> DataFrame:
    """One row: targets never verified, the age in seconds of the stalest target's last verification (0 if none), and whether any was."""
    last = status.where(F.col("state") == "stored").groupBy("target").agg(F.max("verified_at").alias("last"))
    found = target_rows(status, targets).join(last, "target", "left")
    never = F.count(F.when(F.col("last").isNull(), 1))
    return found.agg(never.alias("never_verified"), F.coalesce(F.max(age_s(as_of, F.col("last"))), F.lit(0.0)).alias("stalest_s"), (never < len(targets)).alias("ok"))


def stored_targets(status: DataFrame) -> DataFrame:
    """Of every hash the targets that hold it: the dedup lookup for a whole batch."""
    return status.where("state = 'stored'").groupBy("external_id").agg(F.sort_array(F.collect_set("target")).alias("stored_on"))


def pending_targets(items: DataFrame, status: DataFrame, targets: Sequence[str], down: Sequence[str] = ()) -> DataFrame:
    """Of every item the targets to write, whether some were skipped for being down, and which and how many already hold it.

    ok is false for items that are refused before any transfer: a hash that isn't one, or no targets at all.
    """
    every, held = F.array(*map(F.lit, targets)).cast("array<string>"), F.coalesce("stored_on", F.array().cast("array<string>"))
    absent = F.array_except(every, held)
    is_down = F.array(*map(F.lit, down)).cast("array<string>")
    return items.join(stored_targets(status), "external_id", "left").select(
        *items.columns,
        F.array_except(absent, is_down).alias("pending"),
        (F.size(F.array_intersect(absent, is_down)) > 0).alias("skipped_down"),
        F.array_intersect(every, held).alias("held"),
        F.size(F.array_intersect(every, held)).alias("deduplicated"),
        (is_content_hash(F.col("external_id")) & F.lit(bool(targets))).alias("ok"),
    )


def classify_fanout(results: DataFrame, aborted: Column | None = None) -> DataFrame:
    """Of every object: whether all targets stored it, whether a healthy one failed, and what to record.

    results: external_id, target, ok, down. A target that is down doesn't count as failed and isn't recorded;
    failures of an aborted transfer aren't recorded.
    """
    aborted = F.lit(False) if aborted is None else aborted
    record = F.col("ok") | (~F.col("down") & ~aborted)
    noted = F.when(record, F.struct("target", F.when(F.col("ok"), "stored").otherwise("failed").alias("state")))
    return results.groupBy("external_id").agg(
        F.bool_and("ok").alias("all_stored"), F.bool_or(~F.col("ok") & ~F.col("down")).alias("healthy_failed"), F.sort_array(F.collect_list(noted)).alias("statuses")
    )


def fold_status(attempts: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Status rows after all attempts in the order of seq; ``before`` is the ledger's status.

    A stored status never fails again. Bytes and time are those of the last stored attempt; without one, the bytes
    of the first and no time. Every aggregate combines before the shuffle, so a hash that is retried for ever is one
    row a task.
    """
    rows = attempts.select("external_id", "target", "state", "stored_bytes", F.col("happened_at").alias("verified_at"), "seq")
    if before is not None:
        rows = rows.unionByName(before.select("external_id", "target", "state", "stored_bytes", "verified_at", F.lit(None).cast("long").alias("seq")))
    seq = F.coalesce("seq", F.lit(-(1 << 62)))
    stored = F.col("state") == "stored"
    last = F.max(F.when(stored, F.struct(seq.alias("seq"), "stored_bytes", "verified_at"))).alias("last")
    first = F.min(F.struct(seq.alias("seq"), "stored_bytes")).alias("first")
    return rows.groupBy("external_id", "target").agg(last, first).select(
        "external_id", "target", F.when(F.col("last").isNotNull(), "stored").otherwise("failed").alias("state"),
        F.when(F.col("last").isNotNull(), F.col("last.stored_bytes")).otherwise(F.col("first.stored_bytes")).alias("stored_bytes"), F.col("last.verified_at").alias("verified_at"),
    )


def fold_objects(attempts: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Object rows after all attempts: the last verified size, else the first; first seen at the first attempt."""
    rows = attempts.select("external_id", F.col("stored_bytes").alias("size"), F.col("size_verified").alias("verified"), F.col("happened_at").alias("first_seen"), "seq")
    if before is not None:
        rows = rows.unionByName(before.select("external_id", "size", F.lit(False).alias("verified"), "first_seen", F.lit(None).cast("long").alias("seq")))
    seq = F.coalesce("seq", F.lit(-(1 << 62)))
    last, first = F.max(F.when(F.col("verified"), F.struct(seq.alias("seq"), "size"))).alias("last"), F.min(F.struct(seq.alias("seq"), "size", "first_seen")).alias("first")
    return rows.groupBy("external_id").agg(last, first).select("external_id", F.coalesce("last.size", "first.size").alias("size"), F.col("first.first_seen").alias("first_seen"))


def status_faults(objects: DataFrame, status: DataFrame) -> DataFrame:
    """Rows that break the ledger's constraints, with the reason: unknown state, unknown object, a key twice."""
    state = status.where(~F.coalesce(F.col("state").isin("stored", "failed"), F.lit(False))).select("external_id", "target", F.lit("state").alias("fault"))
    unknown = status.join(objects.select("external_id"), "external_id", "left_anti").select("external_id", "target", F.lit("object").alias("fault"))
    twice = status.groupBy("external_id", "target").count().where("count > 1").select("external_id", "target", F.lit("key").alias("fault"))
    return state.unionByName(unknown).unionByName(twice)


def restore_guard(files: DataFrame, at: Column) -> DataFrame:
    """Whether a file's current version is the one of ``at``: refused where it has no date or changed later."""
    verdict = F.when(F.col("updated_date").isNull(), "no_date").when(F.col("updated_date") > at, "changed_later").otherwise("ok")
    return files.select("id", "external_id", verdict.alias("verdict"))


def restore_requests(requests: DataFrame, files: DataFrame, at: Column) -> DataFrame:
    """The guard for asked-for ids (column id): not_found where there is no file, or one without a content hash; else as ``restore_guard``."""
    guarded = restore_guard(files.where(F.coalesce(F.col("external_id"), F.lit("")) != ""), at)
    return requests.select("id").distinct().join(guarded, "id", "left").select("id", "external_id", F.coalesce("verdict", F.lit("not_found")).alias("verdict"))


def repair_sources(gaps: DataFrame, down: Sequence[str] = ()) -> DataFrame:
    """Holders of every gap in the order of trying: healthy ones first, each part by name."""
    is_down = F.array(*map(F.lit, down)).cast("array<string>")
    ranked = F.sort_array(F.transform("stored_on", lambda t: F.struct(F.array_contains(is_down, t).alias("down"), t.alias("target"))))
    return gaps.select("external_id", "stored_on", F.transform(ranked, lambda s: s["target"]).alias("sources"))
