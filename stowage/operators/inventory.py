"""A target's own inventory against the ledger, existence sweeps, samples and verdicts.

All targets are judged in one plan. A verdict's name is a string; a row without a rule is Unknown and fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The verdicts.
VERIFIED, DRIFT, CORRUPT, FAULT, UNVERIFIABLE, NO_DATA, UNKNOWN = "Verified", "Drift", "Corrupt", "Fault", "Unverifiable", "NoData", "Unknown"


def inventory_diff(manifest: DataFrame, status: DataFrame) -> DataFrame:
    """Of every target: manifest lines, lines the ledger doesn't have (surplus copies of one id count each), ledger rows that no line has.

    A hot id can't arise: lines are counted by id before they meet the ledger's one row.
    """
    lines = manifest.where(F.col("external_id").isNotNull() & (F.col("external_id") != "")).groupBy("target", "external_id").agg(F.count(F.lit(1)).alias("c"))
    held = status.where("state = 'stored'").select("target", "external_id", F.lit(1).cast("long").alias("held"))
    both = lines.join(held, ["target", "external_id"], "full").select("target", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("held", F.lit(0)).alias("held"))
    return both.groupBy("target").agg(
        F.sum("c").alias("manifest_size"), F.sum(F.greatest(F.col("c") - F.col("held"), F.lit(0))).alias("extra"), F.sum(F.when(F.col("c") == 0, F.col("held")).otherwise(0)).alias("missing")
    )


def missing_ids(manifest: DataFrame, status: DataFrame) -> DataFrame:
    """Stored in the ledger, not in the manifest."""
    return status.where("state = 'stored'").select("target", "external_id").join(manifest.select("target", "external_id"), ["target", "external_id"], "left_anti")


def orphan_ids(manifest: DataFrame, status: DataFrame) -> DataFrame:
    """In the manifest, not stored in the ledger."""
    held = status.where("state = 'stored'").select("target", "external_id")
    return manifest.select("target", "external_id").distinct().join(held, ["target", "external_id"], "left_anti")


def existence_tally(listing: DataFrame) -> DataFrame:
    """Of every target, from target, external_id, present (null: couldn't be asked) and denied (null: no): rows checked, missing, errored and read-denied.

    all_denied: every probe was refused by a definite denial, so the credential may only write.
    """
    errored = F.col("present").isNull()
    denied = F.count(F.when(errored & F.coalesce("denied", F.lit(False)), 1)) if "denied" in listing.columns else F.lit(0).cast("long")
    tally = listing.groupBy("target").agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(~F.col("present"), 1)).alias("missing"), F.count(F.when(errored, 1)).alias("errored"), denied.alias("read_denied"))
    return tally.withColumn("all_denied", (F.col("checked") > 0) & (F.col("read_denied") == F.col("checked")))


def ascending(lines: DataFrame, block: int = 10_000) -> DataFrame:
    """Of every target, from target, line (a number), external_id: whether its ids ascend strictly in byte order, so that a merge can read them.

    Lines are cut into blocks; inside each, neighbours are compared, and then the ends of blocks that follow each
    other, so that a long manifest is many tasks. Lines without an id are left out.
    """
    rows = lines.where("external_id is not null and external_id <> ''").select("target", "line", "external_id", F.floor(F.col("line") / block).alias("block"))
    before = F.lag("external_id").over(Window.partitionBy("target", "block").orderBy("line"))
    inside = rows.withColumn("good", F.coalesce(before < F.col("external_id"), F.lit(True)))
    ends = inside.groupBy("target", "block").agg(F.bool_and("good").alias("good"), F.min_by("external_id", "line").alias("first"), F.max_by("external_id", "line").alias("last"))
    last = F.lag("last").over(Window.partitionBy("target").orderBy("block"))
    joined = ends.withColumn("good", F.col("good") & F.coalesce(last < F.col("first"), F.lit(True)))
    return joined.groupBy("target").agg(F.bool_and("good").alias("ascending"))


def sweep(status: DataFrame, stored: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """target, external_id, present of every stored row, against one listing of the stores (target, external_id).

    ``roots`` names the targets (target) whose root was seen to be there: what the others don't list is not missing but
    unknown (null), for an unmounted store lists nothing.
    """
    seen = stored.select("target", "external_id", F.lit(True).alias("present")).distinct()
    held = status.where("state = 'stored'").select("target", "external_id")
    found = held.join(seen, ["target", "external_id"], "left")
    if roots is None:
        return found.withColumn("present", F.coalesce("present", F.lit(False)))
    # one row a target
    found = found.join(roots.select("target", F.lit(True).alias("there")).distinct(), "target", "left")
    return found.select("target", "external_id", F.coalesce("present", F.when(F.col("there"), False)).alias("present"))


def existence_verdict() -> Column:
    """Over a tally: what is missing is drift; what couldn't be asked leaves the target unverifiable."""
    return F.when(F.col("missing") > 0, DRIFT).when(F.col("errored") > 0, UNVERIFIABLE).otherwise(VERIFIED)


def inventory_verdict(corrupt: Column | None = None) -> Column:
    """Over a diff: orphans are drift, also where a line after them is corrupt; what is only missing is not a fault here."""
    corrupt = F.lit(False) if corrupt is None else corrupt
    return F.when(F.col("extra") > 0, DRIFT).when(corrupt, CORRUPT).otherwise(VERIFIED)


def immutability_verdict(capable: Column, readable: Column, lock: Column, versioning: Column) -> Column:
    return F.when(~capable, NO_DATA).when(~readable, UNVERIFIABLE).when(lock & versioning, VERIFIED).when(lock.isNotNull() & versioning.isNotNull(), DRIFT).otherwise(UNKNOWN)


def failed(verdict: Column, exempt: Column) -> Column:
    """Unverifiable fails unless the target is exempt; an unknown name or null fails."""
    return ~F.coalesce(verdict.isin(VERIFIED, NO_DATA) | ((verdict == UNVERIFIABLE) & exempt), F.lit(False))


def report(verdicts: DataFrame) -> DataFrame:
    """One row over target, verdict, failed: targets, those that failed, by name, and whether the whole run passes (nothing judged doesn't)."""
    names = F.array_join(F.sort_array(F.collect_list(F.when(F.col("failed"), F.concat_ws(": ", "target", "verdict")))), "; ")
    bad = F.count(F.when(F.col("failed"), 1))
    return verdicts.agg(F.count(F.lit(1)).alias("targets"), bad.alias("failed"), names.alias("failures"), ((bad == 0) & (F.count(F.lit(1)) > 0)).alias("passed"))


def exempt(worm: Column, readable: Column) -> Column:
    """A write-once target that lets nobody read can't be blamed for that."""
    return worm & ~readable


def gauges(verdict: Column) -> tuple[Column, Column]:
    """Whether a target is known to be fine (1, 0, null where nothing is known), and whether the probe worked; one that found no data did."""
    fine = F.when(verdict == VERIFIED, 1).when(verdict.isin(DRIFT, CORRUPT), 0)
    return fine, F.when(verdict.isin(VERIFIED, DRIFT, CORRUPT, NO_DATA), 1).otherwise(0)


def keyset_page(rows: DataFrame, key: str, after: str, n: int) -> DataFrame:
    """The next n rows by key, in byte order."""
    return rows.where(F.col(key) > after).orderBy(key).limit(n)


def rotating_sample(rows: DataFrame, key: str, start: str, n: int) -> DataFrame:
    """n rows after ``start`` in a circle; the row at the start itself is never taken."""
    return rows.where(F.col(key) != start).orderBy(F.col(key) < start, key).limit(n)


def circuit_trips(outcomes: DataFrame, threshold: int) -> DataFrame:
    """Of every target the first outcome (target, seq, ok) at which so many of its last 2 * threshold failed.

    Frames need a target's outcomes in one order. They are cut into runs of seq; a run carries the end of the one
    before, so that a target with most of the outcomes is many tasks.
    """
    span, back = 10_000, 2 * threshold
    # seq is dense within a target here: row numbers by run and the number of rows before the run
    runs = outcomes.withColumn("run", F.floor(F.col("seq") / span))
    within = Window.partitionBy("target", "run").orderBy("seq")
    numbered = runs.withColumn("i", F.row_number().over(within))
    sizes = runs.groupBy("target", "run").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("target").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("target", "run", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    placed = numbered.join(sizes, ["target", "run"]).select("target", "seq", "ok", (F.col("before") + F.col("i") - 1).alias("at"))
    placed = placed.withColumn("block", F.floor(F.col("at") / span))
    tail = placed.where(F.col("at") % span >= span - back).withColumn("block", F.col("block") + 1).withColumn("carried", F.lit(True))
    every = placed.withColumn("carried", F.lit(False)).unionByName(tail)
    frame = Window.partitionBy("target", "block").orderBy("at").rowsBetween(-(back - 1), 0)
    tripped = every.withColumn("fails", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(frame)).where(~F.col("carried") & (F.col("fails") >= threshold))
    return tripped.groupBy("target").agg(F.min("seq").alias("tripped_at"))
