"""Mixing sources to target weights by hash-random keys and exact budgets.

Every row gets a hash-random key. Each source is range-split over its keys into buckets of about equal size, the
buckets' word counts become prefix sums per source, over runs of buckets and then inside each run, and a running sum
inside a bucket gives every row its place in the source's random order. A source's budget is so many whole epochs and
a cut in that order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import keyed, quoted, written

#: Rows of one source that one bucket holds, about; buckets, not sources, are the unit of sorting.
ROWS_PER_BUCKET = 4_000
#: A source's target and a row's repeats stop at so many times its size.
MOST_EPOCHS = 3
KEY_BITS = 52
#: Buckets of one source that are summed up in one task; their sums are summed up in another.
BUCKETS_PER_RUN = 2_000
#: Rows alike in source, id and size that one task writes.
ALIKE = 10_000
#: Sources up to which one task orders them; beyond, ranges of them are ordered apart and joined by prefix sums.
SOURCES_AT_ONCE = 100_000


def n_words(text: Column) -> Column:
    """Number of runs of bytes other than 0x20 and 0x09 to 0x0D; null as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: int) -> Column:
    """52 bits of the MD5 of seed and id, so that reruns and other engines agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, KEY_BITS // 4), 16, 10).cast("long")


def _earlier(rows: DataFrame, order: list[Column], sums: dict[str, Column], at_once: int) -> DataFrame:
    """``rows`` with, for each of ``sums``, its sum over the rows before in this order, as a long.

    Up to ``at_once`` rows are one window. More are dealt into ranges of the order and written, so that a range stays
    what it is; the ranges' totals, one row a range, are summed up before the rows of each.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    n = rows.count()
    if n <= at_once:
        return rows.withColumns({k: running(c, Window.partitionBy(F.lit(0)).orderBy(*order)) for k, c in sums.items()})
    part = f"part_{uuid.uuid4().hex}"
    dealt = written(rows.repartitionByRange(-(-n // at_once), *order).withColumn(part, F.spark_partition_id()), "mix-ranges")
    ranges = dealt.groupBy(part).agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    ranges = ranges.select(part, *(running(F.col(k), Window.partitionBy(F.lit(0)).orderBy(part)).alias(f"{k}_{part}") for k in sums))
    within = Window.partitionBy(part).orderBy(*order)
    placed = dealt.withColumns({k: running(c, within) for k, c in sums.items()}).join(ranges, part)
    return placed.select(*rows.columns, *((F.col(k) + F.col(f"{k}_{part}")).alias(k) for k in sums))


def source_targets(sources: DataFrame, at_once: int = SOURCES_AT_ONCE) -> DataFrame:
    """Targets of sources (source, source_size, and further columns, which stay): weights 1, 2, 3, repeating, by code point, null last.

    Together they are all sizes. A target above three times its source's size stops there and the excess is dealt
    again by weight; with sources in order of 3 * size / weight, those that stop come first, so one pass over
    running sums finds the share a unit of weight gets. An empty table gives no rows; without words all targets are 0.
    """
    named = [F.col("source").isNull(), F.col("source")]
    cap = F.lit(MOST_EPOCHS) * F.col("source_size")
    ranked = _earlier(sources, named, {"rank": F.lit(1)}, at_once)
    ranked = ranked.withColumn("weight", (F.col("rank") % 3 + 1).cast("long")).withColumn("room", cap.cast("double") / F.col("weight"))
    ranked = written(ranked, "mix-ranked")
    totals = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    placed = _earlier(ranked, [F.col("room"), *named], {"cap_before": cap, "weight_before": F.col("weight")}, at_once)
    share = (F.lit(totals["size"] or 0) - F.col("cap_before")).cast("double") / (F.lit(totals["weight"] or 0) - F.col("weight_before")).cast("double")
    # the first that doesn't stop, in the very order of the sums: rooms may tie
    first = F.min(F.struct("room", F.col("source").isNull().alias("nameless"), "source", "share")).alias("level")
    level = placed.withColumn("share", share).where("share <= room").agg(first).first()["level"]
    target = cap.cast("double") if level is None else F.least(cap.cast("double"), F.lit(level["share"]) * F.col("weight"))
    return ranked.select(*sources.columns, target.alias("target"))


def mix(docs: DataFrame, seed: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies.

    copies is how often the mix takes the row, 0 to 3; taken is copies * size. The row at which a source's budget
    ends is taken if at least half of it is inside, so a source misses its target by half of one row at most.
    Null texts have size 0, a null source is a source of its own, rows of size 0 are taken with the whole epochs and
    where their place is inside the budget. Rows of one id sort by size; rows alike in both are interchangeable. An
    empty table gives no rows; a table without words takes nothing (targets 0). Other columns are not looked at.
    """
    placed = _placed(docs, seed, rows_per_bucket)
    taken = lambda rows: rows.withColumn("copies", _copies(F.col("k"))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
    few = placed.where(F.col("m") <= ALIKE).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("k"))
    many = placed.where(F.col("m") > ALIKE).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(ALIKE).cast("long"))).alias("k0"))
    # rows alike beyond a number are dealt anew, so that no task writes them all
    many = many.repartition("at", "k0").select("*", F.explode(F.sequence("k0", F.least(F.col("k0") + ALIKE, F.col("m")) - 1)).alias("k"))
    return taken(few).unionByName(taken(many))


def mixed(docs: DataFrame, seed: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The rows of ``docs``, all their columns, each as often as the mix takes it.

    The cut of a source is one place in its order, so a row needs its source's cut only and texts don't move. Rows
    alike in id and size at the very cut are taken together.
    """
    placed = _placed(docs, seed, rows_per_bucket)
    cut = F.max(F.when(_copies(F.lit(0)) > F.col("epochs"), F.struct("at", "doc_id", "size"))).alias("cut")
    cuts = written(placed.groupBy(*_NAMED).agg(F.max("epochs").alias("epochs"), cut, F.sum("m").alias("n")), "mix-cuts")
    total = cuts.agg(F.sum("n")).first()[0] or 0
    # the row itself is one column, so that no name of its columns can clash
    own = F.struct(random_key(F.col("d.doc_id").cast("long"), seed).alias("at"), F.col("d.doc_id").cast("long").alias("doc_id"), n_words(F.col("d.text")).alias("size"))
    rows = docs.select(F.struct(*(docs[quoted(c)] for c in docs.columns)).alias("d")).select("d", *_named(F.col("d.source")))
    joined = keyed(rows, cuts, _NAMED, "n", total)
    copies = F.col("epochs") + F.coalesce(own <= F.col("cut"), F.lit(False)).cast("long")
    return joined.select("d", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("copy")).select("d.*")


_NAMED = ["nameless", "name"]


def _named(source: Column) -> list[Column]:
    """A source as two columns without nulls."""
    return [source.isNull().alias("nameless"), F.coalesce(source.cast("string"), F.lit("")).alias("name")]


def _copies(k: Column) -> Column:
    """Copies of the k-th of the rows alike of ``_placed``."""
    middle = (F.col("start") + k * F.col("size")).cast("double") + F.col("size") / F.lit(2.0)
    more = (F.col("epochs") < MOST_EPOCHS) & (F.col("source_size") > 0) & (middle <= F.col("rest"))
    return F.col("epochs") + more.cast("long")


def _placed(docs: DataFrame, seed: int, rows_per_bucket: int) -> DataFrame:
    """Rows alike in source, id and size once, with their number m and the words of the source before the first of them (start).

    Of one id, or of no id, there are as many as there are sizes, whatever share of the rows it has.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_named(F.col("source")), n_words(F.col("text")).alias("size"))
    rows = written(rows.groupBy(*_NAMED, "doc_id", "size").agg(F.count(F.lit(1)).alias("m")).withColumn("at", random_key(F.col("doc_id"), seed)), "mix-rows")
    words = F.sum(F.col("size") * F.col("m"))
    sources = rows.groupBy(*_NAMED).agg(words.alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = written(sources.withColumn("source", F.when(~F.col("nameless"), F.col("name"))), "mix-sources")
    total = sources.agg(F.sum("n")).first()[0] or 0
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_bucket)).cast("long").alias("buckets")
    plan = written(source_targets(sources).select(*_NAMED, "source_size", "target", "n", buckets), "mix-plan")
    # by a double, since the product of key and buckets may be more than a long holds; it keeps the order of keys
    bucket = F.least(F.floor(F.col("at").cast("double") * F.col("buckets").cast("double") / F.lit(float(1 << KEY_BITS))).cast("long"), F.col("buckets") - 1)
    placed = keyed(rows, plan, _NAMED, "n", total).withColumn("bucket", bucket)
    where = [*_NAMED, "bucket"]
    sums = placed.groupBy(*where).agg(words.alias("bucket_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    sums = written(sums.withColumn("run", F.floor(F.col("bucket") / BUCKETS_PER_RUN)), "mix-buckets")
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.groupBy(*_NAMED, "run").agg(F.sum("bucket_size").alias("run_size"))
    runs = runs.select(*_NAMED, "run", F.coalesce(F.sum("run_size").over(earlier(*_NAMED, "run")), F.lit(0)).alias("run_start"))
    sums = sums.withColumn("inside", F.coalesce(F.sum("bucket_size").over(earlier(*_NAMED, "run", "bucket")), F.lit(0))).join(runs, [*_NAMED, "run"])
    sums = sums.select(*where, "source_size", "target", (F.col("run_start") + F.col("inside")).alias("bucket_start"))
    within = Window.partitionBy(*where).orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    found = placed.select("doc_id", "size", "m", "at", *where).withColumn("before", F.coalesce(words.over(within), F.lit(0))).join(sums, where)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    found = found.withColumns({"epochs": epochs, "start": F.col("bucket_start") + F.col("before")})
    return found.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))


#: The same rows from plain windows over whole sources.
ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS place
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM sources),
roomy AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS room FROM ranked),
shares AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS share
  FROM roomy
  WINDOW b AS (ORDER BY room, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT share FROM shares WHERE share <= room ORDER BY room, source IS NULL, source LIMIT 1),
plan AS (
  SELECT source, source_size,
         least(CAST(3 * source_size AS DOUBLE), coalesce((SELECT share FROM level) * weight, CAST(3 * source_size AS DOUBLE))) AS target
  FROM ranked),
placed AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
         CAST(coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           + size / 2.0::DOUBLE AS middle
  FROM rows_ r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source),
taken AS (
  SELECT *, epochs + CASE WHEN epochs < 3 AND source_size > 0 AND middle <= target - epochs * source_size THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM taken
"""
