"""Exact deduplication as a stateful stream over content digests.

A stream of (digest, identifier, locator) rows is folded, in several micro-batches, into keyed RocksDB state that never
expires. Each key retains its digest, the largest identifier and that row's locator, the key of its staged row, and
the number of rows; a later batch finds there what earlier ones left. The staged row of that key is the one that
stays. Every row of a digest with two rows or more is a hit, and its whole text is then compared with the text that
lies at the locator; texts that share a digest but not their bytes are grouped again by digest and text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, dropped, keyed, row_key, scratch, settings, small, text_of, written, written_path

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Rows of one group that are compared with one copy of the text that stays.
ROWS_PER_SALT = 500
#: Copies of one text at most; beyond, more rows are compared with each.
MOST_SALTS = 20_000
#: Bytes of staged rows that one micro-batch of a small table takes. Micro-batches grow with the root of what is staged,
#: and so does their number: each opens the state of all partitions once more.
BATCH_BYTES = 1 << 20


def batch_size(staged: int) -> int:
    """Bytes that one micro-batch takes of so many that are staged."""
    return max(BATCH_BYTES, math.isqrt(staged * BATCH_BYTES))


def _bytes_below(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def fold_stream(stream: DataFrame) -> DataFrame:
    """A stream of digest, doc_id, row_id as one row of state per digest, for output mode update."""
    return stream.groupBy("digest").agg(F.max(F.struct("doc_id", "row_id")).alias("stays"), F.count(F.lit(1)).alias("group_size"))


def _run_stream(stream: DataFrame, label: str) -> DataFrame:
    """The state after everything that is available; each micro-batch's updates are written under its number, so a replay repeats nothing."""
    spark = stream.sparkSession
    out, checkpoint = scratch(spark, f"{label}-updates"), scratch(spark, f"{label}-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    state = fold_stream(stream)
    with settings(spark, STATE_CONF):
        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
    updates = spark.read.schema("digest binary, stays struct<doc_id: bigint, row_id: bigint>, group_size bigint")
    try:
        found = updates.parquet(f"{out}/batch=*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], state.schema)
    return found.groupBy("digest").agg(F.max("stays").alias("stays"), F.max("group_size").alias("group_size"))


def _mismatched(staged: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Digests under which a text differs from the text at the locator; hot groups are dealt over salted copies of it."""
    salts = F.least(F.ceil(F.col("group_size") / ROWS_PER_SALT), F.lit(MOST_SALTS)).cast("int").alias("salts")
    multi = written(groups.where("group_size > 1").select("digest", "group_size", F.col("stays.row_id").alias("locator"), salts), "dedup-hits")
    texts, n = staged.select("digest", "row_id", "text"), multi.count()
    hits = texts.join(F.broadcast(multi), "digest") if n <= BROADCAST_ROWS else keyed(texts, multi, ["digest"], "group_size", total)
    stays = hits.where("row_id = locator").select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = hits.where("row_id <> locator").select("digest", "text", F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int").alias("salt"))
    return rows.join(stays, ["digest", "salt"]).where("text <> kept_text").select("digest").distinct()


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256_of, batch_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest doc_id
    stays, nulls counting as smallest; of rows repeated whole, exactly one. An empty table gives no rows. Columns
    of ``docs`` other than doc_id and text are not looked at. ``digest`` maps text to binary; any function gives
    the same rows, since the bytes decide. ``batch_bytes`` bounds what a micro-batch reads, in whole files; unset,
    it follows from how much is staged.
    """
    spark = docs.sparkSession
    # the id of a row is fixed by writing it, with its text; the stream reads a narrow copy
    text = F.col("text")
    staged = written(text_of(docs).select("doc_id", F.monotonically_increasing_id().alias("row_id"), digest(text).alias("digest"), sha256_of(text).alias("sha"), "text"), "dedup-staged")
    rows = written(staged.drop("text"), "dedup-rows")
    path = written_path(rows)
    stream = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", batch_bytes or batch_size(_bytes_below(spark, path))).parquet(path)
    groups = written(_run_stream(stream, "dedup"), "dedup-groups")
    total = rows.count()
    clashes = written(_mismatched(staged, groups, total), "dedup-clashes")
    n_clashes = clashes.count()
    found = keyed(rows, groups, ["digest"], "group_size", total)
    if n_clashes:
        found = found.join(small(clashes, n_clashes), "digest", "left_anti")
    else:
        dropped(staged)
    found = found.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("stays.row_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return found.unionByName(_regrouped(staged, clashes, n_clashes)) if n_clashes else found


def _regrouped(staged: DataFrame, clashes: DataFrame, n_clashes: int) -> DataFrame:
    """The rows under clashing digests, grouped by the whole text."""
    rows = written(staged.join(small(clashes, n_clashes), "digest", "left_semi").select("doc_id", "row_id", "text"), "dedup-regrouped")
    groups = rows.groupBy("text").agg(F.max(F.struct("doc_id", "row_id")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "text").select(
        "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("stays.row_id")).alias("kept"), F.sha2("text", 256).alias("text_sha256")
    )


def distinct_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated whole, one.

    Texts don't move: what goes is a table of ids and digests, broadcast if it is small.
    """
    judged = exact_dedup(docs)
    key, digits = f"dedup_{uuid.uuid4().hex}", F.col("text_sha256")
    keys = judged.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), digits))
    gone = written(keys.where("not (doc_id <=> keep_id)").select(F.col("key").alias(key)).distinct(), "dedup-gone")
    again = written(keys.where("doc_id <=> keep_id and group_size > 1").groupBy(F.col("key").alias(key)).count().where("count > 1").select(key), "dedup-again")
    n_again = again.count()
    rows = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(small(gone, gone.count()), key, "left_anti")
    if n_again:
        once = rows.join(small(again, n_again), key, "left_semi").dropDuplicates([key])
        rows = rows.join(small(again, n_again), key, "left_anti").unionByName(once)
    return rows.drop(key)


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
