"""The ledger's status as a stored table: buckets by content hash for look-ups, parts of it rewritten by upserts.

A hash belongs to a part, a partition of the table, and within it to one of a few buckets, so a join or a grouping by hash
needs no shuffle of the ledger, and a batch rewrites only the parts that its hashes fall into. Batches are numbered: one
that has been applied is known by its mark and changes nothing, and one that was cut off is folded again, which gives
the same rows, since a fold over its own result is that result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from .shared import shared_folder

#: Parts of a table and buckets of each part; a part of 1 GB is rewritten in seconds.
PARTS, BUCKETS = 64, 8
_COLUMNS = "external_id string, target string, state string, stored_bytes bigint, verified_at timestamp"


def part_of(external_id: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(external_id), F.lit(parts)).cast("int")


class LedgerTable:
    """A stored status table at ``path``, known in this session by ``name``."""

    def __init__(self, spark: SparkSession, path: str, name: str, parts: int = PARTS, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.name, self.parts = spark, path.rstrip("/"), name, parts
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({_COLUMNS}, part int) USING parquet PARTITIONED BY (part) CLUSTERED BY (external_id) SORTED BY (external_id) INTO {buckets} BUCKETS LOCATION '{self.path}/status'"
        )
        if self._exists("status"):
            spark.sql(f"MSCK REPAIR TABLE {name}")

    def _exists(self, sub: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def status(self) -> DataFrame:
        return self.rows().drop("part")

    def _put(self, rows: DataFrame) -> None:
        """Replaces the parts that rows are in, and no other."""
        mode, key = "dynamic", "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, mode)
        try:
            rows.write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(key, before)

    def upsert(self, attempts: DataFrame, batch: int) -> bool:
        """Folds attempts (as ``ledger.fold_status``) into the parts they touch; False if this batch was applied before."""
        if self._exists(f"applied/batch={batch}"):
            return False
        found = attempts.withColumn("part", part_of(F.col("external_id"), self.parts))
        touched = sorted(r.part for r in found.select("part").distinct().collect())  # at most as many as there are parts
        before = self.rows().where(F.col("part").isin(touched)).drop("part")
        staged = f"{self.path}/staged/batch={batch}"
        # the new parts are complete before any old one goes
        ledger.fold_status(attempts, before).withColumn("part", part_of(F.col("external_id"), self.parts)).write.mode("overwrite").parquet(staged)
        shape = self.rows().schema
        rows = self.spark.read.schema(shape).parquet(staged).select(*shape.names).repartition("part", "external_id")
        self._put(rows)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/applied/batch={batch}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return True

    def of_batch(self, items: DataFrame) -> DataFrame:
        """The status rows of a batch's hashes (external_id). Only their parts are read, and the ledger isn't shuffled: the batch comes to its buckets, small ones by broadcast.

        Spark's runtime filter brings a Bloom filter of the batch's hashes to the ledger's scan where that is large enough
        (spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold).
        """
        hashes = items.where("external_id > ''").select("external_id")
        parts = hashes.select(part_of(F.col("external_id"), self.parts).alias("part")).distinct().collect()  # at most as many as there are
        own = self.rows().where(F.col("part").isin(sorted(r.part for r in parts)))
        return own.join(hashes, "external_id", "left_semi").drop("part")

    def pending(self, items: DataFrame, targets: Sequence[str], down: Sequence[str] = ()) -> DataFrame:
        """``ledger.pending_targets`` of a batch against the stored ledger."""
        return ledger.pending_targets(items, self.of_batch(items), targets, down)


def stored(status: DataFrame, parts: int = PARTS, buckets: int = BUCKETS) -> LedgerTable:
    """A new table in the shared folder that holds ``status``."""
    folder = shared_folder(status.sparkSession, "ledger")
    table = LedgerTable(status.sparkSession, folder, f"ledger_{folder.rsplit('-', 1)[1]}", parts, buckets)
    shape = table.rows().schema
    rows = status.withColumn("part", part_of(F.col("external_id"), parts)).select(*(F.col(f.name).cast(f.dataType) for f in shape))
    table._put(rows.repartition("part", "external_id"))
    return table
