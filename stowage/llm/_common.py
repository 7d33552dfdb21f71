"""Shared folders, written cuts of the lineage, size-checked broadcasts and joins on hot keys."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow keys (at most a few dozen bytes each) up to which a counted side is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 500_000


#: Keys with more than this many rows, or this part of all rows if that is more, are hot: MOST_HOT of them at most.
HOT_ROWS, MOST_HOT = 20_000, 100_000
#: Bytes of one Arrow batch while an operator writes what it needs again; what the caller runs has the session's own.
BATCH_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share, from spark.checkpoint.dir.

    Where it is unset a temporary folder takes its place if the master is local, as in tests; elsewhere it is an error,
    since executors would write where others can't read.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir()


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-stowage-")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Runs what is inside with these settings, and puts back what was there."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, and lost executors lose none of it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def written_path(table: DataFrame) -> str:
    """The folder of a table that ``written`` returned."""
    return _PATHS[table]


def dropped(*tables: DataFrame | None) -> None:
    """Removes the files of tables that ``written`` returned, once nothing will read them any more."""
    for df in tables:
        if df is not None and (path := _PATHS.pop(df, None)):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are few; otherwise Spark shuffles it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sized(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """``df`` of about so many narrow ``rows`` in as many tasks as they need, where shuffles are cut for larger tables."""
    return df.coalesce(max(1, -(-rows // per_task)))


def keyed(rows: DataFrame, side: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with ``side``, which has one row a key and in its column ``n`` how many of the ``total`` rows have that key.

    Hot keys are broadcast, so their rows stay where they are: at most MOST_HOT keys can have more than a MOST_HOT-th
    of all rows. The other keys are left to Spark's own join. Keys must not be null.
    """
    limit = max(HOT_ROWS, total // MOST_HOT)
    if total <= limit:
        return rows.join(side, keys)
    hot = side.where(F.col(n) > limit)
    cool = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(side.where(F.col(n) <= limit), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cool)


def row_key(doc_id: Column, text: Column) -> Column:
    """A row's id and the SHA-256 of its text (null as empty), as one string."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (null as empty) and the columns ``more``; whatever else ``docs`` holds is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def quoted(name: str) -> str:
    """A column's name as it is, dots included."""
    return f"`{name.replace('`', '``')}`"


def local_path(uri: str) -> str | None:
    """The local path of a file: URI or a plain path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else os.path.abspath(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
