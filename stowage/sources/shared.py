"""The folder that all executors share, from spark.checkpoint.dir, and tables written there to cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch where its values are whole contents; a larger value is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession, label: str = "stream") -> str:
    """A new path in the folder of spark.checkpoint.dir; a temporary one where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(found or _own_folder()).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-stowage-")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands Python no batches beyond ``BATCH_BYTES``, so that its memory doesn't grow with a partition."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new path of the shared folder and read again, so that executors that are lost lose none of it."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
