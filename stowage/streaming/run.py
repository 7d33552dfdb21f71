"""Running a streaming query over a table until all that is there has been read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

_STORE = "spark.sql.streaming.stateStore.providerClass"


def _slices(table: DataFrame, by: str | None, slices: int) -> list[DataFrame]:
    """The table cut by quantiles of a column, nulls first; every row is in one slice."""
    if by is None or slices < 2:
        return [table]
    value = F.col(by).cast("double")
    edges = sorted({e for e in table.select(value.alias("v")).approxQuantile("v", [k / slices for k in range(1, slices)], 0.01)})
    lows, highs = [None, *edges], [*edges, None]
    least = lambda e: F.coalesce(value < e, F.lit(True))
    return [table.where((F.lit(True) if hi is None else least(hi)) & (F.lit(True) if lo is None else ~least(lo))) for lo, hi in zip(lows, highs, strict=True)]


def finished(table: DataFrame, query: Callable[[DataFrame], DataFrame], mode: str = "append", by: str | None = None, slices: int = 1) -> DataFrame:
    """The rows that ``query`` has given when the stream over ``table`` ends; an empty table gives none.

    The table is staged in the shared folder and read from there. With ``by`` it arrives in ``slices`` parts in the order
    of that column: after each the query ends and goes on from its checkpoint with the next, so that every part is at
    least one micro-batch and reads the state that earlier ones left. What a micro-batch gives is written under its
    number, so one that is run again replaces what it wrote.
    """
    spark = table.sparkSession
    folder = shared_folder(spark)
    table.limit(0).write.parquet(f"{folder}/in")
    stream = query(spark.readStream.schema(table.schema).parquet(f"{folder}/in"))
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    # keyed state with timers needs this store, and a query keeps the one it began with
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in _slices(table, by, slices):
            part.write.mode("append").parquet(f"{folder}/in")
            writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep)
            writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch=*")
