"""A manifest in blocks with a sparse index of their keys, so that a page or a range is read without the rest.

Lines are ascending by id over all blocks; a block is a file of its own, and the blocks in the order of their numbers are
the manifest. The index has a row a block: first and last id, lines and bytes, and by prefix sums the lines and bytes
before it. It is as small as the manifest has blocks, and is itself read with the range as a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .manifests import manifest_lines, scan_lines
from .shared import written

#: Lines of a block.
LINES = 100_000
INDEX = "block bigint, first string, last string, lines bigint, bytes bigint, line_offset bigint, byte_offset bigint"


def write(objects: DataFrame, folder: str, lines: int = LINES) -> None:
    """Writes the lines of stored objects (as ``manifests.manifest_lines``; ids are unique) in blocks below folder/blocks, then folder/index."""
    ids = F.get_json_object("value", "$.externalID")
    placed = manifest_lines(objects).select(ids.alias("external_id"), "value").withColumn("place", F.monotonically_increasing_id())
    # what one task sorted is cut into blocks of so many lines, so only the last of each has fewer
    placed = written(placed, "manifest-lines").withColumns({"part": F.shiftright("place", 33), "cut": F.floor(F.col("place").bitwiseAND((1 << 33) - 1) / lines)})
    size = F.sum(F.octet_length("value") + 1)
    blocks = placed.groupBy("part", "cut").agg(F.min("external_id").alias("first"), F.max("external_id").alias("last"), F.count(F.lit(1)).alias("lines"), size.alias("bytes"))
    order = Window.orderBy("part", "cut")  # one row a block
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    blocks = written(blocks.select("*", (F.row_number().over(order) - 1).cast("long").alias("block"), before("lines").alias("line_offset"), before("bytes").alias("byte_offset")), "manifest-blocks")
    rows = placed.join(blocks.select("part", "cut", "block"), ["part", "cut"]).repartition("block").sortWithinPartitions("block", "external_id")
    rows.select("block", "value").write.partitionBy("block").mode("overwrite").text(f"{folder}/blocks")
    # the index comes last: without it there is no manifest
    blocks.select(*(f.split()[0] for f in INDEX.split(", "))).orderBy("first").coalesce(1).write.mode("overwrite").parquet(f"{folder}/index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _lines_of(spark: SparkSession, folder: str, blocks: DataFrame, target: str) -> DataFrame:
    """The lines of some blocks as ``scan_lines`` gives them; a manifest's blocks are told by number, so no folder is listed whole."""
    paths = [f"{folder}/blocks/block={r.block}" for r in blocks.select("block").orderBy("block").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], "target string, external_id string, corrupt boolean")
    return scan_lines(spark.read.text(paths).select(F.lit(target).alias("target"), "value"))


def read_range(spark: SparkSession, folder: str, target: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """target, external_id of all ids above ``low`` and up to ``high`` (unset: no bound), from the blocks that overlap."""

    def inside(above: Column, upto: Column) -> Column:
        return (F.lit(True) if low is None else above > low) & (F.lit(True) if high is None else upto <= high)

    blocks = index(spark, folder).where(inside(F.col("last"), F.col("first")))
    return _lines_of(spark, folder, blocks, target).where(~F.col("corrupt") & inside(F.col("external_id"), F.col("external_id"))).select("target", "external_id")


def read_page(spark: SparkSession, folder: str, target: str, after: str, n: int) -> DataFrame:
    """The next n ids after a key, ascending, from no more blocks than hold them."""
    ahead = index(spark, folder).where(F.col("last") > after)
    held = F.coalesce(F.sum("lines").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the first block may hold but one id after the key, so the blocks after it must have n themselves
    first = F.first("lines").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = ahead.withColumns({"held": held, "of_first": first}).where((F.col("held") == 0) | (F.col("held") - F.col("of_first") < n))
    found = _lines_of(spark, folder, near, target).where(~F.col("corrupt") & (F.col("external_id") > after))
    return found.select("target", "external_id").orderBy("external_id").limit(n)
