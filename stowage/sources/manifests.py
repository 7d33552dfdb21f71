"""Manifests: a target's inventory as JSON lines, one file a snapshot."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import MANIFEST_DIR, MANIFEST_NAME, MANIFEST_POINTER, is_manifest_name, manifest_line

#: A longer line counts as corrupt.
LINE_BYTES = 1 << 20


def manifest_name(when: datetime, nanoseconds: int = 0) -> str:
    """<UTC time>.jsonl, with nanoseconds, which a Spark timestamp doesn't hold."""
    utc = when.astimezone(timezone.utc)
    return f"{utc:%Y%m%dT%H%M%S}.{utc.microsecond * 1000 + nanoseconds:09d}Z.jsonl"


def latest(names: list[str], pointer: str | None = None) -> str | None:
    """The newest name that is one; the pointer counts only if nothing newer is listed."""
    valid = [n for n in [*names, *([pointer] if pointer else [])] if re.fullmatch(MANIFEST_NAME[1:-1], n)]
    return max(valid, default=None)


#: A line is read as one JSON object and nothing else: no quotes or numbers but JSON's own.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_JSON_SPACE = " \t\r\n"


def scan_lines(lines: DataFrame) -> DataFrame:
    """target, external_id, corrupt of every line (target, value) that says something; a null line says nothing.

    Empty lines, null and lines without an id say nothing; keys match in any case, and the last that isn't null counts.
    Corrupt is what isn't one object, has an id that is no string, or is longer than LINE_BYTES.
    """
    # in an array, so that what follows the object shows, with an end of its own; a map keeps the order of keys, a variant their values' types
    parsed = F.from_json(F.concat(F.lit("["), "value", F.lit(",{}]")), "array<map<string,variant>>", _STRICT)
    fields = F.map_entries(F.try_element_at("parsed", F.lit(1)))
    said = F.filter(fields, lambda e: (F.lower(e["key"]) == "externalid") & ~F.coalesce(F.is_variant_null(e["value"]), F.lit(True)))
    silent = F.coalesce(F.btrim("value", F.lit(_JSON_SPACE)) == "null", F.lit(True)) | (F.col("value") == "")
    whole = (F.size("parsed") == 2) & F.try_element_at("parsed", F.lit(1)).isNotNull() & (F.octet_length("value") <= LINE_BYTES)
    # a long line isn't parsed at all
    short = lines.select("target", "value", F.when(F.octet_length("value") <= LINE_BYTES, parsed).alias("parsed")).where(~silent)
    found = short.select("target", F.coalesce(whole, F.lit(False)).alias("whole"), said.alias("said"))
    good = F.col("whole") & F.forall("said", lambda e: F.schema_of_variant(e["value"]) == "STRING")
    last = F.try_variant_get(F.try_element_at("said", F.lit(-1))["value"], "$", "string")
    read = found.select("target", F.when(good & (last != ""), last).alias("external_id"), (~good).alias("corrupt"))
    return read.where("external_id is not null or corrupt")


def read_manifest(spark: SparkSession, path: str, target: str) -> DataFrame:
    """``scan_lines`` of a target's manifest."""
    return scan_lines(spark.read.text(path).select(F.lit(target).alias("target"), "value"))


def newest(names: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """target, name of every target's newest manifest, from listed names and pointers alike (target, name).

    Only valid names count, and of those only what is not in ``gone`` (target, name); a target without any has no row.
    """
    valid = names.where(is_manifest_name(F.col("name")))
    if gone is not None:
        valid = valid.join(gone.select("target", "name"), ["target", "name"], "left_anti")
    return valid.groupBy("target").agg(F.max("name").alias("name"))


def manifest_lines(objects: DataFrame) -> DataFrame:
    """The JSON lines of stored objects (external_id, size, created_by, source_created_date), ascending by id."""
    have = lambda c, t: F.col(c) if c in objects.columns else F.lit(None).cast(t)
    line = manifest_line(F.col("external_id"), F.col("size"), have("created_by", "string"), have("source_created_date", "timestamp"))
    return objects.select("external_id", line.alias("value")).orderBy("external_id").select("value")


def write_manifest(objects: DataFrame, folder: str) -> None:
    """Writes the lines as range-sorted part files: in name order they are one ascending manifest, and no task writes all of it."""
    manifest_lines(objects).write.mode("overwrite").text(folder)


def export(objects: DataFrame, root: str, when: datetime, nanoseconds: int = 0) -> str:
    """Writes a target's manifest below its root under the name of ``when``, then the pointer to it; returns the name.

    A pointer that can't be written is no fault: the newest listed name wins over it.
    """
    spark, name = objects.sparkSession, manifest_name(when, nanoseconds)
    write_manifest(objects, f"{root}/{MANIFEST_DIR}/{name}")
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST_POINTER}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(name.encode()))
        finally:
            out.close()
    except Py4JJavaError:
        pass
    return name
