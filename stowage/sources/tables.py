"""Schemas of the ledger, the corpus and the queue; probes that fail early, and the first, empty tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.content import Store

SCHEMAS = {
    "objects": "external_id string, size bigint, first_seen timestamp, created_by string, source_created_date timestamp",
    "status": "external_id string, target string, state string, stored_bytes bigint, verified_at timestamp",
    "files": "id bigint, external_id string, created_by string, created_date timestamp, updated_date timestamp, size bigint, temporary_location boolean",
    "queue": "id bigint, file_id bigint, external_id string, priority int, status string, attempts int, deliveries int, last_error string, created_by string, created_date timestamp, size bigint, claimed_at timestamp, visible_at timestamp",
}


def drift(df: DataFrame, table: str) -> list[str]:
    """How a table's columns differ from what the operators need; more columns are no fault."""
    wanted = [c.strip().split(" ") for c in SCHEMAS[table].split(",")]
    have = dict(df.dtypes)
    return [f"{table}: no column {c}" if c not in have else f"{table}: {c} is {have[c]}, not {kind}" for c, kind in wanted if have.get(c) != kind]


def migrate(spark: SparkSession, folder: str) -> list[str]:
    """Creates the tables that don't exist yet; running it again changes nothing. Returns those it made."""
    made = []
    for name, schema in SCHEMAS.items():
        path = f"{folder}/{name}"
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
            spark.createDataFrame([], schema).write.parquet(path)
            made.append(name)
    return made


def preflight(store: Store) -> None:
    """Writes, reads and removes a sentinel; raises OSError where the store can't be written."""
    folder = os.path.join(store.root, "_preflight")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, uuid.uuid4().hex)
    with open(path, "wb") as f:
        f.write(b"ok")
    with open(path, "rb") as f:
        if f.read() != b"ok":
            raise OSError(f"{store.name}: the sentinel doesn't read back")
    os.unlink(path)


def root_present(store: Store) -> bool:
    """Whether the store's root is there at all; without it nothing that is absent may count as missing."""
    return os.path.isdir(store.root)


def stored_listing(spark: SparkSession, store: Store) -> DataFrame:
    """target, external_id of all objects of a store, from one distributed listing; fails where the root is gone."""
    if not root_present(store):
        raise OSError(f"{store.name}: root {store.root} is not there")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store.root).select("path")
    return files.selectExpr(f"'{store.name}' AS target", "regexp_extract(path, '([0-9a-f]{64})$', 1) AS external_id").where("external_id <> ''")
