"""Scalar rules of the ledger, the queue and the object stores, as columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and constants that results depend on.
HASH_PATTERN = "^[0-9a-f]{64}$"
MANIFEST_DIR = "_manifest"
MANIFEST_POINTER = "_manifest/LATEST"
MANIFEST_NAME = r"^\d{8}T\d{6}\.\d{9}Z\.jsonl$"
ZSTD_MAGIC = "28B52FFD"
BACKOFF_BASE_S, BACKOFF_MOST_S, BACKOFF_MOST_POWER = 5, 600, 20
DEFER_S = 120


def _sha3_256_hex(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield values.map(lambda v: None if v is None else hashlib.sha3_256(v).hexdigest())


def sha3_256_hex(c: Column) -> Column:
    """Lowercase hex of the SHA3-256 of binary values, null for null; Spark has no built-in for it."""
    return F.pandas_udf(_sha3_256_hex, "string")(c)


def is_content_hash(c: Column) -> Column:
    """Exactly 64 lowercase hex digits; null counts as not."""
    return F.coalesce(c.rlike(HASH_PATTERN), F.lit(False))


def shard_key(c: Column) -> Column:
    """aa/bb/hash; a hash of fewer than four characters stands alone."""
    return F.when(F.length(c) < 4, c).otherwise(F.concat_ws("/", F.substring(c, 1, 2), F.substring(c, 3, 2), c))


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def manifest_key(c: Column) -> Column:
    return F.concat_ws("/", F.lit(MANIFEST_DIR), base_name(c))


def is_manifest_name(c: Column) -> Column:
    return F.coalesce(c.rlike(MANIFEST_NAME), F.lit(False))


def codec_of(c: Column) -> Column:
    """none for '' and none, zstd for zstd, null for anything else."""
    return F.when(F.coalesce(c, F.lit("")).isin("", "none"), "none").when(c == "zstd", "zstd")


def has_zstd_magic(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.unhex(F.lit(ZSTD_MAGIC)), F.lit(False))


def backoff_s(attempts: Column) -> Column:
    """Seconds until the next try, from the attempts before this one."""
    power = F.least(F.coalesce(attempts, F.lit(0)), F.lit(BACKOFF_MOST_POWER))
    return F.least(F.lit(BACKOFF_BASE_S) * F.pow(F.lit(2.0), power), F.lit(float(BACKOFF_MOST_S)))


def defer_s(jitter: Column) -> Column:
    """Two to four minutes; ``jitter`` runs from 0 to 1."""
    return F.lit(float(DEFER_S)) * (F.lit(1.0) + jitter)


def age_s(now: Column, then: Column) -> Column:
    """Seconds, as double."""
    return (F.unix_micros(now) - F.unix_micros(then)).cast("double") / F.lit(1e6)


def later(when: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(when) + (seconds * F.lit(1e6)).cast("long"))


def env_token(c: Column) -> Column:
    """A name as part of an environment variable."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "_")


def manifest_line(external_id: Column, size: Column, created_by: Column, source_created: Column) -> Column:
    """A manifest's JSON line; optional fields go where they are null."""
    return F.to_json(F.struct(external_id.alias("externalID"), size.alias("size"), created_by.alias("createdBy"), F.date_format(source_created, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("sourceCreatedDate")))
