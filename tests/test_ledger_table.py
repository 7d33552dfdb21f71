"""The stored ledger: look-ups without a shuffle of it, upserts that touch what they must."""

import datetime
import hashlib
import re

from pyspark.sql import functions as F

from stowage.operators import ledger
from stowage.sources import ledger_table

AT = datetime.datetime(2024, 1, 15)
STATUS = "external_id string, target string, state string, stored_bytes long, verified_at timestamp"
ATTEMPT = "seq long, external_id string, target string, state string, stored_bytes long, happened_at timestamp"


def sha(n):
    return hashlib.sha256(str(n).encode()).hexdigest()


def status(spark, n):
    return spark.createDataFrame([(sha(i), t, "stored" if (i + k) % 5 else "failed", i, AT if (i + k) % 5 else None) for i in range(n) for k, t in enumerate("abc") if (i + k) % 3], STATUS)


def files(table):
    return {f"{r.path}@{r.modificationTime}" for r in table.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{table.path}/status").select("path", "modificationTime").collect()}


def rows(df):
    return sorted(map(tuple, df.select("external_id", "target", "state", "stored_bytes", "verified_at").collect()), key=str)


def test_upsert_touches_only_its_parts_and_once(spark):
    before = status(spark, 300)
    table = ledger_table.stored(before, 16, 2)
    assert rows(table.status()) == rows(before)
    attempts = spark.createDataFrame([(1, sha(3), "a", "failed", 0, AT), (2, sha(3), "c", "stored", 77, AT), (3, sha(999), "b", "failed", 5, AT), (4, sha(999), "b", "stored", 6, AT)], ATTEMPT)
    old = files(table)
    assert table.upsert(attempts, 0)
    now, want = files(table), rows(ledger.fold_status(attempts, before))
    touched = {r.part for r in attempts.select(ledger_table.part_of(F.col("external_id"), 16).alias("part")).distinct().collect()}
    part = lambda name: int(re.search(r"part=(\d+)", name)[1])
    assert {part(f) for f in old ^ now} <= touched and len(touched) == 2
    assert rows(table.status()) == want
    # the batch again: nothing changes; cut off before its mark: the same rows
    assert not table.upsert(attempts, 0) and files(table) == now
    assert table.upsert(attempts, 1) and rows(table.status()) == want
    # another session finds the table by its path
    again = ledger_table.LedgerTable(spark, table.path, table.name + "_again", 16, 2)
    assert rows(again.status()) == want


def test_lookup_brings_the_batch_to_the_ledger(spark):
    before = status(spark, 400)
    table = ledger_table.stored(before, 8, 4)
    items = spark.createDataFrame([(sha(i), i) for i in range(0, 400, 7)] + [(sha(5000), 1), ("no hash", 2), ("", 3)], "external_id string, size long")
    want = ledger.pending_targets(items, before, "abc", "b")
    found = table.pending(items, "abc", "b")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = table.of_batch(items)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # down from the join, the side of the ledger has no exchange before its scan
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and table.name in x)
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    assert join < scan and not any("Exchange" in x for x in lines[join:scan]), plan
    assert "might_contain" in plan, plan
