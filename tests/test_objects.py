"""The object store as a data source: two phases, failures, reads by runs of folders, restore."""

import hashlib
import json
import os
import types

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stowage.sources import objects as store


def sha3(data):
    return hashlib.sha3_256(data).hexdigest()


def files(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names)


def content(spark, bodies):
    return spark.createDataFrame([(sha3(b), bytearray(b)) for b in bodies], "external_id string, content binary").repartition(3)


def test_written_to_all_stores_at_once_and_read_back(spark, tmp_path):
    bodies = [f"object {i}".encode() for i in range(40)] + [b"", b"\x28\xb5\x2f\xfd not zstd"]
    (tmp_path / "c").write_text("a file where the root should be")
    places = [store.Place("a", str(tmp_path / "a")), store.Place("b", f"file://{tmp_path}/b", "zstd"), store.Place("c", str(tmp_path / "c"))]
    rows = content(spark, bodies).unionByName(spark.createDataFrame([("../no hash", bytearray(b"x"))], "external_id string, content binary"))
    done = {(r.external_id, r.target): (r.ok, r.stored_bytes) for r in store.stored(rows, places).collect()}
    assert len(done) == 3 * 43
    assert all(done[sha3(b), "a"] == (True, len(b)) and done[sha3(b), "b"][0] and done[sha3(b), "c"] == (False, 0) for b in bodies)
    assert not done["../no hash", "a"][0]
    assert files(tmp_path / "a") == sorted(f"{h[:2]}/{h[2:4]}/{h}" for h in map(sha3, bodies))
    read = store.objects(spark, str(tmp_path / "a"), runs=7)
    assert {r.external_id: bytes(r.payload) for r in read.collect()} == {sha3(b): b for b in bodies}
    one = read.where(F.col("external_id") == sha3(bodies[3]))
    assert [r.external_id for r in one.collect()] == [sha3(bodies[3])] and one.rdd.getNumPartitions() == 1
    assert read.where(F.col("external_id") == "../../etc/passwd").count() == 0
    assert all(r.payload is None for r in store.objects(spark, str(tmp_path / "a"), payload=False).collect())
    with pytest.raises(Exception, match="unknown, not missing"):
        store.objects(spark, str(tmp_path / "nowhere")).collect()


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    for i in range(24):
        (tmp_path / "a" / "00" / "00").mkdir(parents=True, exist_ok=True)
        (tmp_path / "a" / "00" / "00" / f"{i:064x}").write_bytes(bytes([i]) * 500_000)
    reader = store._Reader({"path": str(tmp_path / "a"), "runs": "1"})
    batches = list(reader.read(reader.partitions()[0]))
    assert sum(b.num_rows for b in batches) == 24 and max(b.nbytes for b in batches) <= store.BATCH_BYTES + 10_000
    read = store.objects(spark, str(tmp_path / "a"), runs=1)
    assert {r.external_id: bytes(r.payload) for r in read.collect()} == {f"{i:064x}": bytes([i]) * 500_000 for i in range(24)}
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with store.small_batches(spark):
        rows = read.select(F.pandas_udf(lambda v: pd.Series([sum(map(len, v))] * len(v)), "long")("payload").alias("n")).collect()
    assert max(r.n for r in rows) <= store.BATCH_BYTES + 500_000 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    place = [store.Place("a", str(tmp_path / "a"))]
    broken = F.when(F.col("i") == 17, F.raise_error(F.lit("half-way"))).otherwise(F.encode(F.col("i").cast("string"), "UTF-8"))
    rows = spark.range(20).withColumnRenamed("id", "i").select(F.sha2(F.col("i").cast("string"), 256).alias("external_id"), broken.alias("content"))
    with pytest.raises(Exception, match="half-way"):
        store.staged(rows, place)
    assert files(tmp_path / "a") == []


def test_a_task_that_ends_after_the_abort_leaves_nothing(tmp_path, monkeypatch):
    # Spark aborts a write when a task has failed, while others still run
    place = store.Place("a", str(tmp_path / "a"))
    (tmp_path / "a" / "_staged" / "job").mkdir(parents=True)
    writer = store._Writer({"job": "job", "places": json.dumps([place])})
    monkeypatch.setattr(store.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 7))

    def rows():
        yield Row(external_id=sha3(b"early"), content=b"early")
        assert len(files(tmp_path / "a")) == 1
        writer.abort([])
        yield Row(external_id=sha3(b"late"), content=b"late")

    writer.write(rows())
    writer.write(iter([Row(external_id=sha3(b"later"), content=b"later")]))
    assert files(tmp_path / "a") == []


def test_publishing_again_changes_nothing_and_only_committed_attempts_count(spark, tmp_path):
    place, bodies = [store.Place("a", str(tmp_path / "a"))], [b"one", b"two", b"three"]
    job = store.staged(content(spark, bodies), place)
    stray = tmp_path / "a" / "_staged" / job / "9-999"  # an attempt that was lost before it could report
    stray.mkdir()
    (stray / sha3(b"lost")).write_bytes(b"lost")
    (stray / "index").write_text(f"{sha3(b'lost')} 4\n")
    assert not [f for f in files(tmp_path / "a") if not f.startswith("_staged")]
    first, again = (sorted(map(tuple, store.published(spark, place, job).collect())) for _ in range(2))
    assert first == again == sorted((sha3(b), "a", len(b)) for b in bodies)
    assert [f for f in files(tmp_path / "a") if not f.startswith("_staged")] == sorted(f"{sha3(b)[:2]}/{sha3(b)[2:4]}/{sha3(b)}" for b in bodies)


def test_restore_skips_replaces_and_tells_what_it_could_not(spark, tmp_path):
    good, packed, damaged, absent, there, wrong = (f"{n} content".encode() for n in ("good", "packed", "damaged", "absent", "there", "wrong"))
    ids = lambda *b: [sha3(x) for x in b]
    put = lambda name, rows, codec="none": store.stored(spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "external_id string, content binary"), [store.Place(name, str(tmp_path / name), codec)]).count()
    put("from", [(sha3(good), good), (sha3(damaged), b"something else"), (sha3(there), there), (sha3(wrong), wrong)])
    put("from", [(sha3(packed), packed)], "zstd")
    put("to", [(sha3(there), there), (sha3(wrong), b"corrupt")])
    wanted = spark.createDataFrame([(i,) for i in [*ids(good, packed, damaged, absent, there, wrong), sha3(good), "no hash"]], "external_id string")
    found = {r.external_id: (r.outcome, r.bytes) for r in store.restored(wanted, str(tmp_path / "from"), str(tmp_path / "to")).collect()}
    assert found == {
        sha3(good): ("restored", len(good)), sha3(packed): ("restored", len(packed)), sha3(damaged): ("failed", 0), sha3(absent): ("missing", 0), sha3(there): ("skipped", len(there)),
        sha3(wrong): ("restored", len(wrong)), "no hash": ("failed", 0),
    }
    assert {r.external_id: bytes(r.payload) for r in store.objects(spark, str(tmp_path / "to")).collect()} == {sha3(b): b for b in (good, packed, there, wrong)}
    again = {r.outcome for r in store.restored(wanted.where(F.col("external_id").isin(ids(good, packed))), str(tmp_path / "from"), str(tmp_path / "to")).collect()}
    assert again == {"skipped"}
