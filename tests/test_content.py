"""Objects between stores, manifests, settings and streams."""

import datetime
import hashlib
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from stowage.operators import content, inventory, ledger
from stowage.operators.content import Store
from stowage.sources import manifests, settings, tables
from stowage.streaming import circuit, consumer


def sha3(data):
    return hashlib.sha3_256(data).hexdigest()


@pytest.fixture
def stores(tmp_path):
    return [Store("a", str(tmp_path / "a")), Store("b", str(tmp_path / "b"), codec="zstd"), Store("c", str(tmp_path / "c"), worm=True)]


def put(store, data, stored=None):
    path = store.path(sha3(data))
    content.commit(path, iter([data if stored is None else stored]))
    return sha3(data)


def test_backup_verify_restore_drill(spark, stores, tmp_path):
    objects = [b"", b"x", os.urandom(3 << 20), b"\x28\xb5\x2f\xfd not zstd"]
    source = tmp_path / "source"
    source.mkdir()
    for o in objects:
        (source / sha3(o)).write_bytes(o)
    bad = sha3(b"other")
    (source / bad).write_bytes(b"wrong bytes")
    items = spark.createDataFrame([(h, str(source / h), ["a", "b", "c"]) for h in [*map(sha3, objects), bad]], "external_id string, path string, pending array<string>")
    done = content.backup(items, stores).collect()
    assert {r.external_id for r in done if r.state == "failed"} == {bad} and len(done) == 15
    assert not [f for s in stores for _, _, files in os.walk(s.root) for f in files if f.endswith(".tmp") or f == bad]
    for store in stores:
        found = content.verify(items, store).collect()
        assert sorted(r.outcome for r in found) == ["missing"] + ["verified"] * 4
    good = items.where(F.col("external_id") != bad)
    to = str(tmp_path / "out")
    assert {r.outcome for r in content.restore(good, stores[1], to).collect()} == {"restored"}
    with open(os.path.join(to, sha3(b"x")), "wb") as f:
        f.write(b"damaged")
    counts = {r.outcome: r.n for r in content.tally(content.restore(good, stores[1], to)).collect()}
    assert counts == {"skipped": 3, "restored": 1}
    assert {r.outcome for r in content.drill(good, stores[0], str(tmp_path / "drill")).collect()} == {"passed"}
    assert os.listdir(tmp_path / "drill") == []


def test_decode_lets_the_hash_decide(stores):
    inner = zstandard.compress(b"inner")
    digest = put(stores[0], inner)  # an object that is itself zstd
    seen = []
    assert content.decoded(stores[0].path(digest), digest, lambda b: seen.append(b"".join(b))) == "none" and seen[-1] == inner
    packed = put(stores[0], b"inner", inner)
    assert content.decoded(stores[0].path(packed), packed, lambda b: seen.append(b"".join(b))) == "zstd"
    broken = put(stores[0], b"zzz", zstandard.compress(b"zzz")[:-2])
    with pytest.raises(content.Corrupt):
        content.decoded(stores[0].path(broken), broken, lambda b: list(b))
    with pytest.raises(content.Corrupt):
        list(content.verified(iter([b"12345"]), sha3(b"12345"), most=4))


def test_repair_takes_the_first_source_that_decodes(spark, stores):
    data = b"payload" * 100
    digest = put(stores[0], data, b"damaged")
    put(stores[2], data)
    gaps = spark.createDataFrame([(digest, ["a", "c"])], "external_id string, stored_on array<string>")
    done = content.repair(ledger.repair_sources(gaps), stores).collect()
    assert [(r.target, r.state) for r in done] == [("b", "stored")]
    assert content.decoded(stores[1].path(digest), digest, lambda b: list(b)) == "zstd"
    lost = content.repair(ledger.repair_sources(spark.createDataFrame([(sha3(b"no"), ["a"])], "external_id string, stored_on array<string>")), stores).collect()
    assert {r.state for r in lost} == {"failed"} and len(lost) == 2


def test_one_store_fails_alone(stores, tmp_path):
    (tmp_path / "a").write_text("a file where the root should be")
    done = content.fan_out(sha3(b"x"), iter([b"x"]), stores)
    assert [s for _, s, _, _ in done] == ["failed", "stored", "stored"]


def test_manifests(spark, tmp_path):
    objects = spark.createDataFrame([("bb", 2), ("aa", 1)], "external_id string, size long")
    manifests.write_manifest(objects, str(tmp_path / "m"))
    found = manifests.read_manifest(spark, str(tmp_path / "m"), "t")
    assert sorted(r.external_id for r in found.collect()) == ["aa", "bb"] and found.where("corrupt").count() == 0
    a, b = (manifests.manifest_name(datetime.datetime(2024, 1, 15, tzinfo=datetime.timezone.utc), n) for n in (1, 2))
    assert manifests.latest([a, "junk.jsonl"], b) == b and manifests.latest([a, b], a) == b and manifests.latest(["../" + a]) is None
    held = spark.createDataFrame([("aa", "t", "stored")], "external_id string, target string, state string")
    judged = inventory.inventory_diff(found.select("target", "external_id"), held).select(inventory.inventory_verdict().alias("v"))
    assert judged.first().v == "Drift"


def test_settings():
    found = settings.load({"targets": [{"name": "a", "root": "/a"}]}, {"STOWAGE_TARGETS": "b-1", "STOWAGE_TARGET_B_1_ROOT": "/b", "STOWAGE_TARGET_B_1_WORM": "true", "STOWAGE_CONCURRENCY": "3"})
    assert [t.name for t in found.targets] == ["a", "b-1"] and found.targets[1].worm and found.concurrency == 3 and settings.faults(found) == []
    assert settings.read_target(found.targets).name == "a" and settings.read_target(found.targets, "b-1").name == "b-1"
    with pytest.raises(LookupError):
        settings.read_target(found.targets[1:])
    bad = settings.load({"concurrency": 0, "stale_s": 1, "targets": [{"name": "x-y", "type": "s3", "tls": False, "sse": "k", "audit_key": "k"}, {"name": "x_y", "codec": "gzip"}]})
    assert len(settings.faults(bad)) >= 8


def test_run_success_rules():
    assert content.sweep_passes("backfill", {"stored": 2, "skipped": 1}) and not content.sweep_passes("backfill", {"failed": 1})
    assert not content.sweep_passes("reconcile", {"skipped": 1}) and not content.sweep_passes("restore", {}) and not content.sweep_passes("drill", {}) and content.sweep_passes("drill", {"passed": 1})


def test_circuit_half_open():
    c = circuit.Circuit(2, 60)
    c.record(False, 0)
    c.record(False, 1)
    assert c.down(2) and c.trips == 1
    c.record(False, 50)  # a failure while open starts the cooldown again
    assert c.down(109) and not c.down(110) and c.trips == 1
    c.record(True, 51)  # a success closes it, whatever the cooldown says
    assert c.opened_at is None and c.window == []
    c.record(False, 52)
    assert not c.down(53)
    flaky = circuit.Circuit(5, 60)
    for i in range(10):
        flaky.record(i == 4 or i > 5, i)
    assert flaky.trips == 1


def test_circuit_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [("t", i, at + datetime.timedelta(seconds=i), i > 3) for i in range(6)] + [("u", i, at, True) for i in range(3)]
    schema = "target string, seq long, at timestamp, ok boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = circuit.circuits(stream, threshold=3).writeStream.format("memory").queryName("circuits").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    found = {(r.target, r.seq): (r.open, r.trips) for r in spark.table("circuits").collect()}
    assert found["t", 1] == (False, 0) and found["t", 2] == (True, 1) and found["t", 3] == (True, 1) and found["t", 5] == (False, 1) and found["u", 2] == (False, 0)


def test_drain_and_replay(spark, tmp_path):
    schema = "id long, status string, external_id string"
    for part in range(2):
        spark.createDataFrame([(part * 2 + i, "pending" if i else "done", f"h{part}{i}") for i in range(2)], schema).write.parquet(str(tmp_path / f"in/p={part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/p=*"))

    def work(rows):
        return rows.select("external_id", F.lit("a").alias("target"), F.lit("stored").alias("state"), F.lit(1).cast("long").alias("stored_bytes"), F.lit(True).alias("size_verified"), F.lit(datetime.datetime(2024, 1, 1)).alias("happened_at"), F.col("id").alias("seq"))

    for _ in range(2):
        consumer.drain(stream, work, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    attempts = spark.read.parquet(str(tmp_path / "out/attempts"))
    assert sorted(r.external_id for r in consumer.statuses(attempts).collect()) == ["h01", "h11"] and attempts.count() == 2


def test_redelivery_timer(spark, tmp_path):
    # timers go by the events' own time: the last event moves it on
    schema = "id long, seq long, event string, at timestamp"
    at = lambda s: datetime.datetime(2024, 1, 15) + datetime.timedelta(seconds=s)
    rows = [(1, 1, "claimed", at(0)), (2, 2, "claimed", at(0)), (2, 3, "settled", at(1)), (3, 4, "claimed", at(100))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = consumer.redeliver(stream, ttl_s=60).writeStream.format("memory").queryName("again").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    import time

    end = time.time() + 60
    while time.time() < end and spark.table("again").count() == 0:
        time.sleep(1)
    q.stop()
    assert [(r.id, r.deliveries, r.status) for r in spark.table("again").collect()] == [(1, 1, "pending")]


def test_sources_over_http(spark, stores, tmp_path):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            code = {"/x": 200, "/gone": 410}.get(self.path, 503)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"x" if code == 200 else b"")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    items = spark.createDataFrame([(sha3(b"x"), f"{base}/x", ["a"])], "external_id string, path string, pending array<string>")
    assert [(r.state, r.stored_bytes) for r in content.backup(items, stores).collect()] == [("stored", 1)]
    with pytest.raises(content.SourceGone):
        list(content.blocks_from(f"{base}/gone"))
    with pytest.raises(OSError) as e:
        list(content.blocks_from(f"{base}/later"))
    assert not isinstance(e.value, content.SourceGone)
    server.shutdown()


def test_tables_probe_and_listing(spark, stores, tmp_path):
    folder = str(tmp_path / "ledger")
    assert set(tables.migrate(spark, folder)) == set(tables.SCHEMAS) and tables.migrate(spark, folder) == []
    for name in tables.SCHEMAS:
        df = spark.read.parquet(f"{folder}/{name}")
        assert tables.drift(df, name) == [] and len(tables.drift(df.drop(df.columns[0]), name)) == 1
    with pytest.raises(OSError):
        tables.stored_listing(spark, stores[0])
    tables.preflight(stores[0])
    digest = put(stores[0], b"x")
    listed = tables.stored_listing(spark, stores[0])
    assert [tuple(r) for r in listed.collect()] == [("a", digest)]
    status = spark.createDataFrame([(digest, "a", "stored"), ("f" * 64, "a", "stored")], "external_id string, target string, state string")
    assert {r.external_id: r.present for r in inventory.sweep(status, listed).collect()} == {digest: True, "f" * 64: False}


def test_circuit_rule_for_aborted_transfers():
    assert [content.circuit_counts(*x) for x in ((False, False, False), (True, True, True), (True, True, False), (True, False, True))] == [True, True, False, False]
