"""Streams over staged tables, in one micro-batch and in several, against plain restatements."""

import datetime
import random

from pyspark.sql import functions as F

from stowage.streaming import circuit, consumer, run

AT = datetime.datetime(2024, 1, 15)


def restated_redeliveries(events, ttl_s, most):
    """events (id, seq, event, seconds); what is up at the end is told by the latest event of all. Nothing resets deliveries."""
    found, ended = [], max((e[3] for e in events), default=0)
    for i in {e[0] for e in events}:
        deliveries, claim = 0, None
        for _, seq, event, at in [*sorted((e for e in events if e[0] == i), key=lambda e: e[1]), (i, None, None, ended)]:
            if claim and at - claim[1] > ttl_s:
                deliveries += 1
                found.append((i, claim[0], deliveries, "dead_letter" if deliveries >= most else "pending"))
                claim = None
            if event == "claimed":
                claim = (seq, at)
            elif event == "settled":
                claim = None
    return sorted(found)


def claims(spark, events):
    rows = [(i, seq, event, AT + datetime.timedelta(seconds=at)) for i, seq, event, at in events]
    return spark.createDataFrame(rows, "id long, seq long, event string, at timestamp")


def test_redelivery_in_the_order_of_events(spark):
    rng = random.Random(1)
    events = [(rng.randrange(12), n, rng.choice(["claimed", "claimed", "settled"]), 40 * n) for n in range(150)]
    want = restated_redeliveries(events, 600, 3)
    table = claims(spark, events)
    assert want and {s for *_, s in want} == {"pending", "dead_letter"} and max(d for _, _, d, _ in want) > 3
    assert sorted(map(tuple, run.finished(table.repartition(3), lambda s: consumer.redeliver(s, 600, 3), by="at", slices=5).collect())) == want
    # times out, claimed again, outcome in time, claimed, times out: deliveries go on
    one = [(1, 1, "claimed", 0), (1, 2, "claimed", 700), (1, 3, "settled", 710), (1, 4, "claimed", 720), (2, 5, "settled", 5000)]
    found = run.finished(claims(spark, one).repartition(2), lambda s: consumer.redeliver(s, 600, 3))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, "pending"), (1, 4, 2, "pending")]
    assert run.finished(claims(spark, []), consumer.redeliver).count() == 0


def test_redelivery_of_files_in_any_order(spark):
    rng = random.Random(3)
    events = [(rng.randrange(12), n, rng.choice(["claimed", "claimed", "settled"]), 40 * n) for n in range(150)]
    shuffled = claims(spark, events).withColumn("file", F.col("seq") * 7 % 5)
    # all events are within the lateness; one far later lets the watermark pass them
    ended = claims(spark, [(99, 1000, "settled", 20_000)]).withColumn("file", F.lit(9))
    found = run.finished(shuffled.unionByName(ended), lambda s: consumer.redeliver(s, 600, 3, "14000 seconds"), by="file", slices=5).collect()
    assert sorted(map(tuple, found)) == restated_redeliveries([*events, (99, 1000, "settled", 6000)], 600, 3)


def test_redelivery_keeps_one_state_a_bucket(spark, tmp_path):
    rng = random.Random(5)
    events = [(rng.randrange(400), n, rng.choice(["claimed", "claimed", "settled"]), 4 * n) for n in range(3000)]
    # no id is one id; without a time there is no event
    table = claims(spark, events).unionByName(claims(spark, [(None, 5000, "claimed", 0), (None, 5001, "claimed", 900), (3, 5002, "settled", 0)]).withColumn("at", F.expr("CASE WHEN id IS NULL THEN at END")))
    table.write.parquet(str(tmp_path / "in"))
    stream = consumer.redeliver(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), 600, 3, buckets=8)
    q = stream.writeStream.format("memory").queryName("redelivered").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 9
    finally:
        q.stop()
    want = {*restated_redeliveries(events, 600, 3), (None, 5000, 1, "pending"), (None, 5001, 2, "pending")}
    found = spark.table("redelivered").collect()
    assert set(map(tuple, found)) == want and len(found) == len(want)


def test_retries_until_done_or_given_up(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0, 3, 8]), AT + datetime.timedelta(seconds=rng.randrange(4000))) for i in range(40)] + [(99, 0, AT + datetime.timedelta(seconds=6000))]
    work = lambda i, attempt: (i * 7 + attempt) % 5 == 0
    want, ended = [], max(r[2] for r in rows)
    for i, attempts, at in rows:
        attempts = attempts or 0
        while at is not None and at <= ended:
            ok = work(i, attempts + 1)
            status = "done" if ok else "dead_letter" if attempts + 1 >= 10 else "pending"
            again = at + datetime.timedelta(seconds=min(5 * 2**attempts, 600)) if status == "pending" else None
            attempts += 1
            want.append((i, attempts, at, status, again))
            at = again
    assert {r[3] for r in want} == {"done", "pending", "dead_letter"}
    table = spark.createDataFrame(rows, "id long, attempts int, due timestamp").repartition(3)
    found = run.finished(table.unionByName(table.where("id < 10")), lambda s: consumer.retried(s, work), by="due", slices=5)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # files in any order, within the lateness
    mixed = table.withColumn("file", F.when(F.col("id") == 99, 9).otherwise(F.col("id") % 5))
    found = run.finished(mixed.unionByName(spark.createDataFrame([(98, 9, AT + datetime.timedelta(seconds=11_000), 9)], mixed.schema)), lambda s: consumer.retried(s, work, late="5000 seconds"), by="file", slices=5)
    assert sorted(map(tuple, found.where("id < 98").collect())) == sorted(r for r in want if r[0] < 98)


def test_retries_keep_one_state_a_bucket(spark, tmp_path):
    # as many ids as there are rows, far more than buckets
    rows = spark.range(3000).select("id", F.lit(None).cast("int").alias("attempts"), F.timestamp_seconds(F.lit(1_705_276_800) + F.col("id") % 700).alias("due"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = consumer.retried(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lambda i, attempt: attempt > i % 2, buckets=8)
    q = stream.writeStream.format("memory").queryName("tried").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    finally:
        q.stop()
    ended = 699
    want = {(i, 1, "pending" if i % 2 else "done") for i in range(3000)} | {(i, 2, "done") for i in range(1, 3000, 2) if i % 700 + 5 <= ended}
    assert {(r.id, r.attempt, r.status) for r in spark.table("tried").collect()} == want and spark.table("tried").count() == len(want)


def test_circuits_step_as_one_by_one(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), n, AT + datetime.timedelta(seconds=5 * n), rng.random() < 0.55) for n in range(200)]
    want, own = [], {}
    for target, seq, at, ok in rows:
        c = own.setdefault(target, circuit.Circuit(3, 60.0))
        c.record(ok, at.replace(tzinfo=datetime.timezone.utc).timestamp())
        want.append((target, seq, c.opened_at is not None, c.trips))
    table = spark.createDataFrame(rows, "target string, seq long, at timestamp, ok boolean")
    assert sorted(map(tuple, run.finished(table.repartition(3), lambda s: circuit.circuits(s, 3)).collect())) == sorted(want)
    assert max(t for *_, t in want) > 1


def test_backlog_windows_close_behind_the_watermark(spark):
    rows = [("pending", n % 3, AT + datetime.timedelta(minutes=7 * n)) for n in range(40)] + [("pending", 1, None)]
    table = spark.createDataFrame(rows, "status string, attempts int, created_date timestamp")
    found = run.finished(table, lambda s: consumer.backlog_by_window(s).selectExpr("window.start as starts", "rows", "attempts")).collect()
    ended = max(r[2] for r in rows if r[2]) - datetime.timedelta(hours=1)
    assert found and all(r.starts + datetime.timedelta(minutes=15) <= ended for r in found)
    for r in found:
        own = [a for _, a, at in rows if at and r.starts <= at < r.starts + datetime.timedelta(minutes=15)]
        assert (r.rows, r.attempts) == (len(own), sum(own))
