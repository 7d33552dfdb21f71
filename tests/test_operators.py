"""Rules of the operators on small cases, and properties against plain restatements."""

import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowage.functions import metrics, scalars
from stowage.operators import inventory, ledger, queue

FEW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
AT = datetime.datetime(2024, 1, 15)


def status(spark, rows):
    return spark.createDataFrame(rows, "external_id string, target string, state string, stored_bytes long, verified_at timestamp")


def test_gaps_and_coverage_agree(spark):
    objects = spark.createDataFrame([("x",), ("y",), ("z",)], "external_id string")
    rows = status(spark, [("x", "a", "stored", 1, AT), ("x", "b", "stored", 1, AT), ("y", "a", "stored", 1, AT), ("y", "b", "failed", 0, None), ("y", "gone", "stored", 1, AT)])
    gaps = {r.external_id: r.stored_on for r in ledger.replication_gaps(objects, rows, ["a", "b"]).collect()}
    assert gaps == {"y": ["a"], "z": []}
    assert ledger.coverage(objects, rows, ["a", "b"]).first().gaps == len(gaps)
    assert ledger.coverage(objects, rows, []).first().gaps == 0
    assert ledger.replication_gaps(objects, rows, []).count() == 0


def test_rpo_without_rows(spark):
    r = ledger.rpo_lag(status(spark, []), ["a", "b"], F.lit(AT)).first()
    assert (r.never_verified, r.stalest_s, r.ok) == (2, 0.0, False)


def test_pending_skips_targets_that_are_down(spark):
    items = spark.createDataFrame([("0" * 64,), ("bad",)], "external_id string")
    rows = status(spark, [("0" * 64, "a", "stored", 1, AT)])
    found = {r.external_id: r for r in ledger.pending_targets(items, rows, ["a", "b", "c"], ["c"]).collect()}
    assert found["0" * 64].pending == ["b"] and found["0" * 64].skipped_down and found["0" * 64].deduplicated == 1 and found["0" * 64].ok
    assert not found["bad"].ok


@FEW
@given(st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from("ab"), st.booleans(), st.integers(0, 9), st.booleans()), max_size=12))
def test_fold_equals_one_by_one(spark, events):
    status_now, objects = {}, {}
    rows = []
    for seq, (i, t, ok, size, checked) in enumerate(events):
        size = size if ok else 0
        at = AT + datetime.timedelta(seconds=seq)
        rows.append((seq, i, t, "stored" if ok else "failed", size, checked, at))
        if ok:
            status_now[i, t] = ("stored", size, at)
        else:
            status_now.setdefault((i, t), ("failed", size, None))
        if i not in objects or checked:
            objects[i] = (size, objects[i][1] if i in objects else at)
    df = spark.createDataFrame(rows, "seq long, external_id string, target string, state string, stored_bytes long, size_verified boolean, happened_at timestamp")
    assert {(r.external_id, r.target): (r.state, r.stored_bytes, r.verified_at) for r in ledger.fold_status(df).collect()} == status_now
    assert {r.external_id: (r.size, r.first_seen) for r in ledger.fold_objects(df).collect()} == objects
    # in two parts
    half = len(rows) // 2
    empty = "seq long, external_id string, target string, state string, stored_bytes long, size_verified boolean, happened_at timestamp"
    first = ledger.fold_status(spark.createDataFrame(rows[:half], empty))
    again = ledger.fold_status(spark.createDataFrame(rows[half:], empty), first)
    assert {(r.external_id, r.target): (r.state, r.stored_bytes, r.verified_at) for r in again.collect()} == status_now


@FEW
@given(st.lists(st.sampled_from("abcde"), max_size=9), st.sets(st.sampled_from("abcde")))
def test_diff_counts_surplus_lines(spark, lines, held):
    manifest = spark.createDataFrame([("t", x) for x in lines], "target string, external_id string")
    found = inventory.inventory_diff(manifest, status(spark, [(x, "t", "stored", 1, AT) for x in held])).collect()
    extra = sum(max(lines.count(x) - (x in held), 0) for x in set(lines))
    assert [(r.manifest_size, r.extra, r.missing) for r in found] == ([(len(lines), extra, len(held - set(lines)))] if lines or held else [])


@FEW
@given(st.sets(st.integers(0, 12)), st.integers(0, 12), st.integers(1, 15))
def test_sample_goes_round_once(spark, ids, start, n):
    rows = spark.createDataFrame([(f"{i:02d}",) for i in ids], "id string")
    found = [r.id for r in inventory.rotating_sample(rows, "id", f"{start:02d}", n).collect()]
    assert found == [f"{i:02d}" for i in [*sorted(i for i in ids if i > start), *sorted(i for i in ids if i < start)]][:n]


@FEW
@given(st.lists(st.booleans(), max_size=40), st.integers(1, 4))
def test_trips_as_the_last_outcomes_say(spark, oks, threshold):
    rows = spark.createDataFrame([("t", i, ok) for i, ok in enumerate(oks)], "target string, seq long, ok boolean")
    want = next((i for i in range(len(oks)) if oks[max(0, i + 1 - 2 * threshold) : i + 1].count(False) >= threshold), None)
    assert [r.tripped_at for r in inventory.circuit_trips(rows, threshold).collect()] == ([] if want is None else [want])


def outbox(spark, **more):
    row = {"id": 1, "status": "in_progress", "attempts": None, "deliveries": None, "priority": None, "created_date": AT, "claimed_at": None, "visible_at": None} | more
    return spark.createDataFrame([tuple(row.values())], "id long, status string, attempts int, deliveries int, priority int, created_date timestamp, claimed_at timestamp, visible_at timestamp")


def test_backoff_grows_to_a_limit(spark):
    found = [queue.fail(outbox(spark, attempts=n), F.lit(AT), F.lit("x")).first() for n in (None, 0, 3, 8, 9)]
    assert [(r.visible_at - AT).total_seconds() for r in found] == [5, 5, 40, 600, 600]
    assert [r.status for r in found] == ["pending"] * 4 + ["dead_letter"]


def test_lost_claims_change_nothing(spark):
    before = outbox(spark, status="done", attempts=2)
    for after in (queue.mark_done(before), queue.release(before), queue.skip(before), queue.defer(before, F.lit(AT)), queue.fail(before, F.lit(AT), F.lit("x"))):
        r = after.first()
        assert (r.status, r.attempts, r.visible_at) == ("done", 2, None)


def full_outbox(spark, rows):
    names = "id long, status string, attempts int, deliveries int, last_error string, claimed_at timestamp, visible_at timestamp, more string"
    return spark.createDataFrame(rows, names)


HELD = (1, "in_progress", 3, 7, "earlier", AT, AT, "x")
REST = [(n, s, 3, 7, "earlier", AT, AT, "x") for n, s in enumerate(("pending", "done", "skipped", "dead_letter"), 2)]


def test_transitions_change_claimed_rows_only(spark):
    late = AT + datetime.timedelta(days=1)
    rows = full_outbox(spark, [HELD, *REST])
    due = lambda s: late + datetime.timedelta(seconds=s)
    results = lambda *pairs: spark.createDataFrame([(1, o, r) for o, r in pairs], "id long, outcome string, reason string")
    done, released, skipped = (1, "done", 3, 7, "earlier", AT, AT, "x"), (1, "pending", 3, 7, "earlier", None, None, "x"), (1, "skipped", 3, 7, "earlier", None, AT, "x")
    deferred, failed = (1, "pending", 0, 7, "earlier", None, due(180), "x"), (1, "pending", 4, 7, "boom", None, due(40), "x")
    now, half = F.lit(late), F.lit(0.5)
    settled = lambda *pairs: queue.settle(rows, results(*pairs), now, half)
    for after, want in (
        (queue.mark_done(rows), done), (queue.release(rows), released), (queue.skip(rows), skipped), (queue.defer(rows, now, half), deferred), (queue.fail(rows, now, F.lit("boom")), failed),
        (settled(("done", None)), done), (settled(("released", None)), released), (settled(("skipped", None)), skipped), (settled(("deferred", None)), deferred), (settled(("failed", "boom")), failed),
        (settled(("failed", "boom"), ("done", None), ("done", "again")), done), (settled(("failed", "zz"), ("failed", "boom")), failed), (settled((None, "boom"), ("unheard of", "x")), HELD),
    ):
        assert sorted(tuple(r) for r in after.select(*rows.columns).collect()) == [want, *REST]


def test_reaped_rows_keep_an_earlier_error_until_they_are_given_up(spark):
    late = F.lit(AT + datetime.timedelta(days=1))
    rows = full_outbox(spark, [HELD, (9, "in_progress", 3, 49, "earlier", None, None, "x"), (10, "in_progress", None, None, None, AT + datetime.timedelta(days=1), None, "x"), *REST])
    found = sorted(tuple(r) for r in queue.reap_stale(rows, late).select(*rows.columns).collect())
    assert found[0] == (1, "pending", 3, 8, "earlier", None, AT, "x") and found[1:5] == REST
    assert found[5] == (9, "dead_letter", 3, 50, "crash-loop: exceeded max deliveries", None, None, "x")
    assert found[6] == (10, "in_progress", None, None, None, AT + datetime.timedelta(days=1), None, "x")


def test_failures_end_in_dead_letter(spark):
    for attempts, want in ((None, "pending"), (8, "pending"), (9, "dead_letter"), (30, "dead_letter")):
        r = queue.fail(full_outbox(spark, [(1, "in_progress", attempts, None, "earlier", AT, None, "x")]), F.lit(AT), F.lit("boom")).first()
        assert (r.status, r.attempts, r.last_error, r.claimed_at) == (want, (attempts or 0) + 1, "boom", None)


def test_deferred_rows_are_not_backlog(spark):
    now = F.lit(AT)
    later = AT - datetime.timedelta(seconds=1)
    assert queue.backlog(outbox(spark, status="pending", attempts=0, visible_at=later), now).first().pending == 0
    assert queue.backlog(outbox(spark, status="pending", attempts=1, visible_at=later), now).first().pending == 1
    assert queue.backlog(outbox(spark, status="pending"), now).first().pending == 1


def test_stale_is_strict(spark):
    edge = AT - datetime.timedelta(seconds=3600)
    assert not queue.reap_stale(outbox(spark, claimed_at=edge), F.lit(AT)).first().reaped
    r = queue.reap_stale(outbox(spark, claimed_at=edge - datetime.timedelta(microseconds=1), deliveries=49), F.lit(AT)).first()
    assert (r.reaped, r.status, r.deliveries, r.last_error) == (True, "dead_letter", 50, queue.CRASH_LOOP)


def test_outcomes_in_order(spark):
    rows = spark.createDataFrame([(True, True, True, True), (False, True, True, True), (False, False, True, True), (False, False, False, True), (False,) * 4], "ok boolean, s boolean, g boolean, d boolean")
    assert [r[0] for r in rows.select(queue.outcome(F.col("ok"), F.col("s"), F.col("g"), F.col("d"))).collect()] == list(queue.OUTCOMES)


def test_verdicts(spark):
    rows = spark.createDataFrame([("Verified",), ("NoData",), ("Unverifiable",), ("Drift",), ("Unknown",), (None,)], "v string")
    assert [r[0] for r in rows.select(inventory.failed(F.col("v"), F.lit(False))).collect()] == [False, False, True, True, True, True]
    assert [r[0] for r in rows.select(inventory.failed(F.col("v"), F.lit(True))).collect()] == [False, False, False, True, True, True]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.shard_key(F.lit("abc")).alias("short"), scalars.shard_key(F.lit("abcdef")).alias("long"), scalars.codec_of(F.lit("")).alias("none"), scalars.codec_of(F.lit("gzip")).alias("other"),
        scalars.has_zstd_magic(F.unhex(F.lit("28B52FFD00"))).alias("magic"), scalars.env_token(F.lit("my-s3.a")).alias("token"), scalars.manifest_key(F.lit("../x/y.jsonl")).alias("key"),
        scalars.is_manifest_name(F.lit("20240115T000000.000000001Z.jsonl")).alias("name"),
    ).first()
    assert tuple(row) == ("abc", "ab/cd/abcdef", "none", None, True, "MY_S3_A", "_manifest/y.jsonl", True)


def test_textfile_keeps_the_last_success(tmp_path):
    path = str(tmp_path / "m.prom")
    metrics.write_textfile(path, "drill", True, {"checked": 3}, now=10.0)
    metrics.write_textfile(path, "drill", False, {"checked": 0}, now=20.0)
    assert metrics.prior_success(path, "drill") == 10.0
