"""Registered queries and the SQL they are checked against.

Every query runs an operator over ledger, corpus and queue views that Spark derives from the given tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, scalars
from ..operators import circuits, inventory, ledger, passes, queue, sampler
from .fixtures import AS_OF, TARGETS, oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_NOW = f"timestamp '{AS_OF}'"
_T = "('a'), ('b'), ('c')"
SAMPLE_START = "8000000000000000000000000000000000000000000000000000000000000000"
DOWN = ("b",)


def as_of():
    return F.expr(_NOW)


def query(sql: str | None, *views: str):
    """Registers a function of the views and its SQL over them."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(view(spark, sf_dir, v) for v in views))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if sql in ORACLE_SQL.values() else oracle(sql, *views)
        return f

    return keep


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, for comparison."""
    return df.withColumns({c: F.concat_ws(",", c) for c in columns})


@query(
    """SELECT o.external_id, coalesce(string_agg(s.target, ',' ORDER BY s.target), '') AS stored_on
       FROM led_object o LEFT JOIN led_status s ON o.external_id = s.external_id AND s.state = 'stored'
       GROUP BY o.external_id HAVING count(s.target) < 3""",
    "led_object", "led_status",
)
def replication_gaps(objects, status):
    return _joined(ledger.replication_gaps(objects, status, TARGETS), "stored_on")


@query(
    """SELECT count(*) AS objects, count(*) FILTER (n = 3) AS covered, count(*) FILTER (n < 3) AS gaps
       FROM (SELECT o.external_id, (SELECT count(*) FROM led_status s WHERE s.external_id = o.external_id AND s.state = 'stored') AS n FROM led_object o)""",
    "led_object", "led_status",
)
def coverage_gaps(objects, status):
    return ledger.coverage(objects, status, TARGETS)


@query(
    f"""SELECT count(*) FILTER (mv IS NULL) AS never_verified, coalesce(max(epoch_us({_NOW}) - epoch_us(mv)) / 1e6, 0.0)::DOUBLE AS stalest_s, count(*) FILTER (mv IS NULL) < 4 AS ok
        FROM (SELECT t.target, (SELECT max(verified_at) FROM led_status s WHERE s.target = t.target AND state = 'stored') AS mv FROM (VALUES {_T}, ('d')) t(target))""",
    "led_status",
)
def rpo_lag(status):
    return ledger.rpo_lag(status, (*TARGETS, "d"), as_of())


@query(
    f"SELECT t.target, count(s.external_id) AS stored FROM (VALUES {_T}, ('d')) t(target) LEFT JOIN led_status s ON s.target = t.target AND s.state = 'stored' GROUP BY t.target",
    "led_status",
)
def stored_count_by_target(status):
    return ledger.stored_count_by_target(status, (*TARGETS, "d"))


@query("SELECT id, external_id, coalesce(size, 0) AS size FROM corpus_file WHERE temporary_location IS NOT TRUE AND external_id <> ''", "corpus_file")
def corpus_scan(files):
    return ledger.corpus_scan(files)


@query("SELECT id, external_id, updated_date FROM corpus_file WHERE id = 42", "corpus_file")
def file_lookup(files):
    return ledger.file_by_id(files, 42)


@query("SELECT o.external_id, o.size, s.stored_bytes, s.verified_at FROM led_object o JOIN led_status s USING (external_id) WHERE s.target = 'a' AND s.state = 'stored'", "led_object", "led_status")
def stored_objects(objects, status):
    return ledger.stored_objects(objects, status, "a")


@query("SELECT external_id FROM led_status WHERE target = 'b' AND state = 'stored'", "led_status")
def stored_ids(status):
    return ledger.stored_ids(status, "b")


@query("SELECT external_id, string_agg(target, ',' ORDER BY target) AS stored_on FROM led_status WHERE state = 'stored' GROUP BY external_id", "led_status")
def dedup_lookup(status):
    return _joined(ledger.stored_targets(status), "stored_on")


@query(
    f"""WITH every AS (
         SELECT o.external_id, o.size, t.target, s.target IS NOT NULL AS held, t.target = 'b' AS down
         FROM led_object o CROSS JOIN (VALUES {_T}) t(target) LEFT JOIN led_status s ON s.external_id = o.external_id AND s.target = t.target AND s.state = 'stored')
       SELECT external_id, size, coalesce(string_agg(target, ',' ORDER BY target) FILTER (NOT held AND NOT down), '') AS pending,
              bool_or(NOT held AND down) AS skipped_down, CAST(count(*) FILTER (held) AS INT) AS deduplicated, true AS ok
       FROM every GROUP BY external_id, size""",
    "led_object", "led_status",
)
def pending_targets(objects, status):
    return _joined(ledger.pending_targets(objects, status, TARGETS, DOWN), "pending").drop("held")


@query(ORACLE_SQL["pending_targets"], "led_object", "led_status")
def ledger_lookup(objects, status):
    from ..sources import ledger_table

    return _joined(ledger_table.stored(status, 8, 2).pending(objects, TARGETS, DOWN), "pending").drop("held")


@query(
    """SELECT external_id, bool_and(state = 'stored') AS all_stored, bool_or(state = 'failed' AND target <> 'b') AS healthy_failed,
              coalesce(string_agg(target || ':' || state, ',' ORDER BY target) FILTER (state = 'stored' OR target <> 'b'), '') AS statuses
       FROM led_status GROUP BY external_id""",
    "led_status",
)
def fanout_classes(status):
    results = status.select("external_id", "target", (F.col("state") == "stored").alias("ok"), F.col("target").isin(*DOWN).alias("down"))
    found = ledger.classify_fanout(results)
    return found.withColumn("statuses", F.concat_ws(",", F.transform("statuses", lambda s: F.concat_ws(":", s["target"], s["state"]))))


@query(
    """SELECT external_id, target, CASE WHEN bool_or(state = 'stored') THEN 'stored' ELSE 'failed' END AS state,
              CASE WHEN bool_or(state = 'stored') THEN max_by(stored_bytes, seq) FILTER (state = 'stored') ELSE min_by(stored_bytes, seq) END AS stored_bytes,
              max_by(happened_at, seq) FILTER (state = 'stored') AS verified_at
       FROM attempt GROUP BY external_id, target""",
    "attempt",
)
def ledger_fold(attempts):
    return ledger.fold_status(attempts)


@query(
    """SELECT external_id, coalesce(max_by(stored_bytes, seq) FILTER (size_verified), min_by(stored_bytes, seq)) AS size, min_by(happened_at, seq) AS first_seen
       FROM attempt GROUP BY external_id""",
    "attempt",
)
def ledger_fold_objects(attempts):
    return ledger.fold_objects(attempts)


@query(
    f"""SELECT id, external_id, CASE WHEN updated_date IS NULL THEN 'no_date' WHEN updated_date > {_NOW} THEN 'changed_later' ELSE 'ok' END AS verdict FROM corpus_file""",
    "corpus_file",
)
def restore_current_guard(files):
    return ledger.restore_guard(files, as_of())


@query(
    """SELECT o.external_id, string_agg(s.target, ',' ORDER BY s.target = 'b', s.target) AS sources
       FROM led_object o JOIN led_status s ON o.external_id = s.external_id AND s.state = 'stored' GROUP BY o.external_id HAVING count(*) < 3""",
    "led_object", "led_status",
)
def repair_sources(objects, status):
    found = ledger.repair_sources(ledger.replication_gaps(objects, status, TARGETS), DOWN)
    return _joined(found.where(F.size("sources") > 0), "sources").select("external_id", "sources")


_VISIBLE = f"status = 'pending' AND (visible_at IS NULL OR visible_at <= {_NOW})"
_CLAIM = f"SELECT * FROM outbox WHERE {_VISIBLE} ORDER BY priority DESC NULLS FIRST, created_date ASC NULLS LAST, id LIMIT 100"


@query(f"SELECT id, file_id, priority, 'in_progress' AS status, created_date, {_NOW} AS claimed_at FROM ({_CLAIM})", "outbox")
def claim_top_n(outbox):
    return queue.claim(outbox, 100, as_of()).select("id", "file_id", "priority", "status", "created_date", "claimed_at")


@query(
    f"""SELECT q.id, CASE WHEN c.id IS NULL THEN q.status ELSE 'in_progress' END AS status, CASE WHEN c.id IS NULL THEN q.claimed_at ELSE {_NOW} END AS claimed_at
        FROM outbox q LEFT JOIN (SELECT id FROM ({_CLAIM})) c ON q.id = c.id""",
    "outbox",
)
def claim_transition(outbox):
    return queue.claimed_queue(outbox, 100, as_of()).select("id", "status", "claimed_at")


@query(
    f"""SELECT count(*) AS pending, coalesce((epoch_us({_NOW}) - epoch_us(min(created_date))) / 1e6, 0.0)::DOUBLE AS oldest_s FROM outbox
        WHERE status = 'pending' AND (visible_at IS NULL OR (visible_at <= {_NOW} AND coalesce(attempts, 0) > 0))""",
    "outbox",
)
def backlog_stats(outbox):
    return queue.backlog(outbox, as_of())


_BACKOFF = "least(5 * pow(2.0, least(coalesce(attempts, 0), 20)), 600.0)"
_TRIED_AGAIN = f"make_timestamp(epoch_us({_NOW}) + CAST({_BACKOFF} * 1000000 AS BIGINT))"
_QUEUE = "id, status, attempts, deliveries, last_error, claimed_at, visible_at"


def _updated(sets: dict[str, str], where: str) -> str:
    """The queue after an UPDATE of the rows that meet a condition."""
    columns = (f"CASE WHEN {where} THEN {sets[c]} ELSE {c} END AS {c}" if c in sets else c for c in _QUEUE.split(", "))
    return f"SELECT {', '.join(columns)} FROM outbox"


def _shown(queue_after):
    return queue_after.select(*_QUEUE.split(", "))


_HELD = "status = 'in_progress'"


@query(
    _updated(
        {
            "status": "CASE WHEN coalesce(attempts, 0) + 1 >= 10 THEN 'dead_letter' ELSE 'pending' END", "attempts": "coalesce(attempts, 0) + 1", "last_error": "'boom'", "claimed_at": "NULL",
            "visible_at": _TRIED_AGAIN,
        },
        _HELD,
    ),
    "outbox",
)
def fail_transition(outbox):
    return _shown(queue.fail(outbox, as_of(), F.lit("boom")))


_STALE = f"status = 'in_progress' AND (claimed_at IS NULL OR claimed_at < {_NOW} - INTERVAL '3600' SECOND)"


@query(
    _updated(
        {
            "status": "CASE WHEN coalesce(deliveries, 0) + 1 >= 50 THEN 'dead_letter' ELSE 'pending' END", "deliveries": "coalesce(deliveries, 0) + 1", "claimed_at": "NULL",
            "last_error": "CASE WHEN coalesce(deliveries, 0) + 1 >= 50 THEN 'crash-loop: exceeded max deliveries' ELSE last_error END",
        },
        _STALE,
    ),
    "outbox",
)
def reap_stale(outbox):
    return _shown(queue.reap_stale(outbox, as_of()))


@query(f"SELECT count(*) AS reaped, count(*) FILTER (coalesce(deliveries, 0) + 1 >= 50) AS dead_lettered FROM outbox WHERE {_STALE}", "outbox")
def reaped_counts(outbox):
    return queue.dead_lettered(queue.reap_stale(outbox, as_of()))


@query(_updated({"status": "'pending'", "claimed_at": "NULL", "attempts": "0", "visible_at": f"{_NOW} + INTERVAL '180' SECOND"}, _HELD), "outbox")
def defer_transition(outbox):
    return _shown(queue.defer(outbox, as_of(), F.lit(0.5)))


@query(_updated({"status": "'done'"}, _HELD), "outbox")
def done_transition(outbox):
    return _shown(queue.mark_done(outbox))


@query(_updated({"status": "'pending'", "claimed_at": "NULL", "visible_at": "NULL"}, _HELD), "outbox")
def release_transition(outbox):
    return _shown(queue.release(outbox))


@query(_updated({"status": "'skipped'", "claimed_at": "NULL"}, _HELD), "outbox")
def skip_transition(outbox):
    return _shown(queue.skip(outbox))


_OUTCOME = "CASE WHEN id % 5 = 0 THEN 'done' WHEN id % 7 = 0 THEN 'released' WHEN id % 11 = 0 THEN 'skipped' WHEN id % 3 = 0 THEN 'deferred' ELSE 'failed' END"


@query(
    _updated(
        {
            "status": f"CASE {_OUTCOME} WHEN 'done' THEN 'done' WHEN 'skipped' THEN 'skipped' WHEN 'failed' THEN CASE WHEN coalesce(attempts, 0) + 1 >= 10 THEN 'dead_letter' ELSE 'pending' END ELSE 'pending' END",
            "attempts": f"CASE {_OUTCOME} WHEN 'deferred' THEN 0 WHEN 'failed' THEN coalesce(attempts, 0) + 1 ELSE attempts END",
            "last_error": f"CASE {_OUTCOME} WHEN 'failed' THEN 'boom' ELSE last_error END", "claimed_at": f"CASE {_OUTCOME} WHEN 'done' THEN claimed_at END",
            "visible_at": f"CASE {_OUTCOME} WHEN 'deferred' THEN {_NOW} + INTERVAL '180' SECOND WHEN 'released' THEN NULL WHEN 'failed' THEN {_TRIED_AGAIN} ELSE visible_at END",
        },
        _HELD,
    ),
    "outbox",
)
def settle_outcomes(outbox):
    has = lambda n: F.col("id") % n == 0
    claimed = outbox.where("status = 'in_progress'").select("id", queue.outcome(has(5), has(7), has(11), has(3)).alias("outcome"))
    # a late second result of some rows, which must not count
    results = claimed.union(claimed.where(has(5)).select("id", F.lit("failed"))).withColumn("reason", F.lit("boom"))
    return _shown(queue.settle(outbox, results, as_of(), F.lit(0.5)))


_DIFF = """
    SELECT coalesce(m.target, s.target) AS target, CAST(sum(coalesce(m.c, 0)) AS BIGINT) AS manifest_size,
           CAST(sum(greatest(coalesce(m.c, 0) - CASE WHEN s.external_id IS NULL THEN 0 ELSE 1 END, 0)) AS BIGINT) AS extra,
           count(*) FILTER (m.external_id IS NULL) AS missing
    FROM (SELECT target, external_id, count(*) AS c FROM manifest GROUP BY ALL) m
    FULL JOIN (SELECT target, external_id FROM led_status WHERE state = 'stored') s ON m.target = s.target AND m.external_id = s.external_id GROUP BY 1"""


@query(_DIFF, "manifest", "led_status")
def inventory_diff(manifest, status):
    return inventory.inventory_diff(manifest, status)


@query(f"SELECT target, CASE WHEN extra > 0 THEN 'Drift' ELSE 'Verified' END AS verdict, extra > 0 AS failed FROM ({_DIFF})", "manifest", "led_status")
def inventory_verdicts(manifest, status):
    judged = inventory.inventory_diff(manifest, status).select("target", inventory.inventory_verdict().alias("verdict"))
    return judged.withColumn("failed", inventory.failed(F.col("verdict"), F.lit(False)))


@query("SELECT target, external_id FROM led_status s WHERE state = 'stored' AND NOT EXISTS (SELECT 1 FROM manifest m WHERE m.target = s.target AND m.external_id = s.external_id)", "manifest", "led_status")
def inventory_missing(manifest, status):
    return inventory.missing_ids(manifest, status)


@query("SELECT DISTINCT target, external_id FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM led_status s WHERE s.target = m.target AND s.external_id = m.external_id AND state = 'stored')", "manifest", "led_status")
def inventory_orphans(manifest, status):
    return inventory.orphan_ids(manifest, status)


_TALLY = """SELECT *, checked > 0 AND read_denied = checked AS all_denied FROM (
       SELECT target, count(*) AS checked, count(*) FILTER (NOT present) AS missing, count(*) FILTER (present IS NULL) AS errored, count(*) FILTER (present IS NULL AND denied) AS read_denied
       FROM listing GROUP BY target)"""


@query(
    f"""SELECT *, CASE WHEN missing > 0 THEN 'Drift' WHEN errored > 0 THEN 'Unverifiable' ELSE 'Verified' END AS verdict,
               missing > 0 OR errored > 0 AND NOT (target = 'c' AND all_denied) AS failed,
               CASE WHEN missing > 0 THEN 0 WHEN errored > 0 THEN NULL ELSE 1 END AS fine, CASE WHEN missing = 0 AND errored > 0 THEN 0 ELSE 1 END AS probe_worked
        FROM ({_TALLY})""",
    "listing",
)
def audit_verdict(listing):
    # c is write-once, and exempt if it lets nobody read
    judged = inventory.existence_tally(listing).withColumn("verdict", inventory.existence_verdict())
    fine, worked = inventory.gauges(F.col("verdict"))
    is_c = F.col("target") == "c"
    return judged.withColumns({"failed": inventory.failed(F.col("verdict"), inventory.exempt(is_c, ~F.col("all_denied"))), "fine": fine, "probe_worked": worked})


@query(
    f"""SELECT count(*) AS targets, count(*) FILTER (extra > 0) AS failed, coalesce(string_agg(target || ': Drift', '; ' ORDER BY target) FILTER (extra > 0), '') AS failures,
               count(*) FILTER (extra > 0) = 0 AS passed
        FROM ({_DIFF})""",
    "manifest", "led_status",
)
def inventory_report(manifest, status):
    judged = inventory.inventory_diff(manifest, status).select("target", inventory.inventory_verdict().alias("verdict"))
    return inventory.report(judged.withColumn("failed", inventory.failed(F.col("verdict"), F.lit(False))))


@query(
    """SELECT s.target, s.external_id, m.external_id IS NOT NULL AS present
       FROM led_status s LEFT JOIN (SELECT DISTINCT target, external_id FROM manifest) m ON m.target = s.target AND m.external_id = s.external_id WHERE s.state = 'stored'""",
    "led_status", "manifest",
)
def existence_sweep(status, manifest):
    return inventory.sweep(status, manifest)


@query(
    """SELECT *, CASE WHEN missing > 0 THEN 'Drift' WHEN errored > 0 THEN 'Unverifiable' ELSE 'Verified' END AS verdict FROM (
         SELECT s.target, count(*) AS checked, count(*) FILTER (m.external_id IS NULL AND s.target <> 'c') AS missing, count(*) FILTER (m.external_id IS NULL AND s.target = 'c') AS errored
         FROM led_status s LEFT JOIN (SELECT DISTINCT target, external_id FROM manifest) m ON m.target = s.target AND m.external_id = s.external_id WHERE s.state = 'stored' GROUP BY s.target)""",
    "led_status", "manifest",
)
def existence_unmounted(status, manifest):
    # c's root is not there
    found = inventory.sweep(status, manifest, ledger.target_rows(status, ["a", "b"]))
    return inventory.existence_tally(found).withColumn("verdict", inventory.existence_verdict()).select("target", "checked", "missing", "errored", "verdict")


@query(
    """SELECT external_id, target, verdict, CASE verdict WHEN 'Verified' THEN 1 WHEN 'Drift' THEN 0 END AS fine, CASE WHEN verdict = 'Unverifiable' THEN 0 ELSE 1 END AS probe_worked
       FROM (SELECT external_id, target, CASE WHEN size % 5 = 0 THEN 'NoData' WHEN size % 7 = 0 THEN 'Unverifiable' WHEN size % 2 = 0 AND size % 3 <> 0 THEN 'Verified' ELSE 'Drift' END AS verdict
             FROM (SELECT *, stored_bytes AS size FROM led_status))""",
    "led_status",
)
def immutability_verdicts(status):
    has = lambda n: F.col("stored_bytes") % n == 0
    judged = status.select("external_id", "target", inventory.immutability_verdict(~has(5), ~has(7), has(2), ~has(3)).alias("verdict"))
    fine, worked = inventory.gauges(F.col("verdict"))
    return judged.withColumns({"fine": fine, "probe_worked": worked})


@query(f"SELECT external_id, size FROM led_object WHERE external_id > '{SAMPLE_START}' ORDER BY external_id LIMIT 100", "led_object")
def keyset_page(objects):
    return inventory.keyset_page(objects, "external_id", SAMPLE_START, 100)


@query(
    f"SELECT external_id FROM led_status WHERE target = 'a' AND state = 'stored' AND external_id <> '{SAMPLE_START}' ORDER BY external_id < '{SAMPLE_START}', external_id LIMIT 150", "led_status"
)
def rotating_sample(status):
    return inventory.rotating_sample(ledger.stored_ids(status, "a"), "external_id", SAMPLE_START, 150)


@query(
    """SELECT external_id, target, fault FROM (
         SELECT external_id, target, 'object' AS fault FROM led_status s WHERE NOT EXISTS (SELECT 1 FROM led_object o WHERE o.external_id = s.external_id AND o.size % 3 <> 0)
         UNION ALL SELECT external_id, target, 'state' FROM led_status WHERE state NOT IN ('stored', 'failed'))""",
    "led_object", "led_status",
)
def ledger_faults(objects, status):
    return ledger.status_faults(objects.where("size % 3 <> 0"), status)


@query(
    """WITH w AS (SELECT target, seq, sum(CASE WHEN CAST(external_id AS INT) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS n FROM attempt)
       SELECT target, min(seq) AS tripped_at FROM w WHERE n >= 4 GROUP BY target""",
    "attempt",
)
def circuit_trips(attempts):
    return inventory.circuit_trips(attempts.select("target", "seq", (F.col("external_id").cast("int") % 3 != 0).alias("ok")), 4)


@query(
    """SELECT external_id, substr(external_id, 1, 2) || '/' || substr(external_id, 3, 2) || '/' || external_id AS place, regexp_full_match(external_id, '[0-9a-f]{64}') AS valid
       FROM led_object""",
    "led_object",
)
def object_places(objects):
    return objects.select("external_id", scalars.shard_key(F.col("external_id")).alias("place"), scalars.is_content_hash(F.col("external_id")).alias("valid"))


@query(
    """SELECT target, count(*) FILTER (state = 'stored') AS stored, count(*) FILTER (state = 'failed') AS failed, CAST(sum(stored_bytes) AS BIGINT) AS bytes FROM attempt GROUP BY target""",
    "attempt",
)
def attempt_metrics(attempts):
    return metrics.by_target(attempts)


@query(
    """SELECT '{"externalID":"' || o.external_id || '","size":' || o.size || '}' AS value FROM led_object o JOIN led_status s USING (external_id) WHERE s.target = 'a' AND s.state = 'stored'""",
    "led_object", "led_status",
)
def manifest_export(objects, status):
    from ..sources.manifests import manifest_lines

    return manifest_lines(ledger.stored_objects(objects, status, "a").select("external_id", "size"))


@query(
    f"""SELECT id, external_id, coalesce(verdict, 'not_found') AS verdict
        FROM (SELECT DISTINCT 2 * id AS id FROM corpus_file) r
        LEFT JOIN (SELECT id, external_id, CASE WHEN updated_date IS NULL THEN 'no_date' WHEN updated_date > {_NOW} THEN 'changed_later' ELSE 'ok' END AS verdict
                   FROM corpus_file WHERE external_id <> '') f USING (id)""",
    "corpus_file",
)
def restore_requests(files):
    return ledger.restore_requests(files.select((2 * F.col("id")).alias("id")), files, as_of())


@query(
    """SELECT target, bool_and(good) AS ascending
       FROM (SELECT target, coalesce(lag(external_id) OVER (PARTITION BY target ORDER BY line) < external_id, true) AS good FROM manifest_file) GROUP BY target""",
    "manifest_file",
)
def manifest_order(lines):
    return inventory.ascending(lines, block=100)


@query(
    """SELECT time_bucket(INTERVAL '15' MINUTE, created_date) AS starts, status, count(*) AS rows, CAST(sum(coalesce(attempts, 0)) AS BIGINT) AS attempts
       FROM outbox WHERE created_date IS NOT NULL AND time_bucket(INTERVAL '15' MINUTE, created_date) + INTERVAL '15' MINUTE <= (SELECT max(created_date) - INTERVAL '1' HOUR FROM outbox)
       GROUP BY ALL""",
    "outbox",
)
def stream_backlog(outbox):
    from ..streaming import consumer, run

    return run.finished(outbox, lambda s: consumer.backlog_by_window(s).select(F.col("window.start").alias("starts"), "status", "rows", "attempts"), by="created_date", slices=5)


@query(
    """WITH placed AS (
         SELECT id, seq, event, "at", lead("at") OVER (PARTITION BY id ORDER BY "at", seq) AS next_at, (SELECT date_trunc('milliseconds', max("at")) FROM claim_event) AS ended
         FROM claim_event),
       up AS (SELECT id, seq, row_number() OVER (PARTITION BY id ORDER BY "at", seq) AS deliveries FROM placed WHERE event = 'claimed' AND epoch_us(coalesce(next_at, ended)) - epoch_us("at") > 3600000000)
       SELECT id, seq, deliveries, CASE WHEN deliveries >= 20 THEN 'dead_letter' ELSE 'pending' END AS status FROM up""",
    "claim_event",
)
def stream_redelivery(events):
    from ..streaming import consumer, run

    return run.finished(events, lambda s: consumer.redeliver(s, most=20), by="at", slices=5)


_WAIT = "to_seconds(CAST(least(5 * pow(2, least(attempt - 1, 20)), 600) AS BIGINT))"


@query(
    f"""WITH RECURSIVE q AS (SELECT id, CAST(coalesce(attempts, 0) AS BIGINT) AS attempts, coalesce(visible_at, created_date, {_NOW}) AS due FROM outbox WHERE status = 'pending'),
       w AS (SELECT max(due) AS ended FROM q),
       r AS (
         SELECT id, attempts + 1 AS attempt, due AS "at" FROM q
         UNION ALL
         SELECT id, attempt + 1, "at" + {_WAIT} FROM r, w WHERE (id * 7 + attempt) % 5 <> 0 AND attempt < 10 AND "at" + {_WAIT} <= ended)
       SELECT id, attempt, "at", CASE WHEN (id * 7 + attempt) % 5 = 0 THEN 'done' WHEN attempt >= 10 THEN 'dead_letter' ELSE 'pending' END AS status,
              CASE WHEN (id * 7 + attempt) % 5 <> 0 AND attempt < 10 THEN "at" + {_WAIT} END AS visible_at
       FROM r""",
    "outbox",
)
def stream_retries(outbox):
    from ..streaming import consumer, run

    rows = outbox.where("status = 'pending'").select("id", "attempts", F.coalesce("visible_at", "created_date", as_of()).alias("due"))
    return run.finished(rows, lambda s: consumer.retried(s, lambda i, attempt: (i * 7 + attempt) % 5 == 0), by="due", slices=5)


_OPENED = "SELECT created_date AS opened, CASE WHEN status IN ('done', 'skipped', 'dead_letter') THEN coalesce(claimed_at, created_date + INTERVAL '3' HOUR) END AS closed FROM outbox"


@query(
    f"""WITH q AS ({_OPENED}),
       tick AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + to_seconds(900 * i) AS "at" FROM range(2976) r(i)),
       b AS (SELECT "at", count(*) AS pending, min(opened) AS oldest FROM tick JOIN q ON coalesce(opened <= "at", true) AND coalesce(closed > "at", true) GROUP BY "at"),
       v AS (SELECT "at", target, max(happened_at) AS last FROM tick JOIN attempt ON happened_at <= "at" AND state = 'stored' GROUP BY ALL),
       s AS (SELECT "at", min(last) AS stalest, count(*) AS known FROM v GROUP BY "at")
       SELECT "at", coalesce(pending, 0) AS pending, coalesce((epoch_us("at") - epoch_us(oldest)) / 1e6, 0.0)::DOUBLE AS oldest_s, 4 - coalesce(known, 0) AS never_verified,
              coalesce((epoch_us("at") - epoch_us(stalest)) / 1e6, 0.0)::DOUBLE AS stalest_s, coalesce(known, 0) > 0 AS ok
       FROM tick LEFT JOIN b USING ("at") LEFT JOIN s USING ("at")""",
    "outbox", "attempt",
)
def sampler_history(outbox, attempts):
    closed = F.when(F.col("status").isin("done", "skipped", "dead_letter"), F.coalesce("claimed_at", F.col("created_date") + F.expr("INTERVAL '3' HOUR")))
    rows = outbox.select(F.col("created_date").alias("opened"), closed.alias("closed"))
    verified = attempts.where("state = 'stored'").select("target", F.col("happened_at").alias("verified_at"))
    return sampler.history(rows, verified, (*TARGETS, "d"), F.expr("timestamp '2024-01-01 00:00:00'"), 900, 2976)


@query(
    """WITH s AS (SELECT external_id, target, state, seq // 100 AS batch FROM attempt),
       b AS (SELECT DISTINCT batch FROM s),
       held AS (SELECT b.batch, s.external_id, count(DISTINCT s.target) FILTER (s.state = 'stored') AS n FROM b JOIN s ON s.batch <= b.batch GROUP BY ALL)
       SELECT batch, count(*) AS objects, count(*) FILTER (n = 3) AS covered, count(*) FILTER (n < 3) AS gaps FROM held GROUP BY batch""",
    "attempt",
)
def coverage_history(attempts):
    return sampler.coverage_by_batch(attempts.withColumn("batch", F.floor(F.col("seq") / 100)), "batch", TARGETS)


# one outcome of every target a step: its last 8 results as text (0 failed), whether it is open, and trips so far
_CIRCUIT = """WITH RECURSIVE o AS (
         SELECT target, seq, happened_at, CAST(external_id AS INT) % 3 <> 0 AND seq % 50 < 40 AS ok, row_number() OVER (PARTITION BY target ORDER BY seq) AS i FROM attempt),
       s AS (
         SELECT DISTINCT target, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS happened_at, '' AS w, false AS open, CAST(0 AS BIGINT) AS trips FROM o
         UNION ALL
         SELECT target, i, seq, happened_at, CASE WHEN open AND ok THEN '' ELSE v END, CASE WHEN open AND ok THEN false ELSE f >= 4 END, trips + CASE WHEN NOT open AND f >= 4 THEN 1 ELSE 0 END
         FROM (SELECT *, length(v) - length(replace(v, '0', '')) AS f
               FROM (SELECT s.target, o.i, o.seq, o.happened_at, s.open, o.ok, s.trips, right(s.w || CASE WHEN o.ok THEN '1' ELSE '0' END, 8) AS v FROM s JOIN o ON o.target = s.target AND o.i = s.i + 1)))
       SELECT target, seq, open, trips{} FROM s WHERE i > 0"""


def _outcomes(attempts):
    return attempts.select("target", "seq", F.col("happened_at").alias("at"), ((F.col("external_id").cast("int") % 3 != 0) & (F.col("seq") % 50 < 40)).alias("ok"))


@query(_CIRCUIT.format(", CASE WHEN open THEN happened_at + INTERVAL '60' SECOND END AS until"), "attempt")
def circuit_states(attempts):
    return circuits.states(_outcomes(attempts), 4, 60)


@query(_CIRCUIT.format(""), "attempt")
def stream_circuit(attempts):
    from ..streaming import circuit, run

    return run.finished(_outcomes(attempts), lambda s: circuit.circuits(s, threshold=4), by="seq", slices=5)


_BACKUP = f"""WITH item AS (SELECT external_id, count(*) AS files FROM corpus_file WHERE temporary_location IS NOT TRUE AND external_id <> '' GROUP BY ALL),
     every AS (
       SELECT i.external_id, i.files, t.target, s.target IS NOT NULL AS held, s.target IS NULL AND t.target = 'b' AS skipped, s.target IS NULL AND t.target <> 'b' AS pending, x.ok, x.stored_bytes, x.gone, x.down, x.aborted
       FROM item i CROSS JOIN (VALUES {_T}) t(target) LEFT JOIN led_status s ON s.external_id = i.external_id AND s.target = t.target AND s.state = 'stored'
       LEFT JOIN transfer x ON x.external_id = i.external_id AND x.target = t.target),
     ended AS (
       SELECT external_id, any_value(files) AS files, coalesce(bool_or(gone), false) AS silent, coalesce(bool_or(aborted), false) AS aborted,
              coalesce(string_agg(target, ',' ORDER BY target) FILTER (pending), '') AS pending, CAST(count(*) FILTER (held) AS INT) AS deduplicated,
              CASE WHEN NOT bool_or(pending) THEN CASE WHEN bool_or(skipped) THEN 'deferred' ELSE 'backed' END WHEN coalesce(bool_or(gone), false) THEN 'skipped'
                   WHEN coalesce(bool_or(aborted), false) THEN 'failed' WHEN count(*) FILTER (pending AND (ok IS NULL OR NOT ok AND NOT down)) > 0 THEN 'failed' WHEN count(*) FILTER (pending AND NOT ok) = 0 AND NOT bool_or(skipped) THEN 'backed' ELSE 'deferred' END AS outcome
       FROM every GROUP BY external_id),
     noted AS (SELECT e.external_id, e.target, e.ok, e.stored_bytes FROM every e JOIN ended USING (external_id) WHERE e.pending AND NOT silent AND (e.ok OR NOT e.ok AND NOT e.down AND NOT ended.aborted))"""
_BACKUP_VIEWS = ("corpus_file", "led_status", "transfer")


def _backup(files, status, transfers):
    return passes.backup_outcomes(files, status, transfers, TARGETS, DOWN)


@query(
    f"""{_BACKUP} SELECT e.external_id, e.files, e.pending, e.deduplicated, e.outcome,
                        coalesce(string_agg(n.target || ':' || CASE WHEN n.ok THEN 'stored:' || n.stored_bytes ELSE 'failed:0' END, ',' ORDER BY n.target), '') AS statuses
                 FROM ended e LEFT JOIN noted n ON n.external_id = e.external_id GROUP BY ALL""",
    *_BACKUP_VIEWS,
)
def backup_outcomes(files, status, transfers):
    found = _joined(_backup(files, status, transfers), "pending").drop("held")
    return found.withColumn("statuses", F.concat_ws(",", F.transform("statuses", lambda s: F.concat_ws(":", s["target"], s["state"], s["bytes"].cast("string")))))


@query(f"{_BACKUP} SELECT outcome, count(*) AS objects, CAST(sum(files) AS BIGINT) AS files FROM ended GROUP BY outcome", *_BACKUP_VIEWS)
def backup_tally(files, status, transfers):
    return _backup(files, status, transfers).groupBy("outcome").agg(F.count(F.lit(1)).alias("objects"), F.sum("files").alias("files"))


@query(f"{_BACKUP} SELECT count(*) AS objects, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'failed') = 0 AS passed FROM ended", *_BACKUP_VIEWS)
def backup_result(files, status, transfers):
    return passes.run_result(_backup(files, status, transfers), "backup")


@query(
    f"""{_BACKUP} SELECT coalesce(n.external_id, s.external_id) AS external_id, coalesce(n.target, s.target) AS target, CASE WHEN n.ok THEN 'stored' ELSE coalesce(s.state, 'failed') END AS state,
                        CASE WHEN n.ok THEN n.stored_bytes ELSE coalesce(s.stored_bytes, 0) END AS stored_bytes, CASE WHEN n.ok THEN {_NOW} ELSE s.verified_at END AS verified_at
                 FROM noted n FULL JOIN led_status s ON s.external_id = n.external_id AND s.target = n.target""",
    *_BACKUP_VIEWS,
)
def backup_recorded(files, status, transfers):
    return passes.recorded(_backup(files, status, transfers), status, as_of())


@query(ORACLE_SQL["backup_recorded"], *_BACKUP_VIEWS)
def ledger_upsert(files, status, transfers):
    from ..sources import ledger_table

    # into a stored ledger, in two batches, of which the first comes again
    table, done = ledger_table.stored(status, 8, 2), passes.attempts(_backup(files, status, transfers), as_of())
    low = F.col("external_id") < "8"
    for number, part in ((0, done.where(low)), (1, done.where(~low)), (0, done.where(low))):
        table.upsert(part, number)
    return table.status()


@query(
    f"""{_BACKUP} SELECT target, CAST(sum(stored) AS BIGINT) AS stored, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(held) AS BIGINT) AS deduplicated, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
                   SELECT target, CAST(ok AS INT) AS stored, CAST(NOT ok AS INT) AS failed, 0 AS held, CASE WHEN ok THEN stored_bytes ELSE 0 END AS bytes FROM noted
                   UNION ALL SELECT target, 0, 0, CAST(held AS INT), 0 FROM every) GROUP BY target""",
    *_BACKUP_VIEWS,
)
def backup_target_counts(files, status, transfers):
    return passes.target_counts(_backup(files, status, transfers), TARGETS)


@query(ORACLE_SQL["backup_target_counts"], *_BACKUP_VIEWS)
def observed_counts(files, status, transfers):
    from ..sources.shared import written

    counted = metrics.Counted(_backup(files, status, transfers), TARGETS)
    written(counted.observed, "outcomes")
    return counted.by_target()


_REPAIR = f"""SELECT external_id, arg_min(target, CASE WHEN target = 'b' THEN 'z' ELSE target END) FILTER (held AND readable) AS source, coalesce(string_agg(target, ',' ORDER BY target) FILTER (pending), '') AS pending,
           CASE WHEN NOT bool_or(held) THEN 'skipped' WHEN bool_or(held AND readable) AND count(*) FILTER (pending AND coalesce(NOT ok, true) OR NOT held AND target = 'b') = 0 AND NOT coalesce(bool_or(gone), false) AND NOT coalesce(bool_or(aborted), false) THEN 'repaired'
                ELSE 'failed' END AS outcome
    FROM (SELECT o.external_id, t.target, s.target IS NOT NULL AS held, r.target IS NOT NULL AS readable, s.target IS NULL AND t.target <> 'b' AS pending, x.ok, x.gone, x.aborted
          FROM led_object o CROSS JOIN (VALUES {_T}) t(target) LEFT JOIN led_status s ON s.external_id = o.external_id AND s.target = t.target AND s.state = 'stored'
          LEFT JOIN readable r ON r.external_id = o.external_id AND r.target = t.target LEFT JOIN transfer x ON x.external_id = o.external_id AND x.target = t.target)
    GROUP BY external_id HAVING count(*) FILTER (held) < 3"""
_REPAIR_VIEWS = ("led_object", "led_status", "readable", "transfer")


def _repair(objects, status, readable, transfers):
    gaps = ledger.repair_sources(ledger.replication_gaps(objects, status, TARGETS), DOWN)
    return passes.repair_outcomes(gaps, readable, transfers, TARGETS, DOWN)


@query(_REPAIR, *_REPAIR_VIEWS)
def repair_outcomes(objects, status, readable, transfers):
    return _joined(_repair(objects, status, readable, transfers), "pending").drop("statuses")


@query(f"SELECT count(*) AS objects, count(*) FILTER (outcome <> 'repaired') AS failed, count(*) FILTER (outcome <> 'repaired') = 0 AS passed FROM ({_REPAIR})", *_REPAIR_VIEWS)
def repair_result(objects, status, readable, transfers):
    return passes.run_result(_repair(objects, status, readable, transfers), "repair")


@query(
    """SELECT external_id, bool_and(state = 'stored') AS all_stored, bool_or(state = 'failed' AND target <> 'b') AS healthy_failed,
              coalesce(string_agg(target || ':' || state, ',' ORDER BY target) FILTER (state = 'stored' OR target <> 'b' AND external_id >= '8'), '') AS statuses
       FROM led_status GROUP BY external_id""",
    "led_status",
)
def fanout_aborted(status):
    # transfers of hashes below 8 were aborted: what failed in them is not recorded
    results = status.select("external_id", "target", (F.col("state") == "stored").alias("ok"), F.col("target").isin(*DOWN).alias("down"))
    found = ledger.classify_fanout(results, F.col("external_id") < "8")
    return found.withColumn("statuses", F.concat_ws(",", F.transform("statuses", lambda s: F.concat_ws(":", s["target"], s["state"]))))


@query(
    """WITH said AS (SELECT * FROM attempt WHERE seq % 13 <> 0 AND seq % 11 <> 0)
       SELECT external_id, target, state, stored_bytes AS bytes FROM said UNION ALL SELECT external_id, 'd', 'failed', NULL FROM said""",
    "attempt", "outcome_record",
)
def record_set(attempts, records):
    return passes.record_set(records)


@query(
    """SELECT target, CASE WHEN size % 9 NOT IN (2, 5) THEN external_id END AS external_id, size % 9 IN (2, 5) AS corrupt FROM manifest WHERE size % 9 NOT IN (0, 3, 4)""",
    "manifest", "manifest_text",
)
def manifest_scan(manifest, lines):
    from ..sources.manifests import scan_lines

    return scan_lines(lines)


@query(
    f"""WITH held AS (SELECT external_id FROM led_object JOIN led_status USING (external_id) WHERE target = 'a' AND state = 'stored')
        SELECT 'range' AS part, external_id FROM held WHERE external_id > '4' AND external_id <= '{SAMPLE_START}'
        UNION ALL SELECT * FROM (SELECT 'page', external_id FROM held WHERE external_id > '{SAMPLE_START}' ORDER BY external_id LIMIT 100)""",
    "led_object", "led_status",
)
def manifest_ranges(objects, status):
    from ..sources import manifest_index
    from ..sources.shared import shared_folder

    spark, folder = objects.sparkSession, shared_folder(objects.sparkSession, "manifest")
    manifest_index.write(ledger.stored_objects(objects, status, "a").select("external_id", "size"), folder, lines=50)
    of = lambda name, rows: rows.select(F.lit(name).alias("part"), "external_id")
    return of("range", manifest_index.read_range(spark, folder, "a", "4", SAMPLE_START)).unionByName(of("page", manifest_index.read_page(spark, folder, "a", SAMPLE_START, 100)))


@query(
    """SELECT target, max(name) AS name FROM manifest_name WHERE regexp_full_match(name, '[0-9]{8}T[0-9]{6}[.][0-9]{9}Z[.]jsonl') AND name NOT LIKE '202412%' GROUP BY target""",
    "manifest_name",
)
def manifest_newest(names):
    from ..sources.manifests import newest

    return newest(names, names.where("name like '202412%'"))


@query(
    """SELECT id, CASE id % 5 WHEN 2 THEN 'zstd' WHEN 4 THEN NULL ELSE 'none' END AS codec, regexp_replace(upper(name), '[^A-Z0-9]', '_', 'g') AS token, '_manifest/' || id || '.jsonl' AS place, id % 2 = 0 AS packed
       FROM rule_input""",
    "rule_input",
)
def scalar_rules(rows):
    return rows.select(
        "id", scalars.codec_of(F.col("codec")).alias("codec"), scalars.env_token(F.col("name")).alias("token"), scalars.manifest_key(F.col("path")).alias("place"),
        scalars.has_zstd_magic(F.unhex("head")).alias("packed"),
    )


_DRAINED = f"""id AS seq, CAST(file_id AS varchar(20)) AS external_id, 'a' AS target, CASE WHEN id % 4 = 0 THEN 'failed' ELSE 'stored' END AS state,
    CASE WHEN id % 4 = 0 THEN 0 ELSE id % 1000 END AS stored_bytes, coalesce(created_date, {_NOW}) AS happened_at"""


@query(
    f"""WITH done AS (SELECT {_DRAINED} FROM outbox WHERE status = 'pending')
       SELECT external_id, target, CASE WHEN bool_or(state = 'stored') THEN 'stored' ELSE 'failed' END AS state,
              CASE WHEN bool_or(state = 'stored') THEN max_by(stored_bytes, seq) FILTER (state = 'stored') ELSE min_by(stored_bytes, seq) END AS stored_bytes,
              max_by(happened_at, seq) FILTER (state = 'stored') AS verified_at
       FROM done GROUP BY external_id, target""",
    "outbox",
)
def stream_drain(outbox):
    from ..streaming import consumer

    failed = F.col("id") % 4 == 0
    work = lambda rows: rows.select(
        F.col("id").alias("seq"), F.col("file_id").cast("string").alias("external_id"), F.lit("a").alias("target"), F.when(failed, "failed").otherwise("stored").alias("state"),
        F.when(failed, 0).otherwise(F.col("id") % 1000).alias("stored_bytes"), F.coalesce("created_date", as_of()).alias("happened_at"),
    )
    return consumer.statuses(consumer.drained(outbox, work))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA3-256 of every document; neither engine has it built in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", scalars.sha3_256_hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("external_id"))


QUERIES["content_hashes"] = content_hashes


def _stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id and what a store tells of its text: by id plain, packed, damaged, or (packed text as the object) plain again."""
    from ..functions import payloads

    text, kind = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.col("doc_id") % 4
    put = docs.select("doc_id", text.alias("content"), payloads.packed(text, F.when(kind.isin(1, 3), "zstd").otherwise("none")).alias("packed"))
    item = F.when(kind == 3, F.col("packed")).otherwise(F.col("content"))
    held = put.select("doc_id", scalars.sha3_256_hex(item).alias("digest"), F.when(kind == 2, F.concat("content", F.unhex(F.lit("00")))).otherwise(F.col("packed")).alias("payload"))
    return held.select("doc_id", payloads.told(F.col("payload"), F.col("digest")).alias("found")).select("doc_id", "found.*")


def object_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a store holds it, told by its hash."""
    from ..sources.shared import small_batches, written

    found = _stored_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    with small_batches(spark):
        return written(found.select("doc_id", "codec", "ok", F.when(F.col("doc_id") % 4 < 2, F.col("size")).alias("size")), "verified")


def _objects(docs: DataFrame) -> DataFrame:
    """Every distinct text as an object: its hash, its bytes, and their number."""
    from ..sources.shared import small_batches, written

    text = docs.select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")).distinct()
    with small_batches(docs.sparkSession):
        return written(text.select(scalars.sha3_256_hex(F.col("content")).alias("external_id"), "content", F.octet_length("content").alias("n")), "objects")


def _restorable(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """Objects, a store that holds most of them (by size packed, damaged, or not at all), and one to restore to, with some intact and some damaged."""
    from ..sources import objects as store
    from ..sources.shared import shared_folder

    spark = docs.sparkSession
    own, kind = _objects(docs), F.col("n") % 5
    folder = shared_folder(spark, "stores")
    for name, codec, rows, damaged in (
        ("from", "none", kind.isin(0, 2), kind == 2), ("from", "zstd", kind.isin(1, 4), F.lit(False)), ("to", "none", (kind == 4) | (F.col("n") % 7 == 0), kind != 4),
    ):
        content = F.when(damaged, F.concat("content", F.unhex(F.lit("00")))).otherwise(F.col("content"))
        store.stored(own.where(rows).select("external_id", content.alias("content")), [store.Place(name, f"{folder}/{name}", codec)])
    return own, f"{folder}/from", f"{folder}/to"


def store_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects written to three stores at once, of which one can't be written, and what a sweep of them finds that should be there."""
    from ..sources import objects as store
    from ..sources.shared import shared_folder, written

    own, folder = _objects(spark.read.parquet(f"{sf_dir}/documents.parquet")), shared_folder(spark, "stores")
    places = [store.Place("a", f"{folder}/a"), store.Place("b", f"{folder}/b", "zstd"), store.Place("c", "/proc/no store here")]
    done = written(store.stored(own, places), "stored")
    # the ledger also knows of texts that were never sent to a
    ledger_rows = done.unionByName(own.where("n % 3 = 0").select(F.sha2("content", 256).alias("external_id"), F.lit("a").alias("target"), F.lit(True).alias("ok"), F.lit(0).cast("long").alias("stored_bytes")))
    status = ledger_rows.select("external_id", "target", F.when(F.col("ok"), "stored").otherwise("failed").alias("state"))
    listing = store.objects(spark, f"{folder}/a", payload=False).select(F.lit("a").alias("target"), "external_id").unionByName(store.objects(spark, f"{folder}/b", payload=False).select(F.lit("b").alias("target"), "external_id"))
    found = inventory.existence_tally(inventory.sweep(status, listing)).select("target", "checked", "missing")
    counts = done.groupBy("target").agg(F.count(F.when(F.col("ok"), 1)).alias("stored"), F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.sum(F.when(F.col("target") == "a", F.col("stored_bytes")).otherwise(0)).alias("plain_bytes"))
    return counts.join(found, "target", "left").select("target", "stored", "failed", "plain_bytes", F.coalesce("checked", F.lit(0)).cast("long").alias("checked"), F.coalesce("missing", F.lit(0)).cast("long").alias("missing"))


def restore_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How restoring every object into a store ends, and how many of them read back intact afterwards."""
    from ..functions import payloads
    from ..sources import objects as store
    from ..sources.shared import small_batches, written

    own, source, target = _restorable(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    done = written(store.restored(own, source, target), "restored")
    told = store.objects(spark, target).select("external_id", payloads.told(F.col("payload"), F.col("external_id")).alias("t")).where("t.ok").select("external_id", F.lit(True).alias("intact"))
    with small_batches(spark):
        told = written(told, "told")
    return done.join(told, "external_id", "left").groupBy("outcome").agg(F.count(F.lit(1)).alias("objects"), F.sum("bytes").alias("bytes"), F.count("intact").alias("intact"))


def drill_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a drill passes: a rotating sample, which is the feature, restored into an empty store."""
    from ..sources import objects as store
    from ..sources.shared import shared_folder

    own, source, _ = _restorable(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sample = inventory.rotating_sample(own.withColumn("key", F.sha2("content", 256)), "key", SAMPLE_START, 100)
    return passes.run_result(store.restored(sample, source, shared_folder(spark, "drill")), "drill")


_OBJECTS = "SELECT t, CAST(strlen(t) AS BIGINT) AS n FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents)"
QUERIES |= {f.__name__: f for f in (object_verify, store_sweep, restore_result, drill_result)}
ORACLE_SQL |= {
    "object_verify": """SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'zstd' WHEN 2 THEN NULL ELSE 'none' END AS codec, doc_id % 4 <> 2 AS ok,
        CASE WHEN doc_id % 4 < 2 THEN CAST(strlen(coalesce(text, '')) AS BIGINT) END AS size FROM documents""",
    "store_sweep": f"""WITH o AS ({_OBJECTS})
        SELECT target, count(*) FILTER (target <> 'c') AS stored, count(*) FILTER (target = 'c') AS failed, CAST(sum(CASE WHEN target = 'a' THEN n ELSE 0 END) AS BIGINT) AS plain_bytes,
               count(*) FILTER (target <> 'c') + count(*) FILTER (target = 'a' AND n % 3 = 0) AS checked, count(*) FILTER (target = 'a' AND n % 3 = 0) AS missing
        FROM o CROSS JOIN (VALUES ('a'), ('b'), ('c')) v(target) GROUP BY target""",
    "restore_result": f"""SELECT outcome, count(*) AS objects, CAST(sum(CASE WHEN outcome IN ('restored', 'skipped') THEN n ELSE 0 END) AS BIGINT) AS bytes, count(*) FILTER (outcome IN ('restored', 'skipped')) AS intact
        FROM (SELECT n, CASE n % 5 WHEN 4 THEN 'skipped' WHEN 3 THEN 'missing' WHEN 2 THEN 'failed' ELSE 'restored' END AS outcome FROM ({_OBJECTS})) GROUP BY outcome""",
    "drill_result": f"""SELECT count(*) AS objects, count(*) FILTER (n % 5 IN (2, 3)) AS failed, count(*) FILTER (n % 5 IN (2, 3)) = 0 AND count(*) > 0 AS passed
        FROM (SELECT n, sha256(t) AS key FROM ({_OBJECTS}) ORDER BY key < '{SAMPLE_START}', key LIMIT 100)""",
}
