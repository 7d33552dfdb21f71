"""Ledger, corpus and queue views over the given tables, in text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-15 00:00:00"
TARGETS = ("a", "b", "c")

#: {sha} is the content hash of ``text``: sha2(text, 256) in Spark, sha256(text) in DuckDB.
VIEWS = {
    "corpus_file": """
        SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '' ELSE {sha} END AS external_id,
               CASE WHEN doc_id % 23 = 0 THEN NULL ELSE n_chars END AS size,
               CASE WHEN doc_id % 13 = 0 THEN true WHEN doc_id % 7 = 0 THEN NULL ELSE false END AS temporary_location,
               CASE WHEN doc_id % 11 = 0 THEN NULL ELSE make_timestamp(2024, 1, 1 + CAST(doc_id % 28 AS int), 0, 0, 0.0) END AS updated_date
        FROM documents""",
    "led_object": """
        SELECT external_id, min(coalesce(size, 0)) AS size FROM corpus_file
        WHERE external_id IS NOT NULL AND external_id <> '' GROUP BY external_id""",
    "tgt": "SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 2)) v(target, ti)",
    "led_status": """
        SELECT o.external_id, t.target, CASE WHEN (o.size * 7 + t.ti * 3) % 11 = 0 THEN 'failed' ELSE 'stored' END AS state,
               CASE WHEN (o.size * 7 + t.ti * 3) % 11 = 0 THEN 0 ELSE o.size END AS stored_bytes,
               CASE WHEN (o.size * 7 + t.ti * 3) % 11 = 0 THEN NULL ELSE make_timestamp(2024, 1, 1 + CAST((o.size + t.ti * 5) % 28 AS int), 0, 0, 0.0) END AS verified_at
        FROM led_object o CROSS JOIN tgt t WHERE (o.size + t.ti) % 13 <> 0""",
    "outbox": """
        SELECT event_id AS id, CAST(event_id % 200 AS bigint) AS file_id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(event_id % 3 AS int) END AS priority,
               CASE WHEN event_id % 10 < 6 THEN 'pending' WHEN event_id % 10 = 6 THEN 'in_progress' WHEN event_id % 10 = 7 THEN 'done' WHEN event_id % 10 = 8 THEN 'skipped' ELSE 'dead_letter' END AS status,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 12 AS int) END AS attempts,
               CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 52 AS int) END AS deliveries,
               CASE WHEN event_id % 9 < 4 THEN 'error ' || (event_id % 7) END AS last_error,
               CASE WHEN event_id % 31 = 0 THEN NULL ELSE ts END AS created_date,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + INTERVAL '1' HOUR END AS claimed_at,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL '2' HOUR END AS visible_at
        FROM events""",
    # a target's own inventory: some stored ids are absent, some are listed twice, some were never recorded
    "manifest": """
        SELECT target, external_id, stored_bytes AS size FROM led_status WHERE state = 'stored' AND stored_bytes % 7 <> 0
        UNION ALL SELECT target, external_id, stored_bytes FROM led_status WHERE state = 'stored' AND stored_bytes % 11 = 1
        UNION ALL SELECT target, external_id, 0 FROM led_status WHERE state = 'failed' AND target <> 'b'""",
    # what each store lists, with what could not be asked (NULL) and whether that was a definite denial; c may only be written to
    "listing": """
        SELECT target, external_id, CASE WHEN target = 'c' OR stored_bytes % 41 = 3 THEN NULL ELSE stored_bytes % 9 <> 4 END AS present, target = 'c' OR stored_bytes % 2 = 0 AS denied
        FROM led_status WHERE state = 'stored'""",
    # manifests line by line: a's and c's ids ascend, but for one repeated line of c; b's are in the order of their sizes
    "manifest_file": """
        SELECT target, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN target = 'b' THEN size ELSE 0 END, external_id) AS line, external_id
        FROM manifest WHERE target <> 'a' OR size > 0 AND size % 11 <> 1""",
    # claims and outcomes of queue rows, in the order of seq
    "claim_event": """
        SELECT user_id AS id, event_id AS seq, CASE WHEN event_id % 5 < 3 THEN 'claimed' ELSE 'settled' END AS event, ts AS at FROM events""",
    # results of backup attempts in the order of seq
    "attempt": """
        SELECT event_id AS seq, CAST(user_id % 250 AS varchar(20)) AS external_id, CASE WHEN event_id % 3 = 0 THEN 'a' WHEN event_id % 3 = 1 THEN 'b' ELSE 'c' END AS target,
               CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'stored' END AS state, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 1000 END AS stored_bytes,
               event_id % 5 < 3 AS size_verified, ts AS happened_at
        FROM events""",
    # how the transfers of a pass end; sources that couldn't be read have no row, some that were aborted have none for c
    "transfer": """
        SELECT o.external_id, t.target, (o.size + t.ti) % 10 <> 0 AS ok, o.size AS stored_bytes, o.size % 37 = 0 AS gone, t.target = 'c' AND o.size % 4 = 0 AS down, o.size % 7 = 5 AS aborted
        FROM led_object o CROSS JOIN tgt t WHERE o.size % 29 <> 0 AND NOT (o.size % 14 = 5 AND t.target = 'c')""",
    # copies that decode to their hash
    "readable": "SELECT external_id, target FROM led_status WHERE state = 'stored' AND stored_bytes % 3 <> 1",
    # manifests as text: lines that are empty, without an id, in other cases, or corrupt
    "manifest_text": """
        SELECT target, CASE size % 9 WHEN 0 THEN '' WHEN 1 THEN chr(123) || '"ExternalID":"' || external_id || '"' || chr(125) WHEN 2 THEN external_id WHEN 3 THEN chr(123) || '"size":1' || chr(125)
               WHEN 4 THEN 'null' WHEN 5 THEN chr(123) || '"externalID":5' || chr(125) ELSE chr(123) || '"externalID":"' || external_id || '","size":' || size || chr(125) END AS value
        FROM manifest""",
    # names in targets' manifest folders, strays among them
    "manifest_name": """
        SELECT target, '2024' || lpad(CAST(1 + seq % 12 AS varchar(20)), 2, '0') || lpad(CAST(1 + seq % 28 AS varchar(20)), 2, '0') || 'T' || lpad(CAST(seq % 24 AS varchar(20)), 2, '0') || '5900.'
               || lpad(CAST(seq AS varchar(20)), 9, '0') || CASE WHEN seq % 7 = 0 THEN 'Z.jsonl.tmp' ELSE 'Z.jsonl' END AS name
        FROM attempt""",
    # what a pass reports of an object, as JSON
    "outcome_record": """
        SELECT external_id, CASE WHEN seq % 13 = 0 THEN NULL WHEN seq % 11 = 0 THEN '[]'
               ELSE '[' || chr(123) || '"target":"' || target || '","state":"' || state || '","bytes":' || stored_bytes || ',"more":1' || chr(125) || ',' || chr(123) || '"target":"d","state":"failed"' || chr(125) || ']' END AS statuses
        FROM attempt""",
    "rule_input": """
        SELECT doc_id AS id, source AS name, coalesce(source, 's') || '/x/' || doc_id || '.jsonl' AS path, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'none' WHEN 2 THEN 'zstd' WHEN 4 THEN 'gzip' END AS codec,
               CASE WHEN doc_id % 2 = 0 THEN '28B52FFD00' ELSE '28B52FFE' END AS head
        FROM documents""",
}
NEEDS = {"led_object": ["corpus_file"], "led_status": ["led_object", "tgt"], "manifest": ["led_status"], "listing": ["led_status"], "manifest_file": ["manifest"], "transfer": ["led_object", "tgt"], "readable": ["led_status"], "manifest_text": ["manifest"],
         "manifest_name": ["attempt"], "outcome_record": ["attempt"]}
_TABLES = {"corpus_file": "documents", "outbox": "events", "attempt": "events", "claim_event": "events", "rule_input": "documents"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; no temporary view is left behind."""
    sources = {n: view(spark, sf_dir, n) for n in NEEDS.get(name, [])}
    text = VIEWS[name].replace("{sha}", "sha2(text, 256)")
    if name in _TABLES:
        found = spark.read.parquet(f"{sf_dir}/{_TABLES[name]}.parquet")
        # the queue's times are points in time, in the session's zone
        sources[_TABLES[name]] = found.withColumns({c: found[c].cast("timestamp") for c, kind in found.dtypes if kind == "timestamp_ntz"})
    for n in sources:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(text, **sources)


def _ordered(names: list[str]) -> list[str]:
    found: list[str] = []
    for n in names:
        found += [x for x in [*_ordered(NEEDS.get(n, [])), n] if x not in found]
    return found


def oracle(query: str, *names: str) -> str:
    """DuckDB text of ``query`` over the views ``names``."""
    parts = [f"{n} AS ({VIEWS[n].replace('{sha}', 'sha256(text)')})" for n in _ordered(list(names))]
    own = query.strip()
    if own.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {own.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {', '.join(parts)}" + (f", {own.removeprefix('WITH ')}" if own.startswith("WITH ") else f"\n{own}")
