"""Whole passes on small tables, case by case."""

import datetime

from pyspark.sql import functions as F

from stowage.operators import passes
from stowage.sources import manifests

FILES = "id long, external_id string, size long, temporary_location boolean"
STATUS = "external_id string, target string, state string, stored_bytes long, verified_at timestamp"
TRANSFERS = "external_id string, target string, ok boolean, stored_bytes long, gone boolean, down boolean"
AT = datetime.datetime(2024, 1, 15)
H = [f"{n:064x}" for n in range(9)]


def test_backup_case_by_case(spark):
    files = spark.createDataFrame([(n, h, 5, None) for n, h in enumerate(H)] + [(20, H[0], None, False), (21, "../up", 1, None), (22, H[8], 1, True), (23, "", 1, None)], FILES)
    status = spark.createDataFrame([(H[0], t, "stored", 5, AT) for t in "ab"] + [(H[1], "a", "stored", 5, AT), (H[2], "a", "failed", 0, None)], STATUS)
    sent = [
        (H[2], "a", True, 7, None, None), (H[3], "a", False, None, None, True), (H[4], "a", False, 0, False, False), (H[5], "a", False, 0, True, False), (H[7], "b", True, 5, None, None),
        (H[0], "a", False, 0, None, None), (None, "a", True, 1, None, None),
    ]
    transfers = spark.createDataFrame(sent, TRANSFERS)
    found = passes.backup_outcomes(files, status, transfers, ["a"])
    got = {r.external_id: (r.outcome, r.files, [tuple(s) for s in r.statuses]) for r in found.collect()}
    assert got == {
        H[0]: ("backed", 2, []), H[1]: ("backed", 1, []), H[2]: ("backed", 1, [("a", "stored", 7)]), H[3]: ("deferred", 1, []), H[4]: ("failed", 1, [("a", "failed", 0)]),
        H[5]: ("skipped", 1, []), H[6]: ("failed", 1, []), H[7]: ("failed", 1, []), H[8]: ("failed", 1, []), "../up": ("failed", 1, []),
    }
    after = {(r.external_id, r.target): r.state for r in passes.recorded(found, status, F.lit(AT)).collect()}
    assert after == {(H[0], "a"): "stored", (H[0], "b"): "stored", (H[1], "a"): "stored", (H[2], "a"): "stored", (H[4], "a"): "failed"}
    # the same pass again finds what it recorded
    again = passes.backup_outcomes(files, passes.recorded(found, status, F.lit(AT)), transfers, ["a"])
    assert {r.external_id: r.outcome for r in again.collect()} == {k: v[0] for k, v in got.items()}
    counts = {r.target: tuple(r)[1:] for r in passes.target_counts(found, ["a", "z"]).collect()}
    assert counts == {"a": (1, 1, 2, 7), "z": (0, 0, 0, 0)}
    down = passes.backup_outcomes(files, status, transfers, ["a", "b"], ["b"])
    assert {r.external_id: r.outcome for r in down.collect() if r.external_id in H[:3]} == {H[0]: "backed", H[1]: "deferred", H[2]: "deferred"}
    assert {r.outcome for r in passes.backup_outcomes(files, status, transfers, []).collect()} == {"failed"}


def test_backup_of_nothing(spark):
    empty = passes.backup_outcomes(spark.createDataFrame([], FILES), spark.createDataFrame([], STATUS), spark.createDataFrame([], TRANSFERS), ["a"])
    assert empty.count() == 0
    assert {k: tuple(passes.run_result(empty, k).first()) for k in passes.FAILS} == {"backup": (0, 0, True), "repair": (0, 0, True), "restore": (0, 0, False), "drill": (0, 0, False)}


def test_repair_case_by_case(spark):
    gaps = spark.createDataFrame(
        [(H[0], ["a", "b"], ["a", "b"]), (H[1], ["a"], ["a"]), (H[2], [], []), (H[3], ["a", "b"], ["b", "a"]), (H[4], ["a"], ["a"])], "external_id string, stored_on array<string>, sources array<string>"
    )
    readable = spark.createDataFrame([(H[0], "b"), (H[3], "a"), (H[3], "b"), (H[4], "a"), (H[2], "a")], "external_id string, target string")
    transfers = spark.createDataFrame([(H[0], "c", True, 3, None, None), (H[3], "c", False, 0, None, None), (H[4], "b", True, 3, None, None), (H[4], "c", True, 3, None, None)], TRANSFERS)
    found = passes.repair_outcomes(gaps, readable, transfers, ["a", "b", "c"])
    got = {r.external_id: (r.source, r.outcome, len(r.statuses)) for r in found.collect()}
    assert got == {H[0]: ("b", "repaired", 1), H[1]: (None, "failed", 0), H[2]: (None, "skipped", 0), H[3]: ("b", "failed", 1), H[4]: ("a", "repaired", 2)}
    assert tuple(passes.run_result(found, "repair").first()) == (5, 3, False)
    assert tuple(passes.run_result(found.where("outcome = 'skipped'"), "repair").first()) == (1, 1, False)


def test_record_set_of_odd_arrays(spark):
    rows = [("x", None), ("y", "[]"), ("z", '[{"target":"a","more":[1]},{"target":null,"state":"failed","bytes":9223372036854775807}]')]
    found = passes.record_set(spark.createDataFrame(rows, "external_id string, statuses string"))
    assert sorted(map(tuple, found.collect()), key=str) == [("z", "a", None, None), ("z", None, "failed", 2**63 - 1)]


def test_manifest_export_and_newest(spark, tmp_path):
    objects = spark.createDataFrame([("bb", 2), ("aa", 1)], "external_id string, size long")
    names = [manifests.export(objects, f"file://{tmp_path}", AT.replace(tzinfo=datetime.timezone.utc), n) for n in (5, 7)]
    assert (tmp_path / "_manifest" / "LATEST").read_text() == names[1] == max(names)
    listed = spark.createDataFrame([("t", n) for n in [*names, names[0], "LATEST", "x" + names[1], None]], "target string, name string")
    assert [tuple(r) for r in manifests.newest(listed).collect()] == [("t", names[1])]
    gone = spark.createDataFrame([("t", names[1])], "target string, name string")
    assert [tuple(r) for r in manifests.newest(listed, gone).collect()] == [("t", names[0])]
    assert manifests.newest(listed.where("name = 'LATEST'")).count() == 0
    read = manifests.read_manifest(spark, f"file://{tmp_path}/_manifest/{names[1]}", "t")
    assert sorted(r.external_id for r in read.collect()) == ["aa", "bb"]


def test_manifest_lines_of_odd_kinds(spark):
    lines = [" ", '{"externalID":NaN}', '{"externalID":"x","EXTERNALID":"y"}', '{"externalID":"x","externalid":null}', '{"externalID":""}', "[" * 100_000, None]
    found = manifests.scan_lines(spark.createDataFrame([("t", v) for v in lines], "target string, value string").coalesce(1)).collect()
    assert [(r.external_id, r.corrupt) for r in found] == [(None, True), (None, True), ("y", False), ("x", False), (None, True)]


def test_payloads_told_by_their_hash(spark):
    import hashlib

    import zstandard

    from stowage.functions import payloads

    pack, sha = zstandard.compress, lambda b: hashlib.sha3_256(b).hexdigest()
    rows = [
        (0, b"text", sha(b"text")), (1, pack(b"text"), sha(b"text")), (2, pack(b"text"), sha(pack(b"text"))), (3, pack(b"text") + pack(b" more"), sha(b"text more")), (4, b"", sha(b"")),
        (5, pack(b"x" * 5000)[:-3], sha(b"x" * 5000)), (6, b"\x28\xb5\x2f\xfd no", sha(b"\x28\xb5\x2f\xfd no")), (7, b"other", sha(b"text")), (8, None, sha(b"")), (9, pack(b"y" * 5000), sha(b"y" * 5000)), (10, b"text", None),
    ]
    table = spark.createDataFrame(rows, "n int, payload binary, digest string")
    got = {r.n: (r.found.codec, r.found.ok, r.found.size) for r in table.select("n", payloads.told(F.col("payload"), F.col("digest"), 4000).alias("found")).collect()}
    bad = (None, False, None)
    assert got == {0: ("none", True, 4), 1: ("zstd", True, 4), 2: ("none", True, len(pack(b"text"))), 3: ("zstd", True, 9), 4: ("none", True, 0), 5: bad, 6: ("none", True, 7), 7: bad, 8: bad, 9: bad, 10: bad}
    put = table.select("n", *(payloads.packed(F.col("payload"), F.lit(c)).alias(f"c{i}") for i, c in enumerate(["", "none", "zstd", "gzip", None])))
    for r in put.collect():
        raw = rows[r.n][1]
        assert r.c0 == r.c1 == r.c4 == raw and r.c3 is None and (r.c2 is None if raw is None else zstandard.ZstdDecompressor().decompress(r.c2, max_output_size=10_000) == raw)
    assert table.limit(0).select(payloads.told(F.col("payload"), F.col("digest")).alias("found")).count() == 0


def test_lines_are_one_object_each_and_stay_in_the_jvm(spark):
    from stowage.sources.manifests import LINE_BYTES, scan_lines

    nothing, corrupt = (None, False), (None, True)
    lines = {
        "": nothing, "null": nothing, " null ": nothing, "{}": nothing, '{"externalID":"a"}': ("a", False), '{"ExternalID":"b","size":1}': ("b", False), '{"externalID":"a","EXTERNALID":"c"}': ("c", False),
        '{"EXTERNALID":"c","externalID":"a"}': ("a", False), '{"externalID":"a","externalID":"z"}': ("z", False), '{"externalID":5}': corrupt, '{"externalID":null}': nothing, '{"externalID":"a","ExternalId":null}': ("a", False),
        '{"externalID":""}': nothing, "[]": corrupt, '[{"externalID":"a"}]': corrupt, "1": corrupt, '"x"': corrupt, '{"externalID":"a"} x': corrupt, '{"externalID":"a"},{"externalID":"b"}': corrupt, '{"externalID":"a"}]': corrupt,
        "{'externalID':'a'}": corrupt, '{"externalID":"a","n":NaN}': corrupt, '{"externalID":"a","n":[1,{"externalID":"q"}]}': ("a", False), '{"externalID":{"externalID":"q"}}': corrupt, '{"externalID":true}': corrupt, '{"externalID":"a"': corrupt,
        "garbage": corrupt, '{"externalID":"\\u00e9"}': ("é", False), '{"n":01}': corrupt, '{"externalID":"a",}': corrupt, '  {"externalID":"a"}  ': ("a", False), '{"externalID":"5"}': ("5", False), '{"\\u0065xternalID":"esc"}': ("esc", False),
        '{"externalID":"a","n":"' + "x" * LINE_BYTES + '"}': corrupt, '{"externalID":["a"]}': corrupt, "nullx": corrupt, "  ": corrupt,
    }
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(lines)] + [("none", None)], "target string, value string")
    scanned = scan_lines(df)
    found = {int(r.target): (r.external_id, r.corrupt) for r in scanned.collect()}
    assert {line: found.get(i, nothing) for i, line in enumerate(lines)} == lines
    assert "Python" not in scanned._jdf.queryExecution().executedPlan().toString()


def test_counters_are_filled_while_outcomes_are_written(spark, tmp_path):
    from stowage.functions.metrics import Counted

    schema = "external_id string, statuses array<struct<target: string, state: string, bytes: bigint>>, held array<string>"
    rows = [("x", [("a", "stored", 5), ("b", "failed", 0)], ["c"]), ("y", [("a", "stored", 7)], ["b", "c"]), ("z", [], [])]
    counted = Counted(spark.createDataFrame(rows, schema).repartition(3), "abcd")
    counted.observed.write.parquet(str(tmp_path / "outcomes"))
    assert sorted(map(tuple, counted.by_target().collect())) == [("a", 2, 0, 0, 12), ("b", 0, 1, 1, 0), ("c", 0, 0, 2, 0), ("d", 0, 0, 0, 0)]
    empty = Counted(spark.createDataFrame([], schema), "a")
    empty.observed.write.parquet(str(tmp_path / "none"))
    assert list(map(tuple, empty.by_target().collect())) == [("a", 0, 0, 0, 0)]
