"""Pages and ranges of an indexed manifest against the whole of it, and the blocks that they read."""

import hashlib

from stowage.sources import manifest_index


def test_ranges_and_pages_read_only_what_overlaps(spark, tmp_path):
    ids = sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(500))
    folder = str(tmp_path / "m")
    manifest_index.write(spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "external_id string, size long").repartition(5), folder, lines=20)
    blocks = manifest_index.index(spark, folder).orderBy("block").collect()
    assert sum(b.lines for b in blocks) == 500 and all(b.lines <= 20 for b in blocks) and all(a.last < b.first for a, b in zip(blocks, blocks[1:]))
    assert [b.line_offset for b in blocks] == [sum(x.lines for x in blocks[:k]) for k in range(len(blocks))]
    body = b"".join(open(f, "rb").read() for b in blocks for f in sorted(map(str, (tmp_path / "m" / "blocks" / f"block={b.block}").glob("*.txt"))))
    for b in blocks:  # offsets are those of the blocks one after the other
        assert body[b.byte_offset : b.byte_offset + b.bytes].count(b"\n") == b.lines and b.first.encode() in body[b.byte_offset : b.byte_offset + 90]
    read = lambda df: [r.external_id for r in df.orderBy("external_id").collect()]
    files = lambda df: len({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    for low, high in ((None, None), (ids[37], ids[61]), (ids[499], None), (None, ids[0]), ("0", "00"), (ids[3] + "x", ids[4])):
        found = manifest_index.read_range(spark, folder, "t", low, high)
        assert read(found) == [i for i in ids if (low is None or i > low) and (high is None or i <= high)]
        overlap = sum((low is None or b.last > low) and (high is None or b.first <= high) for b in blocks)
        assert (files(found) if overlap else 0) == overlap
    for after, n in (("", 7), (ids[30], 25), (ids[490], 100), (ids[499], 5), (ids[19], 20)):
        page = manifest_index.read_page(spark, folder, "t", after, n)
        assert read(page) == [i for i in ids if i > after][:n]
    assert files(manifest_index.read_page(spark, folder, "t", ids[100], 10)) <= 4 < len(blocks)


def test_empty_manifest(spark, tmp_path):
    folder = str(tmp_path / "m")
    manifest_index.write(spark.createDataFrame([], "external_id string, size long"), folder)
    assert manifest_index.index(spark, folder).count() == 0 == manifest_index.read_range(spark, folder, "t").count()
