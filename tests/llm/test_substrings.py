"""Removal of repeated bytes against brute force."""

import collections
import hashlib
import random

import pytest

from stowage.llm import substrings
from tests.llm.plain import HARD, awkward, empty


def brute(rows, threshold):
    texts = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in texts:
        for p in range(len(b) - threshold + 1):
            g = b[p : p + threshold]
            least[g] = min(i, least.get(g, i))
    out = collections.Counter()
    for (doc, _), (i, b) in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - threshold + 1):
            if least[b[p : p + threshold]] < i:
                gone[p : p + threshold] = b"\1" * threshold
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out[doc, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def found(df):
    return collections.Counter(map(tuple, df.collect()))


def pieces(rng, docs):
    """Documents out of shared and own passages, so that repeats begin and end anywhere, touch and overlap."""
    abc = "ab é日"
    shared = ["".join(rng.choice(abc) for _ in range(rng.randrange(10, 160))) for _ in range(25)] + ["a" * 130, "ab" * 80, " " * 70]
    rows = []
    for i in range(docs):
        parts = [rng.choice(shared) if rng.random() < 0.6 else "".join(rng.choice(abc) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6))]
        rows.append((rng.randrange(docs) if rng.random() < 0.2 else i, "".join(p[rng.randrange(5) :] for p in parts)))
    return rows


@pytest.mark.parametrize("threshold", [50, 20, 33, 120])
def test_equals_brute_force(spark, threshold):
    rows = pieces(random.Random(threshold), 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(substrings.repeats(docs, threshold)) == brute(rows, threshold)


def test_slices_and_chunks_cut_anywhere(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE", 97)
    monkeypatch.setattr(substrings, "CHUNK", 700)
    rows = pieces(random.Random(9), 100)
    assert found(substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 50)


def test_awkward(spark):
    docs = awkward(spark, *enumerate(HARD, 20), (9, "xy " * 30_000), (8, "z" + "xy " * 20_000))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(substrings.repeats(docs)) == brute(rows, 50)
    assert substrings.repeats(empty(spark)).count() == 0
    clashing = docs.selectExpr("doc_id", "text", "1 as `a.b`", "2 as chunk", "3 as n_bytes")
    assert found(substrings.repeats(clashing)) == brute(rows, 50)
    with pytest.raises(ValueError):
        substrings.repeats(docs, 8)
