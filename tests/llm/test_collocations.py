"""Collocations against a plain count of all phrases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stowage.llm import collocations
from stowage.llm._ask import LOW
from tests.llm.plain import awkward, empty


def brute(rows, least, top):
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            counts[lang].update(tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, words[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def some(seed, docs):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "of", "new", "york", "city", "Ünï", "日本", "a", "b-c", "x y", "d'e"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for _ in range(docs):
        words = [rng.choice(vocabulary[: 3 + rng.randrange(10)]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text + (passage if rng.random() < 0.3 else "")))
    return rows


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("least", "top", "pack"), [(5, 2000, 4 << 20), (12, 7, 2000)])
def test_equals_brute_force(spark, monkeypatch, least, top, pack):
    monkeypatch.setattr(collocations, "PACK", pack)
    rows = some(least, 250)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert found(collocations.collocations(docs, least, top)) == brute(rows, least, top)


def test_awkward(spark):
    docs = awkward(spark, *((100 + n, "New York. new york city " * n) for n in range(12)))
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert found(collocations.collocations(docs)) == brute(rows, 30, 2000)
    clashing = docs.selectExpr("text", "lang", "1 as `a.b`", "2 as rank", "3 as chunk", "4 as phrase")
    assert found(collocations.collocations(clashing, 3)) == brute(rows, 3, 2000)
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(docs.where("text is null or text = ''")).count() == 0


def test_counts_past_64_bits(spark):
    found = spark.sql("select (2000000 * cast(9000000000000000000 as decimal(19,0))) div (cast(9000000000000000000 as decimal(19,0)) + cast(9000000000000000001 as decimal(19,0))) as s").first()
    assert found.s == 2_000_000 * 9_000_000_000_000_000_000 // 18_000_000_000_000_000_001


def test_rounds_parse_no_text_again(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd") + rng.choice([" ", " ", " ", ", "]) for _ in range(200)) for _ in range(40)]
    parsed = pa.Table.from_batches(collocations._parsed([pa.record_batch({"lang": ["en"] * 40, "text": texts})]))
    chunks = parsed.group_by(["lang", "body", "own"]).aggregate([([], "count_all")]).rename_columns(["lang", "body", "own", "freq"]).combine_chunks()
    (row,) = [r for batch in collocations._packed(chunks.to_batches()) for r in batch.to_pylist()]
    row["chunk"] = 0
    again = []
    for name in ("word_hashes", "_word_bounds"):
        monkeypatch.setattr(collocations, name, lambda *_, real=getattr(collocations, name), name=name: again.append(name) or real(*_))
    counting, said = collocations.Counting(1, 30), {}
    for n in range(1, 5):
        codes, more, counts = counting.question(n)(row)
        said[n] = counting.answer(np.zeros(len(codes), np.int64), codes & LOW, more, counts)
        counting.replies.append(type("Told", (), {"of": lambda self, chunk, n=n: said[n]})())
    found = {(phrase, a) for _, phrase, size, a in zip(*pa.Table.from_batches(counting.phrases([pa.RecordBatch.from_pylist([row])])).to_pydict().values(), strict=True) if size}
    count = collections.Counter()
    for text in texts:
        for piece in text.split(","):
            w = piece.split()
            count.update(" ".join(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    assert found == {(p, a) for p, a in count.items() if a >= 30}
    assert any(p.count(" ") == 2 for p, _ in found)
    assert again == []


@pytest.mark.parametrize("most", [3, 1000, (1 << 64) - 1])
def test_numbered(most):
    rng = np.random.default_rng(most % 7)
    keys = rng.integers(0, most, 500, np.uint64, endpoint=True)
    keys[100:200] = keys[:100]
    first, group = collocations._numbered(keys)
    own, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    assert (first == at).all() and (group == inverse).all() and (keys[first] == own).all()
    assert [len(x) for x in collocations._numbered(keys[:0])] == [0, 0]
