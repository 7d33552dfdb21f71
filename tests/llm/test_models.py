"""Classifiers on held-out rows and awkward tables, and the pipeline stage by stage."""

import collections
import hashlib
import html
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stowage.llm import language_id, quality, toxicity
from stowage.llm._words import buffers, mix
from tests.llm.plain import awkward, empty, shingles, words
from tests.llm.test_dedup import brute_near
from tests.llm.test_text import restated_targets

DATA = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_quality_on_held_out_rows(spark):
    rows = quality.judge(table(spark, "documents"), table(spark, "labels")).join(table(spark, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all((r.score >= 0.3) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)


def test_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(m, s, (4000, 3)) for m, s in ((0, 1), (1, 2))]
    model = quality.fit_sums(np.array([4000.0, 4000.0]), np.array([a.sum(axis=0) for a in x]), np.array([a.T @ a for a in x]))
    own = [np.linalg.inv(f) @ np.linalg.inv(f).T for f in model.factors]
    at = rng.normal(0, 2, (50, 3))
    logs = [-0.5 * np.einsum("ij,jk,ik->i", at - m, np.linalg.inv(c), at - m) - 0.5 * np.log(np.linalg.det(c)) for m, c in zip(model.means, own)]
    assert np.allclose(model.scores(at), 1 / (1 + np.exp(logs[0] - logs[1])))


def plain_features(text):
    """The 13 statistics by plain Python."""
    data = (text or "").encode()
    own = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, lengths = len(own), [len(w) for w in own]
    share = lambda part, whole: math.log((part + 0.5) / (max(whole - part, 0) + 0.5))
    kind = lambda chars: sum(b in chars for b in data)
    upper, digit, space, stop = set(range(65, 91)), set(range(48, 58)), {32, *range(9, 14)}, set(b".,")
    letter = upper | set(range(97, 123)) | set(range(128, 256))
    mark = set(range(256)) - letter - digit - space - stop
    mean = sum(lengths) / max(n, 1)
    spread = math.sqrt(max(sum(x * x for x in lengths) / max(n, 1) - mean**2, 0))
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in own]
    counts = collections.Counter(low)
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), share(kind(upper), kind(letter)), share(kind(stop), len(data)), share(kind(mark), len(data)), share(kind(digit), len(data)), share(data.count(b"\n"), n),
        share(len(counts), n), share(max(0, n - 1) - len(set(zip(low, low[1:]))), n), share(max(counts.values(), default=0), n), share(sum(w[0] in upper for w in own), n), share(sum(w[-1] in mark for w in own), n),
    ]


def test_quality_equals_plain_features_and_densities(spark):
    docs, labels = table(spark, "documents").limit(300).union(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id > 6 or doc_id is null or text is null")), table(spark, "labels")
    rows = [(r.doc_id, plain_features(r.text)) for r in docs.collect()]
    found = sorted((r.doc_id or -1, r.x) for r in quality.vectors(docs).collect())
    assert np.allclose([x for _, x in found], [x for _, x in sorted((i or -1, x) for i, x in rows)])
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    x = [np.array([v for i, v in rows if known.get(i) == c]) for c in (0, 1)]
    n, d = [len(a) for a in x], 13
    own = [np.cov(a.T, bias=True) for a in x]
    pooled = sum(k * c for k, c in zip(n, own)) / sum(n)
    logs = []
    for a, k, cov in zip(x, n, own):
        w = k / (k + 10 * d)
        cov = 0.95 * (w * (0.9 * cov + 0.1 * pooled) + (1 - w) * pooled) + 0.05 * np.diag(np.maximum(np.diag(pooled), 1e-3))
        logs.append(lambda v, m=a.mean(axis=0), c=cov, k=k: math.log((k + 1) / (sum(n) + 2)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (v - m) @ np.linalg.solve(c, v - m))
    want = sorted((i or -1, 1 / (1 + math.exp(np.clip(logs[0](np.array(v)) - logs[1](np.array(v)), -60, 60)))) for i, v in rows)
    scored = sorted((r.doc_id or -1, r.score) for r in quality.judge(docs, labels).collect())
    assert [i for i, _ in scored] == [i for i, _ in want] and np.allclose([s for _, s in scored], [s for _, s in want], atol=1e-6)


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    docs = awkward(spark)
    found = quality.judge(docs, labels)
    assert found.count() == docs.count() and found.where("score is null or isnan(score)").count() == 0
    assert quality.judge(empty(spark), labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).where("score between 0 and 1").count() == docs.count()


def test_toxicity_finds_labelled_rows(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rows = toxicity.judge(docs, labels).withColumnRenamed("toxic", "said").join(labels, "doc_id").collect()
    assert np.mean([r.said for r in rows if r.toxic]) > 0.75 and np.mean([not r.said for r in rows if not r.toxic]) > 0.99
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == toxicity.judge(docs, labels).where("not toxic").count()


def test_toxicity_on_held_out_rows(spark):
    # a third of sf0.1's labels; sf0.01 has too few toxic ones to learn from
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels.where("crc32(cast(doc_id as string)) % 3 <> 0"))
    rows = toxicity.score(docs, chain).withColumnRenamed("toxic", "said").join(labels.where("crc32(cast(doc_id as string)) % 3 = 0"), "doc_id").collect()
    assert len(rows) > 1000 and np.mean([r.said for r in rows if r.toxic]) > 0.85 and np.mean([not r.said for r in rows if not r.toxic]) > 0.99


def plain_terms(text):
    """Words, then their beginnings of 4 and 5 bytes, then runs of 6 bytes inside words, each in text order."""
    found = [bytes(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))]
    starts = [("begin", w[:n]) for n in (4, 5) for w in found if len(w) >= n]
    return [*(("word", w) for w in found), *starts, *(("run", w[i : i + 6]) for w in found for i in range(len(w) - 5))]


def restated_logistic(x, y):
    x = np.array([[*row, 1.0] for row in x])
    w, shrink = np.zeros(x.shape[1]), np.array([0.3] * (x.shape[1] - 1) + [1e-6])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve(x.T @ np.diag(p * (1 - p) + 1e-6) @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
    return w


def restated_chain(rows, names):
    """p of each category for rows (doc_id, text, label or None), by dictionaries; names: the number of each term, which breaks ties."""
    terms = {i: collections.Counter(plain_terms(t)) for i, t, _ in rows}
    known = [(i, y, zlib.crc32(f"fold{i}".encode()) % 5) for i, _, y in rows if y is not None]

    def groups(without):
        own = [(i, y) for i, y, f in known if f != without]
        n = [sum(y == 1 for _, y in own), sum(y == 0 for _, y in own)]
        seen = collections.defaultdict(lambda: [0, 0])
        for i, y in own:
            for t in terms[i]:
                seen[t][1 - y] += 1
        scores = []
        for t, (bad, good) in seen.items():
            if bad + good >= 5 and bad * n[1] > good * n[0]:
                cells = [(bad, n[0], bad + good), (good, n[1], bad + good), (n[0] - bad, n[0], sum(n) - bad - good), (n[1] - good, n[1], sum(n) - bad - good)]
                scores.append((-sum(a * math.log(a / (b * c / sum(n))) for a, b, c in cells if a), names[t], t, bad >= 5 and bad >= 0.9 * (bad + good)))
        best = sorted(scores)[:300]
        rows = [{i for i, y in own if y == 1 and terms[i][t]} for _, _, t, _ in best]
        alike = [[round(len(a & b) / math.sqrt(len(a) * len(b)), 9) for b in rows] for a in rows]
        other = min(range(len(best)), key=lambda j: (alike[0][j], j))
        part = [int(alike[other][j] > alike[0][j]) for j in range(len(best))]
        for _ in range(20):
            like = lambda j, g: round(sum(alike[j][i] for i in range(len(best)) if part[i] == g) / max(1, part.count(g)), 9)  # noqa: B023, E731
            if part == (moved := [int(like(j, 1) > like(j, 0)) for j in range(len(best))]):
                break
            part = moved
        return [*([(t, m) for (_, _, t, m), g in zip(best, part, strict=True) if g == k] for k in range(2)), [(t, m) for _, _, t, m in best]]

    def ordered(gs, like):
        common = lambda a, b: len({t for t, _ in a} & {t for t, _ in b})
        swap = common(gs[1], like[0]) + common(gs[0], like[1]) > common(gs[0], like[0]) + common(gs[1], like[1])
        return [gs[1], gs[0], gs[2]] if swap else gs

    def see(i, group):
        marks = sum(terms[i][t] for t, m in group if m)
        return [*(math.log1p(terms[i][t]) for t, _ in group), math.log1p(marks), float(marks > 0)]

    every = groups(None)
    without = [ordered(groups(f), every) for f in range(5)]
    wanted = lambda gs, k, i, y: float(y == 1 and (k == 2 or any(terms[i][t] for t, _ in gs[k])))
    unseen, said = {i: [] for i, _, _ in known}, {i: [] for i in terms}
    for k in range(3):
        w = restated_logistic([see(i, every[k]) + unseen[i] for i, _, _ in known], [wanted(every, k, i, y) for i, y, _ in known])
        out = {}
        for f in range(5):
            v = restated_logistic([see(i, without[f][k]) + unseen[i] for i, _, g in known if g != f], [wanted(without[f], k, i, y) for i, y, g in known if g != f])
            out |= {i: 1 / (1 + math.exp(-(np.dot(see(i, without[f][k]) + unseen[i], v[:-1]) + v[-1]))) for i, _, g in known if g == f}
        for i in out:
            unseen[i] = unseen[i] + [out[i]]
        for i in said:
            said[i] = said[i] + [1 / (1 + math.exp(-(np.dot(see(i, every[k]) + said[i], w[:-1]) + w[-1])))]
    return said


def test_toxicity_equals_a_chain_of_dictionaries(spark):
    rng = random.Random(6)
    bad, good = ["grobian", "scumbag", "vermin", "Dummkopf", "idiotic", "trash"], ["harbour", "Ünïcode", "meadow", "letter", "x1", "candle", "of", "river-bank"]
    rows = []
    for i in range(150):
        toxic = i % 3 == 0
        text = " ".join(rng.choice(bad if toxic and rng.random() < 0.25 or rng.random() < 0.01 else good) for _ in range(rng.randrange(1, 30)))
        rows.append((i, text, int(toxic) if i % 10 else None))
    hashes, row = toxicity.terms_of(*buffers(pa.array([" ".join(sorted({w for _, t, _ in rows for w in t.split()}))])))
    plain = plain_terms(" ".join(sorted({w for _, t, _ in rows for w in t.split()})))
    names = dict(zip(plain, hashes.view(np.int64).tolist(), strict=True))
    assert len(set(names.values())) == len(names) and not row.any()
    want = restated_chain(rows, names)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    found = toxicity.judge(docs, spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")).collect()
    for r in found:
        assert [r.p_group_1, r.p_group_2, r.p_toxic] == pytest.approx(want[r.doc_id], abs=1e-4)
        assert r.toxic == (r.p_toxic >= 0.5)
    assert sum(r.toxic for r in found) > 30


def test_clusters_of_terms():
    # rows 0 to 3 hold terms 0 and 2, rows 4 to 7 terms 1 and 3, row 8 all of them
    seen = np.array([[1, 0, 1, 0]] * 4 + [[0, 1, 0, 1]] * 4 + [[1, 1, 1, 1]], bool)
    assert toxicity.clusters(seen, 2).tolist() == [0, 1, 0, 1]
    assert toxicity.clusters(seen[:, :1], 2).tolist() == [0]
    assert toxicity.clusters(np.zeros((0, 3), bool), 2).tolist() == [0, 0, 0]


def test_rows_of_one_id_are_told_apart(spark):
    docs, labels = table(spark, "documents").select("doc_id", "text"), table(spark, "labels")
    marked = toxicity.judge(docs, labels)
    bad, fine = docs.join(marked.where("toxic"), "doc_id").first(), docs.join(marked.where("not toxic"), "doc_id").first()
    odd = docs.union(spark.createDataFrame([(bad.doc_id, fine.text), (None, bad.text), (None, None)], "doc_id long, text string")).withColumn("key", F.lit(1)).withColumn("toxic", F.lit(True))
    kept = toxicity.clean(odd, labels)
    assert kept.columns == odd.columns and kept.where(F.col("doc_id") == bad.doc_id).count() == 1 and kept.where("doc_id is null").count() == 1


def test_toxicity_awkward(spark):
    docs, labels = awkward(spark), spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.judge(docs, labels).count() == docs.count()
    assert toxicity.judge(docs, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.judge(empty(spark), labels).count() == 0 and toxicity.clean(empty(spark), labels).count() == 0


def test_languages_of_pages(spark):
    pages = table(spark, "pages")
    rows = language_id.identify(pages, table(spark, "documents")).collect()
    assert len(rows) == pages.count()
    assert np.mean([r.lang == r.declared for r in rows]) > 0.9 and np.mean([r.text_lang == r.lang for r in rows]) > 0.9


def test_other_evidence_decides_short_pages(spark):
    docs = spark.createDataFrame([("the of and to in that is was " * 30, "en"), ("der die und zu den das ist ein " * 30, "de")], "text string, lang string")
    german = [(n, "http://a.beispiel.de/x", '<html lang="de">der und die das ist zu den ein der die</html>') for n in range(30)]
    english = [(100 + n, "http://b.sample.com/x", '<html lang="en">the of and to in that is was</html>') for n in range(30)]
    odd = [(200, "http://a.beispiel.de/y", '<html lang="de"></html>'), (201, "http://b.sample.com/y", ""), (202, None, None), (None, "http://b.sample.com/z", "")]
    pages = spark.createDataFrame(german + english + odd + odd[:1], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    found = {r.page_id: r for r in language_id.identify(pages, docs).collect()}
    assert found[200].lang == "de" and found[201].lang == "en" and found[None].lang == "en" and found[202].lang in ("de", "en") and found[3].lang == "de"
    assert language_id.identify(pages.limit(0), docs).count() == 0
    assert language_id.identify(pages, docs.limit(0)).where("lang = 'und'").count() == pages.count()


def plain_visible(page):
    return html.unescape(re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", page, flags=re.DOTALL | re.IGNORECASE))


def test_markup_goes_in_one_pass():
    rng = random.Random(9)
    parts = ["<", ">", "<!--", "-->", "<script>", "</script>", "</SCRIPT  >", "<style a=1>", "</style>", "<b class=x>", "text", " ", "&amp;", "\n", "<scripts>", "<Script"]
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert language_id.visible(page) == plain_visible(page), page
    for part in ("<script ", "<!-- ", "<style>", "</script ", "<", "<html ", "<a>"):
        began = time.perf_counter()
        language_id.visible(part * (4_000_000 // len(part)))
        assert time.perf_counter() - began < 10


def restated_languages(pages, docs):
    """lang and confidence of (page_id, url, html) by dictionaries, from documents (text, lang)."""
    def runs(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode())
        return [low[i : i + 3] for i in range(len(low) - 2) if low[i : i + 3] != b"   "]

    bucket = lambda run: int(mix(np.array([int.from_bytes(run, "little")], np.uint64))[0]) % (1 << 15)
    langs = sorted({lang for _, lang in docs})
    counts = {lang: collections.Counter(bucket(r) for t, own in docs if own == lang for r in runs(t)) for lang in langs}
    sizes = {lang: sum(counts[lang].values()) + 0.5 * (1 << 15) for lang in langs}
    normal = lambda logs: [math.exp(x - max(logs)) / sum(math.exp(y - max(logs)) for y in logs) for x in logs]
    rows = []
    for i, url, page in pages:
        said = [0.3 * sum(math.log((counts[lang][bucket(r)] + 0.5) / sizes[lang]) for r in runs(plain_visible(page or ""))) for lang in langs]
        said = [max(x - max(said), -40.0) for x in said]
        host = (re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", url or "") or ["", ""])[1].lower()
        declared = (re.search(r"(?i)<html[^<>]*\blang\s*=\s*[\"']?([a-z]+)", page or "") or ["", ""])[1].lower()
        keys = {"host": host, "domain": (re.search(r"([^.]+\.[^.]+)$", host) or ["", ""])[1], "suffix": (re.search(r"([^.]+)$", host) or ["", ""])[1], "declared": declared}
        rows.append((i, said, normal(said), keys))
    total = [sum(p[k] for _, _, p, _ in rows) for k in range(len(langs))]
    overall = [(t + 1) / (sum(total) + len(langs)) for t in total]
    found = []
    for i, said, p, keys in rows:
        others = {key: [sum(q[k] for _, _, q, other in rows if other[key] == keys[key]) - p[k] for k in range(len(langs))] for key in keys}
        smooth = lambda own, prior, n: [(max(c, 0) + n * q) / (max(sum(own), 0) + n) for c, q in zip(own, prior)]
        prior = smooth(others["host"], smooth(others["domain"], overall, 20), 10)
        given = lambda key: [(max(c, 0) + 2 * max(sum(others[key]) / (sum(total) + 1), 1e-6)) / (t + 1 + 2) for c, t in zip(others[key], total)]
        post = [s + math.log(q) for s, q in zip(said, prior)]
        if keys["declared"]:
            post = [x + math.log(g) for x, g in zip(post, given("declared"))]
        if keys["host"]:
            post = [x + 0.5 * math.log(g) for x, g in zip(post, given("suffix"))]
        post = normal(post)
        found.append((i, langs[post.index(max(post))], max(post)))
    return found


def test_languages_equal_fused_dictionaries(spark):
    rng = random.Random(4)
    vocabulary = {"de": "der die und zu den das ist ein über".split(), "en": "the of and to in that is was from".split(), "fr": "le la les et un une dans été sur".split()}
    docs = [(" ".join(rng.choices(w, k=60)), lang) for lang, w in vocabulary.items() for _ in range(3)]
    pages = []
    for i in range(60):
        lang = rng.choice(list(vocabulary))
        text = " ".join(rng.choices(vocabulary[lang], k=rng.choice([0, 1, 3, 12])))
        html_ = rng.choice([f'<html lang="{rng.choice([lang, "en"])}"><!-- x --><b>{text}</b></html>', f"<p>{text}", text])
        pages.append((i, rng.choice([f"https://{rng.choice('ab')}.{lang}-site.{rng.choice([lang, 'com'])}/x", f"http://u:p@h.org:80/{i}", "nonsense", None]), html_))
    found = language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "text string, lang string")).collect()
    want = {i: (lang, c) for i, lang, c in restated_languages(pages, docs)}
    for r in found:
        assert r.lang == want[r.page_id][0] and r.confidence == pytest.approx(want[r.page_id][1])


def test_pipeline_awkward_and_empty(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    for name, docs in (("awkward", awkward(spark)), ("empty", empty(spark))):
        folder = str(tmp_path / name)
        docs.select(*columns).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        plain = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
        assert {r.decoded_sha256 for r in rows} <= plain and (len(rows) > 0) == (name == "awkward")


def test_pipeline_by_stage(spark, tmp_path):
    docs = table(spark, "documents")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = (before, docs.collect())
        assert name == "byte_bpe" or docs.columns == columns
    before, after = rows["toxicity"]
    assert 0.8 * len(before) < len(after) < len(before)
    before, after = rows["exact_dedup"]
    assert {r.text: r.doc_id for r in after} == {t: max(r.doc_id for r in before if r.text == t) for t in {r.text for r in before}} and len(after) == len({r.text for r in before})
    before, after = rows["near_dup"]
    ids = {r.doc_id for r in after}
    for r in before:
        if r.doc_id not in ids:
            own = shingles(r.text, 5)
            assert any(100 * len(own & s) >= 80 * len(own | s) for o in before if o.doc_id != r.doc_id for s in [shingles(o.text, 5)])
    before, after = rows["mixing"]
    size = sum(len(words(r.text)) for r in before)
    assert abs(sum(len(words(r.text)) for r in after) - size) < 0.05 * size
    before, after = rows["byte_bpe"]
    assert sorted(r.decoded_sha256 for r in after) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in before)


def restated_copies(rows):
    """How often the mix takes each of the rows (doc_id, text, source), by the order of their keys in each source."""
    sources = collections.defaultdict(list)
    for i, t, s in rows:
        sources[s].append((hashlib.md5(f"0:{i}".encode()).hexdigest()[:13], i, len(words(t))))
    sizes = {s: sum(n for _, _, n in own) for s, own in sources.items()}
    copies = {}
    for s, target in restated_targets(sizes).items():
        epochs, run = int(target // sizes[s]), 0
        for _, i, n in sorted(sources[s]):
            copies[i, s] = epochs + (epochs < 3 and run + n / 2 <= target - epochs * sizes[s])
            run += n
    return collections.Counter({k: n for k, n in copies.items() if n})


def test_pipeline_keeps_one_of_every_component_and_mixes_by_source(spark, tmp_path):
    stages, docs = dict(corpus_pipeline.STAGES), table(spark, "documents")
    before = docs.collect()
    roots = brute_near([(r.doc_id, r.text) for r in before], 5, 80)
    stages["near_dup"](spark, docs, DATA).write.parquet(str(tmp_path / "near"))
    docs = spark.read.parquet(str(tmp_path / "near"))
    after = docs.collect()
    assert sorted(r.doc_id for r in after) == sorted(i for i, root in roots.items() if i == root) and len(after) < len(before)
    mixed = collections.Counter((r.doc_id, r.source) for r in stages["mixing"](spark, docs, DATA).collect())
    assert mixed == restated_copies([(r.doc_id, r.text, r.source) for r in after])


def test_languages_beyond_the_most_frequent_are_one(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    rows = [(n, "le chat est la", "fr") for n in range(5)] + [(n, "the cat is here", "en") for n in range(4)] + [(n, f"junk {n} zzz", f"x{n}") for n in range(9)]
    langs, logs = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["en", "fr", "und"] and logs.shape == (3, language_id.BUCKETS)
    pages = spark.createDataFrame([(1, "", "<p>le chat est la"), (2, "", "the cat is here")], "page_id long, url string, html string")
    assert {r.page_id: r.text_lang for r in language_id.identify(pages, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {1: "fr", 2: "en"}
