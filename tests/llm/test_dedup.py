"""Exact and near deduplication against brute force."""

import collections
import hashlib
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from stowage.llm import components, exact_dedup, near_dup
from tests.llm.plain import HARD, awkward, empty, shingles

DATA = "/root/testdata/sf0.001"


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = collections.Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = False
        for i in ids:
            now = i == keep and not kept
            kept |= now
            out[i, keep, len(ids), now, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def found_exact(df):
    return collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_exact_awkward(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found_exact(exact_dedup.exact_dedup(docs)) == brute_exact(rows)
    kept = exact_dedup.distinct_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t in rows})
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_looks_at_the_bytes_where_digests_clash(spark):
    docs = awkward(spark, *((100 + n, f"text {n % 7}") for n in range(30)))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    weak = lambda t: F.encode((F.length(t) % 2).cast("string"), "UTF-8")
    assert found_exact(exact_dedup.exact_dedup(docs, digest=weak)) == brute_exact(rows)


def test_exact_in_many_batches(spark):
    docs = awkward(spark, *((100 + n, f"text {n % 7}") for n in range(30))).repartition(6)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found_exact(exact_dedup.exact_dedup(docs, batch_bytes=1)) == brute_exact(rows)


def test_exact_state_is_read_by_later_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "scratch", lambda spark, label: f"{tmp_path}/{label}")
    docs = spark.range(0, 60_000, 1, 8).selectExpr("id as doc_id", "concat('text ', id % 20000) as text")
    found = exact_dedup.exact_dedup(docs)
    assert found.where("group_size = 3 and keep_id = 40000 + doc_id % 20000 and kept = (doc_id = keep_id)").count() == found.count() == 60_000
    assert len(list((tmp_path / "dedup-updates").glob("batch=*"))) > 1
    # more batches, and larger ones, the more is staged
    assert [-(-n // exact_dedup.batch_size(n)) for n in (1 << 18, 16 << 20, 1 << 30)] == [1, 4, 32]


def brute_near(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, s in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def test_near_equals_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    for k in (4, 5):
        found = near_dup.near_dup(spark.read.parquet(f"{DATA}/documents.parquet"), k).collect()
        assert {r.doc_id: r.component_id for r in found} == brute_near(rows, k, 80)
        assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingles(t, k)) for i, t in rows}
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_bands_of_small_sets_agree_as_independent_values_do():
    rng = np.random.default_rng(2)
    shared = []
    for _ in range(1500):
        five = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
        shared.append(np.mean(near_dup.bands(five)[0] == near_dup.bands(five[:4])[0]))
    assert abs(np.mean(shared) - 0.8**6) < 0.02  # 0.6**3 if both values of a permutation are in a band


def test_near_chains_and_large_groups(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for n in range(150):  # copies with a few words changed, each near some others only
        w = list(base)
        for _ in range(n % 5):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((n, " ".join(w)))
    drift = list(base)
    for n in range(60):  # a chain: each is near the one before, the ends are not
        drift[2 * n % 120] = f"y{n}"
        rows.append((1000 + n, " ".join(drift)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_dup(docs, 4).collect()} == brute_near(rows, 4, 80)


def boilerplate(n, rng):
    """Texts of which three quarters are the same; every tenth has a near copy, and some of these one more."""
    common, rows = [f"c{i}" for i in range(90)], []
    for i in range(n):
        own = [f"o{i}.{j}" for j in range(30)]
        rows.append(common + own)
        if i % 10 == 0:
            for changes in range(1, 2 + (i % 20 == 0)):
                near = common + list(own)
                for _ in range(changes):
                    near[rng.randrange(len(near))] = f"x{rng.randrange(10**6)}"
                rows.append(near)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_near_popular_bands(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "POPULAR", 5)
    crowds, grouped = [], near_dup._by_rare_shingles

    def seen(crowd, *more):
        found = grouped(crowd, *more)
        crowds.append((crowd.count(), found.count(), found.groupBy("band").count().agg({"count": "max"}).first()[0]))
        return found

    monkeypatch.setattr(near_dup, "_by_rare_shingles", seen)
    rows = boilerplate(200, random.Random(8))
    # one id on two rows, an id of a repeated row, and classes apart from each other whose sets differ in size
    rows += [(3, rows[40][1] + " tail"), rows[7], (900, " ".join(rows[9][1].split()[:100])), (901, rows[11][1] + " a b c d e f g h i j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dup.near_dup(docs, 4).collect()}
    assert crowds and crowds[0][0] > 100 and crowds[0][2] < 20
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, 4))
    links = [(i, j) for i in sets for j in sets if i < j and any(100 * len(x & y) >= 80 * len(x | y) for x in sets[i] for y in sets[j])]
    want = {i: i for i in sets}
    while any(want[i] != want[j] for i, j in links):
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    assert found == want and len(set(want.values())) < len(want)


def test_near_awkward(spark):
    docs = awkward(spark)
    found = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.near_dup(docs).collect())
    assert found == {(1, 1, True): 1, (2, 1, False): 2, (3, 3, True): 1, (4, 4, True): 1, (None, None, True): 2, (5, 5, True): 1, (6, 6, True): 1, (7, 7, True): 2}
    assert near_dup.representatives(docs).count() == docs.count() - 2
    clashing = docs.withColumn("gone_id", F.lit(1)).withColumn("cls", F.lit(1))
    assert near_dup.representatives(clashing).columns == clashing.columns and near_dup.representatives(clashing).count() == docs.count() - 2
    assert near_dup.representatives(empty(spark)).count() == 0
    assert near_dup.near_dup(empty(spark)).count() == 0


def test_near_repeated_rows_with_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    near, other = " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(60))
    chain = [" ".join([*base[:-n], *(f"z{i}" for i in range(n))]) for n in (3, 5)]
    rows = [(1, " ".join(base))] * 3 + [(2, near)] * 2 + [(3, chain[0])] + [(4, chain[1])] * 2 + [(5, other)] * 2 + [(5, near)] * 2 + [(6, other + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_dup(docs).collect())
    assert found == collections.Counter((i, len(shingles(t, 5)), 1, i == 1) for i, t in rows)
    pairs = spark.createDataFrame([(1, 2), (5, 6)], "a long, b long")
    assert sorted(map(tuple, near_dup._confirmed(pairs, docs, 5, 80).collect())) == [(1, 2), (5, 6)]


def test_words_that_hash_badly_are_not_linked(spark):
    rows = list(enumerate(HARD))
    assert {r.doc_id: r.component_id for r in near_dup.near_dup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {i: i for i, _ in rows}


def test_rows_that_share_an_id_join_their_classes(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dup.near_dup(docs).collect()} == {(1, 1), (5, 1), (9, 1)}


def test_components(spark):
    rng = random.Random(3)
    for edges in ([(i, i + 1) for i in range(40)], [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], [(0, i) for i in range(1, 30)], []):
        parent = {x: x for e in edges for x in e}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert {x: found.get(x, x) for x in parent} == {x: root(x) for x in parent}
    forest = [(i, rng.randrange(i)) for i in range(1, 50)]
    assert {r.root for r in components.forest_roots(spark.createDataFrame(forest, "a long, b long")).collect()} == {0}
