"""Near-duplicate components by min-max hashing over word shingles.

One Arrow pass gives every document the digest of its shingle set and, from 128 permutations, 128 minima and 128
maxima; these are banded, the minima first, so that a band never holds both of one permutation. Documents with one set
are one class, named by its smallest doc_id. Classes that share a band are candidates. Each class is first compared
with one other, the smallest class of a band, which joins most groups of copies at a linear cost. The classes of a band
that are still apart are then compared in blocks of bounded size: a block's task compares signatures, across components
only, and keeps for every class its likely partners; a second task confirms these on the full sets of 64-bit shingle
hashes and returns the links that join something, so no list of pairs is written or shuffled. A pair is compared in the
first band that it shares.

A band in which more than POPULAR classes stay apart, boilerplate as a rule, is not compared each with each. Its classes
are grouped instead by the rarest of their shingles, as many as linked sets can't all miss: two sets that share percent
of their union share one of them, whatever the order. These groups take the same two steps as bands do, so no link is
lost and the cost follows what documents share besides the boilerplate.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import keyed, sized, small, text_of, written
from ._words import U, buffers, lean, mix, slices, word_hashes
from .components import components, forest_roots

#: A pair with Jaccard similarity s shares no band with probability (1 - s**6)**42: 3e-6 at 0.8, 2e-9 at 0.85. In small
#: sets minimum and maximum of one permutation agree less often together, so the values of a band are of different ones.
PERMUTATIONS, ROWS, BANDS = 128, 6, 42
#: Classes on either side of a block; a band's larger groups become several blocks.
CHUNK = 800
#: Shingles on either side, all sets together; blocks of long texts have fewer classes.
CHUNK_SHINGLES = 1 << 20
#: Pairs that one copy of a head's set is compared in.
PAIRS_PER_SALT = 500
VALUES = BANDS * ROWS
#: Classes of a band outside its largest component, from which on the band is grouped by rare shingles.
POPULAR = 4 * CHUNK
#: Deviations of a signature's agreement that a linked pair may be below its mean.
DEVIATIONS = 5

_RNG = np.random.default_rng(8)
_A = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WORD_PLACE = mix(_RNG.integers(1, 1 << 62, 64, dtype=U)) | U(1)
_BAND_PLACE = mix(_RNG.integers(1, 1 << 62, ROWS, dtype=U)) | U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer than k words has its whole sequence as one."""
    words, rows = word_hashes(data, offsets)
    n = max(0, len(words) - k + 1)
    grams = np.zeros(n, U)
    for j in range(k):
        grams += words[j : j + n] * _WORD_PLACE[j % 64]
    grams = mix(grams + U(k))
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(grams[lo : hi - k + 1])
        elif hi > lo:
            yield mix(np.array([int((words[lo:hi] * _WORD_PLACE[: hi - lo]).sum()) ^ (hi - lo)], U))
        else:
            yield np.zeros(0, U)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a set under every permutation of 32-bit numbers."""
    least, most = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    low = (shingles >> U(32)).astype(np.uint32)
    for at in range(0, len(low), 512):
        x = low[None, at : at + 512] * _A[:, None]
        x ^= x >> np.uint32(15)
        x *= _B[:, None]
        np.minimum(least, x.min(axis=1), out=least)
        np.maximum(most, x.max(axis=1), out=most)
    return least, most


def bands(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Hashes of the bands of the minima and then the maxima, the band's number in each; and a byte of every value with four of every band's hash."""
    values = np.concatenate(signature(shingles))[: BANDS * ROWS].astype(U)
    hashes = mix((values.reshape(BANDS, ROWS) * _BAND_PLACE).sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U)).view(np.int64)
    return hashes, (mix(values) & U(255)).astype(np.uint8).tobytes() + hashes.astype(np.uint32).tobytes()


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The halves of each set's 128-bit digest."""
    mixed = [mix(s ^ U(0xA5A5A5A5A5A5A5A5)) for s in sets]
    return tuple(np.array([s.sum(dtype=U) for s in own], U).view(np.int64) for own in (sets, mixed))


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit digest (hi, lo), its band hashes (none without words) and its signature in short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(*buffers(part.column("text")), k))
                hi, lo = _digests(sets)
                banded = [bands(s) if len(s) else (np.zeros(0, np.int64), b"") for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(hi), pa.array(lo), _list_array([b for b, _ in banded]), pa.array([v for _, v in banded], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "hi", "lo", "bands", "bytes"],
                )

    return text_of(docs).mapInArrow(lean(run), "doc_id long, n_shingles long, hi long, lo long, bands array<long>, bytes binary")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(*buffers(part.column("text")), k))
                hi, lo = _digests(sets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(hi), pa.array(lo), _list_array(sets)], ["cls", "hi", "lo", "shingles"])

    return text_of(docs).mapInArrow(lean(run), "cls long, hi long, lo long, shingles array<long>")


def _once(rows: DataFrame, *keys: str) -> DataFrame:
    """One of the written rows of each key; only rows of repeated keys are shuffled with all their columns."""
    again = written(sized(rows.groupBy(*keys).count().where("count > 1").select(*keys), rows.count()), "near-again")
    if not (n := again.count()):
        return rows
    again = small(again, n)
    return rows.join(again, [*keys], "left_anti").unionByName(rows.join(again, [*keys], "left_semi").dropDuplicates([*keys]))


def _least(percent: int) -> int:
    """Of two linked sets' VALUES signature bytes, so many agree at least.

    With similarity s a byte agrees with probability s + (1 - s) / 256; the deviation of the mean is at most
    sqrt(s * (1 - s) / VALUES), 0.025 at 0.8.
    """
    s = percent / 100
    return int(VALUES * (s - DEVIATIONS * (s * (1 - s) / VALUES) ** 0.5))


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Runs of rows that are alike in the keys, of rows that are sorted by them."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *changes.tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = tuple(c[lo] for c in columns)
            if waiting and own != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(lo, hi - lo))
            last = own
    if waiting:
        yield pa.Table.from_batches(waiting)


def _blocks(state: DataFrame) -> DataFrame:
    """The rows of state (band, at, cls, n, root), by block: band, l, c, role.

    A group of at most CHUNK classes and CHUNK_SHINGLES is one block, role 2: each with each. Of a larger one, all classes are dealt into
    columns (role 0), and those outside the group's largest component also into lines (role 1); each block is a line
    against a column. So a component however large costs no more than its rows times what is apart from it.
    """
    by_root = state.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    counts = by_root.groupBy("band").agg(F.sum("k").alias("m"), F.sum("s").alias("s"), F.max(F.struct("k", "root", "s")).alias("top"))
    n = state.count()
    blocks_of = lambda k, s: F.greatest(F.lit(1), F.ceil(k / CHUNK), F.ceil(s / CHUNK_SHINGLES)).cast("int")
    rest = F.col("m") - F.col("top.k")
    counts = counts.select("band", F.col("top.root").alias("top"), rest.alias("rest"), blocks_of(rest, F.col("s") - F.col("top.s")).alias("lines"), blocks_of(F.col("m"), F.col("s")).alias("columns"))
    counts = written(sized(counts, n), "near-counts")
    lines, columns = F.col("lines"), F.col("columns")
    place = lambda of, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), of).cast("int")
    cell = lambda l, c, role: F.struct(l.cast("int").alias("l"), c.cast("int").alias("c"), F.lit(role).alias("role"))
    right = F.transform(F.sequence(F.lit(0), lines - 1), lambda l: cell(l, place(columns, 1), 0))
    left = F.when(F.col("root") != F.col("top"), F.transform(F.sequence(F.lit(0), columns - 1), lambda c: cell(place(lines, 2), c, 1))).otherwise(F.array().cast("array<struct<l:int,c:int,role:int>>"))
    cells = F.when(columns == 1, F.array(cell(F.lit(0), F.lit(0), 2))).otherwise(F.concat(right, left))
    return state.join(counts, "band").where("rest > 0").select("band", "at", "cls", "n", "root", F.explode(cells).alias("x")).select("band", "x.l", "x.c", "x.role", "at", "cls", "n", "root")


def _likely(blocks: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """band, l, c, cls, partners: of each block the classes with a likely partner there; a pair is listed with one of its two.

    Of pairs in groups by rare shingles (at is -1) all are compared, whatever bands they share.
    """
    least = _least(percent)

    def pairs_of(group: pa.Table) -> pa.RecordBatch | None:
        get = lambda c: group.column(c).to_numpy()
        cls, n, root, role, at = get("cls"), get("n"), get("root"), get("role"), get("at")
        raw = np.frombuffer(b"".join(group.column("bytes").to_pylist()), np.uint8).reshape(len(cls), -1)
        sig, shared = np.ascontiguousarray(raw[:, :VALUES]), np.ascontiguousarray(raw[:, VALUES:]).view(np.uint32)
        lines, columns = np.flatnonzero(role > 0), np.flatnonzero(role != 1)
        partners: dict[int, np.ndarray] = {}
        for lo in range(0, len(lines), 32):
            x = lines[lo : lo + 32]
            fits = (root[x][:, None] != root[columns][None]) & (100 * np.minimum(n[x][:, None], n[columns][None]) >= percent * np.maximum(n[x][:, None], n[columns][None]))
            if role[0] == 2:
                fits &= cls[x][:, None] < cls[columns][None]
            i, j = np.nonzero(fits)
            for part in range(0, len(i), 1 << 14):
                a, b = x[i[part : part + (1 << 14)]], columns[j[part : part + (1 << 14)]]
                good = (sig[a] == sig[b]).sum(axis=1) >= least
                a, b = a[good], b[good]
                # a band is shared if its hashes agree in 32 bits and all its values in a byte each
                first = ((shared[a] == shared[b]) & (sig[a] == sig[b]).reshape(-1, BANDS, ROWS).all(axis=2)).argmax(axis=1)
                good = (at[a] == at[b]) & ((at[a] < 0) | (first == at[a]))
                a, b = a[good], b[good]
                for own in np.unique(a).tolist():
                    partners[own] = np.concatenate([partners.get(own, np.zeros(0, np.int64)), cls[b[a == own]]])
        if not partners:
            return None
        named = {int(cls[k]): v for k, v in partners.items()}
        every = np.unique(np.concatenate([np.array(list(named), np.int64), *named.values()]))
        one = lambda c, t: pa.array([group.column(c)[0].as_py()] * len(every), t)
        lists = pa.array([named[k].tolist() if k in named else [] for k in every.tolist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([one("band", pa.int64()), one("l", pa.int32()), one("c", pa.int32()), pa.array(every), lists], ["band", "l", "c", "cls", "partners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "band", "l", "c"):
            if group.num_rows > 1 and (found := pairs_of(group)) is not None:
                yield found

    rows = blocks.join(signatures, "cls").repartition("band", "l", "c").sortWithinPartitions("band", "l", "c")
    return rows.select("band", "l", "c", "role", "at", "cls", "n", "root", "bytes").mapInArrow(lean(run), "band long, l int, c int, cls long, partners array<long>")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _links(likely: DataFrame, docs: DataFrame, k: int, percent: int, n: int) -> DataFrame:
    """The links (a, b) among likely partners, confirmed on the full sets; of each block as many as join its classes."""

    def links_of(group: pa.Table) -> tuple[list[int], list[int]]:
        cls = group.column("cls").to_pylist()
        sets = [np.sort(np.asarray(x.values).view(U)) for x in group.column("shingles")]
        of: dict[int, list[int]] = {}
        for i, c in enumerate(cls):
            of.setdefault(c, []).append(i)
        parent, a, b = {c: c for c in of}, [], []

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for i, partners in enumerate(group.column("partners").to_pylist()):
            for j in (j for p in partners or [] for j in of.get(p, ())):
                # what is joined already needs no more links
                if (x := root(cls[i])) != (y := root(cls[j])) and _linked(sets[i], sets[j], percent):
                    parent[max(x, y)] = min(x, y)
                    a.append(cls[i])
                    b.append(cls[j])
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "band", "l", "c"):
            a, b = links_of(group)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = likely.join(_wanted_sets(docs, likely.select(F.col("cls").alias("doc_id")), k, n), "cls").repartition("band", "l", "c").sortWithinPartitions("band", "l", "c")
    return rows.select("band", "l", "c", "cls", "partners", "shingles").mapInArrow(lean(run), "a long, b long")


def _wanted_sets(docs: DataFrame, ids: DataFrame, k: int, n: int) -> DataFrame:
    """cls, hi, lo, shingles of the documents with these ids (doc_id), each set of an id once."""
    wanted = written(sized(ids.distinct(), n), "near-wanted")
    sets = written(_sets(text_of(docs).join(small(wanted, wanted.count()), "doc_id", "left_semi"), k), "near-sets")
    return _once(sets, "cls", "hi", "lo")


def _popular(state: DataFrame, n: int) -> DataFrame | None:
    """band of those in which more than POPULAR classes are outside the largest component; None if there is none."""
    by_root = state.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"))
    over = by_root.groupBy("band").agg((F.sum("k") - F.max("k")).alias("rest")).where(F.col("rest") > POPULAR).select("band")
    over = written(sized(over, n), "near-popular")
    return None if over.isEmpty() else over


def _by_rare_shingles(crowd: DataFrame, docs: DataFrame, k: int, percent: int, n: int) -> DataFrame:
    """The rows (cls, n) of crowd by rare shingles, as rows of bands are: cls, n, at (-1), band (the shingle).

    Shingles are in the order of how many sets of the crowd hold them, then of their hash. Of n shingles the first
    n - ceil(n * percent / 100) + 1 go: sets that miss each other in these can't share enough of the rest. A shingle
    that one class only has is left out.
    """
    sets = _wanted_sets(docs, crowd.select(F.col("cls").alias("doc_id")), k, n)
    flat = sets.select("cls", "hi", "lo", F.explode("shingles").alias("band"))
    total = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    held = written(flat.groupBy("band").agg(F.count(F.lit(1)).alias("held")), "near-held")
    ranked = keyed(flat, held, ["band"], "held", total).groupBy("cls", "hi", "lo").agg(F.sort_array(F.collect_list(F.struct("held", "band"))).alias("x"))
    size = F.size("x")
    first = F.slice("x", 1, (size - F.ceil(size * percent / 100) + 1).cast("int"))
    rare = ranked.select("cls", F.explode(F.transform(F.filter(first, lambda y: y["held"] > 1), lambda y: y["band"])).alias("band")).distinct()
    return written(crowd.select("cls", "n").distinct().join(rare, "cls").select("cls", "n", F.lit(-1).alias("at"), "band"), "near-rare")


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids with 100 * intersection >= percent * union of the full sets of any of their rows, each once."""
    sets = _wanted_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), k, pairs.count())
    # a head with many partners is as many keys as they need, each with a copy of its set
    n = pairs.count()
    heads = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / PAIRS_PER_SALT).cast("int"))
    heads = written(sized(heads, n), "near-salts")
    salted = keyed(pairs, heads, ["a"], "n", n).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).select("a", "b", "salt")
    right = salted.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    left = heads.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "sa", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = right.join(left, ["a", "salt"])
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(F.lit(100) * shared >= F.lit(percent) * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct()


def _headed(live: DataFrame, roots: DataFrame | None, docs: DataFrame, k: int, percent: int, n: int) -> DataFrame:
    """Roots after each class is compared with one other only: of the heads of its bands the one it meets in most."""
    top = written(sized(live.groupBy("band").agg(F.min(F.struct("cls", "n")).alias("top")).select("band", F.col("top.cls").alias("head"), F.col("top.n").alias("head_n")), n), "near-heads")
    below = live.join(top, "band").where("cls <> head").where(_sizes_fit("n", "head_n", percent))
    met = below.groupBy("cls", "head").agg(F.count(F.lit(1)).alias("k")).groupBy(F.col("cls").alias("b")).agg(F.max(F.struct("k", (-F.col("head")).alias("head"))).alias("most"))
    pairs = written(sized(met.select((-F.col("most.head")).alias("a"), "b"), n), "near-pairs")
    return _joined(roots, written(sized(_confirmed(pairs, docs, k, percent), n), "near-links"))


def near_dup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked at 100 * intersection >= percent * union of their k-word shingle sets; component_id is the
    smallest doc_id reachable. Documents without words are linked with nothing. Rows that share a doc_id are one
    node, with the links of all of them; of these, all rows with the component's id are kept. A null doc_id has no
    name to be linked by: component_id is null and the row is kept, while rows with its set stay linked with each
    other. An empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    rows = written(profiles(docs, k), "near-profiles")
    n = rows.count()
    classes = written(sized(rows.where("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("cls"), F.count(F.lit(1)).alias("rows")), n), "near-classes")
    named = rows.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "hi", "lo")
    members = written(sized(keyed(named, classes, ["hi", "lo"], "rows", n).drop("rows"), n), "near-members")
    heads = members.where("doc_id = cls").select("cls", "hi", "lo").distinct()
    # a row repeated whole is one node, so all that follows takes it once
    once = _once(rows.where("n_shingles > 0 and doc_id is not null"), "doc_id", "hi", "lo")
    banded = once.join(heads.withColumnRenamed("cls", "doc_id"), ["doc_id", "hi", "lo"])
    banded = written(sized(banded.select(F.col("doc_id").alias("cls"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("at", "band")), n, 5_000), "near-bands")
    shared = banded.groupBy("band").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a < z").select("band")
    shared = written(sized(shared, n, 5_000), "near-shared")
    live = written(sized(banded.join(shared, "band"), n, 5_000), "near-live")
    candidates = written(sized(live.select("cls").distinct(), n), "near-candidates")
    signatures = once.join(small(candidates.withColumnRenamed("cls", "doc_id"), candidates.count()), "doc_id", "left_semi")
    signatures = signatures.join(heads.withColumnRenamed("cls", "doc_id"), ["doc_id", "hi", "lo"]).select(F.col("doc_id").alias("cls"), "bytes")
    signatures = written(sized(signatures, n, 10_000), "near-signatures")

    # a doc_id on several rows joins the classes these are in
    first = members.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b").select("doc_id", "a")
    edges = written(sized(members.join(first, "doc_id").where("cls <> a").select("a", F.col("cls").alias("b")), n), "near-links")
    roots = None if edges.isEmpty() else written(components(edges), "near-roots")
    n_live = live.count()
    if n_live:
        roots = _headed(live, roots, docs, k, percent, n_live)
        # then, by blocks, all that share a band and are apart
        state = written(sized(_rooted(live, roots), n_live), "near-state")
        if (popular := _popular(state, n_live)) is not None:
            crowd = written(sized(state.join(popular, "band", "left_semi").select("cls", "n").distinct(), n_live), "near-crowd")
            rare = _by_rare_shingles(crowd, docs, k, percent, crowd.count())
            n_rare = rare.count()
            if n_rare:
                roots = _headed(rare, roots, docs, k, percent, n_rare)
            rest = state.join(popular, "band", "left_anti").select("cls", "n", "at", "band").unionByName(rare)
            n_live += n_rare
            state = written(sized(_rooted(rest, roots), n_live), "near-state")
        likely = written(sized(_likely(_blocks(state), signatures, percent), n_live, 10_000), "near-likely")
        roots = _joined(roots, written(sized(_links(likely, docs, k, percent, n_live), n_live), "near-links"))

    found = members.withColumn("root", F.col("cls")) if roots is None else _rooted(members, roots)
    found = found.select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names.

    A row goes if its id is not the least of its component; so of a repeated id all rows stay or all go, and rows with
    a null id, null or empty text stay. An empty table gives no rows. Texts don't move; the ids that go are broadcast
    if they are few.
    """
    gone_id = f"gone_{uuid.uuid4().hex}"
    gone = written(near_dup(docs, k, percent).where("not kept").select(F.col("doc_id").alias(gone_id)).distinct(), "near-gone")
    return docs.join(small(gone, gone.count()), docs["doc_id"].cast("long") == F.col(gone_id), "left_anti")


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    """Whether a set can make up the share of the other at all."""
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root after more links: these become links of roots, which are few, and roots move on to theirs."""
    if roots is None:
        return written(sized(forest_roots(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), links.count()), "near-roots")
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    over = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = written(sized(components(sized(over.distinct(), links.count())), links.count()), "near-moved").select(F.col("node").alias("root"), F.col("root").alias("over"))
    n = roots.count() + 1
    up = roots.join(moved, "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    fresh = moved.select(F.col("root").alias("node"), F.col("over").alias("root")).join(roots.select("node"), "node", "left_anti")
    return written(sized(up.union(fresh), n), "near-roots")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


#: The rows of near_dup(documents, k=4, percent=80), ids being distinct and not null: all pairs that share a shingle,
#: and labels carried along links, so its cost grows with the square of a group and it is meant for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS shingles
  FROM words),
sizes AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM sets),
member AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM member x JOIN member y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n_shingles + y.n_shingles - k)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS label FROM sizes UNION SELECT b, label FROM reached JOIN steps ON a = doc_id WHERE label < b)
SELECT doc_id, n_shingles, min(label) AS component_id, doc_id = min(label) AS kept FROM sizes JOIN reached USING (doc_id) GROUP BY doc_id, n_shingles
"""
