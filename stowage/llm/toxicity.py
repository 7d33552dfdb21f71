"""Toxicity by a classifier chain.

Terms (words, beginnings of words and runs of bytes inside words, so that endings and compounds don't hide a stem)
that tell toxic labelled documents are found by a grouped count over the labelled sample, and clustered by the toxic
documents they share. Logistic models then predict the categories one after the other: toxic with a term of the first
cluster, of the second, and toxic at all. The earlier links see the terms of their cluster, the last one all terms,
and each the probabilities of the earlier categories. These are out of fold in training: for the rows of a fold,
terms, clusters and models come from the other folds. Scoring takes the models of all folds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, row_key, small, text_of, written
from ._words import FOLDED, U, buffers, lean, mix, slices, word_hashes

#: In this order. The labels hold one flag, so the earlier categories are groups that the data show: toxic documents
#: with a term of one cluster of the telling terms; the last is the flag itself.
CATEGORIES = ("group_1", "group_2", "toxic")
#: Rounds of clustering, if it doesn't settle before.
ROUNDS = 20
#: Labelled rows that the models are fitted on, about; a hash of doc_id chooses them where there are more.
LABELLED_ROWS = 12_000
TERMS = 300
#: Bytes of a run inside a word, and of beginnings.
RUN = 6
BEGINNINGS = (4, 5)
FOLDS = 5
RIDGE = 0.3
REJECT = 0.5
#: A term marks if it is in so many labelled documents and so large a part of these is toxic.
MARK_ROWS, MARK_SHARE = 5, 0.9

#: Words here are runs of ASCII letters and digits and of bytes above 0x7F.
BREAKS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, their beginnings, and all runs of RUN bytes inside words, and the row each is in (not in text order)."""
    words, rows = word_hashes(data, offsets, BREAKS, FOLDED)
    at = offsets - offsets[0]
    data = data[offsets[0] : offsets[-1]]
    apart, low = BREAKS[data], _LOWER[data]
    new_row = np.zeros(len(data) + 1, bool)
    new_row[at] = True
    first = ~apart
    first[1:] &= apart[:-1] | new_row[1:-1]
    hashes, places = [words], []
    value, whole = np.zeros(len(data), U), np.ones(len(data), bool)
    for j in range(RUN):
        n = max(0, len(data) - j)
        value, whole = value[:n] | (low[j:].astype(U) << U(8 * j)), whole[:n] & ~apart[j:]
        if j:
            whole &= ~new_row[j : j + n]
        size = j + 1
        if size == RUN or size in BEGINNINGS:
            here = np.flatnonzero(whole if size == RUN else whole & first[:n])
            hashes.append(mix(value[here] | U((1 if size == RUN else size) << 56)))
            places.append(here)
    row = [np.searchsorted(rows, np.arange(len(words)), side="right") - 1, *(np.searchsorted(at, p, side="right") - 1 for p in places)]
    return np.concatenate(hashes), np.concatenate(row)


@dataclass
class Links:
    """The terms of each link of a chain, by places in an array of term hashes, and which of them mark."""

    groups: list[np.ndarray]
    marking: list[np.ndarray]

    def inputs(self, counts: np.ndarray, k: int) -> np.ndarray:
        """What link k sees of documents by terms: its own terms, their marks, and whether there is any."""
        own = counts[:, self.groups[k]]
        marks = own[:, self.marking[k]].sum(axis=1)
        return np.column_stack([np.log1p(own), np.log1p(marks), marks > 0])

    def targets(self, counts: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
        return [*(toxic & (counts[:, g].sum(axis=1) > 0) for g in self.groups[:-1]), toxic]


@dataclass
class Chain:
    terms: np.ndarray  #: sorted term hashes
    links: Links
    weights: list[np.ndarray]  #: one per category: its terms, its marks, earlier categories, constant

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """counts: documents by terms; returns documents by categories."""
        done = np.zeros((len(counts), 0))
        for k, w in enumerate(self.weights):
            done = np.column_stack([done, _predicted(np.column_stack([self.links.inputs(counts, k), done]), w)])
        return done


def _predicted(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic weights by Newton steps; the last is the constant, which is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    shrink[-1] = 1e-6
    for _ in range(12):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(counts: np.ndarray, toxic: np.ndarray, fold: np.ndarray, terms: np.ndarray, links: Links, links_without: list[Links]) -> Chain:
    """A chain over a sample: term counts by document, labels and folds; the links' terms, and those found without each fold."""
    targets = links.targets(counts, toxic)
    targets_without = [own.targets(counts, toxic) for own in links_without]
    earlier, weights = np.zeros((len(counts), 0)), []
    for k, y in enumerate(targets):
        weights.append(_logistic(np.column_stack([links.inputs(counts, k), earlier]), y.astype(float)))
        unseen = np.zeros(len(counts))
        for f, own in enumerate(links_without):
            out = fold == f
            if out.any() and not out.all():
                x = np.column_stack([own.inputs(counts, k), earlier])
                unseen[out] = _predicted(x[out], _logistic(x[~out], targets_without[f][k][~out].astype(float)))
        earlier = np.column_stack([earlier, unseen])
    return Chain(terms, links, weights)


def _term_counts(part: pa.RecordBatch, terms: np.ndarray) -> np.ndarray:
    counts = np.zeros((part.num_rows, len(terms)), np.float64)
    if len(terms):
        found, row = terms_of(*buffers(part.column("text")))
        maybe = np.zeros(1 << 16, bool)
        maybe[(terms & U(0xFFFF)).astype(np.int64)] = True
        likely = np.flatnonzero(maybe[(found & U(0xFFFF)).astype(np.int64)])
        found, row = found[likely], row[likely]
        at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
        hit = terms[at] == found
        np.add.at(counts, (row[hit], at[hit]), 1)
    return counts


def _label_rows(labels: DataFrame, most: int) -> DataFrame:
    """doc_id, toxic and fold of at most about ``most`` labelled rows."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = max(1, known.count())
    at = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12), 16, 10).cast("double") / float(16**12)
    return known.where(at < most / n).withColumn("fold", F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))) % FOLDS)


def _telling(stats: DataFrame, totals: list[tuple[int, int]], variant: int) -> DataFrame:
    """The TERMS terms that tell toxic documents best, by the rows of all folds (variant FOLDS) or of all but one: variant, place, term, marks."""
    folds = [k for k in range(FOLDS) if k != variant]
    n_toxic, n_clean = (sum(totals[k][i] for k in folds) for i in (0, 1))
    sums = stats.select("term", *(sum((F.col(f"{c}{k}") for k in folds), F.lit(0)).cast("double").alias(c) for c in ("t", "c")))
    # by how much the term's share of toxic and clean documents tells them apart: the log likelihood ratio
    t, c, n = F.col("t"), F.col("c"), float(max(1, n_toxic + n_clean))
    part = lambda seen, side: seen * F.log(F.greatest(seen, F.lit(1e-9)) / (F.lit(float(max(1, side)) / n) * (t + c)))
    rest = lambda seen, side: (side - seen) * F.log(F.greatest(side - seen, F.lit(1e-9)) / F.greatest(F.lit(float(max(1, side)) / n) * (n - t - c), F.lit(1e-9)))
    score = part(t, n_toxic) + part(c, n_clean) + rest(t, n_toxic) + rest(c, n_clean)
    best = sums.where((t + c >= MARK_ROWS) & (t * n_clean > c * n_toxic)).withColumn("score", score).orderBy(F.desc("score"), "term").limit(TERMS)
    return best.select(F.lit(variant).alias("variant"), "score", "term", ((t >= MARK_ROWS) & (t >= MARK_SHARE * (t + c))).alias("marks"))


def clusters(seen: np.ndarray, n: int) -> np.ndarray:
    """Of each column of a table of documents by terms, best terms first, the number of its cluster, by the rows it shares.

    Similarity is the cosine, over terms, of the rows they are in. The first term starts a cluster, then each time the
    one least like all that have started; a term then goes to the cluster that it is most like on average, the first
    of several, until none moves.
    """
    x = seen / np.maximum(1.0, np.sqrt(seen.sum(axis=0, dtype=float)))
    alike = np.round(x.T @ x, 9)
    starts = [0]
    for _ in range(n - 1):
        starts.append(int(alike[starts].max(axis=0).argmin()))
    own = alike[starts].argmax(axis=0)
    for _ in range(ROUNDS):
        member = np.eye(n)[own]
        mean = np.round(alike @ member / np.maximum(1, member.sum(axis=0)), 9)
        moved = mean.argmax(axis=1)
        if (moved == own).all():
            break
        own = moved
    return own


def _links_of(found: list, terms: np.ndarray, seen: np.ndarray, like: Links | None = None) -> Links:
    """The links by the terms that one variant chose and the toxic rows it knows; clusters in the order of ``like``'s, which they share most terms with."""
    found = sorted(found, key=lambda r: (-r["score"], r["term"]))
    at = np.searchsorted(terms, np.array([r["term"] for r in found], np.int64).view(U))
    marks, n = np.array([r["marks"] for r in found], bool), len(CATEGORIES) - 1
    own = clusters(seen[:, at], n) if len(at) else np.zeros(0, int)
    order = range(n)
    if like is not None:
        order = max(permutations(order), key=lambda o: sum(np.isin(at[own == k], g).sum() for k, g in zip(o, like.groups, strict=False)))
    return Links([*(at[own == k] for k in order), at], [*(marks[own == k] for k in order), marks])


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Chain:
    """Fits the chain on labelled rows; the sample's size, not that of ``docs``, bounds what reaches the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, row = terms_of(*buffers(part.column("text")))
                order = np.lexsort((row, found))
                found, row = found[order], row[order]
                once = np.ones(len(found), bool)
                once[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
                found, row = found[once], row[once]
                keys, at = np.unique(found, return_index=True)
                if len(keys):
                    toxic, fold = part.column("toxic").to_numpy()[row], part.column("fold").to_numpy()[row]
                    n = [np.add.reduceat(((toxic == y) & (fold == k)).astype(np.int64), at) for y in (1, 0) for k in range(FOLDS)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, n)], ["term", *names])

    names = [f"{c}{k}" for c in "tc" for k in range(FOLDS)]
    known = _label_rows(labels, labelled_rows)
    sample = written(text_of(docs).join(F.broadcast(known), "doc_id"), "toxic-sample")
    counted = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = [(counted.get((k, 1), 0), counted.get((k, 0), 0)) for k in range(FOLDS)]
    top = []
    if all(any(t[i] for t in totals) for i in (0, 1)):
        stats = sample.mapInArrow(lean(words), f"term long, {', '.join(f'{n} long' for n in names)}").groupBy("term").agg(*(F.sum(n).alias(n) for n in names))
        stats = written(stats.where(sum((F.col(n) for n in names), F.lit(0)) >= MARK_ROWS), "toxic-terms")
        variants = [_telling(stats, totals, v) for v in range(FOLDS + 1)]
        best = variants[0]
        for other in variants[1:]:
            best = best.union(other)
        top = best.collect()
        dropped(stats)
    terms = np.unique(np.array([r["term"] for r in top], np.int64).view(U))
    if not len(terms):
        # nothing tells toxic rows, so none is taken for toxic
        dropped(sample)
        return Chain(terms, _links_of([], terms, np.zeros((0, 0), bool)), [np.array([*[0.0] * (2 + k), np.log(1e-6)]) for k in range(len(CATEGORIES))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts = _term_counts(part, terms)
                rows = [np.flatnonzero(row) for row in counts]
                at = pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))
                n = pa.array([row[r].astype(np.int64).tolist() for r, row in zip(rows, counts, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("fold"), at, n], ["toxic", "fold", "at", "n"])

    rows = sample.mapInArrow(lean(vectors), "toxic int, fold long, at array<int>, n array<long>").toPandas()
    dropped(sample)
    counts = np.zeros((len(rows), len(terms)))
    for own, at, n in zip(counts, rows["at"], rows["n"], strict=True):
        own[at] = n
    toxic, fold = rows["toxic"].to_numpy(int) == 1, rows["fold"].to_numpy(int)
    chosen = [[r for r in top if r["variant"] == v] for v in range(FOLDS + 1)]
    every = _links_of(chosen[FOLDS], terms, counts[toxic] > 0)
    without = [_links_of(chosen[v], terms, counts[toxic & (fold != v)] > 0, every) for v in range(FOLDS)]
    return fit_chain(counts, toxic, fold, terms, every, without)


def score(docs: DataFrame, chain: Chain, reject: float = REJECT, *more: str) -> DataFrame:
    """doc_id, p_<category> for each category and toxic (the last probability is at least ``reject``), for every row, and the columns ``more``.

    Null and empty texts have no terms and get the constant's probabilities; rows are independent of each other, so
    ties, repeated rows and null ids come out as they are. Without labels of both classes, or terms that tell them
    apart, no row is toxic. Columns other than doc_id, text and ``more`` are not looked at.
    """
    names = [f"p_{c}" for c in CATEGORIES]
    source = text_of(docs, *(F.col(c).alias(f"more_{i}") for i, c in enumerate(more)))
    fields = ", ".join([f"doc_id long, {', '.join(f'{n} double' for n in names)}, toxic boolean", *(f"more_{i} {source.schema[f'more_{i}'].dataType.simpleString()}" for i in range(len(more)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = chain.probabilities(_term_counts(part, chain.terms))
                kept = [part.column(f"more_{i}") for i in range(len(more))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= reject), *kept], ["doc_id", *names, "toxic", *(f"more_{i}" for i in range(len(more)))])

    return source.mapInArrow(lean(run), fields).select("doc_id", *names, "toxic", *(F.col(f"more_{i}").alias(c) for i, c in enumerate(more)))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, that are not toxic.

    What goes is a table of ids and digests, broadcast if it is small, so texts don't come back from Python. Rows with
    null or empty texts stay, as their probabilities are the constant's; repeated rows stay or go together; two rows
    of one id are told apart by their texts; an empty table gives no rows.
    """
    key = f"toxic_{uuid.uuid4().hex}"
    judged = score(docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias(key)), fit(docs, labels), REJECT, key)
    gone = written(judged.where("toxic").select(key).distinct(), "toxic-gone")
    kept = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(small(gone, gone.count()), key, "left_anti")
    return kept.drop(key)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` under a chain fitted on the labelled rows of ``docs``."""
    return score(docs, fit(docs, labels))
