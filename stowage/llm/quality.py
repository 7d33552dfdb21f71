"""Quality by regularised quadratic discriminant analysis.

Every document becomes a short vector of transformed statistics of its whole text. Counts, sums and products of
the vectors are added up by class in Spark; class covariances are shrunk towards the pooled one and its diagonal.
A score is the logistic of the difference of two log densities, each from a cached Cholesky factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small, text_of, written
from ._words import buffers, lean, mix, slices, word_hashes

#: Shares of the pooled covariance in a class's, and of the pooled diagonal in the result.
POOLED, DIAGONAL = 0.1, 0.05
#: A document is predicted good at this score.
GOOD = 0.3
HELD_OUT = 5

_ASCII = np.arange(256)
_UPPER = (_ASCII >= ord("A")) & (_ASCII <= ord("Z"))
_LETTER = _UPPER | ((_ASCII >= ord("a")) & (_ASCII <= ord("z"))) | (_ASCII >= 0x80)
_DIGIT = (_ASCII >= ord("0")) & (_ASCII <= ord("9"))
_SPACE = (_ASCII == 0x20) | ((_ASCII >= 9) & (_ASCII <= 13))
_STOP = np.isin(_ASCII, [ord(c) for c in ".,"])
_MARK = ~(_LETTER | _DIGIT | _SPACE | _STOP)
FEATURES = ("words", "word_length", "length_spread", "upper", "stops", "marks", "digits", "lines", "distinct", "repeats", "top_word", "capitals", "mark_ends")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log-odds of a share, with half a count on either side."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by FEATURES of texts that lie at ``offsets`` in ``data``."""
    at = offsets - offsets[0]
    data = data[offsets[0] : offsets[-1]]
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    n_bytes = np.diff(at).astype(float)
    space = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    starts = ~space
    starts[1:] &= space[:-1] | first[1:-1]
    ends = ~space
    ends[:-1] &= space[1:] | first[1:-1]
    n = sums(starts).astype(float)
    lo, hi = np.flatnonzero(starts), np.flatnonzero(ends)
    length = (hi - lo + 1).astype(float)
    row = np.searchsorted(at, lo, side="right") - 1
    m = len(at) - 1
    mean = np.bincount(row, length, m) / np.maximum(n, 1)
    square = np.bincount(row, length**2, m) / np.maximum(n, 1)
    letters = sums(_LETTER[data])
    hashes, words_at = word_hashes(data, at)
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) > 1 else hashes[:0]
    distinct, repeats, top = np.zeros(m), np.zeros(m), np.zeros(m)
    for i, (a, b) in enumerate(zip(words_at[:-1].tolist(), words_at[1:].tolist(), strict=True)):
        if b > a:
            counts = np.unique(hashes[a:b], return_counts=True)[1]
            distinct[i], top[i] = len(counts), counts.max()
            repeats[i] = b - a - 1 - len(np.unique(pairs[a : b - 1])) if b - a > 1 else 0
    capitals = np.bincount(row, _UPPER[data[lo]], m)
    mark_ends = np.bincount(row, _MARK[data[hi]], m)
    return np.column_stack(
        [
            np.log1p(n), np.log1p(mean), np.log1p(np.sqrt(np.maximum(square - mean**2, 0))), _share(sums(_UPPER[data]), letters), _share(sums(_STOP[data]), n_bytes),
            _share(sums(_MARK[data]), n_bytes), _share(sums(_DIGIT[data]), n_bytes), _share(sums(data == 10), n), _share(distinct, n), _share(repeats, n),
            _share(top, n), _share(capitals, n), _share(mark_ends, n),
        ]
    )


@dataclass
class Discriminant:
    means: np.ndarray  #: classes by features
    factors: list[np.ndarray]  #: inverses of the Cholesky factors of the classes' covariances
    constants: np.ndarray  #: log prior less half the log determinant

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        logs = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def fit_sums(n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """From counts, sums and products of the vectors of the two classes. A class without rows takes the pooled moments."""
    d = sums.shape[1]
    total = max(1.0, n.sum())
    pooled_mean = sums.sum(axis=0) / total
    means = np.array([s / k if k else pooled_mean for s, k in zip(sums, n, strict=True)])
    own = [p / k - np.outer(m, m) if k else np.zeros((d, d)) for p, m, k in zip(products, means, n, strict=True)]
    pooled = sum(k * c for k, c in zip(n, own, strict=True)) / total
    spread = np.diag(np.maximum(np.diag(pooled), 1e-3))
    factors, constants = [], []
    for k, cov in zip(n, own, strict=True):
        weight = k / (k + 10 * d)  # a small class leans on the pooled moments
        cov = weight * ((1 - POOLED) * cov + POOLED * pooled) + (1 - weight) * pooled
        chol = np.linalg.cholesky((1 - DIAGONAL) * cov + DIAGONAL * spread)
        factors.append(np.linalg.inv(chol))
        constants.append(np.log((k + 1) / (total + 2)) - np.log(np.diag(chol)).sum())
    return Discriminant(means, factors, np.array(constants))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(False))


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and the vector x (array of double) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(*buffers(part.column("text")))
                at = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["doc_id", "x"])

    return text_of(docs).mapInArrow(lean(run), "doc_id long, x array<double>")


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """Fits on the labelled rows of doc_id, x that aren't held out, all of them; only sums reach the driver."""
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    known = written(known.where(~held_out(F.col("doc_id"))), "quality-labels")
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            y = batch.column("y").to_numpy()
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([t.tolist() for t in total])], ["y", "sums"])

    parts = rows.join(small(known, known.count()), "doc_id").select("x", "y").mapInArrow(lean(sums), "y long, sums array<double>")
    found = np.zeros((2, 1 + d + d * d))
    for r in parts.select("y", F.posexplode("sums")).groupBy("y", "pos").agg(F.sum("col").alias("s")).collect():
        found[r["y"], r["pos"]] = r["s"]
    return fit_sums(found[:, 0], found[:, 1 : 1 + d], found[:, 1 + d :].reshape(2, d, d))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only the text makes a score. Null and empty texts have the vector of no words; rows are independent, so ties,
    repeated rows and null ids come out as they are (a null id isn't held out and has no label). Without labels all
    scores are 0.5 where neither class is known; an empty table gives no rows. Columns other than doc_id and text
    are not looked at.
    """
    rows = written(vectors(docs), "quality-vectors")
    model = fit(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    scored = rows.mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
