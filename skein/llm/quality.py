"""Quality classification by regularised quadratic discriminant analysis."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm._text import chunks, word_hashes, words

FEATURES = ("bytes", "words", "word_bytes", "upper", "digits", "marks", "symbols", "markup", "emphasis", "other", "breaks", "same_as_before", "different")

#: The class of a byte: 0 lower-case letters and continuation, 1 A-Z, 2 digits, 3 usual marks,
#: 4 symbols, 5 what menus, tables and markup are set with, 6 exclamation and question marks,
#: 7 white space, 8 bytes over 127, 9 line breaks.
_CLASS = np.full(256, 4, np.int64)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 3
_CLASS[[ord(c) for c in "|<>{}[]=_/\\~#*"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[[9, 11, 12, 13, 32]] = 7
_CLASS[10] = 9
_CLASS[128:] = 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of each text: logarithms of sizes, logits of shares."""
    n, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n) * 10, size)
    owner += _CLASS[data]
    of = np.bincount(owner, minlength=n * 10).reshape(n, 10).astype(float)
    starts, ends, counts = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    word_owner = np.repeat(np.arange(n), counts)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
    order = np.lexsort((hashes, word_owner))
    h, o = hashes[order], word_owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    repeated = np.bincount(word_owner[same], minlength=n)
    different = np.bincount(o[new], minlength=n)
    letters = np.bincount(word_owner, weights=ends - starts, minlength=n)

    def logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.log((part + 0.5) / (whole - part + 0.5))

    # a text uses about words ** 0.9 different words; more than that is no better
    usual = np.minimum(different / np.maximum(counts, 1) ** 0.9, 1)
    columns = [np.log1p(size), np.log1p(counts), np.log1p(letters / np.maximum(counts, 1))]
    columns += [logit(of[:, k], size) for k in (1, 2, 3, 4, 5, 6, 8, 9)]
    columns += [logit(repeated, np.maximum(counts, repeated)), np.log(usual + 0.01)]
    return np.stack(columns, 1)


@dataclass(frozen=True)
class QualityModel:
    """Means, inverse Cholesky factors and log-determinants of the classes 0 and 1."""

    prior: float
    means: np.ndarray
    factors: np.ndarray
    dets: np.ndarray
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The posterior of class 1, from the difference of Mahalanobis log-densities."""
        if not len(self.means):
            return np.full(len(x), self.prior)
        z = [(x - m) @ f.T for m, f in zip(self.means, self.factors)]
        density = [-0.5 * (np.einsum("ij,ij->i", y, y) + d) for y, d in zip(z, self.dets)]
        odds = (density[1] - density[0]) / self.temper + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of every row and whole text: its statistics as float64 bytes. What follows
    moves these alone, no text. Null texts count as empty. Repeated rows give repeated rows; no
    other column is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, text_col):
            yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array([x.tobytes() for x in features(data, offsets)], pa.binary())], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, "doc_id long, x binary")


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("x").to_pylist())).reshape(rows.num_rows, len(FEATURES))


def fit(labelled: DataFrame, label_col: str = "quality", shrink: float = 0.1, temper: float = 3.0) -> QualityModel:
    """Fits on every row of statistics x with a label 0 or 1, from the classes' counts, sums and
    products alone, which tasks add up; the driver reads one fixed-size matrix. A class
    covariance is shrunk by `shrink` towards the pooled diagonal. Log-density differences are
    divided by `temper`, as statistics of one text are not independent. With a class missing
    every score is the smoothed share of class 1."""
    d = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1))
        for rows in batches:
            x = np.hstack([np.ones((rows.num_rows, 1)), _matrix(rows)])
            y = rows.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(total.size), pa.int32()), "x": total.ravel()})

    rows = labelled.select("x", F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)")
    found = rows.mapInArrow(moments, "place int, x double").groupBy("place").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros(2 * (d + 1) ** 2)
    total[found["place"]] = found["x"]
    total = total.reshape(2, d + 1, d + 1)
    n = total[:, 0, 0]
    prior = (n[1] + 1) / (n.sum() + 2)
    if n.min() < 2:
        return QualityModel(prior, np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), temper)
    means = total[:, 0, 1:] / n[:, None]
    spread = [t[1:, 1:] / c - np.outer(m, m) for t, c, m in zip(total, n, means)]
    pooled = np.diag((spread[0] * n[0] + spread[1] * n[1]) / n.sum()) + 1e-6
    covariances = [(1 - shrink) * s + shrink * np.diag(pooled) + 1e-6 * np.eye(d) for s in spread]
    lower = [np.linalg.cholesky(c) for c in covariances]
    return QualityModel(prior, means, np.stack([np.linalg.inv(f) for f in lower]), np.array([2 * np.log(np.diag(f)).sum() for f in lower]), temper)


def score_quality(stats: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of rows of statistics(): the posterior of label 1, and whether it
    is threshold or more. Empty texts have their statistics and so their score too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            score = model.score(_matrix(rows))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")
