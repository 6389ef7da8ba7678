"""Quality by regularised quadratic discriminant analysis.

A text becomes a short vector of transformed statistics of all its bytes and
words.  Class means and covariances come from sums that every task adds up for
itself, so all labelled rows train and the driver sees a few hundred numbers.
Covariances shrink towards their diagonal and a multiple of the identity; the
score is the logistic of the difference of the Mahalanobis log densities plus
log priors, computed with cached Cholesky factors.

Defined cases: a null text counts as empty and gets a score; labels other than
0 and 1, or null, train nothing; several labels of one doc_id each count; with
one class only, or none, every score is 1 or the share of ones, 0.5 without
labels; rows repeated with one doc_id each count and each get a score; an empty table gives no rows;
extra columns are ignored, and kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import NOT_SPACE, chunks, text_bytes, tidy, words_of
from .common import filter_texts, held_out, staged, table

FEATURES = ("word_bytes", "upper", "digits", "stops", "symbols", "new_lines", "repeats", "variety", "wide")

_CLASSES = np.zeros(256, np.uint8)
_CLASSES[65:91] = 1
_CLASSES[97:123] = 2
_CLASSES[48:58] = 3
_CLASSES[list(b".,;:'\"()-?")] = 4
_CLASSES[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 5
_CLASSES[10] = 6
_CLASSES[128:] = 7


#: Signs, and words, of common prose that every text is read with: a short text has no extreme shares by chance.
BACKGROUND = 60.0
BACKGROUND_WORDS = 20.0


def _share(part: np.ndarray, whole: np.ndarray, usual: float, more: float = BACKGROUND) -> np.ndarray:
    """Variance-stabilised share, 0 to pi / 2, with ``more`` signs of the usual share added."""
    return np.arcsin(np.sqrt(np.clip((part + usual * more) / (whole + more), 0.0, 1.0)))


def _of_chunk(body: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    words = words_of(body, offsets, lo, hi, NOT_SPACE)
    a = int(offsets[lo])
    raw, at = body[a : int(offsets[hi])], offsets[lo : hi + 1] - a
    kinds = _CLASSES[raw]
    count = np.zeros((8, hi - lo))
    some = np.flatnonzero(at[1:] > at[:-1])
    for k in range(8 if len(some) else 0):
        count[k, some] = np.add.reduceat(kinds == k, at[some], dtype=np.int64)
    upper, lower, digits, stops, symbols, lines, wide = count[1:]
    n_words = np.diff(words.at).astype(float)
    n_bytes = np.diff(at).astype(float)
    same = np.zeros(len(words.hash) + 1, np.int64)
    if len(words.hash) > 1:
        again = np.zeros(len(words.hash), bool)
        again[1:] = words.hash[1:] == words.hash[:-1]
        first = words.at[:-1][words.at[:-1] < len(again)]
        again[first] = False
        np.cumsum(again, out=same[1:])
    repeats = same[words.at[1:]] - same[words.at[:-1]]
    kinds_of = np.array([len(np.unique(words.hash[words.at[i] : words.at[i + 1]])) for i in range(hi - lo)], float)
    out = np.empty((hi - lo, len(FEATURES)))
    more = BACKGROUND_WORDS
    out[:, 0] = np.log((n_bytes + 6.0 * more) / (n_words + more))
    out[:, 1] = _share(upper, upper + lower, 0.03)
    out[:, 2] = _share(digits, n_bytes, 0.002)
    out[:, 3] = _share(stops, n_bytes, 0.03)
    out[:, 4] = _share(symbols, n_bytes, 0.0)
    out[:, 5] = _share(lines, n_words, 0.02, more)
    out[:, 6] = _share(repeats, n_words, 0.0, more)
    out[:, 7] = np.log(kinds_of + more) / np.log(n_words + more)
    out[:, 8] = _share(wide, n_bytes, 0.03)
    return out


def text_features(column: pa.Array) -> np.ndarray:
    body, offsets = text_bytes(column)
    parts = [_of_chunk(body, offsets, lo, hi) for lo, hi in chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x): the statistics of each row, from one pass over the texts."""

    def run(batches):
        for batch in batches:
            x = text_features(batch.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), flat], ["doc_id", "held_out", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """By class: rows, sum of x and sum of its outer products, over all of ``labelled`` (quality, x)."""
    d = len(FEATURES)

    def run(batches):
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y, x = batch.column("quality").to_numpy(zero_copy_only=False), _matrix(batch.column("x"))
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        for c in (0, 1):
            if sums[c, 0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(sums.shape[1], c), pa.int32()), pa.array(np.arange(sums.shape[1]), pa.int32()), pa.array(sums[c])], ["c", "at", "v"])

    got = labelled.select(F.col("quality").cast("int").alias("quality"), "x").mapInArrow(tidy(run), "c int, at int, v double").groupBy("c", "at").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in got:
        out.setdefault(r["c"], np.zeros(1 + d + d * d))[r["at"]] = r["v"]
    return {c: (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d)) for c, v in out.items()}


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-density offsets of both classes."""

    prior: float
    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    offset: np.ndarray | None = None

    @classmethod
    def fit(cls, sums, shrink: float = 0.1, floor: float = 1e-4) -> Discriminant:
        n = sum(v[0] for v in sums.values())
        if len(sums) < 2:
            return cls(prior=(sums[1][0] / n if 1 in sums else 0.0) if n else 0.5)
        means, whiten, offset = [], [], []
        for c in (0, 1):
            m, s, ss = sums[c]
            mean = s / m
            cov = ss / m - np.outer(mean, mean)
            weight = max(shrink, min(1.0, len(mean) / m))
            cov = (1 - weight) * cov + weight * np.diag(np.diag(cov))
            cov += (floor + 1e-2 * weight * np.trace(cov) / len(cov)) * np.eye(len(cov))
            root = np.linalg.cholesky(cov)
            means.append(mean)
            whiten.append(np.linalg.inv(root))
            offset.append(np.log(m / n) - np.log(np.diag(root)).sum())
        return cls(sums[1][0] / n, np.array(means), np.array(whiten), np.array(offset))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if self.means is None:
            return np.full(len(x), self.prior)
        g = [self.offset[c] - 0.5 * np.square((x - self.means[c]) @ self.whiten[c].T).sum(axis=1) for c in (0, 1)]
        return 1.0 / (1.0 + np.exp(np.clip(g[0] - g[1], -500.0, 500.0)))


class QualityClassifier:
    """Scores of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality) of rows that aren't held out."""

    def __init__(self, docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None):
        self.features = staged(feature_table(docs), "features")
        taught = self.features if learn_from is None else feature_table(learn_from)
        known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality in (0, 1)")
        rows = taught.where("not held_out").join(known, "doc_id").select("quality", "x")
        self.model = Discriminant.fit(moments(rows))

    def scores(self) -> DataFrame:
        """(doc_id, held_out, score, predicted) for each row."""
        model = self.model

        def run(batches):
            for batch in batches:
                s = model.score(_matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return self.features.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more; learnt from ``labels`` of rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality in (0, 1)")
    model = Discriminant.fit(moments(feature_table(docs).where("not held_out").join(known, "doc_id").select("quality", "x")))

    def judge(batches):
        for batch in batches:
            yield model.score(text_features(batch.column("text"))) >= least

    return filter_texts(docs, judge)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QualityClassifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).scores()
