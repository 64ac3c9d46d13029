"""Operator 4: quality classifier, a regularised quadratic discriminant.

Each text becomes a fixed vector of transformed statistics (shares through an arcsine root, counts through logarithms). Each class
has a mean and a covariance, shrunk towards the pooled one and a multiple of the identity. A score is the logistic of the log-density difference, from
Mahalanobis distances by Cholesky factors that are computed once and sent to the workers (a few KB).

The classifier is fitted on at most SAMPLE labelled rows, those with the smallest hash of their id; everything else covers all rows. Only the text enters a
score. Rows whose crc32(doc_id as text) mod 5 is 0 are held out and never fitted on.

Defined cases: null and empty texts have all statistics 0 and a score like any other, very long ones are read whole; a null doc_id is neither held out nor fitted on; repeated rows are
scored each, and of rows with one doc_id one text is fitted on, the first in order; other columns, whatever their names, are ignored, or kept by keep_good(); without labelled rows of both classes every score is the share of label 1 (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain, table
from .hashing import SEPARATOR, mix, text_chunks, windows, word_hashes, words

SAMPLE, POOLED, RIDGE, THRESHOLD = 20_000, 0.5, 0.05, 0.3
NAMES = ("words", "length", "length_sd", "upper", "digits", "stops", "symbols", "bars", "wide", "breaks", "spaces", "repeated", "top", "again", "short", "marked", "line")


def _class(characters: str) -> np.ndarray:
    found = np.zeros(256, np.int64)
    found[[ord(c) for c in characters]] = 1
    return found


_UPPER, _DIGITS, _STOPS, _BARS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(".,;:?'\"-()"), _class("|")
_SYMBOLS = _class("!#$%&*+/<=>@[\\]^_`{}~")
_WIDE, _BREAK, _GAP = (np.arange(256) >= 128).astype(np.int64), _class("\n"), SEPARATOR.astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each document."""
    n = len(offsets) - 1
    w = words(data, offsets)
    h = word_hashes(data, w, lower=True)
    size = np.diff(offsets)
    count = np.diff(w.first)

    def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return (total[at[1:]] - total[at[:-1]]).astype(np.float64)

    some, chars = np.maximum(count, 1), np.maximum(size, 1)
    long = (w.ends - w.starts).astype(np.float64)
    mean = per_doc(long, w.first) / some
    spread = np.sqrt(np.maximum(per_doc(long**2, w.first) / some - mean**2, 0))
    share = lambda k: np.arcsin(np.sqrt(np.clip(per_doc(k[data], offsets) / chars, 0, 1)))
    last = data[w.ends - 1] if len(w.ends) else np.empty(0, np.uint8)
    marked = per_doc(_SYMBOLS[last] + _BARS[last], w.first) / some
    distinct, top, again = np.zeros(n), np.zeros(n), np.zeros(n)
    pairs = mix(windows(h, 2))
    for d in np.flatnonzero(count):
        a, b = w.first[d], w.first[d + 1]
        _, times = np.unique(h[a:b], return_counts=True)
        distinct[d], top[d] = len(times) / (b - a), times.max() / (b - a)
        if b - a > 1:
            again[d] = 1 - len(np.unique(pairs[a : b - 1])) / (b - a - 1)
    root = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    breaks = per_doc(_BREAK[data], offsets)
    columns = [
        np.log1p(count), np.log1p(mean), np.log1p(spread), share(_UPPER), share(_DIGITS), share(_STOPS), share(_SYMBOLS), share(_BARS), share(_WIDE), share(_BREAK), share(_GAP),
        root(1 - distinct) * (count > 0), root(top), root(again), root(per_doc((long <= 3).astype(np.int64), w.first) / some), root(marked), np.log1p(size / (breaks + 1)),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    prior: float
    mean: np.ndarray | None = None  # 2 x features
    factor: np.ndarray | None = None  # 2 inverse Cholesky factors
    logdet: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior)
        density = [-0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(axis=1) - 0.5 * self.logdet[k] for k in (0, 1)]
        odds = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    prior = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or len(np.unique(y)) < 2:
        return Model(prior)
    parts = [x[y == k] for k in (0, 1)]
    means = np.stack([p.mean(axis=0) for p in parts])
    centred = [p - m for p, m in zip(parts, means, strict=True)]
    whole = sum(c.T @ c for c in centred) / len(x)
    scale = np.diag(np.maximum(np.diag(whole), 1e-4))
    factors, logdets = [], []
    for c in centred:
        own = c.T @ c / len(c)
        weight = max(pooled, min(1.0, x.shape[1] / len(c)))
        lower = np.linalg.cholesky((1 - weight) * own + weight * whole + ridge * scale)
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * np.log(np.diag(lower)).sum())
    return Model(prior, means, np.stack(factors), np.array(logdets))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 5 == 0, F.lit(False))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in text_chunks(batch.column("text")):
            x = features(data, offsets)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(row, end - row), flat], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows of `labels` (doc_id, quality) that aren't held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    chosen = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    # one text of each (doc_id, label): `sample` rows reach the driver at most, however often an id is repeated
    texts = plain(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.select("label", "text").mapInArrow(_vectors, "label int, x array<double>").collect()
    rows.sort()  # arrival order must not matter
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(NAMES)), np.array([r.label for r in rows], np.int64))


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, end - row) for k in batch.schema.names if k != "text"), pa.array(model.value.score(features(data, offsets)))], [*(k for k in batch.schema.names if k != "text"), "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = plain(docs).withColumn("held_out", held_out()).select("doc_id", "held_out", "text").mapInArrow(_scores(shared), "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score `threshold` at least, with all their columns."""
    from pyspark.sql.functions import pandas_udf

    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def of(text):
        import pandas as pd

        held = pa.array(text, pa.string())
        parts = [shared.value.score(features(data, offsets)) for _, _, data, offsets in text_chunks(held)]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return docs.where(of(F.coalesce(F.col("text"), F.lit(""))) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
