"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text gives STATISTICS numbers (lengths, character classes, repetition), each made more
nearly normal by a logarithm. Per class, count, sum and sum of outer products come
from all training rows by a combinable aggregation, so fitting needs no sample. A class
covariance is shrunk towards the pooled covariance's diagonal and factored by Cholesky once; a text's
score is the logistic of the difference of the two Mahalanobis log densities plus the log prior odds, tempered by TEMPERATURE.

Defined cases: null and empty texts are the empty text, which has a score like any other; repeated
rows are scored each; a null doc_id is not held out, and never labelled; a doc_id with several
labels counts as their rounded mean, null labels are left out; with one class or none to learn
from, scores are 0.5; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import SPACED, Words, bounded, release_memory, row_groups, stored, table, text_buffers

SHRINKAGE, TEMPERATURE, THRESHOLD, FOLDS = 0.1, 4.0, 0.3, 5
_KIND = np.zeros(256, np.int64)  # 0: other symbols
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[[32, 9, 11, 12, 13]], _KIND[10], _KIND[[44, 46]] = 5, 6, 7
STATISTICS = 22


def _share(x: float, n: float) -> float:
    return np.log(x / max(n, 1) + 0.005)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS numbers for each text."""
    out = np.zeros((len(offsets) - 1, STATISTICS))
    for lo, hi in row_groups(offsets):
        w = Words(data, offsets[lo : hi + 1], SPACED)
        length = w.end - w.start
        for r in range(hi - lo):
            raw = data[offsets[lo + r] : offsets[lo + r + 1]]
            h, size = w.hash[w.first[r] : w.first[r + 1]], length[w.first[r] : w.first[r + 1]]
            n, m = len(raw), len(h)
            hist = np.bincount(raw, minlength=256)
            kind = np.bincount(_KIND, hist, 8)
            p = hist[hist > 0] / max(n, 1)
            _, count = np.unique(h, return_counts=True)
            pairs = len(np.unique(h[1:] * np.uint64(3) + h[:-1])) if m > 1 else 0
            cut = np.flatnonzero(raw == 10)
            lines = raw.tobytes().split(b"\n") if len(cut) else []
            out[lo + r] = (
                np.log1p(n), np.log1p(m), *(_share(x, n) for x in kind), -(p * np.log(p)).sum(),
                _share(len(count), m), _share(count.max() if m else 0, m), _share((h[1:] == h[:-1]).sum() if m > 1 else 0, m), _share(pairs, m),
                np.log1p(size.mean() if m else 0), np.log1p(size.std() if m else 0), np.log1p(size.max() if m else 0), _share((size == 1).sum(), m),
                _share(len(lines) - len(set(lines)), len(lines)), _share(hist[124], m), _share(hist[33] + hist[35] + hist[36] + hist[37] + hist[42], m),
            )
    return out


def _statistic_rows(batches):
    for batch in batches:
        x = statistics(*text_buffers(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), STATISTICS).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


@dataclass
class Discriminant:
    """Class means, whitening by cached Cholesky factors, and constants of the log densities."""

    mean: np.ndarray
    white: np.ndarray
    constant: np.ndarray
    temperature: float = TEMPERATURE

    @classmethod
    def fit(cls, n: np.ndarray, total: np.ndarray, outer: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant | None:
        """From each class's count, sum and sum of outer products; None without both classes."""
        if min(n) < 1:
            return None
        mean = total / n[:, None]
        cov = outer / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (cov * n[:, None, None]).sum(0) / n.sum()
        target = np.diag(np.diag(pooled) + 1e-4)
        factors = [np.linalg.cholesky((1 - shrinkage) * c + shrinkage * target) for c in cov]
        constant = np.array([np.log(n[k] / n.sum()) - np.log(np.diag(f)).sum() for k, f in enumerate(factors)])
        return cls(mean, np.stack([np.linalg.inv(f) for f in factors]), constant)

    def score(self, x: np.ndarray) -> np.ndarray:
        d = [self.constant[k] - 0.5 * (((x - self.mean[k]) @ self.white[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((d[1] - d[0]) / self.temperature, -40, 40)))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def trainable(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): the rounded mean of a document's labels, where it is one of the two classes."""
    label = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    return label.where("quality in (0, 1)")


def _vectors(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, STATISTICS)


def _text_vectors(column) -> np.ndarray:
    return statistics(*text_buffers(column))


def learned(train: DataFrame, vectors=_vectors) -> Discriminant | None:
    """train: quality, and what `vectors` makes statistics of. What reaches the driver is two classes' moments, whatever the number of rows."""

    def moments(batches):
        release_memory()
        n, outer = np.zeros(2), np.zeros((2, STATISTICS + 1, STATISTICS + 1))
        for b in batches:
            q = b.column(0).to_numpy()
            x = np.column_stack((np.ones(len(q)), vectors(b.column(1))))
            for k in (0, 1):
                n[k] += (q == k).sum()
                outer[k] += x[q == k].T @ x[q == k]
        for k in (0, 1):
            if n[k]:
                size = outer[k].size
                yield pa.RecordBatch.from_arrays([pa.array([k] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(outer[k].reshape(-1))], ["k", "i", "v"])

    got = train.mapInArrow(moments, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    outer = np.zeros((2, (STATISTICS + 1) ** 2))
    for r in got:
        outer[r.k, r.i] = r.v
    outer = outer.reshape(2, STATISTICS + 1, STATISTICS + 1)
    return Discriminant.fit(outer[:, 0, 0], outer[:, 0, 1:], outer[:, 1:, 1:])


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant | None:
    """rows: doc_id, x."""
    return learned(rows.where(~held_out()).join(trainable(labels), "doc_id").select("quality", "x"))


def statistics_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_statistic_rows, "doc_id long, x array<double>")


def scored(rows: DataFrame, model: Discriminant | None) -> DataFrame:
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if model and len(x) else np.full(len(x), 0.5))

    return rows.select("doc_id", held_out().alias("held_out"), score("x").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(statistics_of(table(spark, sf_dir, "documents")))
    return scored(rows, fit(rows, table(spark, sf_dir, "labels")))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts; all columns are kept.

    Statistics are computed of the rows to learn from, and of each row as it is scored; none is stored. Null and empty
    texts are scored like others, repeated rows and null doc_ids are kept or go each by its text; without labels of both
    classes all rows stay; an empty table gives no rows.
    """
    learn = docs.where(~held_out()).select("doc_id", "text").join(bounded(trainable(labels)), "doc_id").select("quality", "text")
    model = learned(learn, _text_vectors)  # in one pass of Python, so that a task keeps one worker

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics(*text_buffers(pa.array(text, pa.string())))) if model and len(text) else np.full(len(text), 0.5))

    return docs.where(score("text") >= THRESHOLD)
