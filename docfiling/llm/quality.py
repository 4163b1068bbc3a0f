"""Quality classifier: a regularised quadratic discriminant over statistics of the text.

Each document becomes a vector of transformed statistics (length, shares of kinds of characters, repetition, word
lengths).  Counts, sums and cross products by class come from Spark sums; the class covariances are shrunk towards the
pooled one and towards a multiple of the identity, factored once (Cholesky), and a document's score is the logistic of
the difference of the log densities, by Mahalanobis distances, plus the log prior odds.

Labels, language, source and id are never inputs.  All labelled rows outside the held-out fold are used.

Edge cases: null texts count as empty; empty texts get a score like any other.  Labels that are null or neither 0 nor 1
are ignored, repeated labels count as often as they stand there.  With no labelled rows every score is 0.5; with one class only,
every score is that class's smoothed share.  A row without an id is never labelled.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, SAME, chunks, small_batches, stage, word_hashes

_KINDS = {
    "upper": list(range(65, 91)),
    "digit": list(range(48, 58)),
    "mark": [b for b in b"!%$#&*@^~=+<>{}[]\\/_`"],
    "bar": [ord("|")],
    "stop": [b for b in b".,;:?"],
    "line": [10],
    "wide": list(range(0xC0, 0x100)),
}
NAMES = ["log_words", "log_word_length", *_KINDS, "distinct", "adjacent", "pairs"]
WIDTH = len(NAMES)
_TABLES = []
for _bytes in _KINDS.values():
    _t = np.zeros(256, np.int64)
    _t[_bytes] = 1
    _TABLES.append(_t)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of WIDTH transformed statistics for each text."""
    out = [np.zeros((0, WIDTH))]
    for a, b, data, offsets in chunks(column):
        hashes, first, starts, ends = word_hashes(data, offsets, SAME, BLANK)
        n_bytes, n_words = np.diff(offsets), np.diff(first)
        rows = np.zeros((b - a, WIDTH))
        words = np.maximum(n_words, 1)
        letters = np.concatenate([[0], np.cumsum(ends - starts)])
        rows[:, 0] = np.log1p(n_words)
        rows[:, 1] = np.log1p((letters[first[1:]] - letters[first[:-1]]) / words)
        total = np.zeros(len(data) + 1, np.int64)
        for k, table in enumerate(_TABLES, 2):
            np.cumsum(table[data], out=total[1:])
            rows[:, k] = np.log1p(100 * (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n_bytes, 1))
        same = np.zeros(len(hashes) + 1, np.int64)
        if len(hashes) > 1:
            np.cumsum(hashes[1:] == hashes[:-1], out=same[1:-1])
            same[-1] = same[-2]
        pairs = hashes.copy()
        pairs[:-1] = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
        for i in range(b - a):
            x, y = first[i], first[i + 1]
            if y > x:
                rows[i, 9] = np.log1p(20 * (1 - len(np.unique(hashes[x:y])) / (y - x)))
                rows[i, 10] = np.log1p(100 * (same[y - 1] - same[x]) / (y - x))
                rows[i, 11] = np.log1p(100 * (1 - len(np.unique(pairs[x : y - 1])) / max(1, y - x - 1))) if y - x > 1 else 0.0
        out.append(rows)
    return np.concatenate(out)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (array of WIDTH doubles) for each row."""
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, x array<double>")


class Discriminant:
    """Two Gaussian classes; `score` is the share of class 1."""

    def __init__(self, count: np.ndarray, total: np.ndarray, cross: np.ndarray, pooled_share: float = 0.1, ridge: float = 0.02):
        self.count = count
        self.prior = float((count[1] + 1) / (count.sum() + 2)) if count.sum() else 0.5
        self.ready = bool((count > 0).all())
        if not self.ready:
            return
        self.mean = total / count[:, None]
        scatter = np.array([cross[k] - count[k] * np.outer(self.mean[k], self.mean[k]) for k in (0, 1)])
        pooled = scatter.sum(axis=0) / count.sum()
        self.factor, self.log_det = [], []
        for k in (0, 1):
            own = (1 - pooled_share) * scatter[k] / count[k] + pooled_share * pooled
            size = max(np.trace(pooled) / len(pooled), 1e-6)
            low = np.linalg.cholesky((1 - ridge) * own + (ridge * size + 1e-9) * np.eye(len(pooled)))
            self.factor.append(low)
            self.log_det.append(2 * np.log(np.diag(low)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready or not len(x):
            return np.full(len(x), self.prior)
        log = []
        for k in (0, 1):
            z = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)
            log.append(-0.5 * ((z * z).sum(axis=0) + self.log_det[k]))
        odds = log[1] - log[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(found: DataFrame, labels: DataFrame, label_col: str = "quality", **shrinkage: float) -> Discriminant:
    """Fit on the labelled rows of doc_id, x outside the held-out fold.

    The sums reach the driver as 2 * (1 + WIDTH + WIDTH ** 2) numbers whatever the size of the input.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    rows = found.filter(~held_out()).join(known, "doc_id").select("y", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + WIDTH + WIDTH**2))
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, WIDTH)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        y, k = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(y.ravel(), pa.int32()), pa.array(k.ravel(), pa.int32()), pa.array(sums.ravel())], names=["y", "k", "v"])

    sums = np.zeros((2, 1 + WIDTH + WIDTH**2))
    for r in rows.mapInArrow(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect():
        sums[r["y"], r["k"]] = r["v"]
    return Discriminant(sums[:, 0], sums[:, 1 : 1 + WIDTH], sums[:, 1 + WIDTH :].reshape(2, WIDTH, WIDTH), **shrinkage)


def score(found: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score for each row of doc_id, x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return found.mapInArrow(run, "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    found = stage(features(docs, id_col, text_col), "statistics")
    return score(found, fit(found, labels)).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns as they were."""
    model = fit(stage(features(docs, id_col, text_col), "statistics"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array(model.score(statistics(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
