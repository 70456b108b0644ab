"""Document quality by a regularised quadratic discriminant.

A document is a short vector of transformed statistics of its whole text. Each class is a normal density
whose covariance is shrunk towards the classes' pooled one, and that towards its own diagonal. The score
is the posterior of class 1, from the difference of the log densities: Mahalanobis distances and log
determinants come from Cholesky factors that are computed once and sent with the task.

The statistics of all documents are written once; the classes' means and covariances are sums over all
labelled rows that may be learnt from, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, begin, fold, matrix, sub_batches, sum_vectors, text_bytes

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGIT = bytes(range(0x30, 0x3A))
_BLANK = b" \t\n\x0b\f\r"
_HIGH = bytes(range(0x80, 0x100))

#: Names of the statistics, in the order of :func:`statistics`.
STATISTICS = ("words", "word_length", "upper", "signs", "doubled_signs", "bars", "cries", "digits", "repeats", "variety", "same_lines", "stops")


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a text; all zero where it has no words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(text)
    filled = sum(map(len, words))
    upper = size - len(text.translate(None, _UPPER))
    lower = size - len(text.translate(None, _LOWER))
    digits = size - len(text.translate(None, _DIGIT))
    marks = text.translate(None, _UPPER + _LOWER + _DIGIT + _HIGH + _BLANK)
    doubled = 0
    if marks:
        raw = np.frombuffer(text, np.uint8)
        sign = (raw > 0x20) & (raw < 0x7F) & ~_ALNUM[raw]
        doubled = int(((raw[1:] == raw[:-1]) & sign[1:]).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(n),
        np.log(filled / n),
        (upper / (upper + lower + 1)) ** 0.5,
        (len(marks) / filled) ** 0.5,
        (doubled / n) ** 0.5,
        (marks.count(b"|") / n) ** 0.5,
        (marks.count(b"!") / n) ** 0.5,
        (digits / filled) ** 0.5,
        (sum(map(eq, words, words[1:])) / n) ** 0.5,
        np.log(len(set(words)) / n) / np.log(n + 9),
        (1 - len(set(lines)) / len(lines)) ** 0.5 if lines else 0.0,
        (marks.count(b".") / n) ** 0.5,
    ]


_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = True
WIDTH = len(STATISTICS)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every whole text; null texts count as empty."""
    begin(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            stats = [statistics(t) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Discriminant:
    """Two normal densities; ``whiten[c]`` is the inverse of the lower Cholesky factor of class c."""

    prior: float
    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The posterior of class 1 of each row."""
        if not len(self.means):
            return np.full(len(x), self.prior)
        logs = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.whiten[c].T
            logs.append(-0.5 * (z * z).sum(1) - 0.5 * self.log_det[c])
        odds = np.log(self.prior / (1 - self.prior)) + logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(rows: DataFrame, shrink: float = 0.3, diagonal: float = 0.1) -> Discriminant:
    """``rows`` (label 0 or 1, stats). A class without rows leaves a constant: the other class's share."""
    block = 1 + WIDTH + WIDTH * WIDTH

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, y = matrix(batch.column("stats"), WIDTH), batch.column("label").to_numpy(zero_copy_only=False)
        out = []
        for c in (0, 1):
            some = x[y == c]
            out += [[len(some)], some.sum(0), (some.T @ some).ravel()]
        return np.concatenate(out)

    sums = sum_vectors(rows.where("label in (0, 1)"), moments, 2 * block).reshape(2, block)
    n = sums[:, 0]
    total = n.sum()
    prior = float((n[1] + 1) / (total + 2))
    if n.min() < 2:
        return Discriminant(prior, np.empty((0, WIDTH)), np.empty((0, WIDTH, WIDTH)), np.empty(0))
    means = sums[:, 1 : 1 + WIDTH] / n[:, None]
    spread = sums[:, 1 + WIDTH :].reshape(2, WIDTH, WIDTH) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = spread.sum(0) / total
    pooled = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(WIDTH)
    whiten, log_det = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrink) * spread[c] / n[c] + shrink * pooled)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(prior, means, np.array(whiten), np.array(log_det))


def _fitted(stats: DataFrame, labels: DataFrame, modulus: int, held_out: int) -> Discriminant:
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(~fold("doc_id", modulus, held_out))
    return fit(stats.join(usable, "doc_id").select("label", "stats"))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are learnt only from rows whose crc32(doc_id as text) mod ``modulus`` is not ``held_out``; labels
    other than 0 and 1 and null ids are ignored, a repeated label counts each time. Texts that are null or
    empty have a score too; texts of any length are read whole; repeated rows repeat. An empty table gives
    no rows; other columns are not read, whatever their names.
    """
    stats = Written(document_statistics(docs), "quality-stats").df
    model = _fitted(stats, labels, modulus, held_out)
    begin(docs.sparkSession, 1 << 13)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(matrix(batch.column("stats"), WIDTH))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = stats.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", fold("doc_id", modulus, held_out).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The input's rows whose score reaches the threshold, as they were: each is judged where it lies.

    Statistics are worked out again for that, as this costs less than moving texts to meet their scores. Null
    and empty texts are judged like any other, repeated rows repeat, null ids do not matter, an empty table
    stays empty."""
    stats = Written(document_statistics(docs, text_col=text_col), "quality-stats")
    model = _fitted(stats.df, labels, modulus, held_out)
    stats.drop()
    begin(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, text_col):
            x = np.array([statistics(t) for t in text_bytes(batch.column(text_col))])
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
