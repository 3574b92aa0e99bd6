"""Quality score from a regularised quadratic discriminant (operator 9).

Document statistics are counted once per text, transformed (logarithm or square root) and
stored, narrow. Class means and covariances are sums over all labelled learnable documents,
combined before the shuffle. Each covariance is shrunk towards the pooled variances; its
Cholesky factor is computed once and used for every Mahalanobis distance. The difference of
the two log densities, with the prior, is turned into a probability by a line fitted on a
bounded sample of CALIBRATION labelled rows.

Learnable: a label is known and crc32(doc_id as text) mod FOLDS is not 0. Labels, lang,
source and doc_id are never inputs of a score.

Defined results: null text counts as empty; an empty text has a score like any other; a
null doc_id is never learnt from; with labels of one class or none every score is the share
of 1 with one imagined row of each; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import Texts, as_texts, hash_sample, prepare, slices, stored, texts_of, windows_of, words_of

FOLDS, THRESHOLD, SHRINKAGE, CALIBRATION = 5, 0.3, 0.2, 20_000
FEATURES = [
    "words", "word_bytes", "distinct_words", "adjacent_repeats", "top_word", "repeated_windows", "symbols", "exclaims", "stops",
    "upper", "digits", "wide", "lines", "repeated_lines",
]
_CLASSES = {name: np.isin(np.arange(256), list(chars)) for name, chars in {
    "symbols": b"#*$%&|<>", "exclaims": b"!?", "stops": b".,;:", "upper": range(65, 91), "digits": range(48, 58), "wide": range(128, 256),
}.items()}


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def _distinct(codes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each text, and how often its most frequent one occurs."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(codes):
        order = np.lexsort((codes, of))
        c, o = codes[order], of[order]
        begins = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (o[1:] != o[:-1])]))
        runs = np.diff(np.append(begins, len(c)))
        np.add.at(distinct, o[begins], 1)
        np.maximum.at(top, o[begins], runs)
    return distinct, top


def _lines(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the lines that aren't empty, and their texts."""
    from scholia.llm.common import span_hashes

    data, offsets = texts
    cuts = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10) if len(ends) else ends
    full = ends > starts
    starts, ends = starts[full], ends[full]
    return span_hashes(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1


def statistics(texts: Texts) -> np.ndarray:
    """The transformed statistics of each text, in the order of FEATURES."""
    n = len(texts.offsets) - 1
    size = np.diff(texts.offsets)
    words = words_of(texts)
    count = np.diff(words.first)
    per_word, per_byte = 1 / np.maximum(count, 1), 1 / np.maximum(size, 1)
    rate = {
        k: np.bincount(np.searchsorted(texts.offsets, np.flatnonzero(inside[texts.data]), "right") - 1, minlength=n)[:n]
        for k, inside in _CLASSES.items()
    }
    distinct, top = _distinct(words.codes, words.of, n)
    next_same = (words.codes[1:] == words.codes[:-1]) & (words.of[1:] == words.of[:-1])
    eights = windows_of(words.codes, 8)[: max(0, len(words.codes) - 7)]
    inside = words.of[7:] == words.of[: len(eights)] if len(eights) else np.zeros(0, bool)
    n_windows = np.maximum(count - 7, 0)
    fresh, _ = _distinct(eights[inside], words.of[: len(eights)][inside], n)
    lines, line_of = _lines(texts)
    n_lines = np.bincount(line_of, minlength=n)
    fresh_lines, _ = _distinct(lines, line_of, n)
    length = np.bincount(words.of, words.ends - words.starts, minlength=n)
    return np.stack([
        np.log1p(count), np.log1p(length * per_word), distinct * per_word, np.sqrt(np.bincount(words.of[1:][next_same], minlength=n) * per_word),
        np.sqrt(top * per_word), np.sqrt((n_windows - fresh) / np.maximum(n_windows, 1)),
        *[np.sqrt(rate[k] * (per_word if k in ("symbols", "exclaims", "stops") else per_byte)) for k in _CLASSES],
        np.sqrt(n_lines * per_word), np.sqrt((n_lines - fresh_lines) / np.maximum(n_lines, 1)),
    ], axis=1)


def features(documents: DataFrame) -> DataFrame:
    """Per document: doc_id and the transformed statistics."""
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = statistics(as_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in x.T]], names=["doc_id", *FEATURES])

    return texts_of(documents).mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


class Model(NamedTuple):
    """Means and inverse Cholesky factors of classes 0 and 1, their log determinants, the log prior odds, and the score's line."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float
    slope: float
    offset: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with the prior."""
        logs = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets)]
        return logs[1] - logs[0] + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(x) + self.offset, -500, 500)))


def _line(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, slightly held back so that separable classes give finite ones."""
    scale = max(float(np.abs(z).mean()), 1e-9)
    z, w = np.clip(z / scale, -20, 20), np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))], axis=1)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-6) / scale, float(w[1])


def learn(stats: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, calibration: int = CALIBRATION) -> Model:
    """Fit on the statistics of the labelled learnable documents."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold() != 0)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")
    )
    rows = stats.join(known, "doc_id")
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("label").agg(
        F.count("*").alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i, j in pairs],
    ).collect()
    by = {r["label"]: r for r in sums}
    n = [by[c]["n"] if c in by else 0 for c in (0, 1)]
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n) < 2:
        none = np.zeros((0, d))
        return Model(none, none, np.zeros(0), prior, 1.0, 0.0)
    means, spreads = [], []
    for c in (0, 1):
        mean = np.array([by[c][f"s{i}"] for i in range(d)]) / n[c]
        square = np.zeros((d, d))
        for i, j in pairs:
            square[i, j] = square[j, i] = by[c][f"s{i}_{j}"] / n[c]
        means.append(mean)
        spreads.append(square - np.outer(mean, mean))
    pooled = np.diag((n[0] * np.diag(spreads[0]) + n[1] * np.diag(spreads[1])) / sum(n) + 1e-4)
    factors, log_dets = [], []
    for c in (0, 1):
        lower = np.linalg.cholesky((1 - shrinkage) * spreads[c] + shrinkage * pooled + 1e-6 * np.eye(d))
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    model = Model(np.array(means), np.array(factors), np.array(log_dets), prior, 1.0, 0.0)
    part = hash_sample(rows, F.xxhash64(F.lit(5), "doc_id"), calibration, sum(n)).select("label", *FEATURES).collect()
    x = np.array([r[1:] for r in part], float).reshape(-1, d)
    y = np.array([r[0] for r in part], float)
    slope, offset = _line(model.evidence(x), y)
    return model._replace(slope=slope, offset=offset)


def score(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    stats = stored(features(documents), "quality-statistics")
    model = learn(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = stats.withColumn("held_out", F.coalesce(fold() == 0, F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
