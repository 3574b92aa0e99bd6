"""Language by nearest centroid (operator 5).

A text is a vector of hashed byte 2-grams and 3-grams of its lower-case letters: sublinear term
frequency times inverse document frequency, at length 1. Document frequencies are counted
over all learnable documents; each language's centroids come from spherical k-means over a
bounded sample of SAMPLE documents (those with the smallest hash of their id). A text gets
the language of the centroid with the largest cosine; texts farther from it than all but
REJECT of that language's sample, and a margin, are marked rejected and score less.

Learnable: lang is known and crc32(doc_id as text) mod FOLDS is not HELD_OUT. lang, source
and doc_id are never inputs of a prediction.

Defined results: null text or a text without a letter is und with score 0; a null doc_id is
never learnt from; with nothing learnable all are und; equal cosines go to the first language
by name; repeated rows each give a row, and are learnt from once; an empty table gives no rows; a very long
text is counted as a whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import as_texts, prepare, slices, stored

FOLDS, HELD_OUT = 4, 2
#: Length of the vectors; sample documents and centroids of each language.
BUCKETS, SAMPLE, CENTROIDS = 4096, 400, 4
REJECT, MARGIN, SHARPNESS = 0.01, 0.05, 20.0
#: Texts that are turned into vectors at once.
ROWS = 256
#: Runs of ASCII characters other than letters count as one blank: marks and numbers say nothing of a language.
_LETTERS = np.full(256, 32, np.uint32)
_LETTERS[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    radius: np.ndarray


def counts(texts: list[str]) -> np.ndarray:
    """How often each bucket's n-grams occur in each text."""
    low = as_texts(pa.array([t.lower() for t in texts], pa.large_string()))
    n, out = len(texts), np.zeros(len(texts) * BUCKETS)
    row = np.repeat(np.arange(n) * BUCKETS, np.diff(low.offsets))
    data = _LETTERS[low.data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    row, data = row[keep], data[keep]
    gram = data
    for k in (1, 2):
        if len(data) <= k:
            break
        gram = gram[:-1] | (data[k:] << np.uint32(8 * k))
        same = row[k:] == row[:-k]
        place = ((gram * np.uint32(2_654_435_761)) ^ np.uint32(k * 0x5BD1E995)) * np.uint32(2_246_822_519) >> np.uint32(20)
        out += np.bincount((row[:-k] + place)[same], minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def vectors(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = (np.log1p(found) * weights).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _has_letter():
    import regex

    return regex.compile(r"\p{L}").search


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the first vector and then always the farthest one."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centers = x[chosen]
    for _ in range(20):
        member = np.argmax(x @ centers.T, axis=1)
        sums = np.stack([x[member == j].sum(axis=0) if (member == j).any() else centers[j] for j in range(len(centers))])
        fresh = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(fresh, centers):
            break
        centers = fresh
    return centers


def learn(documents: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    prepare(documents.sparkSession)
    learnable = documents.where((fold() != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in _blocks(batches):
            found = counts(batch.column("text").to_pylist())
            total += (found > 0).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(np.append(total, n))], names=["bucket", "n"])

    held = {
        r["bucket"]: r["n"]
        for r in learnable.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    }  # BUCKETS + 1 rows
    n = held.get(BUCKETS, 0)
    weights = np.log((1 + n) / (1 + np.array([held.get(b, 0) for b in range(BUCKETS)]))) + 0.1

    # the sample is chosen from ids alone; the counts of its texts, not the texts, come with a second, filtered scan
    hashed = F.xxhash64(F.lit(11), "doc_id")
    place = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    share = F.lit(2.0 * sample + 100) / F.count("*")  # ids far above the bound to be expected stay out of the ranking
    bound = F.when(share < 0.99, (share * 2.0**64 - 2.0**63).cast("long")).otherwise(F.lit(2**63 - 1)).alias("_bound")
    sizes = learnable.groupBy(F.col("lang").alias("_of")).agg(bound)
    near = learnable.select("lang", "doc_id").join(F.broadcast(sizes), F.col("lang") == F.col("_of")).where(hashed <= F.col("_bound"))
    ids = near.select("lang", "doc_id").distinct().withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= sample)
    wanted = stored(ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")), "language-sample")  # sample rows a language

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has_letter = _has_letter()
        for batch in _blocks(batches):
            texts = batch.column("text").to_pylist()
            found = counts(texts).astype("<f4")
            packed = [row.tobytes() if has_letter(t) else None for row, t in zip(found, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(packed, pa.binary())], names=["lang", "doc_id", "counts"])

    same = (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))
    chosen = learnable.select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), same, "left_semi")
    vectors_of = chosen.mapInArrow(sparse, "lang string, doc_id long, counts binary").groupBy("lang", "doc_id").agg(F.max("counts").alias("counts"))
    by: dict[str, list[np.ndarray]] = {}
    for r in vectors_of.orderBy("lang", "doc_id").collect():  # sample vectors of BUCKETS numbers a language
        if r["counts"] is not None:
            by.setdefault(r["lang"], []).append(np.frombuffer(r["counts"], "<f4"))
    languages, centers, of, radius = sorted(by), [], [], []
    for i, lang in enumerate(languages):
        x = vectors(np.stack(by[lang]), weights)
        c = cluster(x, centroids)
        distance = 1 - (x @ c.T).max(axis=1)
        centers.append(c)
        of += [i] * len(c)
        radius.append(float(np.quantile(distance, 1 - REJECT)) + MARGIN)
    if not languages:
        return Model([], weights, np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(0))
    return Model(languages, weights, np.concatenate(centers).astype(np.float32), np.array(of), np.array(radius))


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    shared = prepare(documents.sparkSession).sparkContext.broadcast(model)  # BUCKETS x CENTROIDS a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, has_letter = shared.value, _has_letter()
        for batch in _blocks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, scores, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if m.languages:
                near = vectors(counts(texts), m.weights) @ m.centroids.T
                best = np.stack([near[:, m.of == i].max(axis=1) for i in range(len(m.languages))], axis=1)
                first = best.argmax(axis=1)
                top = best.max(axis=1)
                chance = 1 / np.exp(SHARPNESS * (best - top[:, None])).sum(axis=1)
                distance = np.maximum(1 - top, 0)
                reject = distance > m.radius[first]
                score = np.where(reject, chance * m.radius[first] / np.maximum(distance, 1e-12), chance)
                for i, t in enumerate(texts):
                    if has_letter(t):
                        names[i], scores[i], far[i] = m.languages[first[i]], min(1.0, float(score[i])), bool(reject[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(scores), pa.array(far)],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
