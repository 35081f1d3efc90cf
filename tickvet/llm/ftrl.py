"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, neighbouring pairs and pairs one word apart. Each coordinate
has its own learning rate, and the L1 term keeps most weights at exactly 0, so that the model is a short list of
(bucket, weight) that is broadcast whatever the corpus.

Bounds: trained on at most `train_rows` labelled documents (least hash of id), in `passes` passes in a fixed order in one
task; at most `dim` weights. Scoring reads whole texts of all documents.

Edge cases: a null or empty text has no features and the score of the intercept; rows with null labels or ids are not
learned from; of contradictory labels of one id the larger counts, and of several texts of one id one (the least features as bytes);
with no training rows every score is 0.5; repeated documents score alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvet.llm.common import collected, crc_fold, gapped_pairs, slices, text_bytes, word_hashes


def features(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all n-grams and skip-grams; repeats included."""
    h, row = word_hashes(*text_bytes(column))
    parts = [(h, row), gapped_pairs(h, row, 1), gapped_pairs(h, row, 2)]
    return (np.concatenate([p[0] for p in parts]) % np.uint64(dim)).astype(np.int64), np.concatenate([p[1] for p in parts])


class Ftrl:
    """Per-coordinate FTRL-proximal for binary features; index 0 is the intercept's."""

    def __init__(self, dim: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dim + 1), np.zeros(dim + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


def train(docs: DataFrame, labels: DataFrame, held_out=None, dim: int = 1 << 20, train_rows: int = 12_000, passes: int = 8, **ftrl) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight) of the nonzero weights; bucket -1 is the intercept."""
    spark = docs.sparkSession
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    if held_out is not None:
        known = known.filter(~held_out)
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect()
    held = spark.sparkContext.broadcast({r.doc_id: int(r.y) for r in chosen})

    def pick(batches):
        for batch in batches:
            wanted = batch.filter(pa.array([i in held.value for i in batch.column("doc_id").to_pylist()], pa.bool_()))
            for part in slices(iter([wanted])):
                bucket, row = features(part.column("text"), dim)
                order = np.lexsort((bucket, row))
                bucket, row = bucket[order], row[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
                per_row = np.split(bucket[fresh].astype(np.int32), np.cumsum(np.bincount(row[fresh], minlength=part.num_rows))[:-1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([b.tobytes() for b in per_row], pa.binary())], ["doc_id", "buckets"])

    picked = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pick, "doc_id long, buckets binary")
    rows = picked.groupBy("doc_id").agg(F.min("buckets").alias("buckets"))

    def learn(batches):
        model, data = Ftrl(dim, **ftrl), []
        for batch in batches:
            for doc_id, b in zip(batch.column("doc_id").to_pylist(), batch.column("buckets").to_pylist(), strict=True):
                data.append((np.frombuffer(b, np.int32), held.value[doc_id]))
        for epoch in range(passes):
            for i in np.random.default_rng(epoch).permutation(len(data)):
                model.learn(np.concatenate([[0], data[i][0] + 1]), data[i][1])
        w = model.weights()
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some - 1, pa.int64()), pa.array(w[some])], ["bucket", "weight"])

    learned = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "buckets").mapInArrow(learn, "bucket long, weight double")
    # No table between: it would be a file for each shuffle partition of at most train_rows rows, each begun by processes of the file system's.
    got = collected(learned)
    return np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], dim: int = 1 << 20) -> DataFrame:
    """doc_id, score of whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        bucket, weight = held.value
        dense = np.zeros(dim)
        dense[bucket[bucket >= 0]] = weight[bucket >= 0]
        intercept = weight[bucket < 0].sum()
        for batch in slices(batches):
            at, row = features(batch.column("text"), dim)
            some = dense[at] != 0
            pairs = np.unique(row[some] * dim + at[some])
            z = intercept + np.bincount(pairs // dim, dense[pairs % dim], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, dim: int = 1 << 20, **training) -> DataFrame:
    """Train on labels outside fold `held` of the ids, score every document."""
    held_out = crc_fold("doc_id", folds) == held
    scored = score(docs, train(docs, labels, held_out, dim, **training), dim)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
