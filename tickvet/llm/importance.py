"""Quality by importance resampling.

Two bags of hashed word uni- and bigrams are estimated: the target's from documents labelled good, the raw one from
all documents. A document's log weight is the sum of log(p_target / p_raw) over its n-grams; the sample is the k rows
with the largest log weight + Gumbel noise, which draws without replacement in proportion to the weights.

Bounds: the model has `dim` buckets; the target is fitted on at most `target_rows` labelled documents (those with the
smallest hash of their id), raw counts cover every document.

Edge cases: a null or empty text has no n-grams, so log weight 0; null labels are no target; a null id is never a
target and shares one noise value with the other null ids; rows of the same id and text have the same key, so a tie
at the threshold keeps all of them (the only way the sample can exceed k); with no target rows or an empty table the
weights are 0 or the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvet.llm.common import gapped_pairs, materialize, mix, slices, text_bytes, word_hashes


def _features(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    h, row = word_hashes(*text_bytes(batch.column("text")))
    pair, pair_row = gapped_pairs(h, row)
    return (np.concatenate([h, pair]) % np.uint64(dim)).astype(np.int64), np.concatenate([row, pair_row])


def fit(docs: DataFrame, labels: DataFrame, dim: int = 10_000, target_rows: int = 20_000) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, with add-one smoothing."""
    spark = docs.sparkSession
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).collect()
    ids = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in chosen], np.int64)))

    def count(batches):
        raw, target = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in slices(batches):
            bucket, row = _features(batch, dim)
            raw += np.bincount(bucket, minlength=dim)
            known = np.isin(batch.column("doc_id").fill_null(0).to_numpy(), ids.value)
            known &= batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            target += np.bincount(bucket[known[row]], minlength=dim)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    parts = docs.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, target long")
    raw, target = np.zeros(dim), np.zeros(dim)
    for b, r, t in parts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[b], target[b] = r, t
    if not target.any():
        return np.zeros(dim)
    return np.log((target + 1) / (target.sum() + dim)) - np.log((raw + 1) / (raw.sum() + dim))


def score(docs: DataFrame, ratio: np.ndarray, seed: int = 0) -> DataFrame:
    """doc_id, n_features, log_weight, gumbel_key of each document."""
    model, dim = docs.sparkSession.sparkContext.broadcast(ratio), len(ratio)

    def each(batches):
        for batch in slices(batches):
            bucket, row = _features(batch, dim)
            n = np.bincount(row, minlength=batch.num_rows)
            weight = np.bincount(row, model.value[bucket], batch.num_rows).astype(float)  # of no features it is of integers
            ids = batch.column("doc_id").fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
            u = ((mix(mix(ids + np.uint64(seed + 1))) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(weight), pa.array(weight - np.log(-np.log(u)))], ["doc_id", "n_features", "log_weight", "gumbel_key"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, n_features long, log_weight double, gumbel_key double")


def kth_largest(df: DataFrame, column: str, k: int, few: int = 10_000, bins: int = 1024) -> float:
    """The exact k-th largest value, by histograms that narrow down; at most `few` values or `bins` counts come to the driver."""
    while True:
        n, low, high = df.agg(F.count(column), F.min(column), F.max(column)).first()
        if low == high:
            return low
        if n <= few:
            return sorted((r[0] for r in df.select(column).collect()), reverse=True)[k - 1]
        bin_of = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / (high - low) * bins))
        for b, here in sorted(df.groupBy(bin_of.alias("b")).count().collect(), reverse=True):
            if k <= here:
                break
            k -= here
        df = df.filter(bin_of == b)


def resample(docs: DataFrame, labels: DataFrame, fraction: float = 0.8, dim: int = 10_000, target_rows: int = 20_000, seed: int = 0) -> DataFrame:
    """score() of all documents and `selected`: whether it is among the k = ceil(fraction x rows) with the largest keys."""
    scored = materialize(score(docs, fit(docs, labels, dim, target_rows), seed))
    n = scored.count()
    least = kth_largest(scored, "gumbel_key", math.ceil(fraction * n)) if n else 0.0
    return scored.withColumn("selected", F.col("gumbel_key") >= least)
