"""Shared pieces: materialised cut points, bounded slices of Arrow batches, and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tickvet.shared import CLEAN, discard, held, written  # noqa: F401

SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}  # texts come to Python by 1,000 rows at most


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    return written(df, SMALL)


def collected(df: DataFrame) -> list[Row]:
    """The few rows of df, with the settings of materialize() but no table."""
    with held(df.sparkSession, CLEAN | SMALL):
        return df.collect()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(column: str, folds: int):
    """crc32 of the column's text modulo folds; a null value counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about most_bytes of text (one long text may exceed it alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(text_bytes(batch.column(text))[1]))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the offsets of each row in them; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


# Bytes of words: 0 separates, 1 belongs to a word, 2 is a token of its own.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.ones(256, np.uint8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 0
_PUNCT = _SPACE.copy()
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _PUNCT[_c] = 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; x is of type uint64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray, punctuation: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) in reading order, and the row of each.

    punctuation: each ASCII punctuation mark is a token of its own; else words are what white space separates.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = _LOWER[data]
    kind = (_PUNCT if punctuation else _SPACE)[low]
    first = kind != 0
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    starts = offsets[:-1][offsets[:-1] < n]
    first[starts] = kind[starts] != 0
    last = kind != 0
    last[:-1] &= first[1:] | (kind[1:] == 0)
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers_to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[e] - sums[s]) * inverse[s]), np.searchsorted(offsets, s, "right") - 1


def gapped_pairs(h: np.ndarray, row: np.ndarray, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (word, word gap places later) within a row, and the rows."""
    if len(h) <= gap:
        return h[:0], row[:0]
    same = row[gap:] == row[:-gap]
    return mix(h[:-gap][same] * np.uint64(0x9DDFEA08EB382D69) + h[gap:][same] + np.uint64(gap)), row[:-gap][same]


def word_shingles(h: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of width-word shingles by row; a row with fewer words (but one at least) has one: all its words."""
    factor = np.uint64(0x9DDFEA08EB382D69)
    out, out_row = [h[:0]], [row[:0]]
    if len(h) >= width:
        m = len(h) - width + 1
        acc = np.zeros(m, np.uint64)
        for i in range(width):
            acc = acc * factor + h[i : m + i]
        same = row[width - 1 :] == row[:m]
        out.append(mix(acc[same]))
        out_row.append(row[:m][same])
    count = np.bincount(row, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    for n in range(1, width):
        few = np.flatnonzero(count == n)
        acc = np.full(len(few), n, np.uint64)
        for i in range(n):
            acc = acc * factor + h[begin[few] + i]
        out.append(mix(acc))
        out_row.append(few)
    return np.concatenate(out), np.concatenate(out_row)
