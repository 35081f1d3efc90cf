"""Document fingerprints by one-permutation MinHash.

Every 5-word shingle (words: runs without ASCII white space, A-Z lower-cased) is hashed once; the hash's top bits name
one of `bins` bins, each of which keeps the least rest. Empty bins are filled by optimal densification: bin i takes the
value of the first occupied bin in its own fixed pseudo-random sequence of bins. Of each bin's value the low `bits`
bits are stored. Likeness of two fingerprints corrects the share of equal bins for chance: (share - c) / (1 - c) with
c = 2^-bits, held in 0 to 1.

Edge cases: null text counts as empty; a text without words has the fingerprint of zeros, equal only to its like (their
likeness is 1); fewer than 5 words form one shingle; equal texts have equal fingerprints; documents with the same id
follow each other in the order of their texts; null ids come first; a single row is its own next document; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvet.llm.common import joined_bytes, mix, shuffle_partitions, word_hashes, word_shingles

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Fingerprinter:
    def __init__(self, bins: int = 512, bits: int = 4, width: int = 5):
        assert bins & (bins - 1) == 0 and 8 % bits == 0 and bins * bits % 8 == 0
        self.bins, self.bits, self.width = bins, bits, width
        self.log = bins.bit_length() - 1

    def _densify(self, low: np.ndarray) -> None:
        occupied = low != _NONE
        count = occupied.sum(1)
        alone = np.flatnonzero(count == 1)
        low[alone] = low[alone].min(1)[:, None]
        row, bin_ = np.nonzero(~occupied & (count > 1)[:, None])
        step = 0
        while len(row):
            step += 1
            probe = (mix(bin_.astype(np.uint64) * np.uint64(0x10001) + np.uint64(step << 32)) % np.uint64(self.bins)).astype(np.int64)
            hit = occupied[row, probe]
            low[row[hit], bin_[hit]] = low[row[hit], probe[hit]]
            row, bin_ = row[~hit], bin_[~hit]

    def values(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """[rows, bins] low bits, and whether each row has any word."""
        data, offsets = joined_bytes(texts)
        h, row = word_hashes(data, offsets, punctuation=False)
        shingle, row = word_shingles(h, row, len(texts), self.width)
        low = np.full(len(texts) * self.bins, _NONE, np.uint64)
        rest = shingle & np.uint64((1 << (64 - self.log)) - 1)
        np.minimum.at(low, row * self.bins + (shingle >> np.uint64(64 - self.log)).astype(np.int64), rest)
        low = low.reshape(len(texts), self.bins)
        some = (low != _NONE).any(1)
        self._densify(low)
        # The bin's number is mixed in, else the one value of a short text would agree by chance in all bins or none.
        out = (mix(low ^ mix(np.arange(self.bins, dtype=np.uint64))) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        out[~some] = 0
        return out, some

    def packed(self, values: np.ndarray) -> list[str]:
        per = 8 // self.bits
        parts = values.reshape(len(values), -1, per)
        shifts = (np.arange(per) * self.bits).astype(np.uint8)
        return [r.tobytes().hex() for r in np.bitwise_or.reduce(parts << shifts, axis=2).astype(np.uint8)]

    def likeness(self, a, a_some, b, b_some) -> np.ndarray:
        chance = 0.5**self.bits
        share = (a == b).mean(1)
        out = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
        return np.where(a_some & b_some, out, (a_some == b_some).astype(float))


def fingerprints(docs: DataFrame, bins: int = 512, bits: int = 4, width: int = 5) -> DataFrame:
    """doc_id and the packed fingerprint of every document."""

    def each(batches):
        printer = Fingerprinter(bins, bits, width)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                values, _ = printer.values([(t or "").encode() for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(printer.packed(values))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """(part, home, doc_id, text) dealt and sorted so that each home row is followed by its next document.

    Ids are cut into ranges of even counts (approximate quantiles, one number a range to the driver). A range's first
    document is also sent to the range before it (the first range's to the last), where home is false; no other text
    moves twice. Documents of one id stay together.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"))
    cuts = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), "left").astype(np.int32))

    firsts = dict(tuple(r) for r in ids.groupBy(part_of("k").alias("p")).agg(F.min("k")).collect())
    parts = sorted(firsts)
    before = {firsts[p]: parts[i - 1] for i, p in enumerate(parts)}  # the part before; of the first, the last
    heads, head_part = np.array(sorted(before), np.int64), np.array([before[k] for k in sorted(before)], np.int32)

    @F.pandas_udf("array<int>")
    def parts_for(k: pd.Series) -> pd.Series:
        ks = k.to_numpy()
        own = np.searchsorted(bounds, ks, "left").astype(np.int32)
        at = np.minimum(np.searchsorted(heads, ks), max(len(heads) - 1, 0))
        return pd.Series([[p, q + (1 << 30)] if h else [p] for p, q, h in zip(own, head_part[at], heads[at] == ks, strict=True)])

    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = keyed.withColumn("part", F.explode(parts_for(F.coalesce("doc_id", F.lit(-(1 << 63))))))
    dealt = dealt.select((F.col("part") % (1 << 30)).alias("part"), (F.col("part") < 1 << 30).alias("home"), "doc_id", "text")
    return dealt.repartitionById(n, "part").sortWithinPartitions("part", F.desc("home"), F.asc_nulls_first("doc_id"), "text")


def digest(docs: DataFrame, bins: int = 512, bits: int = 4, width: int = 5) -> DataFrame:
    """Of each document: its length, the edited text's SHA-256, both fingerprints, and likeness to the edited text and to the next one.

    The edited text has the last quarter of the code points replaced by as many first ones of the next document.
    """

    def each(batches):
        printer = Fingerprinter(bins, bits, width)
        held: list[tuple] = []  # rows of one part in order, the last of which waits for its next

        def out(rows, following):
            texts = [t for _, t in rows]
            after = texts[1:] + [following]
            edited = []
            for text, more in zip(texts, after, strict=True):
                m = len(text) // 4
                edited.append((text[: len(text) - m] + more[:m]).encode())
            plain, some = printer.values([t.encode() for t in [*texts, following]])
            other, other_some = printer.values(edited)
            cols = [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(printer.packed(plain[:-1])), pa.array(printer.packed(other)), pa.array(printer.likeness(plain[:-1], some[:-1], other, other_some)), pa.array(printer.likeness(plain[:-1], some[:-1], plain[1:], some[1:]))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        part, size = None, 0
        closed = False  # the part's own rows are all out
        for batch in batches:
            for p, home, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if p != part:
                    assert not held, "a part's last document has no next"
                    part, closed, size = p, False, 0
                if not home:
                    if not closed:
                        yield out(held, text)
                        held, closed = [], True
                    continue
                if size > 1 << 20 or len(held) >= 128:
                    yield out(held, text)
                    held, size = [], 0
                held.append((doc_id, text))
                size += len(text)
        assert not held, "a part's last document has no next"

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(each, schema)
