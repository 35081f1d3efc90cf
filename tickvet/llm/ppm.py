"""Language identification by prediction by partial matching (PPM, escape method C with exclusion).

For each language a tree of byte contexts up to `order` bytes is counted on sample texts and then frozen. A byte's code
length is that of PPM: the longest known context predicts it or escapes to the next shorter one, symbols of longer
contexts being excluded; below order 0 all remaining bytes of the 256 are alike. With frozen counts the code length
depends only on the last bytes and the byte itself, so it is tabulated once, exactly, and texts are scored by look-ups.
The language with the shortest code wins (ties: first in alphabetical order); the score is its posterior under equal
priors, 2^-bits normalised over the languages.

Bounds: a language's tree is fitted on at most `per_lang` whole documents (least hash of id), counted a few at a time. Scoring
reads whole texts. A language's table has a row for each of its own contexts and a column for each of its own bytes; a
context it does not know leads to the row of its longest known end. So the model is as large as the sum of its languages
(and 4 bytes for each of at most 257^3 contexts, and for each language and context of any), whatever their number.

Edge cases: a null text or one without letters is `und` with score 0; null lang is not learned from; a null id is folded
as the empty string; with no training rows everything is `und`; repeated rows have equal results; other columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickvet.llm.common import crc_fold, slices, text_bytes


class ByteTrees:
    """Code lengths of bytes after up to three bytes, for several languages."""

    def __init__(self, samples: dict[str, Iterable[bytes]] | Iterable[tuple[str, Iterable[bytes]]]):
        raw = {lang: self._counted(texts) for lang, texts in (samples.items() if isinstance(samples, dict) else samples)}
        self.langs = sorted(raw)
        seen = sorted({int(x) - 1 for c in raw.values() for x in np.unique(c[0][0] % 257)})
        # Symbols: 0 stands before a text's first byte, 1 for all bytes never seen, then those seen.
        self.map = np.ones(256, np.int64)
        self.map[seen] = np.arange(len(seen)) + 2
        a = self.size = len(seen) + 2
        if not self.langs:
            return
        small = np.concatenate([[0], self.map])
        counts = {k: [] for k in range(4)}
        for lang in self.langs:
            for k in range(4):
                keys, n = raw[lang][k]
                keys = sum(small[keys // 257**j % 257] * a**j for j in range(k + 1)) if len(keys) else keys
                order = np.argsort(keys)
                counts[k].append((keys[order], n[order]))
        own = [[np.unique(counts[k][i][0] // a) for k in range(4)] for i in range(len(self.langs))]
        nodes = [np.unique(np.concatenate([x[k] for x in own])) for k in range(4)]
        base = np.concatenate([[0], np.cumsum([len(x) for x in nodes])])
        self.tables, self.rows, self.columns = [], [], []
        for i in range(len(self.langs)):
            table, columns = self._table(own[i], [counts[k][i] for k in range(4)])
            self.tables.append(table.ravel())
            self.columns.append(columns)
            self.rows.append(self._rows(nodes, own[i], base) * table.shape[1])
        self.index = np.zeros(a**3, np.int32)
        triples = np.arange(a**3)
        for k in range(1, 4):
            if len(nodes[k]):
                at, hit = self._places(nodes[k], triples % a**k)
                self.index[hit] = base[k] + at[hit]

    @staticmethod
    def _places(nodes, keys):
        """Places of keys among sorted nodes, and which are there."""
        at = np.minimum(np.searchsorted(nodes, keys), max(len(nodes) - 1, 0))
        return at, (nodes[at] == keys if len(nodes) else np.zeros(len(keys), bool))

    def _table(self, own, counts):
        """A language's code lengths, a row for each of its contexts by order; a symbol's column (0: all it never has)."""
        has = np.unique(counts[0][0] % self.size)
        columns = np.zeros(self.size, np.int32)
        columns[has] = np.arange(len(has)) + 1
        if not len(own[0]):  # empty texts only: all bytes alike
            return np.full((1, 1), 8.0, np.float32), columns
        dense = [self._dense(own[k], columns, len(has) + 1, *counts[k]) for k in range(4)]
        return np.concatenate([self._code_lengths(own, dense, k) for k in range(4)]).astype(np.float32), columns

    def _rows(self, nodes, own, base):
        """For each context of any language the row of its longest end that this language knows."""
        out, first = np.zeros(base[4], np.int32), 0
        for k in range(1, 4):
            first += len(own[k - 1])
            at, known = self._places(own[k], nodes[k])
            shorter, _ = self._places(nodes[k - 1], nodes[k] % self.size ** (k - 1))
            out[base[k] : base[k + 1]] = np.where(known, first + at, out[base[k - 1] + shorter])
        return out

    @staticmethod
    def _counted(texts: Iterable[bytes], most: int = 1 << 20) -> list[tuple[np.ndarray, np.ndarray]]:
        """For 0 to 3 bytes before: contexts and bytes as numbers to base 257 (the byte lowest; 0 before a text), and their counts."""
        held = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] for _ in range(4)]

        def put(symbols):
            for k in range(4):
                code = sum(symbols[3 - j : len(symbols) - j] * 257**j for j in range(k + 1))
                held[k].append(np.unique(code, return_counts=True))
                if len(held[k]) > 64:
                    held[k] = [merged(held[k])]

        def merged(parts):
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        for text in texts:
            data = np.concatenate([[0, 0, 0], np.frombuffer(text, np.uint8).astype(np.int64) + 1])
            for at in range(0, len(data) - 3, most):
                put(data[at : at + most + 3])
        return [merged(x) for x in held]

    def _dense(self, nodes, columns, width, keys, n):
        out = np.zeros((len(nodes), width), np.float32)
        if len(keys):
            out[np.searchsorted(nodes, keys // self.size), columns[keys % self.size]] = n
        return out

    def _code_lengths(self, nodes, dense, k):
        a, m = self.size, len(nodes[k])
        escape, out, excluded = np.ones(m), np.zeros((m, dense[k].shape[1])), np.zeros((m, dense[k].shape[1]), bool)
        for j in range(k, -1, -1):
            key = nodes[k] % a**j
            at = np.minimum(np.searchsorted(nodes[j], key), max(len(nodes[j]) - 1, 0))
            known = nodes[j][at] == key if len(nodes[j]) else np.zeros(m, bool)
            n = np.where(excluded | ~known[:, None], 0, dense[j][at] if len(nodes[j]) else 0)
            total, kinds = n.sum(1), (n > 0).sum(1)
            both = np.maximum(total + kinds, 1)
            out += n * (escape / both)[:, None]
            escape = np.where(kinds > 0, escape * kinds / both, escape)
            excluded |= n > 0
        left = 256 - excluded[:, 1:].sum(1)
        out = np.where(excluded, out, (escape / np.maximum(left, 1))[:, None])
        return -np.log2(np.maximum(out, 1e-300))

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[rows, languages] code lengths of whole texts."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(data):
            return out
        sym, a = self.map[data], self.size
        some = np.flatnonzero(np.diff(offsets) > 0)
        starts = offsets[:-1][some]
        before, code = sym, np.zeros(len(sym), np.int64)
        for k in range(3):
            before = np.concatenate([[0], before[:-1]])
            before[starts] = 0
            code += before * a**k
        context = self.index[code]
        for i in range(len(self.langs)):
            out[some, i] = np.add.reduceat(self.tables[i][self.rows[i][context] + self.columns[i][sym]], starts, dtype=np.float64)
        return out

    def judge(self, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or und, its posterior, bits a byte of the shortest code) of each row of a batch with a text column."""
        texts = batch.column("text").to_pylist()
        letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool) & (len(self.langs) > 0)
        if not letters.any():
            return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), 8.0)
        data, offsets = text_bytes(batch.column("text"))
        bits = self.bits(data, offsets)
        best = bits.argmin(1)
        short = bits.min(1)
        posterior = 1.0 / np.exp2(np.maximum(short[:, None] - bits, -1000.0)).sum(1)
        rate = short / np.maximum(np.diff(offsets), 1)
        return [self.langs[b] if x else "und" for b, x in zip(best, letters, strict=True)], np.where(letters, posterior, 0.0), np.where(letters, rate, 8.0)


def train(docs: DataFrame, held_out=None, per_lang: int = 300) -> ByteTrees:
    """Fit on labelled documents for which held_out is false; the sample is bounded as the module says."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if held_out is not None:
        known = known.filter(~held_out)
    # The least hashes of each of 64 parts of a language first, so that the last choice is among 64 x per_lang rows at most.
    ids = known.select("lang", "doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part"))
    for keys in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("h", "doc_id")
        ids = ids.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_lang).drop("r")
    chosen = [r[1] for r in ids.collect()]
    null = None in chosen
    wanted = F.col("doc_id").isin([i for i in chosen if i is not None]) | (F.col("doc_id").isNull() & F.lit(null))
    rows = known.filter(wanted).select("lang", F.encode("text", "utf-8").alias("b")).orderBy("lang", "b").toLocalIterator()
    one_lang = itertools.groupby(rows, lambda r: r[0])
    return ByteTrees((lang, (bytes(r[1]) for r in itertools.islice(some, per_lang))) for lang, some in one_lang)


def identify(docs: DataFrame, trees: ByteTrees) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of whole texts."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def each(batches):
        for batch in slices(batches):
            lang, score, rate = model.value.judge(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, lang_pred string, score double, bits_per_byte double")


def reject_foreign(docs: DataFrame, trees: ByteTrees, most_bits: float = 7.0) -> DataFrame:
    """Text documents, all columns, in their order: those without letters (null and empty ones too), or that no language's model codes below most_bits a byte, go.

    The bound lets text of a language near a learned one pass; it rejects what is no text (random bytes, encoded data)
    and scripts that no learned language uses. Repeated rows have one fate; column names other than text do not matter.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def each(batches):
        for batch in slices(batches):
            lang, _, rate = model.value.judge(batch)
            yield batch.filter(pa.array((np.array(lang) != "und") & (rate < most_bits)))

    return docs.mapInArrow(each, docs.schema)


def predictions(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Train without fold `held` of the ids, predict every document."""
    held_out = crc_fold("doc_id", folds) == held
    return identify(docs, train(docs, held_out)).select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "bits_per_byte")
