"""Best-fit packing of token sequences, bounded-space and online.

A document's tokens are those of a byte-level BPE vocabulary and an end token. A document longer than a sequence is cut
into full pieces, the first of which takes the remainder. Pieces shorter than a sequence are packed as they come: a bitset has
bit f set if some open bin has f tokens free; the least sufficient f is the best fit. If none suffices, a bin is opened;
beyond `open_bins` the fullest closes first. Full pieces are sequences of their own. The number of open bins bounds the
memory, and no piece waits: a bin closes only because it is full, the fullest of too many, or its group's last.

Pieces are dealt into groups of about `group_rows` by a hash of their place in the table, whatever their ids, and arrive in
the table's order; a group's bins stay within it, so only the last bins of a group of tens of thousands are loose.

Edge cases: null or empty text has the end token only; repeated rows are packed each; a null id is an id of its own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvet.llm.common import materialize, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Packer:
    """place(length): (bin, offset). Bins are numbered in order of opening."""

    def __init__(self, size: int = 1024, open_bins: int = 256):
        self.size, self.limit = size, open_bins
        self.bits, self.open, self.bins = 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        stack = self.free[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            at = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            at, free = self.bins, self.size
            self.bins += 1
        if left := free - length:
            self.free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.size - free


@functools.lru_cache(maxsize=1)
def _encoder(tokenizer_file: str):
    """ids(text) of a tokenizers JSON file. Byte-level BPE without merges across words is encoded by tiktoken, from the file's own vocabulary; any other kind by tokenizers."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    spec = json.load(open(tokenizer_file, encoding="utf-8"))
    plain = Tokenizer.from_file(tokenizer_file)
    slow = lambda text: plain.encode(text, add_special_tokens=False).ids
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return slow
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    added = spec.get("added_tokens", [])  # their strings in a text are cut out first, each being one id
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return slow
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    order = [model["vocab"][m.replace(" ", "", 1)] for m in merged]
    if order != sorted(order) or len(ranks) != len(merged) + 256:  # ids must be the merges' ranks
        return slow
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # of byte-level pre-tokenizers
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: own.encode(text, allowed_special="all", disallowed_special=())


def tokenize(docs: DataFrame, tokenizer_file: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def each(batches):
        encode = _encoder(tokenizer_file)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                at, end = 0, len(ids) % size or size
                piece = 0
                while at < len(ids):
                    rows.append((doc_id, piece, at, end - at, zlib.crc32(ids[at:end].tobytes())))
                    at, end, piece = end, end + size, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, PIECES)


def pack(docs: DataFrame, tokenizer_file: str, size: int = 1024, end_id: int = 2, open_bins: int = 256, group_rows: int = 50_000) -> DataFrame:
    """Every piece with its sequence_id and offset there. A sequence lies within one task's output."""
    pieces = materialize(tokenize(docs, tokenizer_file, size, end_id))
    groups = max(1, -(-pieces.count() // group_rows))

    def each(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        packer = Packer(size, open_bins)
        for batch in batches:
            at = [packer.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    dealt = pieces.withColumn("place", F.monotonically_increasing_id()).repartition(groups, F.xxhash64("place")).sortWithinPartitions("place")
    return dealt.drop("place").mapInArrow(each, PIECES + ", sequence_id long, offset long")
