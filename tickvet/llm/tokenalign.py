"""Alignment of two tokenizers' tokens with a dictionary of groups.

A text is encoded by tokenizer A (byte-level BPE) and B (sentencepiece). Where a token of A and one of B end at the same byte, both sequences are
cut; what lies between two cuts is a group: ids of A and ids of B for the same bytes. Overlapping tokens link; of a group of i A tokens and j B tokens
these are i + j - 1 pairs, one for each stretch between neighbouring ends of either.

1. Texts are encoded by chunks of about 1 MB, and each chunk interns its groups: its documents become places in the chunk's own list of distinct groups.
   A document is a row and so is a group of the list: Parquet is read by batches of rows, which must be small whatever the number of chunks in a file.
2. Chunks' lists are summed by the groups' ids (not by a hash of them): the dictionary, with occurrences and documents of each.
3. Each distinct group is expanded to its links once; times its occurrences (or documents) they give the counts of id pairs.
4. Of each group: the number of its links whose count is the highest of their B id, and the sum of counts. These are joined back by group to the
   chunks that have it, and each chunk adds them up for its documents, in the order in which they were encoded.

No table grows on the driver or is broadcast. A document is held whole by a task: about 100 bytes for each byte of it while it is encoded. A group that occurs everywhere is
one row a chunk.

Edge cases: null and empty texts, and those whose joined A or B bytes are not a space and the text (B's normalisation changes some, as the character U+2581),
have no tokens: zeros, and '' for the digest. Equal texts, repeated and null ids are rows like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvet.llm import bestfit
from tickvet.llm.common import materialize, mix, slices


class Encoders:
    """Both tokenizers, the bytes of their ids, and the text of ids for digests."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        self.special = [t.content for t in self.a.get_added_tokens_decoder().values()]
        self.plain = bestfit._encoder(a_file)  # faster; it takes special tokens' strings for tokens
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        of_char = _byte_of_char()
        a_bytes = {i: bytes(of_char[c] for c in t) if all(c in of_char for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        # Id i of A ends with ',' or, last of its group, '|'; of B with ',' or ';'.
        self.text = [f"{i}{end}".encode() for i in range(len(self.a_bytes)) for end in ",|"] + [f"{i}{end}".encode() for i in range(len(self.b_bytes)) for end in ",;"]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of each text; none where either's bytes are not a space and the text."""
        none = np.zeros(0, np.int32)
        a, b = [none] * len(texts), [none] * len(texts)
        for i, text in enumerate(texts):
            if text:
                spaced = " " + text
                ids_a = self.a.encode(spaced, add_special_tokens=False).ids if any(t in spaced for t in self.special) else self.plain(spaced)
                ids_b, whole = self.b.encode(text), spaced.encode()
                if b"".join(map(self.a_bytes.__getitem__, ids_a)) == whole and b"".join(map(self.b_bytes.__getitem__, ids_b)) == whole:
                    a[i], b[i] = np.array(ids_a, np.int32), np.array(ids_b, np.int32)
        return a, b


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes a byte as itself where it is printable Latin-1, else as the next character from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _piece_bytes(piece: str) -> bytes:
    if m := re.fullmatch("<0x([0-9A-F]{2})>", piece):
        return bytes([int(m[1], 16)])
    return piece.replace("▁", " ").encode()


def _spans(values: np.ndarray, ids: np.ndarray, begin: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of ids; runs begin at `begin` and go on to the next."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    place = np.arange(len(ids)) - np.repeat(begin, np.diff(np.append(begin, len(ids))))
    return np.add.reduceat(mix(mix(ids.astype(np.uint64) + np.uint64(seed << 32)) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin)


def grouped(ids_a: np.ndarray, ids_b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups begin in A's and in B's ids; both cover the same bytes."""
    ends_a, ends_b = np.cumsum(length_a[ids_a]), np.cumsum(length_b[ids_b])
    _, a, b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    return np.concatenate([[0], a[:-1] + 1]).astype(np.int64), np.concatenate([[0], b[:-1] + 1]).astype(np.int64)


CHUNK = "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, seq binary, at int, ids binary, freq long, docs long"


def chunks(docs: DataFrame, a_file: str, b_file: str, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Two kinds of rows of each chunk of documents. A document: its id, token counts and digest, and as 4-byte numbers the places of
    its groups, in order, in the chunk's list of distinct groups. A group of that list: its place `at`, null for documents, with
    occurrences and documents. Materialised.
    """

    def each(batches):
        from pyspark import TaskContext

        encoders, chunk = Encoders(a_file, b_file), TaskContext.get().partitionId() << 31
        for batch in slices(batches, most_bytes=chunk_bytes):
            yield from _chunk(encoders, chunk, batch)
            chunk += 1

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, CHUNK))


def _chunk(e: Encoders, chunk: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    of_a, of_b = e.encode(batch.column("text").to_pylist())
    n_a, n_b = np.array([len(x) for x in of_a], np.int64), np.array([len(x) for x in of_b], np.int64)
    a, b = np.concatenate([*of_a, np.zeros(0, np.int32)]), np.concatenate([*of_b, np.zeros(0, np.int32)])
    empty = np.zeros(0, np.int64)
    begin_a, begin_b = grouped(a, b, e.a_length, e.b_length) if len(a) else (empty, empty)
    size_a, size_b = np.diff(np.append(begin_a, len(a))), np.diff(np.append(begin_b, len(b)))
    # The digest's text: of each group A's ids, then B's.
    code = np.zeros(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[begin_a + size_a - 1] = 1
    last_b[begin_b + size_b - 1] = 1
    code[np.arange(len(a)) + np.repeat(begin_b, size_a)] = 2 * a + last_a
    code[np.arange(len(b)) + np.repeat(begin_a + size_a, size_b)] = 2 * (len(e.a_bytes) + b.astype(np.int64)) + last_b
    at, digests = 0, []
    for many in (n_a + n_b).tolist():
        digests.append(hashlib.sha256(b"".join(map(e.text.__getitem__, code[at : at + many].tolist()))[:-1]).hexdigest() if many else "")
        at += many
    # Groups of a document: those that begin before its last A token.
    ends = np.searchsorted(begin_a, np.cumsum(n_a))
    n_groups = np.diff(ends, prepend=0)
    # Distinct groups, told apart by two hashes and their sizes.
    h = np.stack([_spans(e.a_length, a, begin_a, 1) + mix(_spans(e.b_length, b, begin_b, 2)), mix(_spans(e.a_length, a, begin_a, 3)) + _spans(e.b_length, b, begin_b, 4)])
    _, first, seq = np.unique(h[0], return_index=True, return_inverse=True)
    if not (h[1] == h[1][first][seq]).all():  # pragma: no cover - two groups of one hash
        _, first, seq = np.unique(h.T.copy().view([("x", np.uint64), ("y", np.uint64)]).ravel(), return_index=True, return_inverse=True)
    freq = np.bincount(seq, minlength=len(first))
    of_doc = np.repeat(np.arange(len(n_a)), n_groups)
    pairs = np.unique(seq * max(len(n_a), 1) + of_doc)
    in_docs = np.bincount(pairs // max(len(n_a), 1), minlength=len(first))
    ids = [_packed(a[i : i + k], b[j : j + m]) for i, k, j, m in zip(begin_a[first].tolist(), size_a[first].tolist(), begin_b[first].tolist(), size_b[first].tolist(), strict=True)]
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(c, kinds[kind]) for c, kind in (c.split() for c in CHUNK.split(", "))])

    def rows(many: int, **columns) -> pa.RecordBatch:
        columns["chunk"] = np.full(many, chunk, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(many, f.type) for f in schema], schema=schema)

    places = np.split(seq.astype("<i4"), ends[:-1])
    yield rows(len(n_a), doc_id=batch.column("doc_id"), n_a=n_a, n_b=n_b, n_groups=n_groups, groups_sha256=digests, seq=[x.tobytes() for x in places])
    for i in range(0, len(first), 10_000):
        some = slice(i, i + 10_000)
        yield rows(len(ids[some]), at=np.arange(i, i + len(ids[some])), ids=ids[some], freq=freq[some], docs=in_docs[some])


def _packed(a: np.ndarray, b: np.ndarray) -> bytes:
    """A group's ids as bytes: the number of A's, A's, B's."""
    return np.concatenate([[len(a)], a, b]).astype("<i4").tobytes()


def unpacked(ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(ids, "<i4")
    return x[1 : 1 + x[0]], x[1 + x[0] :]


def listed(found: DataFrame) -> DataFrame:
    """(chunk, at, ids, freq, docs): the lists of all chunks, a row for each group."""
    return found.filter("at IS NOT NULL").select("chunk", "at", "ids", "freq", "docs")


def dictionary(found: DataFrame) -> DataFrame:
    """(ids, freq, docs): each distinct group, its occurrences and the documents that hold it; materialised."""
    return materialize(listed(found).groupBy("ids").agg(F.sum("freq").alias("freq"), F.sum("docs").alias("docs")))


def links(groups: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(ids, freq, docs, a, b, links): the linked id pairs of each distinct group and how many of its links hold them; materialised."""

    def each(batches):
        encoders = Encoders(a_file, b_file)
        for batch in batches:
            out, row = [], []
            for i, ids in enumerate(batch.column("ids").to_pylist()):
                a, b = unpacked(ids)
                ends_a, ends_b = np.cumsum(encoders.a_length[a]), np.cumsum(encoders.b_length[b])
                ends = np.union1d(ends_a, ends_b)
                code, many = np.unique(a[np.searchsorted(ends_a, ends)].astype(np.int64) << 32 | b[np.searchsorted(ends_b, ends)], return_counts=True)
                out.append(np.stack([code >> 32, code & 0xFFFFFFFF, many]))
                row.append(np.full(len(code), i))
            if not out:
                continue
            x, row = np.concatenate(out, axis=1), pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in ("ids", "freq", "docs")), pa.array(x[0].astype(np.int32)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["ids", "freq", "docs", "a", "b", "links"])

    return materialize(groups.mapInArrow(each, "ids binary, freq long, docs long, a int, b int, links long"))


def pairs(linked: DataFrame, times: str = "freq") -> DataFrame:
    """(a, b, count, best): each id pair, its links in the corpus, and whether no pair of its B id has more.

    times: 'freq' counts all links, 'docs' those of each document's distinct groups.
    """
    counted = materialize(linked.groupBy("a", "b").agg(F.sum(F.col("links") * F.col(times)).alias("count")))
    most = counted.groupBy("b").agg(F.max("count").alias("most"))
    return counted.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_file: str, b_file: str, times: str = "freq", chunk_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    found = chunks(docs, a_file, b_file, chunk_bytes)
    linked = links(dictionary(found), a_file, b_file)
    scored = linked.select("ids", "a", "b", "links").join(pairs(linked, times), ["a", "b"])
    of_group = scored.groupBy("ids").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("best"), F.sum(F.col("links") * F.col("count")).alias("sum"))
    back = listed(found).select("chunk", "at", "ids").join(of_group, "ids").select("chunk", "at", "best", "sum")

    def add(key, held, scores):
        at = scores.column("at").to_numpy()
        best, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        best[at], total[at] = scores.column("best").to_numpy(), scores.column("sum").to_numpy()
        row = {k: held.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
        seq, many = np.frombuffer(b"".join(held.column("seq").to_pylist()), "<i4"), row["n_groups"].to_numpy()
        added = []
        for x in (best, total):
            sums = np.concatenate([[0], np.cumsum(x[seq])])
            ends = np.cumsum(many)
            added.append(sums[ends] - sums[ends - many])
        n_links = row["n_a"].to_numpy() + row["n_b"].to_numpy() - many
        return pa.table(row | {"n_links": pa.array(n_links), "n_best": pa.array(added[0]), "count_sum": pa.array(added[1])}).select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    texts = found.filter("at IS NULL").select(F.col("chunk").alias("part"), "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "seq")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("part").cogroup(back.groupBy("chunk")).applyInArrow(add, schema)
