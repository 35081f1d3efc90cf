"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words joined by single spaces. An item of m characters may differ from a passage by
k = m // `per_error` edits. Cut into k + 1 pieces, at least one piece stands unchanged in any such passage, so every
match is found from exact piece hits (Aho-Corasick over all pieces); each hit's neighbourhood is verified by Myers'
bit-parallel distance. Items are matched whole; the result has a row for each (document, item) with the least distance.

Bounds: the automaton is built from a block of items of at most `block_chars` characters; a larger benchmark is
processed in several blocks, each over all documents, so nothing is left out.

Edge cases: null or empty texts and items of no words match nothing; an item too short for one error must occur exactly,
at word borders; repeated items report under each id; a null id stays null in the result; repeated documents each
report; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvet.llm.common import slices

_WORDS = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(_WORDS.findall(text.lower())) if text else ""


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance between pattern and any substring of text, and the end of the first such substring."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        places[c] |= 1 << i
    plus, minus, score, best, best_end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = places.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if score < best:
            best, best_end = score, j + 1
    return best, best_end


class EditMatcher:
    """find(text): {item index: (distance, start, end)} in the normal text."""

    def __init__(self, items: list[str], per_error: int):
        import ahocorasick

        self.items = [normal(x) for x in items]
        self.budget = [len(x) // per_error for x in self.items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (item, k) in enumerate(zip(self.items, self.budget, strict=True)):
            cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    pieces[item[a:b]].append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        if not len(self.automaton) or not text:
            return {}
        spots: dict[int, set[int]] = defaultdict(set)
        for end, (length, where) in self.automaton.iter(text):
            for i, offset in where:
                spots[i].add(end + 1 - length - offset)
        found = {}
        for i, starts in spots.items():
            item, k = self.items[i], self.budget[i]
            m, best, done = len(item), None, None
            for start in sorted(starts):
                if done is not None and start <= done:  # the last window reached as far as this one needs
                    continue
                low = max(0, start - k)
                reach = start + k + 1
                if not k:
                    hit = (0, start + m - low) if text.startswith(item, start) and start >= 0 and text[start - 1 : start] in ("", " ") and text[start + m : start + m + 1] in ("", " ") else (1, 0)
                    reach = start
                else:
                    hit = myers(item, text[low : max(0, reach + m + k)])
                done = reach
                if hit[0] <= k and (best is None or hit[0] < best[0]):
                    best = (hit[0], max(0, low + hit[1] - m), low + hit[1])
            if best:
                found[i] = best
        return found


def blocks_of(benchmark: DataFrame, block_chars: int):
    """Lists of (item_id, text), each of at most block_chars characters by even hashing; one list if all fit."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-2 * total // block_chars) if total > block_chars else 1
    for b in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, per_error: int = 20, block_chars: int = 16_000_000) -> DataFrame:
    """doc_id, item_id, distance, match_start, match_end (in the normal text) of each document and item in it."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, match_start long, match_end long"
    parts = []
    for block in blocks_of(benchmark, block_chars):
        held = spark.sparkContext.broadcast(sorted(block, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))

        def each(batches, held=held):
            matcher = EditMatcher([t for _, t in held.value], per_error)
            for batch in slices(batches):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    rows += [(doc_id, held.value[i][0], *at) for i, at in matcher.find(normal(text)).items()]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "match_start", "match_end"])

        parts.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, per_error: int = 20, block_chars: int = 16_000_000) -> DataFrame:
    """The documents in which no item was found, all their columns; the text is judged where it lies, without a shuffle."""
    out = docs
    for block in blocks_of(benchmark, block_chars):
        held = docs.sparkSession.sparkContext.broadcast([t for _, t in block])

        def each(batches, held=held):
            matcher = EditMatcher(held.value, per_error)
            for batch in slices(batches):
                yield batch.filter(pa.array([not matcher.find(normal(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

        out = out.mapInArrow(each, out.schema)
    return out
