"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists all vocabulary pieces in a word by their end; dynamic programming over the ends carries
the best score and the number of pieces on the best path. Ties follow the tokenizers library: of equal scores the
candidate with the earliest start (the longest piece) stays. A character that no single piece covers may be unknown at
the least score minus 10; unknown characters become byte pieces if the vocabulary has them, else a run of them is one
piece. Words are cut before each mark that stands for a space, so counts of words add up and are cached (bounded).

The vocabulary is a public file's; its pieces stand in order of rank, and scores follow Zipf's law: -ln(rank + 1) - ln(H).

Edge cases: null and empty text have 0 tokens and score 0; a text of any length is one pass in memory linear in its
longest word; repeated rows have equal results; further columns are ignored.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvet.llm.common import slices

MARK = "▁"


@functools.lru_cache(maxsize=2)
def zipf_vocabulary(model_file: str) -> tuple[tuple[tuple[str, float], ...], bool]:
    """(piece, score) of the ordinary pieces of a sentencepiece file in its order, and whether it has all byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    harmonic = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return tuple((p, -math.log(r + 1) - harmonic) for r, p in enumerate(pieces)), sum(model.is_byte(i) for i in range(size)) == 256


class UnigramCounter:
    """count(word): (pieces, score) of the best path over one word."""

    def __init__(self, pieces, byte_fallback: bool, penalty: float = 10.0, cached: int = 400_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - penalty
        self.byte_fallback, self.cached, self.cache = byte_fallback, cached, {}

    def count(self, word: str) -> tuple[int, float]:
        n = len(word)
        scores, counts, run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found = self.automaton.iter(word)
        end, match = next(found, (n, None))
        unknown = self.unknown
        for at in range(n):
            best, start, single = None, at, False
            while end == at:
                length, score = match
                candidate = scores[at + 1 - length] + score
                if best is None or candidate > best:
                    best, start = candidate, at + 1 - length
                single = single or length == 1
                end, match = next(found, (n, None))
            if not single and (best is None or scores[at] + unknown > best):
                best, start = scores[at] + unknown, at
                step = len(word[at].encode("utf-8", "replace")) if self.byte_fallback else int(not run[at])
                run[at + 1] = True
            else:
                step = 1
            scores[at + 1], counts[at + 1] = best, counts[start] + step
        return counts[n], scores[n]

    def count_text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            words = words[1:]
        cache, total, score = self.cache, 0, 0.0
        for word in words:
            known = cache.get(word)
            if known is None:
                known = self.count(MARK + word)
                if len(word) <= 64:
                    if len(cache) >= self.cached:
                        cache.clear()
                    cache[word] = known
            total += known[0]
            score += known[1]
        return total, score


@functools.lru_cache(maxsize=1)
def _counter(model_file: str) -> UnigramCounter:
    return UnigramCounter(*zipf_vocabulary(model_file))


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, score. model_file: path of a sentencepiece vocabulary that every executor can read."""

    def each(batches):
        counter = _counter(model_file)
        for batch in slices(batches):
            got = [counter.count_text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, n_tokens long, score double")
