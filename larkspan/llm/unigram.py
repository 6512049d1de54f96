"""Count-only Viterbi token counts.

An Aho-Corasick automaton lists every vocabulary piece that ends at a position;
dynamic programming over the positions carries the best score and the number of
pieces on the way, never the pieces themselves. Rules of the tokenizer:

- among equal scores the path whose last piece starts earlier (the longer piece)
  wins, as only a strictly better score replaces a path;
- a character without a piece of its own may stand alone at the worst normal
  score less 10; with byte fallback it counts its UTF-8 bytes, else a run of
  such characters counts one.

Scores are added as doubles. Where no piece holds two neighbouring characters in
a row, every path breaks between them; texts are cut there, and the counts of
parts and words are kept in a bounded memo.

Cases: null and empty texts have no tokens. Texts are counted whole. Repeated
rows give repeated rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.pieces import MARK, NORMAL, USER, Codec, batches_of, parse

UNKNOWN_PENALTY = 10.0
MEMO = 1 << 19


class Counter:
    """Token counts by the pieces and scores of a model file, read as a unigram vocabulary."""

    def __init__(self, data: bytes):
        model = parse(data)
        self.words = Codec.words.__get__(self)
        self.pieces = {p.piece: float(p.score) for p in model.pieces if p.type in (NORMAL, USER)}
        self.fallback = model.trainer_spec.byte_fallback
        self.unknown = min(self.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.parts: dict[str, tuple[int, float]] = {}
        self.memo: dict[str, int] = {}

    def viterbi(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path over a marked text."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        run = [False] * (n + 1)  # the path ends on an unknown character
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        for i, matches in enumerate(ends):
            best = None
            matches.sort(reverse=True)  # earliest start first
            for length, own in matches:
                total = score[i + 1 - length] + own
                if best is None or total > best:
                    best, pieces, odd = total, count[i + 1 - length] + 1, False
            if text[i] not in self.pieces:
                total = score[i] + self.unknown
                if best is None or total > best:
                    best, odd = total, True
                    pieces = count[i] + (len(text[i].encode("utf-8", "surrogatepass")) if self.fallback else int(not run[i]))
            score[i + 1], count[i + 1], run[i + 1] = best, pieces, odd
        return count[n], score[n]

    def count_marked(self, text: str) -> int:
        """Pieces of a marked text, cut where no piece can span."""
        if not self.fallback:
            return self.viterbi(text)[0]
        total, start = 0, 0
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in self.pairs:
                part = text[start:i]
                found = self.parts.get(part)
                if found is None:
                    found = self.viterbi(part)
                    if len(part) <= 48:
                        if len(self.parts) > MEMO:
                            self.parts.clear()
                        self.parts[part] = found
                total += found[0]
                start = i
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.fallback:
            return self.count_marked(MARK + text.replace(" ", MARK))
        memo, total = self.memo, 0
        if len(memo) > MEMO:
            memo.clear()
        for word in self.words(text):
            n = memo.get(word)
            if n is None:
                n = self.count_marked(word if MARK in word else MARK + word)
                if len(word) <= 48:
                    memo[word] = n
            total += n
        return total


def token_counts(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_chars and n_tokens of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            at = 0
            for texts in batches_of(batch.column(1)):
                counts = pa.array(np.array([counter.count(t) for t in texts], np.int64))
                sizes = pa.array(np.array([len(t) for t in texts], np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(texts)], sizes, counts], ["doc_id", "n_chars", "n_tokens"])
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
