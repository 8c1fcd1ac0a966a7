"""Operator 5: token counts by heap-and-linked-list byte-pair merging.

The symbols of a piece form a linked list; a heap holds its adjacent pairs by merge rank and
place. The lowest pair is popped and merged again and again. The count is the number of initial
symbols less the number of merges; no ids are made.

Cases: a null or empty text has 0 tokens and 0 bytes; a special token inside a text counts as one;
very long texts are counted whole; repeated rows are counted alike; an empty frame gives an empty
frame; a column with an output's name is replaced.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe_codec import DEFAULT_VOCABULARY, MOST_WORDS, WORDS, Remembered, short
from .common import texts, with_arrow_columns
from .vocabulary import Vocabulary, pieces_of, read_vocabulary


class Counter:
    """Counts the tokens of texts of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words, self.pieces = Remembered(self._word, MOST_WORDS, short), Remembered(self._piece, MOST_WORDS, short)

    def merges(self, raw: bytes) -> int:
        """How many merges BPE makes in one piece."""
        pairs, single = self.vocabulary.pairs, self.vocabulary.byte_ids
        symbol = [single[b] for b in raw]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for at in range(n - 1):
            found = pairs.get((symbol[at], symbol[at + 1]))
            if found:
                heap.append((found[0], at, found[1]))
        heapify(heap)
        done = 0
        while heap:
            rank, at, made = heappop(heap)
            right = after[at] if symbol[at] >= 0 else n
            if right >= n or pairs.get((symbol[at], symbol[right]), (-1,))[0] != rank:
                continue  # one of the two was merged meanwhile
            symbol[at], symbol[right] = made, -1
            beyond, left = after[right], before[at]
            after[at] = beyond
            if beyond < n:
                before[beyond] = at
                if found := pairs.get((made, symbol[beyond])):
                    heappush(heap, (found[0], at, found[1]))
            if left >= 0 and (found := pairs.get((symbol[left], made))):
                heappush(heap, (found[0], left, found[1]))
            done += 1
        return done

    def _piece(self, piece: str) -> int:
        raw = piece.encode()
        return len(raw) - self.merges(raw)

    def _word(self, word: str) -> int:
        found = pieces_of(word)
        return sum([self.pieces[p] for p in found]) if len(found) > 1 else self._piece(word)

    def count(self, text: str) -> int:
        """Tokens of a text."""
        words, total = self.words, 0
        for k, part in enumerate(self.vocabulary.parts(text)):
            total += 1 if k % 2 else sum([words[w] for w in WORDS.findall(part)])
        return total


def count_tokens(
    df: DataFrame, text: str = "text", out: str = "n_tokens", out_bytes: str = "n_bytes", vocabulary: str | None = None
) -> DataFrame:
    """Adds the number of tokens and of UTF-8 bytes of each text."""
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        counter = Counter(Vocabulary(shared.value))

        def compute(column):
            whole = list(texts(column))
            return [
                pa.array([len(x.encode()) for x in whole], pa.int64()),
                pa.array([counter.count(x) for x in whole], pa.int64()),
            ]

        return compute

    return with_arrow_columns(df, [text], [T.StructField(out_bytes, T.LongType()), T.StructField(out, T.LongType())], make)
