"""Operator 1: BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece there is exactly one token that can come last in its encoding. An
automaton over the vocabulary lists the tokens that end at each byte; of those, the one whose pair
with the last token of the remaining prefix is a pair BPE itself would leave standing is stored.
Following the stored tokens back from the end gives the ids. The work for a piece is linear in its
length times the number of tokens that end at a byte. The short pieces of many texts are worked on side
by side, a byte of each at a time; long ones alone.

Cases: a null or empty text gives no ids; special tokens inside a text become their own id, as the
library does; very long texts are encoded whole, in time that grows with their length; repeated rows
stay; an empty frame gives an empty frame; a column with an output's name is replaced.
"""

from __future__ import annotations

import re
import struct
from array import array
from bisect import bisect_left
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import portions, texts, with_arrow_columns
from .vocabulary import SPACE, Vocabulary, pieces_of, read_vocabulary

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Words remembered in each of two generations in a Python worker (about 200 bytes each), and the longest that is.
MOST_WORDS, LONGEST_WORD = 200_000, 48
#: Places for pairs of tokens whose compatibility is remembered (8 bytes each), a power of two; a later pair takes an earlier one's place.
MOST_PAIRS = 1 << 20
#: Characters of the texts whose new pieces are encoded side by side, so many of these at a time; fewer than ``FEW`` aren't worth it.
SIDE_BY_SIDE, MOST_PIECES, FEW = 1 << 18, 1 << 13, 256


class Remembered(dict):
    """Results of ``work`` for keys met lately, in bounded memory.

    When the younger generation is full it becomes the older one, which is forgotten; a key that is
    met again while it is old becomes young again.
    """

    def __init__(self, work, most: int, keeps=lambda key: True):
        super().__init__()
        self.work, self.most, self.keeps, self.old = work, most, keeps, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.work(key)
            if not self.keeps(key):
                return out
        self.remember({key: out})
        return out

    def remember(self, found: dict) -> None:
        """Makes results young; more than ``most`` are so only if they come together."""
        if len(self) + len(found) > self.most:
            self.old = dict(self)
            self.clear()
        self.update(found)

    def unknown(self, keys) -> list:
        """Those of the keys that are not remembered; old ones become young again."""
        new = set(keys).difference(self)
        again = {key: self.old[key] for key in new if key in self.old}
        self.remember(again)
        return [key for key in new if key not in again]


def short(word: str) -> bool:
    """Whether a word is short enough to be remembered."""
    return len(word) <= LONGEST_WORD


#: A word with the space before it, or white space; pieces never cross these borders.
WORDS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Suffixes:
    """The automaton that lists the tokens ending at a byte, as arrays: for a single piece, and as numpy's for many at once.

    States are numbered by depth, and a state's children by byte, so that the edges (state << 8 | byte) are
    in order and the edge at place k leads to state k + 1.
    """

    def __init__(self, tokens: dict[int, bytes]):
        ids, raws = np.fromiter(tokens, np.int64, len(tokens)), list(tokens.values())
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        flat, starts = np.frombuffer(b"".join(raws), np.uint8), np.cumsum(sizes) - sizes
        at, count, levels = np.zeros(len(raws), np.int64), 1, []
        for depth in range(sizes.max()):
            longer = np.flatnonzero(sizes > depth)
            edges, which = np.unique(at[longer] << 8 | flat[starts[longer] + depth], return_inverse=True)
            at[longer] = count + which
            count += len(edges)
            levels.append(edges)
        self.edges = array("q", np.append(np.concatenate(levels), 1 << 62).tobytes())
        #: Of each state: the place of its first edge.
        self.starts = array("i", np.searchsorted(self.edges, np.arange(count + 1) << 8).astype(np.int32).tobytes())
        self.fails = array("i", [0]) * count
        #: Of each state: the longest token that ends there. Of each token: its bytes, and the longest that ends with it.
        self.longest = array("i", [-1]) * count
        self.sizes, self.shorter = (array("i", [-1]) * (int(ids.max()) + 1) for _ in range(2))
        self.many = [np.frombuffer(x, x.typecode) for x in (self.edges, self.fails, self.longest, self.sizes, self.shorter)]
        _, fails, longest, lengths, shorter = self.many
        longest[at] = ids
        count = 1
        for edges in levels:
            states = np.arange(count, count + len(edges))
            if count > 1:
                fails[states] = self.step(fails[edges >> 8], edges & 255)
            none = states[longest[states] < 0]
            longest[none] = longest[fails[none]]
            count += len(edges)
        lengths[ids], shorter[ids] = sizes, longest[fails[at]]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states after one more byte each; every byte is a token, so the first state has an edge for it."""
        edges, fails = self.many[:2]
        out, left = np.empty(len(states), np.int64), np.arange(len(states))
        while left.size:
            wanted = states.astype(np.int64) << 8 | symbols
            found = np.searchsorted(edges, wanted)
            out[left] = found + 1
            other = edges[found] != wanted
            left, states, symbols = left[other], fails[states[other]], symbols[other]
        return out


class Encoder:
    """Encodes texts of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, most_words: int = MOST_WORDS, most_pairs: int = MOST_PAIRS):
        self.vocabulary = vocabulary
        self.pairs = {left << 31 | right: rank for (left, right), (rank, _) in vocabulary.pairs.items()}
        # of each token: the two it is made of and the rank of that merge, -1 if it is a single byte
        size = max(vocabulary.token_bytes, default=0) + 2  # the last stands for the start of a piece, which no merge crosses
        self.lefts, self.rights, self.ranks = (array("i", [-1]) * size for _ in range(3))
        for token, (left, right, rank) in vocabulary.made.items():
            self.lefts[token], self.rights[token], self.ranks[token] = left, right, rank
        if most_pairs & (most_pairs - 1):
            raise ValueError("places for pairs must be a power of two")
        self.stands = array("Q", [0]) * most_pairs  # (pair + 1) * 2 + whether it stands; 0: free
        self.verdicts = np.frombuffer(self.stands, np.int64)
        reachable = self._reachable()
        self.suffixes = Suffixes({token: raw for token, raw in vocabulary.token_bytes.items() if token in reachable})
        self.words, self.pieces = Remembered(self._word, most_words, short), Remembered(self._piece, most_words, short)

    def _reachable(self) -> set[int]:
        """Tokens that BPE makes of their own bytes: both halves are made, and no earlier merge crosses them."""
        out = set(self.vocabulary.byte_ids)
        for token in sorted((t for t, rank in enumerate(self.ranks) if rank >= 0), key=self.ranks.__getitem__):
            left, right = self.lefts[token], self.rights[token]
            if left in out and right in out and self._kept_apart(left, right, top=False):
                out.add(token)
        return out

    def _kept_apart(self, left: int, right: int, top: bool = True) -> bool:
        """Whether BPE leaves two tokens side by side.

        The merges that made both tokens are undone from the latest to the earliest. At each step
        the symbols that face each other at the border must not have had a merge that would have
        come before the one just undone; of equal ranks the one further left comes first.
        """
        last, pairs, ranks = float("inf"), self.pairs, self.ranks
        while True:
            rank = pairs.get(left << 31 | right)
            if top and rank is not None and rank < last:
                return False
            top = True
            a, b = ranks[left], ranks[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                last, left = a, self.rights[left]
            else:
                last, right = b + 1, self.lefts[right]

    def _piece(self, piece: str) -> bytes:
        """Packed ids of one piece: the last token of every prefix, then back from the end."""
        raw, known = piece.encode(), self.suffixes
        edges, first, fails, longest, sizes, shorter = known.edges, known.starts, known.fails, known.longest, known.sizes, known.shorter
        ends = [len(self.ranks) - 1] * (len(raw) + 1)
        stands, most = self.stands, len(self.stands) - 1
        state = 0
        for at, symbol in enumerate(raw, 1):
            wanted = state << 8 | symbol
            while edges[found := bisect_left(edges, wanted, first[state], first[state + 1])] != wanted:
                state = fails[state]
                wanted = state << 8 | symbol
            state = found + 1
            token = longest[state]
            while True:
                last = ends[at - sizes[token]]
                pair, place = (last << 31 | token) + 1, (last * 40503 ^ token) & most
                verdict = stands[place]
                if verdict >> 1 != pair:
                    stands[place] = verdict = pair << 1 | self._kept_apart(last, token)
                if verdict & 1:
                    break
                token = shorter[token]
            ends[at] = token
        out, at = [], len(raw)
        while at:
            out.append(ends[at])
            at -= sizes[ends[at]]
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)  # remembered by the ten thousand: bytes cost the garbage collector nothing

    def _stand(self, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
        """Of many pairs of tokens: whether BPE leaves them side by side."""
        lefts, rights = lefts.astype(np.int64), rights.astype(np.int64)
        pairs, places = (lefts << 31 | rights) + 1, (lefts * 40503 ^ rights) & len(self.stands) - 1
        known = self.verdicts[places]
        new = np.flatnonzero(known >> 1 != pairs)
        if new.size:
            fresh, which = np.unique(pairs[new], return_inverse=True)
            apart = [self._kept_apart(pair - 1 >> 31, pair - 1 & 0x7FFFFFFF) for pair in fresh.tolist()]
            known[new] = (fresh << 1 | np.array(apart))[which]
            self.verdicts[places[new]] = known[new]
        return known & 1 == 1

    def _side_by_side(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of many pieces: the last token of every prefix of each, then back from the ends."""
        raws = [piece.encode() for piece in pieces]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        flat, starts = np.frombuffer(b"".join(raws), np.uint8), np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")  # at each byte those that are as long come first
        lengths, starts, rows = lengths[order], starts[order], np.arange(len(raws))
        ends = np.full((lengths[0] + 1, len(raws)), len(self.ranks) - 1, np.int32)
        _, _, longest, sizes, shorter = self.suffixes.many
        states = np.zeros(len(raws), np.int64)
        for at in range(1, lengths[0] + 1):
            left = rows[: np.searchsorted(-lengths, -at, "right")]
            states = self.suffixes.step(states[: len(left)], flat[starts[left] + at - 1])
            tokens = longest[states]
            while left.size:
                good = self._stand(ends[at - sizes[tokens], left], tokens)
                ends[at, left[good]] = tokens[good]
                left, tokens = left[~good], shorter[tokens[~good]]
        steps, counts = [], np.zeros(len(raws), np.int64)
        while rows.size:
            tokens = ends[lengths[rows], rows]
            steps.append((rows, tokens))
            counts[rows] += 1
            lengths[rows] -= sizes[tokens]
            rows = rows[lengths[rows] > 0]
        stops = np.cumsum(counts)
        ids = np.empty(stops[-1], "<u4")
        for k, (rows, tokens) in enumerate(steps, 1):
            ids[stops[rows] - k] = tokens
        packed, stops = ids.tobytes(), [0, *(stops * 4).tolist()]
        return {pieces[k]: packed[a:b] for k, a, b in zip(order.tolist(), stops, stops[1:])}

    def _learn(self, words: list[list[str]]) -> None:
        """Remembers the words of several texts, those that are new worked on side by side."""
        new = self.words.unknown(set(chain.from_iterable(words)).difference(self.vocabulary.specials))
        if len(new) < FEW:
            return
        found = [pieces_of(word) for word in new]
        parts = list(filter(short, self.pieces.unknown(piece for pieces in found if len(pieces) > 1 for piece in pieces)))
        # a word that is one piece is remembered as a word only
        todo, ids = list({*parts, *(word for word, pieces in zip(new, found) if len(pieces) == 1 and short(word))}), {}
        for k in range(0, len(todo), MOST_PIECES):
            ids |= self._side_by_side(todo[k : k + MOST_PIECES])
        self.pieces.remember({piece: ids[piece] for piece in parts})
        self.words.remember({w: ids[w] if len(pieces) == 1 else b"".join([self.pieces[x] for x in pieces]) for w, pieces in zip(new, found) if short(w)})

    def _word(self, word: str) -> bytes:
        special = self.vocabulary.specials.get(word)
        if special is not None:
            return struct.pack("<I", special)
        found = pieces_of(word)
        return b"".join([self.pieces[piece] for piece in found]) if len(found) > 1 else self._piece(word)

    def _words(self, text: str) -> list[str]:
        """Words of a text and, in their places, special tokens, which no word contains."""
        parts = self.vocabulary.parts(text)
        if len(parts) == 1:
            return WORDS.findall(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else WORDS.findall(part))]

    def all_packed(self, whole: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, out = self.words, []
        for some in portions(whole, SIDE_BY_SIDE):
            words = [self._words(x) for x in whole[some]]
            self._learn(words)
            out += [b"".join([known[w] for w in x]) for x in words]
        return out

    def packed(self, text: str) -> bytes:
        """Ids of one text."""
        return self.all_packed([text])[0]


class Decoder:
    """Texts of ids; bytes that are no UTF-8 become replacement characters."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = vocabulary.token_bytes

    def text(self, packed: bytes) -> str:
        """The text of packed ids; an id outside the vocabulary gives nothing."""
        ids = np.frombuffer(packed, "<u4").tolist()
        table = self.table
        try:
            raw = b"".join([table[i] for i in ids])
        except KeyError:
            raw = b"".join([table.get(i, b"") for i in ids])
        return raw.decode("utf-8", "replace")


def encode(df: DataFrame, text: str = "text", out: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """Adds ``out``: the ids of each text, packed as little-endian unsigned 32-bit integers."""
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        encoder = Encoder(Vocabulary(shared.value))
        return lambda column: [pa.array(encoder.all_packed(list(texts(column))), pa.binary())]

    return with_arrow_columns(df, [text], [T.StructField(out, T.BinaryType())], make)


def decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Adds ``out``: the text of packed ids, special tokens included; null ids give the empty text."""
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        decoder = Decoder(Vocabulary(shared.value))
        return lambda column: [pa.array([decoder.text(x or b"") for x in column.to_pylist()], pa.string())]

    return with_arrow_columns(df, [ids], [T.StructField(out, T.StringType())], make)


def encode_decode(df: DataFrame, text: str = "text", out: str = "token_ids", decoded: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Adds both the ids of each text and their text, in one pass with one vocabulary a worker."""
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        encoder = Encoder(Vocabulary(shared.value))
        decoder = Decoder(encoder.vocabulary)

        def compute(column):
            ids = encoder.all_packed(list(texts(column)))
            return [pa.array(ids, pa.binary()), pa.array([decoder.text(x) for x in ids], pa.string())]

        return compute

    return with_arrow_columns(df, [text], [T.StructField(out, T.BinaryType()), T.StructField(decoded, T.StringType())], make)


def encode_checked(df: DataFrame, text: str = "text", out: str = "token_ids", same: str = "round_trip", vocabulary: str | None = None, most_words: int = MOST_WORDS, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Adds the ids of each text, and whether they decode to the text; the text itself is left out of the result.

    ``most_words`` are remembered in each of two generations, ``most_pairs`` in all: less memory, more time.
    """
    path = vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        encoder = Encoder(Vocabulary(shared.value), most_words, most_pairs)
        encoder.vocabulary.forget_merges()
        decoder = Decoder(encoder.vocabulary)

        def compute(column):
            whole = list(texts(column))
            ids = encoder.all_packed(whole)
            good = [decoder.text(i) == x for i, x in zip(ids, whole)]
            return [pa.array(ids, pa.binary()), pa.array(good, pa.bool_())]

        return compute

    fields = [T.StructField(out, T.BinaryType()), T.StructField(same, T.BooleanType())]
    return with_arrow_columns(df, [text], fields, make, without=[text])
