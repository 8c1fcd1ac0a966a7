"""Operator 10: language-model scores by a weighted backoff automaton of smoothed n-grams.

Tokens are lower-cased words (A-Z only) and one end a text. The model has all unigrams, bigrams and
trigrams of the training rows, each order smoothed by the one below it (Dirichlet):

    P(w|u v) = (n(u v w) + mu P(w|v)) / (n(u v) + mu)
    P(w|v)   = (n(v w) + mu P(w)) / (n(v) + mu)
    P(w)     = (n(w) + 0.1) / (N + 0.1 (V + 1))

As an automaton: every pair of words of the training rows is a state, every word and the start of a
text is one, and the root. A state has an arc for each word seen after it, weighted log10 P, that
leads to the state of the two words; where there is none, its failure arc leads to the state of the
last word alone, and that state's to the root, weighted log10 mu / (n + mu). The root has an arc for
every word. One traversal from left to right carries the state and adds up the weights. No n-gram is
left out: the automaton grows with the corpus.

No task holds the whole automaton, nor does the driver or a broadcast. Texts are cut into blocks of
about ``BLOCK_TOKENS`` tokens, in place, without a shuffle; a long text is in several. A block names its
distinct words, dealt by hash into parts that give each word a number and add up its counts. It then
asks for its bigrams and trigrams, with its own training counts, dealt by bigram into parts; a part
adds up what the blocks ask for and sends back what other blocks count. So a block loads the states and arcs that its texts can reach.
Bigrams whose words are both so frequent that their trigrams might fill a part are dealt out by
trigram too (``SALT_COUNT``). Requests are packed arrays.

Cases: a null or empty text is one end; very long texts are cut at white space and scored whole; an
empty training set leaves N = V = 0 and scores by the smoothing alone; repeated rows are scored alike
and count as often as they come; a null id hashes as the empty text; an empty frame gives an empty
frame; further columns are left alone.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, small_batches, text_bytes, text_key

MU = 30.0
ADD = 0.1
#: Tokens of a block, and bytes of a text that are split into words at a time.
BLOCK_TOKENS, PORTION = 1_000_000, 1 << 18
#: Tokens, and words of blocks, for which a part adds up requests.
PART_TOKENS, PART_WORDS = 1_000_000, 500_000
#: Occurrences of the rarer word of a bigram from which its trigrams are dealt out.
SALT_COUNT = 500_000
#: Tokens of a stretch of text; the traversal goes through a block's stretches side by side.
STRETCH = 512
#: Places of the start, the end and the first word among a block's words; bits of a place.
START, END, FIRST, BITS = 0, 1, 2, 22
NONE = (1 << (BITS - 1)) - 1

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _packed(a: np.ndarray) -> bytes:
    """An array, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _mixed(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of whole numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        h = (h ^ x.astype(np.uint64)) * _MIX[0]
        h = (h ^ (h >> np.uint64(30))) * _MIX[1]
        h = (h ^ (h >> np.uint64(27))) * _MIX[2]
        h ^= h >> np.uint64(31)
    return h


def _portions(raw: bytes):
    """The words of a text, some at a time."""
    at = 0
    while at < len(raw):
        end = _SPACE.search(raw, at + PORTION)
        end = end.start() if end else len(raw)
        yield raw[at:end].lower().split()
        at = end


BLOCK = "block bigint, rid {0}, rkey array<bigint>, train array<boolean>, first array<boolean>, size array<int>, tokens binary, n_words bigint, words binary, n binary"


def _blocks(rows: DataFrame, kind: str) -> DataFrame:
    """Blocks of texts as places among the block's own words.

    A piece of a text that goes on from another block begins with the two tokens before it.
    """
    id_type = pa.list_(rows.select("rid").limit(0).toArrow().schema.field("rid").type)

    def run(batches):
        place: dict[bytes, int] = {}
        pieces, parts, counts, held, number = [], [], [], 0, 0

        def flush():
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            train = np.repeat([p[2] for p in pieces], [p[4] for p in pieces])
            scored = np.ones(len(tokens), bool)
            at = 0
            for _, _, _, first, size in pieces:
                if not first:
                    scored[at : at + 2] = False
                at += size
            n = np.bincount(tokens[train & scored], minlength=FIRST + len(place)).astype(np.int64)
            columns = list(zip(*pieces))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(TaskContext.get().partitionId() << 20) + number], pa.int64()),
                    pa.array([list(columns[0])], id_type), pa.array([list(columns[1])], pa.list_(pa.int64())),
                    pa.array([list(columns[2])], pa.list_(pa.bool_())), pa.array([list(columns[3])], pa.list_(pa.bool_())), pa.array([list(columns[4])], pa.list_(pa.int32())),
                    pa.array([_packed(tokens)], pa.binary()), pa.array([len(place)], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(b" ".join(place))], pa.binary()), pa.array([_packed(n)], pa.binary()),
                ],
                names=["block", "rid", "rkey", "train", "first", "size", "tokens", "n_words", "words", "n"],
            )

        for batch in batches:
            ids, keys, trains = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for rid, key, raw, train in zip(ids, keys, text_bytes(batch.column(2)), trains):
                first, last, size = True, np.zeros(0, np.int32), 0

                def close():
                    pieces.append((rid, key, train, first, size))  # noqa: B023

                before: list[bytes] = []
                for words in _portions(raw):
                    if held >= BLOCK_TOKENS and before:
                        close()
                        yield flush()
                        place, pieces, parts, held, number = {}, [], [], 0, number + 1
                        last = np.array([place.setdefault(w, FIRST + len(place)) for w in before], np.int32)
                        parts.append(last)
                        first, size = False, len(last)
                    found = np.array([place.setdefault(w, FIRST + len(place)) for w in words], np.int32)
                    parts.append(found)
                    size += len(found)
                    held += len(found)
                    before = words[-2:] if len(words) > 1 else []
                parts.append(np.array([END], np.int32))
                size += 1
                held += 1
                close()
                if held >= BLOCK_TOKENS:
                    yield flush()
                    place, pieces, parts, held, number = {}, [], [], 0, number + 1
        if pieces:
            yield flush()

    return rows.select("rid", "rkey", "t", "train").mapInArrow(run, BLOCK.format(f"array<{kind}>"))


def _words(raw: bytes) -> list[bytes]:
    """A block's words from the end on, which is the empty one."""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    return [b"", *raw.split(b" ")] if raw else [b""]


def _word_parts(words: list[bytes], n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words by part, and where each part begins."""
    part = np.array([xxhash.xxh64_intdigest(w) % n_parts for w in words])
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n_parts + 1))


WORD_REQUEST = "part int, block bigint, words binary, place binary, n binary"


def _word_requests(n_parts: int):
    """The words of a block by part, with their places and training counts."""

    def run(batches):
        for batch in batches:
            for block, raw, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words, n = _words(raw), _unpacked(n, np.int64)[END:]
                order, edges = _word_parts(words, n_parts)
                for part in np.flatnonzero(np.diff(edges)).tolist():
                    own = order[edges[part] : edges[part + 1]]
                    told = zstandard.ZstdCompressor(level=3).compress(b" ".join([words[k] for k in own.tolist()]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (told, _packed(own + END), _packed(n[own])))],
                        names=["part", "block", "words", "place", "n"],
                    )

    return run


def _numbered(table: pa.Table) -> pa.Table:
    """Numbers and counts of the words of a part: a word's number is its place in its first block."""
    table = table.sort_by("block")
    number: dict[bytes, int] = {}
    codes, firsts, counts = [], [], []
    for block, words, place, n in zip(*(table.column(c).to_pylist() for c in ("block", "words", "place", "n"))):
        words = zstandard.ZstdDecompressor().decompress(words).split(b" ")
        place, before = _unpacked(place, np.int64), len(number)
        code = np.array([number.setdefault(w, len(number)) for w in words])
        codes.append(code)
        counts.append(_unpacked(n, np.int64))
        firsts.append((block << BITS) + place[code >= before])  # words of one block differ, so these are new in order
    ids, of = np.concatenate(firsts), np.concatenate(codes)
    total = np.bincount(of, np.concatenate(counts), len(ids)).astype(np.int64)
    return pa.table(
        {
            "block": table.column("block"), "part": table.column("part"),
            "ids": pa.array([_packed(ids[x]) for x in codes], pa.binary()), "c": pa.array([_packed(total[x]) for x in codes], pa.binary()),
        }
    )


def _named(n_parts: int):
    """A block with the numbers and counts of its words, and what it adds to V and N."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        raw, n = left.column("words")[0].as_py(), left.column("n")[0].as_py()
        order, _ = _word_parts(_words(raw), n_parts)
        answers = right.sort_by("part")
        ids, c = np.zeros(len(order) + END, np.int64), np.zeros(len(order) + END, np.int64)
        for column, to in (("ids", ids), ("c", c)):
            to[order + END] = np.concatenate([_unpacked(x, np.int64) for x in answers.column(column).to_pylist()])
        ids[START], c[START] = -1, c[END]  # as many starts as ends
        own = (left.column("block")[0].as_py() << BITS) + np.arange(len(ids))
        tally = [int(((own == ids) & (c > 0)).sum()), int(_unpacked(n, np.int64)[END:].sum())]
        out = left.select(["block", "rid", "rkey", "train", "first", "size", "tokens"])
        return out.append_column("ids", pa.array([_packed(ids)], pa.binary())).append_column("c", pa.array([_packed(c)], pa.binary())).append_column("tally", pa.array([tally], pa.list_(pa.int64())))

    return run


class _Block:
    """N-grams of a block, in the order in which it asks for their counts."""

    def __init__(self, row: dict):
        self.tokens = _unpacked(row["tokens"], np.int32).astype(np.int64)
        self.ids, self.c = _unpacked(row["ids"], np.int64), _unpacked(row["c"], np.int64)
        self.size, self.first = np.array(row["size"], np.int64), np.array(row["first"], bool)
        self.start = np.cumsum(self.size) - self.size
        n = len(self.tokens)
        before, before2 = np.full(n, START), np.full(n, NONE)
        before[1:], before2[2:] = self.tokens[:-1], self.tokens[:-2]
        begins = self.start[self.first]
        before[begins], before2[begins] = START, NONE
        second = begins[self.size[self.first] > 1] + 1
        before2[second] = START
        #: tokens that count here; the first two of a piece that goes on were scored before
        self.scored = np.ones(n, bool)
        for k in (0, 1):
            self.scored[self.start[~self.first] + k] = False
        b = np.int64(BITS - 1)
        self.keys = (before << b | self.tokens) << b | before2
        train = np.repeat(np.array(row["train"], bool), self.size)
        #: distinct trigrams v w u, their counts here; the bigrams v w they belong to
        self.trigrams, at = np.unique(self.keys[self.scored], return_inverse=True)
        self.n = np.bincount(at[train[self.scored]], minlength=len(self.trigrams)).astype(np.int64)
        pair = self.trigrams >> b
        fresh = np.concatenate(([True], pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, bool)
        self.bigrams, self.of = pair[fresh], np.cumsum(fresh) - 1
        self.own = np.bincount(self.of, self.n, len(self.bigrams)).astype(np.int64) if len(pair) else np.zeros(0, np.int64)
        mask = np.int64((1 << (BITS - 1)) - 1)
        self.v, self.w, self.u = self.bigrams >> b, self.bigrams & mask, self.trigrams & mask

    def asked(self, n_parts: int, salt_count: int):
        """Requests: groups (bigram, salt, part) by part, and the trigrams of each in the groups' order.

        A frequent bigram has a group for its own count, with salt 1, and others for its trigrams.
        """
        spread = 1 + np.minimum(self.c[self.v], self.c[self.w]) // salt_count
        hot = np.flatnonzero(spread > 1)
        if len(hot):
            salt = np.where(spread[self.of] > 1, 2 + (_mixed(self.uid(np.arange(len(self.u)))) % spread[self.of].astype(np.uint64)).astype(np.int64), 0)
            order = np.lexsort((salt, self.of))
            of, salt = self.of[order], salt[order]
            fresh = np.concatenate(([True], (of[1:] != of[:-1]) | (salt[1:] != salt[:-1])))
            group_of = np.cumsum(fresh) - 1  # of the ordered trigrams
            bigram, salts = np.concatenate((of[fresh], hot)), np.concatenate((salt[fresh], np.ones(len(hot), np.int64)))
        else:
            order, group_of, bigram, salts = np.arange(len(self.of)), self.of, np.arange(len(self.bigrams)), np.zeros(len(self.bigrams), np.int64)
        part = (_mixed(self.ids[self.v[bigram]], self.ids[self.w[bigram]], salts) % np.uint64(n_parts)).astype(np.int32)
        rank = np.argsort(part, kind="stable")
        place = np.empty(len(rank), np.int32)
        place[rank] = np.arange(len(rank), dtype=np.int32)
        inner = np.argsort(place[group_of], kind="stable")
        return bigram[rank], salts[rank], part[rank], order[inner], place[group_of][inner]

    def uid(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the first words of trigrams; -2 where a text has none."""
        u = self.u[at]
        return np.where(u == NONE, -2, self.ids[np.minimum(u, len(self.ids) - 1)])


REQUEST = "part int, block bigint, v binary, w binary, salt binary, size binary, own binary, u binary, n binary"


def _requests(n_parts: int, salt_count: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                bigram, salts, part, trigram, group = block.asked(n_parts, salt_count)
                first, second, uid = block.ids[block.v[bigram]], block.ids[block.w[bigram]], block.uid(trigram)
                sizes = np.bincount(group, minlength=len(bigram)).astype(np.int32)
                edges = np.concatenate(([0], np.cumsum(sizes)))
                cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    inner = slice(edges[a], edges[b])
                    arrays = (first[a:b], second[a:b], salts[a:b], sizes[a:b], block.own[bigram[a:b]], uid[inner], block.n[trigram[inner]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part[a]], pa.int32()), pa.array([row["block"]], pa.int64()), *(pa.array([_packed(x)], pa.binary()) for x in arrays)],
                        names=["part", "block", "v", "w", "salt", "size", "own", "u", "n"],
                    )

    return run


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Equal rows get equal small numbers."""
    h = _mixed(*columns)
    order = np.argsort(h)
    differ = np.zeros(max(len(order) - 1, 0), bool)
    for x in columns:
        differ |= x[order][1:] != x[order][:-1]
    if (differ & (h[order][1:] == h[order][:-1])).any():  # two rows with one hash: sort by the rows themselves
        order = np.lexsort(columns)
        differ[:] = False
        for x in columns:
            differ |= x[order][1:] != x[order][:-1]
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = np.cumsum(differ)
    return out


def _added_up(table: pa.Table) -> pa.Table:
    """What other blocks count of the n-grams that each block of a part asks for."""
    kinds = {"v": np.int64, "w": np.int64, "salt": np.int64, "size": np.int32, "own": np.int64, "u": np.int64, "n": np.int64}
    held = {c: [_unpacked(x, kind) for x in table.column(c).to_pylist()] for c, kind in kinds.items()}
    edges = np.cumsum([len(x) for x in held["v"]])[:-1]
    inner = np.cumsum([len(x) for x in held["u"]])[:-1]
    v, w, salt, size, own, u, n = (np.concatenate(held.pop(c)) for c in kinds)
    group = _codes(v, w, salt)
    total = np.bincount(group, own).astype(np.int64)[group] - own
    trigram = _codes(u, np.repeat(group, size))
    more = np.bincount(trigram, n).astype(np.int64)[trigram] - n if len(u) else n
    return pa.table(
        {
            "block": table.column("block"), "part": table.column("part"),
            "bigrams": pa.array([_packed(x) for x in np.split(total, edges)], pa.binary()), "trigrams": pa.array([_packed(x) for x in np.split(more, inner)], pa.binary()),
        }
    )


class _Automaton:
    """States and arcs that a block's texts can reach.

    A state is a number: that of a pair of words, then that of a word, then the root. Arcs are sorted
    by state and word.
    """

    def __init__(self, block: _Block, pairs: np.ndarray, triples: np.ndarray, total: int, distinct: int, add: float, mu: float):
        b = np.int64(BITS - 1)
        c, self.n_pairs = block.c.astype(float), len(pairs)
        self.n_words, self.root = len(c), len(pairs) + len(c)
        self.known = c > 0
        self.base = np.log10((c + add) / (total + add * (distinct + 1)))
        smooth = (pairs + mu * 10 ** self.base[block.w]) / (c[block.v] + mu)
        self.word_arcs, self.word_weight = block.bigrams[pairs > 0], np.log10(smooth[pairs > 0])
        self.word_leads = np.flatnonzero(pairs > 0)
        seen = np.flatnonzero((triples > 0) & (block.u != NONE))
        source = np.searchsorted(block.bigrams, block.u[seen] << b | block.v[block.of[seen]])
        arcs = source << b | block.w[block.of[seen]]
        order = np.argsort(arcs)
        self.pair_arcs, self.pair_leads = arcs[order], block.of[seen][order]
        self.pair_weight = np.log10((triples[seen] + mu * smooth[block.of[seen]]) / (pairs[source] + mu))[order]
        self.pair_fails, self.word_fails = np.log10(mu / (pairs + mu)), np.log10(mu / (c + mu))
        self.last = block.w

    @staticmethod
    def _arc(arcs: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(arcs):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
        return at, arcs[at] == key

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that words lead to, and the weights of the arcs on the way."""
        b, weight, to = np.int64(BITS - 1), np.zeros(len(state)), np.full(len(state), self.root)
        left = np.flatnonzero(state < self.n_pairs)
        at, met = self._arc(self.pair_arcs, state[left] << b | word[left])
        weight[left[met]], to[left[met]] = self.pair_weight[at[met]], self.pair_leads[at[met]]
        failed = left[~met]
        weight[failed] += self.pair_fails[state[failed]]
        now = state.copy()
        now[failed] = self.n_pairs + self.last[state[failed]]
        left = np.concatenate((failed, np.flatnonzero((state >= self.n_pairs) & (state < self.root))))
        at, met = self._arc(self.word_arcs, (now[left] - self.n_pairs) << b | word[left])
        weight[left[met]] += self.word_weight[at[met]]
        to[left[met]] = self.word_leads[at[met]]
        failed = left[~met]
        weight[failed] += self.word_fails[now[failed] - self.n_pairs]
        left = np.concatenate((failed, np.flatnonzero(state == self.root)))
        weight[left] += self.base[word[left]]
        to[left] = np.where(self.known[word[left]], self.n_pairs + word[left], self.root)
        return to, weight

    def weights(self, block: _Block) -> np.ndarray:
        """The weight of each token, by one traversal of every stretch from left to right.

        A stretch within a text begins at the root two tokens early: two words lead to the state that all before them lead to.
        """
        sizes = -(-block.size // STRETCH)
        piece = np.repeat(np.arange(len(block.size)), sizes)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = block.start[piece] + nth * STRETCH
        end = np.minimum(start + STRETCH, block.start[piece] + block.size[piece])
        inside = nth > 0
        state = np.where(inside | ~block.first[piece], self.root, self.n_pairs + START)
        at = start - 2 * inside
        order = np.argsort(at - end, kind="stable")  # the longest first
        at, end, state, start = at[order], end[order], state[order], start[order]
        out, length = np.zeros(len(block.tokens)), end - at
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t, side="left"))
            here = at[:n] + t
            state[:n], weight = self.step(state[:n], block.tokens[here])
            fresh = here >= start[:n]
            out[here[fresh]] = weight[fresh]
        return out


def _scores(n_parts: int, salt_count: int, total: int, distinct: int, add: float, mu: float):
    """Scores of the pieces of a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = _Block(row)
        bigram, salts, _, trigram, _ = block.asked(n_parts, salt_count)
        answers = right.sort_by("part")
        more = [np.concatenate([np.zeros(0, np.int64), *(_unpacked(x, np.int64) for x in answers.column(c).to_pylist())]) for c in ("bigrams", "trigrams")]
        pairs, triples = block.own.copy(), block.n.copy()
        whole = salts < 2  # others hold a part of their bigram's trigrams
        pairs[bigram[whole]] += more[0][whole]
        triples[trigram] += more[1]
        automaton = _Automaton(block, pairs.astype(float), triples.astype(float), total, distinct, add, mu)
        weight, base, known = automaton.weights(block), automaton.base[block.tokens], automaton.known[block.tokens]
        add_up = lambda x: np.add.reduceat(np.where(block.scored, x, 0), block.start)
        return pa.table(
            {
                "rid": pa.array(row["rid"], left.schema.field("rid").type.value_type), "rkey": pa.array(row["rkey"], pa.int64()), "first": pa.array(row["first"], pa.bool_()),
                "n_tokens": pa.array(add_up(np.ones(len(weight), np.int64))), "n_known": pa.array(add_up(known.astype(np.int64))),
                "base_score": pa.array(add_up(base)), "score": pa.array(add_up(weight)),
            }
        )

    return run


def score_texts(
    df: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", mu: float = MU, add: float = ADD, salt_count: int = SALT_COUNT
) -> DataFrame:
    """A row for each row of ``df``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train``: true for the rows that the model learns from.
    """
    small_batches(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(f"`{doc_id}`").alias("rid"), text_key(text).alias("rkey"), F.col(f"`{text}`").alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    tables = Tables(df.sparkSession)
    blocks = tables.write(_blocks(rows, kind))
    n_words = blocks.agg(F.coalesce(F.sum(F.col("n_words") + 1), F.lit(0))).first()[0]
    word_parts = max(1, math.ceil(n_words / PART_WORDS))
    asked = blocks.select("block", "words", "n").mapInArrow(_word_requests(word_parts), WORD_REQUEST)
    told = asked.groupBy("part").applyInArrow(_numbered, "block bigint, part int, ids binary, c binary")
    schema = BLOCK.format(f"array<{kind}>").split(", n_words")[0] + ", ids binary, c binary, tally array<bigint>"
    named = tables.write(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_named(word_parts), schema))
    tables.drop(blocks)
    tally = F.col("tally")
    distinct, total, tokens = named.agg(F.coalesce(F.sum(tally[0]), F.lit(0)), F.coalesce(F.sum(tally[1]), F.lit(0)), F.coalesce(F.sum(F.expr("aggregate(size, 0L, (s, x) -> s + x)")), F.lit(0))).first()
    n_parts = max(1, math.ceil(tokens / PART_TOKENS))
    named = named.drop("tally")
    requests = named.mapInArrow(_requests(n_parts, salt_count), REQUEST)
    answers = requests.groupBy("part").applyInArrow(_added_up, "block bigint, part int, bigrams binary, trigrams binary")
    scored = (
        named.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_scores(n_parts, salt_count, total, distinct, add, mu), f"rid {kind}, rkey bigint, first boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    )
    # pieces of one text, and rows that repeat id and text
    times, figures = F.count_if("first"), ("n_tokens", "n_known", "base_score", "score")
    sums = scored.groupBy(F.col("rid").alias("sid"), F.col("rkey").alias("skey")).agg(times.alias("times"), *(F.sum(c).alias(c) for c in figures))
    met = rows.select("rid", "rkey", "train").join(sums, F.col("rid").eqNullSafe(F.col("sid")) & (F.col("rkey") == F.col("skey")))
    of = {c: (F.col(c) / F.col("times")).cast("bigint" if c[0] == "n" else "double").alias(c) for c in figures}
    return met.select(F.col("rid").alias(doc_id), (~F.col("train")).alias("held_out"), of["n_tokens"], of["n_known"], F.lit(total).cast("bigint").alias("train_tokens"), of["base_score"], of["score"])
