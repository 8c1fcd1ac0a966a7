"""Operator 11: documents as prefix, suffix and middle, cut at tokens found by succinct rank and select.

A text's bytes give two packed bitvectors: one has a bit at the last byte of each token (white space
and the word after it, or white space at the end), the other at the first byte of each code point. A
directory holds the bits before every block. The total popcount is the number of tokens n; two ranks
are drawn from the document's id; select gives the bytes where the cuts are, and rank on the other
bitvector turns bytes into code points.

Cases: a null or empty text has no tokens and stays plain; a text that holds one of the marks stays
plain, so that every output can be undone; a null id draws as an empty one; very long texts are cut
whole, in portions of their own; rows that repeat are cut alike; an empty frame gives an empty frame; a column with an output's name is replaced.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import portions, with_arrow_columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SEED = 42
#: Percent of documents that are rearranged, and of those, that have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Bytes of the bitvector of a block of the directory.
BLOCK = 64
#: Bits set in each byte.
BITS = np.array([bin(b).count("1") for b in range(256)], np.uint8)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Bits:
    """A packed bitvector with a directory of the bits before each block."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits)
        self.packed = np.append(packed, np.zeros(-len(packed) % BLOCK + BLOCK, np.uint8))
        self.before = np.append(0, np.cumsum(BITS[self.packed].reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits set before each place."""
        byte = at >> 3
        block = byte // BLOCK
        counts = np.cumsum(BITS[self.packed.reshape(-1, BLOCK)[block]], axis=1, dtype=np.int64)
        within = byte % BLOCK
        row = np.arange(len(at))
        inside = np.where(within > 0, counts[row, within - 1], 0)
        return self.before[block] + inside + BITS[self.packed[byte] & ~(0xFF >> (at & 7)) & 0xFF]

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of each k-th bit that is set, from 1 on."""
        block = np.searchsorted(self.before, k, side="left") - 1
        rest = k - self.before[block]
        counts = np.cumsum(BITS[self.packed.reshape(-1, BLOCK)[block]], axis=1, dtype=np.int64)
        within = (counts < rest[:, None]).sum(axis=1)
        row = np.arange(len(k))
        rest = rest - np.where(within > 0, counts[row, within - 1], 0)
        byte = block * BLOCK + within
        set_ = np.cumsum(np.unpackbits(self.packed[byte][:, None], axis=1), axis=1)
        return byte * 8 + (set_ < rest[:, None]).sum(axis=1)


def boundaries(data: np.ndarray, ends: np.ndarray) -> tuple[Bits, Bits]:
    """Bits at the last bytes of tokens and at the first bytes of code points, of texts laid end to end."""
    blank = SPACE[data]
    last = ~blank
    last[:-1] &= blank[1:]
    last[ends[np.diff(ends, prepend=0) > 0] - 1] = True  # what a text ends with is a token's end
    return Bits(last), Bits((data & 0xC0) != 0x80)


def cuts(texts: list[bytes], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text the tokens n, the bytes before the two cuts, and the code points before and between them."""
    lengths = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    tokens, points = boundaries(np.frombuffer(b"".join(texts), np.uint8), ends)
    base = tokens.rank(starts)
    n = tokens.rank(ends) - base
    a, b = first % (n + 1), second % (n + 1)
    places = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        at = starts.copy()
        some = k > 0
        at[some] = tokens.select(base[some] + k[some]) + 1
        places.append(at)
    ranks = [points.rank(at) for at in (starts, *places)]
    return n, places[0] - starts, places[1] - starts, ranks[1] - ranks[0], ranks[2] - ranks[1]


def draws(doc_id: str, seed: int) -> list[Column]:
    """Four numbers below 2**32 that depend on the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def rearrange(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Adds n, form (plain, psm or spm), prefix_chars, middle_chars and output.

    psm is prefix, suffix, middle, spm suffix, prefix, middle, each after its mark. ``rate`` and
    ``suffix_first`` are percents. The marks must not be able to overlap each other.
    """
    check_marks(marks)
    p, s, m = (x.encode() for x in marks)
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    hashed = [f"__h{k}" for k in range(4)]
    drawn = df.withColumns(dict(zip(hashed, draws(doc_id, seed))))

    def make():
        def compute(column: pa.Array, *numbers: pa.Array) -> list[pa.Array]:
            texts = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
            h = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in numbers]
            rows = []
            for part in portions(texts):
                some = texts[part]
                n, a, b, chars_a, chars_b = (x.tolist() for x in cuts(some, h[0][part], h[1][part]))
                for k, (x, h3, h4) in enumerate(zip(some, h[2][part].tolist(), h[3][part].tolist())):
                    if not x or h3 % 100 >= rate or p in x or s in x or m in x:
                        rows.append((n[k], "plain", None, None, x))
                        continue
                    prefix, middle, suffix = x[: a[k]], x[a[k] : b[k]], x[b[k] :]
                    spm = h4 % 100 < suffix_first
                    out = s + suffix + p + prefix if spm else p + prefix + s + suffix
                    rows.append((n[k], "spm" if spm else "psm", chars_a[k], chars_b[k], out + m + middle))
            made = [pa.array(x, t) for x, t in zip(zip(*rows), arrow)] if rows else [pa.array([], t) for t in arrow]
            return made[:4] + [made[4].cast(pa.string())]

        return compute

    return with_arrow_columns(drawn, [text, *hashed], fields, make).drop(*hashed)


def check_marks(marks: tuple[str, ...]) -> None:
    """Refuses marks that are empty, alike, or could begin inside one another: an output could then not be undone."""
    for x in marks:
        for y in marks:
            if not x or (x is not y and x in y) or any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)))):
                raise ValueError(f"the marks {x!r} and {y!r} can overlap")


def restored(output: str | Column, form: str | Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of: its parts between the marks, put back in order."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(re.escape(x) for x in marks), 4)
    whole = lambda *order: reduce(F.concat, [F.element_at(parts, k) for k in order])
    return F.when(form == "psm", whole(2, 4, 3)).when(form == "spm", whole(3, 4, 2)).otherwise(output)
