"""Operator 8: language identification by error-correcting output codes.

Every language has a codeword of bits: all splits of the languages in two for up to
``EXHAUSTIVE`` languages, else seeded random splits. For each bit a binary classifier over hashed
byte n-grams (naive Bayes log-odds with languages weighted alike) predicts it. Decoding takes the
codeword with the least loss, each bit's logistic loss weighted by how well that bit's classifier
separates its languages in training. A text whose two nearest codewords are about as near is
flagged ambiguous.

The n-gram counts come from at most about ``rows_per_language`` labelled rows a language, chosen by
a hash of id and text: rare languages are used whole. The model has languages x features cells.

Cases: a null text or one without a letter gives ``und`` with score 0, not ambiguous; without any
labelled row all is ``und``; with one language all texts with letters get it, score 1; a null id
hashes as the empty text; very long texts are read whole; repeated rows are drawn together and get the
same answer; an empty frame gives an empty frame; a column with an output's name is replaced.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import portions, small_batches, texts, with_arrow_columns

FEATURES = 1 << 15
#: The bound on the training sample: labelled rows of a language, in expectation.
ROWS_PER_LANGUAGE = 4000
#: Languages a model may have, each with FEATURES counts.
MOST_LANGUAGES = 512
EXHAUSTIVE = 7
#: A text is ambiguous where its score is under this.
AMBIGUOUS = 0.5
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII characters other than letters count as one space.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def codewords(n: int) -> np.ndarray:
    """Bits (-1, 1) of n languages; no column and no column's opposite comes twice."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        rows = [[1] * (2 ** (n - 1) - 1)] + [[0] * (2 ** (n - 1) - 1) for _ in range(n - 1)]
        for column, bits in enumerate(itertools.product((0, 1), repeat=n - 1)):
            if all(bits):
                continue
            for k, bit in enumerate(bits):
                rows[k + 1][column] = bit
        return np.array(rows) * 2.0 - 1
    rng, columns = np.random.default_rng(7), {}
    width = min(15 * int(np.ceil(np.log2(n))), math.comb(n, n // 2) // 2)  # there are no more even splits
    while len(columns) < width:
        column = rng.permutation(np.arange(n) % 2)
        column = column if column[0] else 1 - column
        columns.setdefault(column.tobytes(), column)
    return np.stack(list(columns.values()), axis=1) * 2.0 - 1


def grams(whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 3-grams of texts laid end to end, and where each text's begin.

    Two spaces are put around each text, so that no gram spans two texts' letters.
    """
    raw = [f"  {x.lower()}  ".encode() for x in whole]
    starts = np.cumsum([0] + [len(x) for x in raw])
    b = _FOLD[np.frombuffer(b"".join(raw) + b"  ", np.uint8)]
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int32), starts


class Model:
    """Languages, bit classifiers and bit weights."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """``counts``: features of each language, a row a language in the languages' order."""
        self.languages = languages
        self.codes = codewords(len(languages))
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * FEATURES)
        odds, weight = [], []
        for bit in self.codes.T:
            w = np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0))
            means = share @ w  # what a text of each language scores a gram
            centre = (means[bit > 0].min() + means[bit < 0].max()) / 2
            odds.append(w - centre)
            weight.append(max(1e-3, (means[bit > 0].min() - means[bit < 0].max()) / 2))
        self.odds = np.array(odds, np.float32).reshape(len(odds), FEATURES)
        # bits whose languages lie further apart say more
        self.weight = np.array(weight) / max(sum(weight), 1e-9) * len(weight) if weight else np.ones(0)

    def predict(self, whole: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """The language, score and ambiguity of each text."""
        n, has = len(whole), [bool(x and _LETTER.search(x)) for x in whole]
        if not self.languages:
            return [UNKNOWN] * n, [0.0] * n, [False] * n
        if len(self.languages) == 1:
            return [self.languages[0] if h else UNKNOWN for h in has], [float(h) for h in has], [False] * n
        parts = [self._scored(whole[p], has[p]) for p in portions(whole)]
        return tuple([x for p in parts for x in p[k]] for k in range(3))

    def _scored(self, whole: list[str | None], has: list[bool]) -> tuple[list[str], list[float], list[bool]]:
        n = len(whole)
        index, starts = grams([x or "" for x in whole])
        sums = np.stack([np.add.reduceat(w[index], starts[:-1], dtype=np.float64) for w in self.odds], axis=1)
        length = np.maximum(1, np.diff(starts) - 3)[:, None]
        margin = sums / np.sqrt(length)  # between a mean, which forgets length, and a sum, which trusts it fully
        loss = np.stack([(np.logaddexp(0, -margin * code) * self.weight).sum(axis=1) for code in self.codes], axis=1)
        near = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        near /= near.sum(axis=1, keepdims=True)
        best = near.argmax(axis=1)
        score = near[np.arange(n), best]
        return (
            [self.languages[k] if h else UNKNOWN for k, h in zip(best.tolist(), has)],
            [float(s) if h else 0.0 for s, h in zip(score.tolist(), has)],
            [bool(h and s < AMBIGUOUS) for s, h in zip(score.tolist(), has)],
        )


def fit(
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    where: Column | None = None,
) -> Model:
    """Learns from labelled rows; ``where`` keeps only some of them."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows if where is None else rows.where(where)
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}  # one row a language
    if not sizes:
        return Model([], np.zeros((0, FEATURES)))
    languages = sorted(sizes)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    # the text too, as rows without an id would else be drawn all or none
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text), F.lit(91)), F.lit(1 << 20))
    keep = F.lit(False)
    for x in languages:
        if sizes[x] <= rows_per_language:
            keep = keep | (F.col(lang) == x)
        else:
            keep = keep | ((F.col(lang) == x) & (draw < int((1 << 20) * rows_per_language / sizes[x])))
    number = {x: k for k, x in enumerate(languages)}

    def run(batches):
        counts = np.zeros((len(languages), FEATURES), np.int64)
        for batch in batches:
            whole, names = list(texts(batch.column(0))), [number[x] for x in batch.column(1).to_pylist()]
            for p in portions(whole):
                index, starts = grams(whole[p])
                whose = np.repeat(names[p], np.diff(starts))
                counts += np.bincount(whose * FEATURES + index[: len(whose)], minlength=counts.size).reshape(counts.shape)
        k, f = counts.nonzero()
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(counts[k, f])], names=["k", "f", "n"]
        )

    # one row a language and feature
    sums = rows.where(keep).select(text, lang).mapInArrow(run, "k int, f int, n bigint").groupBy("k", "f").agg(F.sum("n").alias("n"))
    table = sums.toPandas()
    counts = np.zeros((len(languages), FEATURES))
    counts[table["k"].to_numpy(int), table["f"].to_numpy(int)] = table["n"].to_numpy(float)
    return Model(languages, counts)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``ambiguous``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def compute(column):
            language, score, ambiguous = shared.value.predict(column.to_pylist())
            return [pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())]

        return compute

    return with_arrow_columns(
        df,
        [text],
        [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())],
        make,
    )
