"""Operator 13: groups of tokens of two tokenizers that cover the same bytes, and links between them.

The tokens of the second tokenizer (B) are intervals of bytes in a static index, their sorted starts
and ends. Each token of the first (A) asks it by bisection which intervals it overlaps. A gap between
two A tokens that no interval spans is a boundary between groups. All tokens of a group are linked
with each other; over the corpus it is counted how many documents hold a pair of ids linked.

A has a byte-level vocabulary and reads a space and the text; B is a sentencepiece model, which puts
that space there itself. Strings of special tokens inside a text are plain text.

Cases: a null or empty text has no tokens, nor has one whose tokens of either tokenizer don't give
its bytes back, such as one with U+2581; very long texts are aligned whole, and a group of many
tokens by its distinct ids, so that memory follows the distinct pairs and not the links; rows that
repeat are documents of their own; an empty frame gives an empty frame; a column with an output's
name is replaced, and others stay.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, portions, small_batches, with_arrow_columns
from .vocabulary import MOST_BYTES, Vocabulary, read_vocabulary

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Links of a group from which on its ids are counted before they are paired.
MANY_LINKS = 1 << 12
#: Pairs counted at once in a task.
MOST_PAIRS = 1 << 22
#: Pairs of ids whose counts are broadcast (17 bytes each); those in fewer documents are joined.
MOST_KNOWN = 1 << 21
#: Runs of white space that tiktoken's pattern can't hold.
LONG_BLANK = re.compile(r"\s{100000}")

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class First:
    """Tokenizer A: ids of a space and a text, and the bytes of each id."""

    def __init__(self, text: str):
        vocabulary = Vocabulary(text)
        n = max(vocabulary.token_bytes) + 1
        self.bytes = [vocabulary.token_bytes.get(i, b"") for i in range(n)]
        self.text = text
        plain = {raw: i for i, raw in vocabulary.token_bytes.items() if i not in vocabulary.specials.values()}
        in_order = [i for i, _ in sorted(vocabulary.made.items(), key=lambda x: x[1][2])]
        # tiktoken merges by id, which gives the same tokens where ids are in the merges' order
        self.fast = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens={}) if in_order == sorted(in_order) else None

    @cached_property
    def slow(self) -> tokenizers.Tokenizer:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        out = tokenizers.Tokenizer.from_str(self.text)
        out.encode_special_tokens = True
        return out

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it."""
        out = []
        for x in texts:
            if self.fast is None or (len(x) >= 100_000 and LONG_BLANK.search(x)):
                out.append(self.slow.encode(" " + x, add_special_tokens=False).ids)
            else:
                out.append(self.fast.encode_ordinary(" " + x))
        return out


class Second:
    """Tokenizer B: ids of a text, and the bytes of each id."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return self.model.encode(texts, out_type=int, num_threads=1)


def flat(lists: list[list[int]]) -> np.ndarray:
    """Lists of ids as one array."""
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


class Aligner:
    """Aligns the tokens of texts."""

    def __init__(self, first: First, second: Second):
        self.first, self.second = first, second
        self.long_a, self.long_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (first, second))
        self.n_a, self.n_b = len(first.bytes), len(second.bytes)
        marks = [(self.n_a, ","), (self.n_a, "|"), (self.n_b, ","), (self.n_b, ";")]
        self.written = np.array([f"{i}{mark}" for n, mark in marks for i in range(n)], object)

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers for each text; none where either doesn't give the bytes back."""
        whole = [x or "" for x in texts]
        a, b = self.first.ids(whole), self.second.ids(whole)
        bytes_a, bytes_b = self.first.bytes.__getitem__, self.second.bytes.__getitem__
        for k, x in enumerate(whole):
            raw = b" " + x.encode()
            if not x or b"".join(map(bytes_a, a[k])) != raw or b"".join(map(bytes_b, b[k])) != raw:
                a[k], b[k] = [], []
        return a, b

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each group begins among the A and among the B tokens of texts laid end to end, and the ends."""
        end_a, end_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        start_a, start_b = end_a - self.long_a[a], end_b - self.long_b[b]
        lowest = np.searchsorted(end_b, start_a, side="right")  # the first interval that ends after the token's start
        highest = np.searchsorted(start_b, end_a, side="left")  # behind the last that starts before its end
        fresh = np.flatnonzero(lowest[1:] >= highest[:-1]) + 1  # gaps that nothing spans
        heads = np.concatenate([[0], fresh]).astype(np.int64) if len(a) else np.zeros(0, np.int64)
        return np.append(heads, len(a)), np.append(lowest[heads], len(b))

    def pairs(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, A id, B id) as one number each, in order, and how many links each has; ``owner``: each group's text."""
        p, q = np.diff(at_a), np.diff(at_b)
        links, base = p * q, owner.astype(np.uint64) * np.uint64(self.n_a * self.n_b)
        usual = np.flatnonzero(links < MANY_LINKS)
        group = np.repeat(usual, links[usual])
        within = np.arange(len(group)) - np.repeat(np.cumsum(links[usual]) - links[usual], links[usual])
        i, j = at_a[group] + within // q[group], at_b[group] + within % q[group]
        keys = [base[group] + (a[i] * self.n_b + b[j]).astype(np.uint64)]
        weights = None
        large = np.flatnonzero(links >= MANY_LINKS)
        if len(large):
            weights = [np.ones(len(group), np.int64)]
            for g in large.tolist():
                ids_a, times_a = np.unique(a[at_a[g] : at_a[g + 1]], return_counts=True)
                ids_b, times_b = np.unique(b[at_b[g] : at_b[g + 1]], return_counts=True)
                keys.append(base[g] + (ids_a[:, None] * self.n_b + ids_b).ravel().astype(np.uint64))
                weights.append((times_a[:, None] * times_b).ravel())
        every = np.concatenate(keys)
        if weights is None:
            return np.unique(every, return_counts=True)
        order = np.argsort(every)
        every = every[order]
        heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        return every[heads], np.add.reduceat(np.concatenate(weights)[order], heads) if len(every) else np.zeros(0, np.int64)

    def listing(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> list[str]:
        """Ids with the mark that follows each, in the order of the written form: a group's A ids, then its B ids."""
        codes = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a[1:] - 1], last_b[at_b[1:] - 1] = 1, 1
        group_a, group_b = np.repeat(np.arange(len(at_a) - 1), np.diff(at_a)), np.repeat(np.arange(len(at_b) - 1), np.diff(at_b))
        codes[np.arange(len(a)) + at_b[group_a]] = a + last_a * self.n_a
        codes[np.arange(len(b)) + at_a[group_b + 1]] = 2 * self.n_a + b + last_b * self.n_b
        return self.written[codes].tolist()

    def aligned(self, texts: list[str | None]) -> list[tuple]:
        """Of each text: A tokens, B tokens, groups, links, the groups written out, pair ids and pair links, packed."""
        ids_a, ids_b = self.tokens(texts)
        count_a, count_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        a, b = flat(ids_a), flat(ids_b)
        at_a, at_b = self.groups(a, b)
        ends_a, ends_b = np.cumsum(count_a), np.cumsum(count_b)
        owner = np.searchsorted(ends_a, at_a[:-1], side="right")  # a text's end is a boundary, so a group has one text
        n = np.arange(len(texts))
        keys, times = self.pairs(a, b, at_a, at_b, owner)
        space = np.uint64(self.n_a * self.n_b)
        bounds = np.searchsorted(keys, np.append(n, len(texts)).astype(np.uint64) * space).tolist()
        keys = (keys % space).astype(key_type(self.n_a, self.n_b))
        n_groups = np.bincount(owner, minlength=len(texts)).tolist()
        marks = self.listing(a, b, at_a, at_b)
        ends = (ends_a + ends_b).tolist()
        out = []
        for k in range(len(texts)):
            mine = slice(bounds[k], bounds[k + 1])
            links = times[mine]
            written = "".join(marks[ends[k - 1] if k else 0 : ends[k]])[:-1]
            out.append((len(ids_a[k]), len(ids_b[k]), n_groups[k], int(links.sum()), written, keys[mine].tobytes(), packed_links(links)))
        return out


def key_type(n_a: int, n_b: int) -> type:
    """The type of a pair of ids packed as one number."""
    return np.uint32 if n_a * n_b <= 1 << 32 else np.uint64


def packed_links(links: np.ndarray) -> bytes:
    """Numbers of links in two bytes each, or in eight if one is larger."""
    return links.astype("<u2" if not len(links) or links.max() < 1 << 16 else "<u8").tobytes()


def read_links(packed: bytes, n: int) -> np.ndarray:
    """What ``packed_links`` packed for n pairs."""
    return np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u8").astype(np.int64)


def read_model(path: str) -> bytes:
    """A sentencepiece model's content, of a checked size, for a broadcast."""
    with open(path, "rb") as f:
        model = f.read(MOST_BYTES + 1)
    if len(model) > MOST_BYTES:
        raise ValueError(f"{path} is over {MOST_BYTES} bytes")
    return model


def align(df: DataFrame, text: str = "text", first: str | None = None, second: str | None = None) -> DataFrame:
    """Adds n_a, n_b, n_groups, n_links, groups, pair_ids and pair_links for each text.

    groups: a group's A ids, ``|``, its B ids, groups parted by ``;`` and ids by commas. pair_ids: the
    distinct linked pairs in order, each as A id times the number of B ids plus B id, packed as
    ``key_type`` says; pair_links: how many links each pair has, packed too.
    """
    models = df.sparkSession.sparkContext.broadcast((read_vocabulary(first or public_tokenizers.path(FIRST)), read_model(second or public_tokenizers.path(SECOND))))
    kinds = [*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups", T.StringType()), T.StructField("pair_ids", T.BinaryType()), T.StructField("pair_links", T.BinaryType())]
    arrow = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

    def make():
        aligner = Aligner(First(models.value[0]), Second(models.value[1]))

        def compute(column: pa.Array) -> list[pa.Array]:
            texts, rows = column.to_pylist(), []
            for part in portions(texts):
                rows += aligner.aligned(texts[part])
            return [pa.array(x, t) for x, t in zip(zip(*rows), arrow)] if rows else [pa.array([], t) for t in arrow]

        return compute

    return with_arrow_columns(df, [text], kinds, make)


def sizes(first: str | None = None, second: str | None = None) -> tuple[int, int]:
    """How many ids the two tokenizers have."""
    a, b = First(read_vocabulary(first or public_tokenizers.path(FIRST))), Second(read_model(second or public_tokenizers.path(SECOND)))
    return len(a.bytes), len(b.bytes)


def pair_counts(aligned: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """(key, a, b, documents, best): in how many documents ids are linked, and whether that is the A id's highest.

    Pairs are counted by task before they are shuffled. The window of an A id has at most as many
    rows as there are B ids.
    """
    kind = key_type(n_a, n_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

        for batch in batches:
            for packed in batch.column(0).to_pylist():
                held.append(np.frombuffer(packed or b"", kind))
            if sum(map(len, held)) >= MOST_PAIRS:
                yield counted()
        if held:
            yield counted()

    counts = aligned.select("pair_ids").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("documents"))
    both = counts.withColumns({"a": F.expr(f"key div {n_b}").cast("int"), "b": (F.col("key") % n_b).cast("int")})
    highest = F.max("documents").over(Window.partitionBy("a"))
    return both.select("key", "a", "b", "documents", (F.col("documents") == highest).alias("best"))


def split_by_count(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The pairs in most documents, at most ``most`` of them, and the others or None."""
    if counts.count() <= most:
        return counts, None
    powers = {r.power: r.n for r in counts.groupBy(F.floor(F.log2("documents")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    cut, held = max(powers) + 1, 0
    while held + powers.get(cut - 1, 0) <= most:
        cut -= 1
        held += powers.get(cut, 0)
    often = F.col("documents") >= 1 << cut
    return counts.where(often), counts.where(~often)


def count_links(aligned: DataFrame, counts: DataFrame, n_a: int, n_b: int, most: int = MOST_KNOWN) -> DataFrame:
    """Adds n_best, the links whose pair is its A id's best, and count_sum, the sum of the links' counts.

    ``aligned`` and ``counts`` are tables. Counts of pairs in many documents are broadcast, at most
    ``most``; of the others each is in few documents, so that a join by pair has no hot key.
    """
    spark = aligned.sparkSession
    small_batches(spark)
    often, seldom = split_by_count(counts, most)
    local = often.select("key", "documents", "best").toArrow().sort_by("key")  # at most `most` rows
    known = spark.sparkContext.broadcast(tuple(local.column(c).to_numpy() for c in ("key", "documents", "best")))
    kind, left = key_type(n_a, n_b), seldom is not None
    row = F.monotonically_increasing_id().alias("__row")
    fed = aligned.select("*", row) if left else aligned
    fields = [f for f in fed.schema.fields if f.name not in ("pair_ids", "pair_links", "n_best", "count_sum")]
    kept = [f.name for f in fields]
    extra = [T.StructField("__rest", T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("links", T.LongType())])))] if left else []
    schema = T.StructType([*fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, documents, best = known.value
        for batch in batches:
            n_best, total, starts, rest_keys, rest_links = [], [], [0], [], []
            for ids, packed in zip(batch.column("pair_ids").to_pylist(), batch.column("pair_links").to_pylist()):
                mine = np.frombuffer(ids or b"", kind).astype(np.int64)
                links = read_links(packed or b"", len(mine))
                at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
                found = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
                n_best.append(int(links[found][best[at[found]]].sum()))
                total.append(int((links[found] * documents[at[found]]).sum()))
                if left:
                    rest_keys.append(mine[~found])
                    rest_links.append(links[~found])
                    starts.append(starts[-1] + len(rest_keys[-1]))
            out = [batch.column(c) for c in kept] + [pa.array(n_best, pa.int64()), pa.array(total, pa.int64())]
            if left:
                rest = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (rest_keys, rest_links)], names=["key", "links"])
                out.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rest))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    found = fed.mapInArrow(run, schema)
    if not left:
        return found
    found = Tables(spark).write(found)
    missing = found.select("__row", F.inline("__rest")).join(seldom.select("key", "documents", "best"), "key")
    sums = missing.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("links"))).alias("__more_best"), F.sum(F.col("links") * F.col("documents")).alias("__more"))
    both = found.drop("__rest").join(sums, "__row", "left")
    added = {"n_best": F.col("n_best") + F.coalesce("__more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("__more", F.lit(0))}
    return both.withColumns(added).drop("__row", "__more_best", "__more")


def link_statistics(df: DataFrame, text: str = "text", derived: dict | None = None) -> DataFrame:
    """``align`` and ``count_links`` on all texts; ``derived``: columns computed of ``align``'s, which ``groups`` then gives way to.

    Tokens are made once: what the second pass needs is a table in the shared folder, without texts.
    """
    tables, (n_a, n_b) = Tables(df.sparkSession), sizes()
    aligned = align(df, text).drop(text)
    if derived:
        aligned = aligned.withColumns(derived).drop("groups")
    aligned = tables.write(aligned)
    counts = tables.write(pair_counts(aligned, n_a, n_b))
    return count_links(aligned, counts, n_a, n_b)
