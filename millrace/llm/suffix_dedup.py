"""Operator 7: removal of repeated passages by a distributed deep-shallow suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in the same
document or another. Strings are judged on the input, never across documents.

Anchors deal the suffixes out. Every window of LENGTH bytes has one anchor: the place of the least
hash of its ``GRAM``-byte grams, the leftmost of equals. Equal windows have equal anchors at the
same place, so only suffixes with one anchor need to be sorted together. Windows of consecutive
starts with one anchor are a context, sent as hashes, not as text. An anchor met once has no
repeats. Copies of one context are kept once with their number. What is left, the different
contexts of an anchor, is sorted: multikey quicksort, eight bytes at a time, to a shallow depth,
then blind tries for the groups whose common prefix is longer. Equal neighbours at LENGTH bytes
are repeats.

An anchor with over ``LARGE_ANCHOR`` different contexts is dealt out further before it is sorted, so
that no task holds an unbounded group. Of its contexts the least and the greatest, forwards from the
anchor and backwards from it, say which bytes around the anchor all of them share. Windows inside
what is shared are repeats. Every other window reaches beyond it, to the left or to the right, and
if less than LENGTH bytes are shared then by half of what is missing on one side at least. So the
context goes on as one part for either side, dealt by the bytes next to what is shared, with the
windows that reach so far; parts of one anchor that are still too many are dealt again. Each window
is in one part, equal windows are in one group, and a group's rows are contexts, not windows.

Documents are told apart by a 64-bit number: the id, if it is a whole number that all rows have and
no two share, else a number drawn from a table of all ids and texts' hashes.

Cases: null and empty texts have 0 bytes and keep nothing; texts under LENGTH bytes are kept whole;
a row that comes twice repeats itself; documents may have a null id; an empty frame gives an empty
frame; columns with an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, cut, small, text_bytes, text_key

LENGTH, GRAM = 200, 32
SHALLOW = 32
LARGE_ANCHOR = 2000
#: Bytes of texts or contexts that are worked on at once in a Python worker.
CHUNK = 4 << 20
#: Anchors dealt out further up to which they are broadcast to their contexts; beyond it both sides shuffle.
BROADCAST_ROWS = 100_000
#: Bits of a context's place: its start in the text, then its windows and the windows before the anchor.
START_BITS, COUNT_BITS = 40, 12

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(buffer: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place; gram is a multiple of 8."""
    n = len(buffer) - gram + 1
    words = np.ndarray((len(buffer) - 7,), "<u8", np.ascontiguousarray(buffer), 0, (1,))
    h = np.zeros(n, np.uint64)
    for k in range(gram // 8):
        h += (words[8 * k : 8 * k + n] ^ (words[8 * k : 8 * k + n] >> np.uint64(31))) * _K[k % 4]
        h = (h << np.uint64(23)) | (h >> np.uint64(41))
    h ^= h >> np.uint64(32)
    h *= _K[4]
    h ^= h >> np.uint64(29)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def contexts(raw: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Contexts of texts laid end to end: (text, start, number of windows, bytes before the anchor, anchor's hash, context's hash)."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    packed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    anchor = (_least(packed, length - gram + 1) & _PLACE).astype(np.int64)
    n = len(raw) - length + 1
    whose = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + length <= ends[whose]
    fresh = np.ones(n, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (whose[1:] != whose[:-1])
    start = np.flatnonzero(fresh & inside)
    # windows of one anchor and text that don't cross the text's end follow each other without gaps
    run = np.cumsum(fresh)[inside]
    count = np.diff(np.append(np.flatnonzero(np.diff(run, prepend=-1)), len(run)))
    digest = xxhash.xxh64_intdigest
    places = anchor[start]
    own = np.array(
        [digest(raw[s : s + c - 1 + length], a - s) for s, c, a in zip(start.tolist(), count.tolist(), places.tolist())], np.uint64
    )
    begins = np.concatenate(([0], ends))[whose[start]]
    return whose[start], start - begins, count, places - start, h[places], own


def _slices(keys: list, batch: Iterator[bytes], length: int) -> Iterator[tuple[list, list[int], bytes, np.ndarray]]:
    """Texts in portions of about CHUNK bytes; one that is longer goes in overlapping parts."""
    held, shifts, parts, size = [], [], [], 0
    for key, raw in zip(keys, batch):
        if len(raw) < length:
            continue
        for at in range(0, max(1, len(raw) - length + 1), CHUNK):
            part = raw[at : at + CHUNK + length - 1]
            held.append(key)
            shifts.append(at)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield held, shifts, b"".join(parts), np.cumsum([len(p) for p in parts])
                held, shifts, parts, size = [], [], [], 0
    if parts:
        yield held, shifts, b"".join(parts), np.cumsum([len(p) for p in parts])


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    """(g, c, who, at) of every context of every text (who, t); ``at`` holds start, windows and bytes before the anchor."""

    def run(batches):
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for held, shifts, raw, ends in _slices(numbers, text_bytes(batch.column(1)), length):
                which, lo, n, before, g, c = contexts(raw, ends, length)
                at = (lo + np.array(shifts, np.int64)[which]) | n << START_BITS | before << (START_BITS + COUNT_BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(np.array(held, np.int64)[which]), pa.array(at)], names=["g", "c", "who", "at"]
                )

    return docs.mapInArrow(run, "g bigint, c bigint, who bigint, at bigint")


def _unpacked(at: int) -> tuple[int, int, int]:
    """Start, windows and bytes before the anchor."""
    return at & ((1 << START_BITS) - 1), (at >> START_BITS) & ((1 << COUNT_BITS) - 1), at >> (START_BITS + COUNT_BITS)


class BlindTrie:
    """Orders suffixes with a long common prefix: inner nodes hold a depth and one byte a branch.

    A suffix is inserted by walking down by single bytes to some leaf, comparing with that leaf
    once, and branching at the first byte in which the two differ.
    """

    def __init__(self, raw: bytes, length: int):
        self.raw, self.length, self.root = raw, length, None

    def insert(self, at: int) -> None:
        """Adds the suffix that starts at a place."""
        if self.root is None:
            self.root = [self.length, [at]]
            return
        raw, node = self.raw, self.root
        while node[0] < self.length:
            children = node[1]
            node = children.get(raw[at + node[0]]) or next(iter(children.values()))
        other = node[1][0]
        a, b = raw[at : at + self.length], raw[other : other + self.length]
        if a == b:
            node[1].append(at)
            return
        differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
        depth = self.length - (differ.bit_length() + 7) // 8
        parent, node = None, self.root
        while node[0] < depth:
            parent, node = node, node[1][raw[at + node[0]]]
        leaf = [self.length, [at]]
        if node[0] == depth:
            node[1][raw[at + depth]] = leaf
            return
        split = [depth, {raw[other + depth]: node, raw[at + depth]: leaf}]
        if parent is None:
            self.root = split
        else:
            parent[1][raw[at + parent[0]]] = split

    def classes(self) -> Iterator[list[int]]:
        """Classes of suffixes that are equal to the full length, in order."""
        stack = [self.root] if self.root else []
        while stack:
            depth, below = stack.pop()
            if depth == self.length:
                yield below
            else:
                stack += [below[b] for b in sorted(below, reverse=True)]


def sort_suffixes(raw: bytes, starts: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> Iterator[list[int]]:
    """Classes of equal suffixes of ``length`` bytes, of those with two members at least.

    ``starts``: places in ``raw``; only suffixes of one ``group`` are compared. Multikey quicksort
    takes eight bytes at a time up to the shallow depth; then blind tries go on.
    """
    words = np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,))
    order = np.argsort(group, kind="stable")
    starts, group = starts[order], group[order]
    for depth in range(0, min(shallow, length - 7), 8):
        border = np.concatenate(([True], group[1:] != group[:-1]))
        group = np.cumsum(border)
        keep = np.bincount(group)[group] > 1  # a suffix alone has its place
        starts, group = starts[keep], group[keep]
        if not len(starts):
            return
        key = words[starts + depth].astype(np.uint64)
        order = np.lexsort((key, group))
        starts, group, key = starts[order], group[order], key[order]
        border = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        group = np.cumsum(border)
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    places = starts.tolist()
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a == 2:
            x, y = places[a], places[a + 1]
            if raw[x : x + length] == raw[y : y + length]:
                yield [x, y]
        elif b - a > 2:
            trie = BlindTrie(raw, length)
            for x in places[a:b]:
                trie.insert(x)
            yield from (c for c in trie.classes() if len(c) > 1)


#: A context: the bytes before its anchor, backwards, and those from the anchor on; ``lo`` is its start in the text.
CONTEXT = "g bigint, copies bigint, who bigint, lo bigint, before binary, after binary"


def _sorted_marks(length: int):
    """Sorts the contexts of whole groups; returns the runs of repeated windows of contexts met once."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        whole = [r[4][::-1] + r[5] for r in rows]
        raw = b"".join(whole)
        sizes = np.array([len(x) for x in whole])
        at, counts = np.cumsum(sizes) - sizes, sizes - length + 1
        which = np.repeat(np.arange(len(rows)), counts)
        shift = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = at[which] + shift
        _, group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        owner = np.zeros(len(raw) + 1, np.int64)
        owner[starts] = which
        repeated = np.zeros(len(raw) + 1, bool)
        for places in sort_suffixes(raw, starts, group[which], length):
            repeated[places] = True
        out: list[list] = [[], [], []]
        once = np.array([r[1] == 1 for r in rows])
        hit = np.flatnonzero(repeated)
        hit = hit[once[owner[hit]]]
        if len(hit):
            cuts = np.flatnonzero((np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])) + 1
            for run in np.split(hit, cuts):
                r = rows[owner[run[0]]]
                first = r[3] + int(run[0]) - int(at[owner[run[0]]])
                for c, v in zip(out, (r[2], first, first + len(run) - 1 + length)):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["who", "start", "end"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if rows and r[0] != rows[-1][0] and size >= CHUNK // 2:
                    yield work(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4]) + len(r[5])
        if rows:
            yield work(rows)

    return run


def _shared(x: bytes, y: bytes) -> int:
    """How many bytes two strings begin with alike."""
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, x, y): the bytes before and from the anchor that all contexts of a group share, by its least and greatest."""
    for batch in batches:
        g, *ends = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([_shared(a, b) for a, b in zip(ends[k], ends[k + 1])], pa.int32()) for k in (0, 2))], names=["g", "x", "y"]
        )


def _parts(length: int):
    """Contexts with x and y of their group: repeats within what is shared (no bytes), and the parts that reach beyond it."""

    def split(g: int, lo: int, before: bytes, after: bytes, x: int, y: int) -> Iterator[tuple]:
        missing = length - x - y
        if missing <= 0:
            yield None, lo + len(before) - x, lo + len(before) + y
        left = max(1, (missing + 1) // 2)
        right = max(1, missing - left + 1)
        seed = g & (1 << 64) - 1
        # windows that start at least ``left`` bytes before what is shared
        if len(before) >= x + left:
            yield xxhash.xxh64_intdigest(before[x : x + left], seed ^ 1), lo, before, after[: length - x - left]
        # all others: they end at least ``right`` bytes after it
        if len(after) >= y + right:
            kept = before[: length - y - right]
            yield xxhash.xxh64_intdigest(after[y : y + right], seed ^ 2), lo + len(before) - len(kept), kept, after

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for g, copies, who, lo, before, after, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                for key, start, *rest in split(g, lo, before, after, x, y):
                    row = (None, copies, who, start, None, None, rest[0]) if key is None else (key - (key >> 63 << 64), copies, who, start, *rest, None)
                    for c, v in zip(out, row):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["g", "copies", "who", "lo", "before", "after", "end"])

    return run


def _marked(rows: DataFrame, length: int) -> DataFrame:
    """(who, start, end) of the repeated windows of contexts met once, of groups that a task can hold."""
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_sorted_marks(length), "who bigint, start bigint, end bigint")


def _over(rows: DataFrame, large: int) -> DataFrame | None:
    """(g) of the groups of over ``large`` contexts, to be broadcast if few; None if there are none."""
    hot = cut(rows.groupBy("g").count().where(F.col("count") > large).select("g"))
    if hot.isEmpty():
        return None
    return F.broadcast(hot) if small(hot, BROADCAST_ROWS) else hot


def _dealt_marks(tables: Tables, rows: DataFrame, hot: DataFrame, length: int, large: int) -> Iterator[DataFrame]:
    """Marks of anchors with many contexts: their contexts are dealt by further bytes until each group is small."""
    while hot is not None:
        ends = rows.groupBy("g").agg(F.min("before").alias("a"), F.max("before").alias("b"), F.min("after").alias("c"), F.max("after").alias("d"))
        stretches = cut(ends.mapInArrow(_stretches, "g bigint, x int, y int"))
        stretches = F.broadcast(stretches) if small(stretches, BROADCAST_ROWS) else stretches
        met = rows.join(stretches, "g").select("g", "copies", "who", "lo", "before", "after", "x", "y")
        dealt = tables.write(met.mapInArrow(_parts(length), CONTEXT + ", end bigint"))
        yield dealt.where("g is null and copies = 1").select("who", F.col("lo").alias("start"), "end")
        parts = dealt.where("g is not null").drop("end")
        hot = _over(parts, large)
        yield _marked(parts if hot is None else parts.join(hot, "g", "left_anti"), length)
        rows = parts if hot is None else parts.join(hot, "g", "left_semi")


def repeated_passages(docs: DataFrame, length: int = LENGTH, large: int = LARGE_ANCHOR) -> DataFrame:
    """(who, start, end): byte ranges to remove of each text, overlapping. ``docs``: who, a number for each text, and t."""
    if length - GRAM + 1 >= 1 << (COUNT_BITS - 1):
        raise ValueError("passages are too long")
    docs = docs.where(F.octet_length("t") >= length)
    tables = Tables(docs.sparkSession)
    all_seen = tables.write(_occurrences(docs, length))
    # a table: the join then has exchanges of its own, in which a frequent anchor is split
    anchors = tables.write(all_seen.groupBy("g").count().where("count > 1").select("g"))
    seen = tables.write(all_seen.join(anchors, "g"))
    tables.drop(all_seen, anchors)
    kept_once = tables.write(seen.groupBy("g", "c").agg(F.count("*").alias("copies"), F.first("who").alias("who"), F.first("at").alias("at")))
    start = F.col("at").bitwiseAND(F.lit((1 << START_BITS) - 1))
    windows = F.shiftright("at", START_BITS).bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
    copied = seen.join(kept_once.where("copies > 1").select("g", "c"), ["g", "c"], "left_semi").select(
        "who", start.alias("start"), (start + windows - 1 + length).alias("end")
    )
    # different contexts of one anchor: fetch their bytes
    sizes = tables.write(kept_once.groupBy("g").count().where("count > 1"))
    mixed = kept_once.join(sizes, "g").select("g", "copies", "who", "at", "count")

    def fetch(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for who, raw, want in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                for w in want:
                    lo, n, anchor = _unpacked(w["at"])
                    for c, v in zip(out, (w["g"], w["copies"], who, lo, raw[lo : lo + anchor][::-1], raw[lo + anchor : lo + n - 1 + length])):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["g", "copies", "who", "lo", "before", "after"])

    def fetched(chosen: DataFrame) -> DataFrame:
        wanted = chosen.groupBy("who").agg(F.collect_list(F.struct("g", "copies", "at")).alias("want"))  # of one text
        return docs.join(wanted, "who").select("who", "t", "want").mapInArrow(fetch, CONTEXT)

    marks = [copied, _marked(fetched(mixed.where(F.col("count") <= large)), length)]
    largest = sizes.agg(F.max("count")).first()[0] or 0
    if largest > large:
        rows = tables.write(fetched(mixed.where(F.col("count") > large)))
        marks += _dealt_marks(tables, rows, rows, length, large)
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    out = Tables(docs.sparkSession).write(out)
    tables.drop(*[frame for _, frame in tables.paths.values()])
    return out


def _numbered(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The frame with ``__who``, a number for each pair of id and text."""
    own = F.col(f"`{doc_id}`")
    if isinstance(df.schema[doc_id].dataType, T.IntegralType):
        rows, named, distinct = df.agg(F.count("*"), F.count(own), F.count_distinct(own)).first()
        if rows == named == distinct:
            return df.withColumn("__who", own.cast("bigint"))
    keyed = df.withColumns({"__rid": own.cast("string"), "__rkey": text_key(text)})
    names = Tables(df.sparkSession).write(keyed.select(F.col("__rid").alias("__id"), F.col("__rkey").alias("__key")).distinct().withColumn("__who", F.monotonically_increasing_id()))
    return keyed.join(names, F.col("__rid").eqNullSafe(F.col("__id")) & (F.col("__rkey") == F.col("__key"))).drop("__rid", "__rkey", "__id", "__key")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, large: int = LARGE_ANCHOR) -> DataFrame:
    """Adds ``kept`` (bytes that remain), ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs)."""
    outputs = ["kept", "n_bytes", "n_removed", "n_spans"]
    df = df.drop(*outputs)
    numbered = _numbered(df, doc_id, text)
    marks = repeated_passages(numbered.select(F.col("__who").alias("who"), F.col(f"`{text}`").alias("t")), length, large)
    spans = marks.groupBy(F.col("who").alias("__who")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))  # of one text
    joined = numbered.join(spans, "__who", "left").drop("__who")
    kept_columns = df.columns
    schema = T.StructType(
        [df.schema[c] for c in kept_columns]
        + [T.StructField("kept", T.BinaryType())]
        + [T.StructField(c, T.LongType()) for c in outputs[1:]]
    )

    def run(batches):
        for batch in batches:
            kept, figures = [], [[], [], []]
            for raw, spans in zip(text_bytes(batch.column(batch.schema.get_field_index(text))), batch.column(batch.schema.get_field_index("__spans")).to_pylist()):
                parts, at, removed, runs = [], 0, 0, 0
                for s in sorted(spans or [], key=lambda s: s["start"]):
                    if s["start"] > at or not runs:
                        parts.append(raw[at : s["start"]])
                        runs += 1
                        removed += s["end"] - s["start"]
                        at = s["end"]
                    elif s["end"] > at:
                        removed += s["end"] - at
                        at = s["end"]
                parts.append(raw[at:])
                kept.append(b"".join(parts))
                for f, v in zip(figures, (len(raw), removed, runs)):
                    f.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept_columns] + [pa.array(kept, pa.binary())] + [pa.array(f, pa.int64()) for f in figures],
                names=schema.names,
            )

    return joined.mapInArrow(run, schema)
