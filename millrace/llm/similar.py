"""Near-duplicates by exact Jaccard similarity of the distinct word shingles of two texts.

Candidates are texts that agree in one of ``BANDS`` bands of ``ROWS`` min-hashes each: at similarity
s a pair is missed with probability (1 - s ** ROWS) ** BANDS, 0.00003 at 0.8. A candidate becomes a
link only where its distinct shingles, compared whole, are similar enough; none below it is linked.

Where close fingerprints are given, their texts are candidates before all others: copies with few
changes then are joined already.

Texts with one set of shingles are one node. A band's bucket of up to ``SMALL_BUCKET`` nodes gives all
its pairs. In larger ones each node first meets a single pivot, that of its largest bucket, then for a
few rounds one of another bucket, so that a large group of copies is joined by a few pairs a node.
What isn't joined then is compared whole: buckets that hold nodes of different classes are dealt into
tiles of about ``TILE`` nodes and ``TILE_SHINGLES`` shingles a side, with their texts. Each pair of a bucket
is in one tile, and a tile gives only links that join what it knows to be apart, never its pairs.

Cases: a null, empty or wordless text has no shingles, and all such texts are one node; a text
shorter than a shingle is one shingle; very long texts are compared whole, their hashes held by one
task; repeated rows and texts are one node; a component without any non-null id has a null id; an
empty frame gives an empty frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, cut, small as small_enough, small_batches, text_bytes, text_key, with_arrow_columns
from .components import components

BANDS, ROWS = 20, 4
SMALL_BUCKET = 8
#: Rounds in which a node of large buckets meets one pivot only.
TURNS = 2
#: Nodes and shingles of a side of a tile, about, and cells of a matrix of nodes by shingles.
TILE, TILE_SHINGLES, CELLS = 1024, 1 << 20, 1 << 22
#: Nodes up to which they are broadcast to the texts.
BROADCAST_ROWS = 200_000
#: Pairs of one node that a task verifies; more are dealt out.
PAIRS_A_TASK = 512
#: Shingles whose min-hashes are taken at a time.
SLICE = 1 << 12
_ODD = np.random.default_rng(42).integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.uint32(0x85EBCA6B)


def shingles(raw: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text's UTF-8 bytes; a shorter text is one shingle."""
    words = raw.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    buffer = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(buffer, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(buffer[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of a set's min-hashes; a set without shingles has none."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), SLICE):
        x = short[None, k : k + SLICE] * _ODD
        x ^= x >> np.uint32(16)
        x *= _MIX
        np.minimum(least, x.min(axis=1), out=least)
    raw = least.tobytes()
    step = 4 * ROWS
    keys = [xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def majority(found: np.ndarray) -> int:
    """The 64-bit fingerprint of a set of hashes: the bits that more than half of them have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(found), SLICE):
        ones += np.unpackbits(found[k : k + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found)).view(">u8")[0])


def _with_sets(df: DataFrame, width: int) -> DataFrame:
    """Adds node (hash of the set of shingles), n (its size), keys (of its bands) and fp (its fingerprint)."""

    def make():
        def compute(column):
            nodes, sizes, keys, fps = [], [], [], []
            for raw in text_bytes(column):
                found = shingles(raw, width)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), 42))
                sizes.append(len(found))
                keys.append(bands(found))
                fps.append(majority(found))
            nodes, fps = (pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (nodes, fps))
            return [nodes, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), fps]

        return compute

    fields = [T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())]
    return with_arrow_columns(df, ["text"], fields, make)


def _small_pairs(small: int, ratio: Fraction):
    """All pairs (a, b) of buckets of at most ``small`` rows (key, node, n), sorted by key and node, whose sizes allow the similarity."""
    p, q = ratio.numerator, ratio.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.zeros(0, np.int64)] * 3  # the last rows so far, whose bucket may go on
        for batch in batches:
            k, node, n = (np.concatenate((t, c.to_numpy(zero_copy_only=False))) for t, c in zip(tail, batch.columns))
            done = len(tail[0])
            left, right = [], []
            for shift in range(1, small):
                x, y = np.arange(max(0, done - shift), max(0, len(k) - shift)), None
                y = x + shift
                x, y = x[y >= done], y[y >= done]
                hit = (k[x] == k[y]) & (np.minimum(n[x], n[y]) * q >= np.maximum(n[x], n[y]) * p)
                left.append(node[x[hit]])
                right.append(node[y[hit]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in (left, right)], names=["a", "b"])
            tail = [c[-(small - 1) :] if small > 1 else c[:0] for c in (k, node, n)]

    return run


def _root(of: dict[int, int], x: int) -> int:
    while of.get(x, x) != x:
        of[x] = x = of.get(of[x], of[x])
    return x


def _tile_links(width: int, ratio: Fraction):
    """Links (a, b) of a tile's rows (key, low, high, side, node, class, text): of sides 0 and 1, or within one side if there is one only."""
    p, q = ratio.numerator, ratio.denominator

    def run(tile: pa.Table) -> pa.Table:
        side, node, of_class = (tile.column(c).to_numpy() for c in ("side", "node", "class"))
        sets = [shingles(raw, width) for raw in text_bytes(tile.column("text").combine_chunks())]
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        # shingles of two texts at least, as columns
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = times[column] > 1
        owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
        n_columns = int(column.max(initial=-1)) + 1
        shared = np.zeros((len(sets), len(sets)), np.float32)  # about twice TILE rows
        step = max(1, CELLS // len(sets))
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for a in range(0, n_columns, step):
            lo, hi = np.searchsorted(column, [a, a + step])
            cells = np.zeros((len(sets), min(step, n_columns - a)), np.float32)
            cells[owner[lo:hi], column[lo:hi] - a] = 1
            shared += cells @ cells.T
        one = tile.column("low")[0].as_py() == tile.column("high")[0].as_py()
        # shared / (all) >= p / q
        near = shared * (p + q) >= p * (sizes[:, None] + sizes[None, :])
        near &= np.triu(np.ones(near.shape, bool), 1) if one else (side[:, None] == 0) & (side[None, :] == 1)
        near &= of_class[:, None] != of_class[None, :]
        left, right, known = [], [], {}
        for x, y in zip(*np.nonzero(near)):
            i, j = _root(known, int(of_class[x])), _root(known, int(of_class[y]))
            if i != j:
                known[max(i, j)] = min(i, j)
                left.append(int(node[x]))
                right.append(int(node[y]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _verify(width: int, ratio: Fraction):
    """Pairs whose sets are similar, of rows (a, chunk, b, text): of each a the row with its own text comes first, then those of every b."""
    p, q = ratio.numerator, ratio.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), text_bytes(batch.column(3))):
                found = shingles(raw, width)
                if b is None:
                    own = found
                # shared / (all) >= p / q
                elif len(np.intersect1d(own, found, assume_unique=True)) * (p + q) >= p * (len(own) + len(found)):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _one_pivot(buckets: DataFrame, ratio: Fraction, turn: int) -> DataFrame:
    """A pair (pivot, node) for each node of large buckets (key, node, n, class, most) that isn't joined with the pivot yet.

    The pivot is the least node of the node's largest bucket; in later turns it is one by hash, of a bucket by hash.
    """
    least = (F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))).alias("o")
    pivots = buckets.groupBy("key").agg(F.min(F.struct(least, "node", "n", "class")).alias("p"))
    met = buckets.join(pivots, "key", "left")
    p, q = ratio.numerator, ratio.denominator
    fits = (F.col("p.node") != F.col("node")) & (F.col("p.class") != F.col("class")) & (F.least("n", "p.n") * q >= F.greatest("n", "p.n") * p)
    best = F.struct(F.col("most") if turn == 0 else F.lit(0), F.xxhash64("key", F.lit(turn)))
    return met.where(fits).groupBy("node").agg(F.max_by("p.node", best).alias("a")).select("a", F.col("node").alias("b"))


def similar_groups(
    df: DataFrame, doc_id: str, text: str, width: int, similarity: float, small: int = SMALL_BUCKET, near: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(doc_id, rkey, class, component_id): one row a row of ``df``; rkey is the hash of the text.

    ``near``: links (a0, b0) between fingerprints (fp) that are close, the first candidates.
    """
    small_batches(df.sparkSession)
    ratio, tables = Fraction(str(similarity)), Tables(df.sparkSession)
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), text_key(text).alias("rkey"))
    docs = cut(_with_sets(rows, width).drop("text"))
    nodes = cut(docs.dropDuplicates(["node"]).select("node", "n", "keys", "rkey", "fp"))
    buckets = nodes.select(F.explode("keys").alias("key"), "node", "n")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("most")).where("most > 1")
    buckets = tables.write(buckets.join(sizes, "key"))
    classes, links = None, None

    def classed(of: DataFrame) -> DataFrame:
        if classes is None:
            return of.withColumn("class", F.col("node"))
        return of.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")

    def texts_of(some: DataFrame) -> DataFrame:
        """(node, text) of nodes; few nodes go to the texts, so that these aren't shuffled."""
        wanted = cut(some.join(nodes.select("node", "rkey"), "node"))
        wanted = F.broadcast(wanted) if small_enough(wanted, BROADCAST_ROWS) else wanted
        return tables.write(rows.select("rkey", "text").join(wanted, "rkey").select("node", "text").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        of = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("chunks"))
        held = texts_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
        own = held.join(of, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("bigint").alias("b"), "text")
        others = pairs.join(of, "a").join(held, F.col("b") == F.col("node")).select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b", "text")
        found = own.unionByName(others).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "b").mapInArrow(_verify(width, ratio), "a bigint, b bigint")
        found = cut(found)
        tables.drop(held)
        return found

    if near:
        # sets with one fingerprint meet the least of them, and those of close fingerprints each other
        lead = cut(nodes.groupBy("fp").agg(F.min("node").alias("lead")))
        same = nodes.join(lead, "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
        sides = [lead.select(F.col("fp").alias(f"{x}0"), F.col("lead").alias(x)) for x in "ab"]
        links = verified(cut(same.unionByName(near(lead.select("fp")).join(sides[0], "a0").join(sides[1], "b0").select("a", "b")).distinct()))
        classes = components(links).select("node", "component")
    large = F.col("most") > small
    for turn in range(TURNS):
        pairs = _one_pivot(classed(buckets.where(large)), ratio, turn)
        if turn == 0:
            few = buckets.where(~large).select("key", "node", "n").repartition("key").sortWithinPartitions("key", "node")
            pairs = pairs.unionByName(few.mapInArrow(_small_pairs(small, ratio), "a bigint, b bigint")).distinct()
        found = verified(cut(pairs))
        links = found if links is None else links.unionByName(found)
        classes = components(links).select("node", "component")
    # large buckets that hold pairs neither joined nor compared
    open_ = cut(classed(buckets.where(large)).groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("most").alias("most"), F.sum("n").alias("held")).where("low <> high").select("key", "most", "held"))
    if not open_.isEmpty():
        rest = classed(buckets.drop("most", "n").join(open_, "key")).withColumn("tiles", F.greatest(F.ceil(F.col("most") / TILE), F.ceil(F.col("held") / TILE_SHINGLES)).cast("int"))
        dealt = rest.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "class")
        held = texts_of(rest.select("node").distinct())
        found = cut(dealt.join(held, "node").groupBy("key", "low", "high").applyInArrow(_tile_links(width, ratio), "a bigint, b bigint"))
        tables.drop(held)
        classes = components(links.unionByName(found)).select("node", "component")
    tables.drop(buckets)
    classed_nodes = nodes.select(F.col("node").alias("member")).join(classes, F.col("member") == F.col("node"), "left").select("member", F.coalesce("component", "member").alias("class"))
    named = docs.select("doc_id", "rkey", F.col("node").alias("member")).join(classed_nodes, "member").drop("member")
    least = named.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return cut(named.join(least, "class").select("doc_id", "rkey", "class", "component_id"))
