"""Operator 4: SimHash near-duplicates by the generalised pigeonhole principle.

Each text's fingerprint is 64 bits by majority over the hashes of its word shingles. Distinct
fingerprints within ``DISTANCE`` bits are linked as follows. The bits are put into partitions,
correlated bits together, and each partition i gets a threshold t_i (-1: left out). Where the sum of
t_i + 1 exceeds DISTANCE, any two fingerprints within DISTANCE agree up to t_i bits in some
partition i. The number of partitions and the thresholds are those with the least estimated work: a
dynamic program over the partitions on the number of probes and the number of candidates,
estimated from how often values of a partition meet in all the data.

Probing: a fingerprint goes to the bucket of every partition value within t_i / 2 bits of its own,
so that two within t_i meet half way. Buckets are sorted runs of rows. Within one, pairs are
verified by their full distance, and only links that join parts of the bucket not joined yet are
emitted, never all pairs of a group. A bucket over ``LARGE_BUCKET`` is dealt out again by all bits
(exact agreement in one of DISTANCE + 1 parts, again by the pigeonhole).

``keep_one`` asks for a similarity of word shingles instead of a distance. Close fingerprints of the
sets of shingles, found by the same probes, are its first candidates; they are too coarse to be the
only ones, or to decide, so there are others, and the sets themselves are compared (``similar``).

Cases: null, empty and wordless texts have fingerprint zero, linked like any other; shorter texts
than a shingle hash whole; repeated rows are in the same component; a component without any
non-null id has a null id; an empty frame gives an empty frame; columns with an output's name are
replaced.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small, text_bytes, text_key, with_arrow_columns
from .components import components
from .similar import BROADCAST_ROWS, similar_groups

BITS, DISTANCE, SHINGLE = 64, 4, 4
PARTITIONS = (1, 2, 3, 4, 5)
#: Buckets over this many fingerprints are dealt out again by their other bits.
LARGE_BUCKET = 5000
#: Up to this many, a bucket's pairs are compared by shifts of the whole batch.
TINY_BUCKET = 8
#: Partition thresholds are twice the bits that either side flips.
MOST_FLIPS = 2
#: Similarity of texts that count as copies of each other, and the words of their shingles.
SIMILARITY, SIMILARITY_SHINGLE = 0.8, 5
#: Cost of a probe and of a comparison, in units of the latter (measured: about 2 us and 20 ns).
PROBE_COST = 100.0


def fingerprint(raw: bytes, shingle: int = SHINGLE, wide: bool = False) -> tuple[int, ...]:
    """The 64-bit fingerprint of a text's UTF-8 bytes; ``wide``: two of them, by a 128-bit hash."""
    words = raw.lower().split()  # of bytes: A-Z only, and ASCII white space only
    width = 1 + wide
    if not words:
        return (0,) * width
    buffer = b" ".join(words)
    digest = xxhash.xxh128_digest if wide else xxhash.xxh64_digest  # big-endian
    if len(words) <= shingle:
        return tuple(np.frombuffer(digest(buffer, 42), ">u8").tolist())
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    n, ones = len(starts), np.zeros(BITS * width, np.int64)
    for k in range(0, n, 1 << 14):
        part = b"".join([digest(buffer[a:b], 42) for a, b in zip(starts[k : k + (1 << 14)], ends[k : k + (1 << 14)])])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8 * width), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return tuple(np.packbits(ones * 2 > n).view(">u8").tolist())


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE, wide: bool = False) -> DataFrame:
    """Adds the fingerprint of each text as a signed 64-bit integer; ``wide``: a second as ``fp2``."""
    names = [out, f"{out}2"][: 1 + wide]

    def make():
        def compute(column):
            found = np.array([fingerprint(x, shingle, wide) for x in text_bytes(column)], np.uint64).reshape(-1, len(names))
            return [pa.array(np.ascontiguousarray(found[:, k]).view(np.int64), pa.int64()) for k in range(len(names))]

        return compute

    return with_arrow_columns(df, [text], [T.StructField(c, T.LongType()) for c in names], make)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each pair of bits is set."""

    def run(batches):
        sums, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            words = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(words, axis=1, bitorder="little").astype(np.float32)
            sums += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        cell = np.append(np.arange(BITS * BITS), -1)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(sums.ravel(), n))], names=["cell", "n"])

    # 64 x 64 + 1 rows
    table = fps.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas().set_index("cell")["n"]
    return int(table.get(-1, 0)), table.reindex(range(BITS * BITS), fill_value=0).to_numpy(float).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits, as even as can be: each begins with the least used bit and takes those most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = math.ceil(len(free) / (m - k))
        group = [max(free, key=lambda i: (sum(correlation[i][j] for j in free), -i))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda i: (sum(correlation[i][j] for j in group), -i))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]] | None:
    """Flips of least cost that find all within a distance; costs[i][e + 1] is that of e flips in partition i.

    e flips on either side make a threshold of 2 e; -1 leaves a partition out. Dynamic program over
    partitions and the sum of thresholds plus one so far, which must exceed the distance.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        fresh: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for e, extra in enumerate(row, -1):
                key = min(distance + 1, used + max(0, 2 * e + 1))
                if key not in fresh or cost + extra < fresh[key][0]:
                    fresh[key] = (cost + extra, [*chosen, e])
        best = fresh
    return best.get(distance + 1)


def _meetings(bits: int, apart: int, flips: int) -> int:
    """In how many buckets two values meet that differ in ``apart`` bits, each put wherever ``flips`` bits lead."""
    return sum(
        math.comb(apart, a) * math.comb(bits - apart, c)
        for a in range(apart + 1) for c in range(flips + 1) if a + c <= flips and apart - a + c <= flips
    )


def _take(fp: str, bits: list[int]) -> str:
    """SQL for the given bits of a fingerprint, the others cleared."""
    mask = sum(1 << b for b in bits)
    return f"({fp} & {mask - (1 << 64) if mask >> 63 else mask}L)"


def plan_probes(fps: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, flips) of every partition that is probed, of the plan with the least estimated work."""
    n, both = bit_counts(fps)
    p = np.diag(both) / max(n, 1)
    agree = np.maximum(p * p + (1 - p) ** 2, 0.5)
    groups = {m: group_bits(n, both, m) for m in PARTITIONS if m <= distance + 1 <= m * (2 * MOST_FLIPS + 1) and (m > 1 or distance < 2)}
    values = [F.struct(F.lit(10 * m + k).alias("g"), F.expr(_take("fp", g)).alias("v")) for m in groups for k, g in enumerate(groups[m])]
    met = (
        fps.select(F.explode(F.array(*values)).alias("x")).groupBy("x").count()
        .groupBy("x.g").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"))
    )
    pairs = {r[0]: r[1] for r in met.collect()}  # a row a partition
    best: tuple[float, list] | None = None
    for m, parts in groups.items():
        costs = []
        for k, bits in enumerate(parts):
            odds = (1 - agree[bits]) / agree[bits]
            # how many pairs differ in j bits of the partition, to those that differ in none
            ways = np.ones(1)
            for x in odds:
                ways = np.convolve(ways, [1.0, x])
            row = [0.0]
            for e in range(MOST_FLIPS + 1):
                probes = sum(math.comb(len(bits), t) for t in range(e + 1))
                reached = sum((pairs.get(10 * m + k, 0.0) + 1) * ways[j] * _meetings(len(bits), j, e) for j in range(2 * e + 1))
                row.append(n * probes * PROBE_COST + reached)
            costs.append(row)
        found = allocate(costs, distance)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], [(bits, e) for bits, e in zip(parts, found[1]) if e >= 0])
    if best is None:
        raise ValueError(f"no plan finds all within {distance} bits")
    return best[1]


def _keys(part: int, bits: list[int], flips: int) -> list:
    """Hashes of the values within so many flips of a fingerprint's own in one partition."""
    own, out = _take("fp", bits), []
    for t in range(flips + 1):
        for flipped in itertools.combinations(bits, t):
            mask = sum(1 << b for b in flipped)
            out.append(F.xxhash64(F.lit(part), F.expr(f"{own} ^ {mask - (1 << 64) if mask >> 63 else mask}L")))
    return out


def _near(a: np.ndarray, b: np.ndarray, distance: int, whole: int | None) -> np.ndarray:
    """Whether rows of fingerprints are within the distance in the first 64 bits, and ``whole`` in all."""
    differ = np.bitwise_count(a ^ b)
    near = differ[..., 0] <= distance
    return near if whole is None else near & (differ.sum(axis=-1) <= whole)


def _forest(fps: np.ndarray, distance: int, whole: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within a distance in one bucket: at most one a fingerprint."""
    rest, left, right = fps, [fps[:0]], [fps[:0]]
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            for x in queue.pop():
                near = _near(rest, x, distance, whole)
                if near.any():
                    found, rest = rest[near], rest[~near]
                    left.append(np.repeat(x[None], len(found), axis=0))
                    right.append(found)
                    queue.append(found)
                    if not len(rest):
                        break
    return np.concatenate(left), np.concatenate(right)


def _link_runs(distance: int, whole: int | None):
    """Verifies runs of rows of one key; keys come sorted, and a run may go over batches."""

    def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        border = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        sizes = np.diff(border)
        left, right = [fp[:0]], [fp[:0]]
        tiny = np.repeat(sizes <= TINY_BUCKET, sizes)
        k, f = key[tiny], fp[tiny]
        for shift in range(1, TINY_BUCKET):
            if len(k) <= shift:
                break
            hit = (k[shift:] == k[:-shift]) & _near(f[shift:], f[:-shift], distance, whole)
            left.append(f[:-shift][hit])
            right.append(f[shift:][hit])
        for g in np.flatnonzero(sizes > TINY_BUCKET):
            a, b = _forest(fp[border[g] : border[g + 1]], distance, whole)
            left.append(a)
            right.append(b)
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = [], []

        def out(k, f):
            a, b = links(np.concatenate(k), np.concatenate(f))
            columns = [np.ascontiguousarray(x[:, c]).view(np.int64) for x in (a, b) for c in range(x.shape[1])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f"{x}{c}" for x in "ab" for c in range(a.shape[1])])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = np.stack([np.ascontiguousarray(c.to_numpy(zero_copy_only=False)).view(np.uint64) for c in batch.columns[1:]], axis=1)
            start = int(np.searchsorted(k, k[-1]))
            if start or (held_k and held_k[-1][-1] != k[-1]):
                yield out([*held_k, k[:start]], [*held_f, f[:start]])
                held_k, held_f = [], []
            held_k.append(k[start:])
            held_f.append(f[start:])
        if held_k:
            yield out(held_k, held_f)

    return run


def near_links(fps: DataFrame, distance: int = DISTANCE, whole: int | None = None, large: int = LARGE_BUCKET) -> DataFrame:
    """Links (a0, b0) between distinct fingerprints: enough to join all that are within the distance.

    ``fps``: fp, and with ``whole`` fp2, of which both together may differ in ``whole`` bits; the
    links then are (a0, a1, b0, b1).
    """
    columns = ["fp", "fp2"][: 1 if whole is None else 2]
    probes = plan_probes(fps.select("fp"), distance)
    keys = [k for part, (bits, e) in enumerate(probes) for k in _keys(part, bits, e)]
    rows = fps.select(F.explode(F.array(*keys)).alias("key"), *columns)
    # buckets that would be large for one task; few, as each has over `large` rows
    hot = rows.groupBy("key").count().where(F.col("count") > large).select("key")
    hot = cut(hot)
    if not hot.isEmpty():
        spread = np.array_split(np.arange(BITS), distance + 1)
        # all 64 bits in distance + 1 parts: two near fingerprints agree in a part, in any bucket
        again = F.array(*[F.xxhash64("key", F.lit(p), F.expr(_take("fp", list(map(int, bits))))) for p, bits in enumerate(spread)])
        rows = rows.join(hot, "key", "left_anti").unionByName(
            rows.join(hot, "key", "left_semi").select(F.explode(again).alias("key"), *columns)
        )
    schema = ", ".join(f"{x}{c} bigint" for x in "ab" for c in range(len(columns)))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_link_runs(distance, whole), schema).distinct()


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, whole: int | None = None
) -> DataFrame:
    """(doc_id, rkey, fp, class, component_id): one row a row of ``df``; rkey is the hash of the text.

    ``whole``: bits of 128 within which fingerprints of twice the length must be.
    """
    columns = ["fp", "fp2"][: 1 if whole is None else 2]
    node = lambda names: F.col(names[0]) if whole is None else F.xxhash64(*names)
    docs = cut(
        with_fingerprints(
            df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), text_key(text).alias("rkey")), "text", "fp", shingle, whole is not None
        ).drop("text").withColumn("node", node(columns))
    )
    fps = cut(docs.groupBy("node", *columns).agg(F.min("doc_id").alias("least")))
    links = near_links(fps.select(*columns), distance, whole)
    sides = [[f"{x}{c}" for c in range(len(columns))] for x in "ab"]
    found = components(links.select(*(node(x).alias(y) for x, y in zip(sides, "ab")))).withColumnRenamed("node", "member")
    classed = fps.join(found, fps["node"] == found["member"], "left").select("node", "least", F.coalesce("component", "node").alias("class"))
    least = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classed.join(least, "class").select("node", "class", "component_id")
    return docs.join(named, "node").select("doc_id", "rkey", "fp", "class", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SIMILARITY_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the smallest id stays.

    Rows that repeat id and text count as copies. A component without ids keeps the text whose hash
    is smallest. Texts without words are all copies of each other.
    """
    found = similar_groups(df, doc_id, text, shingle, similarity, near=near_links)
    stays = cut(
        found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.min("rkey").alias("rkey"))
        .unionByName(found.where("component_id is null").groupBy("class").agg(F.min("rkey").alias("rkey")).select(F.lit(None).cast(df.schema[doc_id].dataType).alias("doc_id"), "rkey"))
        .select(F.col("doc_id").alias("__id"), F.col("rkey").alias("__key"))
    )
    # what goes is less than what stays; few rows are sent to the texts, so that these aren't shuffled
    names = found.select(F.col("doc_id").alias("__id"), F.col("rkey").alias("__key")).distinct()
    same = names["__id"].eqNullSafe(stays["__id"]) & (names["__key"] == stays["__key"])
    gone = cut(names.join(stays, same, "left_anti"))
    gone = F.broadcast(gone) if small(gone, BROADCAST_ROWS) else gone
    kept = df.withColumn("__text", text_key(text)).join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left_anti")
    repeats = found.groupBy("doc_id", "rkey").count().where("count > 1").limit(1).count()
    kept = kept.dropDuplicates([doc_id, "__text"]) if repeats else kept
    return kept.drop("__text")
