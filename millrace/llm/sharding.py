"""Operator 2: a uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to source blocks by a hash of the row. How many rows of each block go to each shard
is drawn at once, as a matrix with the block sizes as row sums and the shard sizes as column sums
(multivariate hypergeometric), which is the law a uniform permutation gives. Each block is permuted
locally and cut by its row of the matrix; after the exchange each shard is permuted again.

Law ``rows``: shard counts differ by at most one. All draws come from the seed and from hashes of
the rows, so a task that runs again after an executor is lost deals its rows the same way.

Blocks and the bins in which a shard is permuted hold about ``ROWS_PER_BLOCK`` rows each, so no
window is as large as a shard. The matrix has at most ``MOST_BLOCKS`` x shards cells.

Cases: an empty frame gives an empty frame; rows that are alike in every column are counted first
and numbered, so that each copy is dealt by itself, and it doesn't matter which is which; nulls are
hashed as nulls; very long texts are hashed whole; columns named like an output are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BLOCK = 100_000
MOST_BLOCKS = 16_384
#: Beyond this population numpy does not draw; inversion takes over.
NUMPY_POPULATION = 10**9


def _stirling_error(n: int) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without the loss of digits where x is near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return (x * math.log(x / mean) if x else 0.0) + mean - x
    v = (x - mean) / (x + mean)
    out, term, k = (x - mean) * v, 2 * x * v**3, 3
    while abs(term / k) > 1e-17 * abs(out):
        out, term, k = out + term / k, term * v**2, k + 2
    return out


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """Log-probability of x successes of n, to full precision (saddle-point expansion)."""
    if x == 0 or x == n:
        return n * (math.log1p(-q if x else -p))
    c = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return c + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One hypergeometric number for any population: inversion from the mode outwards."""
    if good + bad < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    share, rest = draws / (good + bad), (good + bad - draws) / (good + bad)
    p = math.exp(_log_binomial(mode, good, share, rest) + _log_binomial(draws - mode, bad, share, rest) - _log_binomial(draws, good + bad, share, rest))
    left = rng.random() - p
    down, up, p_down, p_up = mode, mode, p, p
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Draws how many rows each block sends to each shard."""
    if sum(blocks) != sum(shards):
        raise ValueError("blocks and shards hold different numbers of rows")
    rng, left, out = np.random.default_rng(seed), list(shards), []
    for size in blocks:
        row, rest, need = [], sum(left), size
        for k, room in enumerate(left):
            rest -= room
            got = need if k == len(left) - 1 else hypergeometric(rng, room, rest, need)
            row.append(got)
            need -= got
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def _uniform(columns: list[Column], seed: int) -> Column:
    """A 64-bit number from the row and the seed, hashed twice so that its parts do not show."""
    return F.xxhash64(F.xxhash64(F.lit(seed), *columns), F.lit(seed ^ 0x5DEECE66D))


def shuffle_to_shards(df: DataFrame, n_shards: int = 24, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """Adds ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 within its shard).

    ``keys``: columns that make a row's draw, by default all that can be hashed.
    """
    if n_shards < 1:
        raise ValueError("there must be a shard at least")
    df = df.drop("shard", "slot")
    names = keys or [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    columns = [F.col(f"`{c}`") for c in names]
    total = df.count()
    df = _copies_numbered(df, columns, total)
    columns = [*columns, *([F.col("__copy")] if "__copy" in df.columns else [])]
    n_blocks = min(MOST_BLOCKS, max(2 * n_shards, math.ceil(total / ROWS_PER_BLOCK)))
    dealt = df.withColumns(
        {"__block": F.pmod(_uniform(columns, seed), F.lit(n_blocks)).cast("int"), "__draw": _uniform(columns, seed + 1)}
    )
    # at most MOST_BLOCKS rows
    sizes = {r[0]: r[1] for r in dealt.groupBy("__block").count().collect()}
    blocks = [sizes.get(b, 0) for b in range(n_blocks)]
    shards = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    cells, matrix = [], communication_matrix(blocks, shards, seed)
    for block, row in enumerate(matrix):
        start = 0
        for shard, n in enumerate(row):
            if n:
                cells.append((block, shard, start, start + n))
                start += n
    ends = df.sparkSession.createDataFrame(
        [(b, [c[3] for c in cells_of], [c[1] for c in cells_of]) for b, cells_of in _by_block(cells)],
        "__block int, __ends array<bigint>, __shards array<int>",
    )
    local = Window.partitionBy("__block").orderBy("__draw")
    sent = (
        dealt.withColumn("__rank", F.row_number().over(local))
        .join(_hinted(ends, 2 * n_shards * n_blocks), "__block")  # MOST_BLOCKS rows of 2 x n_shards numbers
        .withColumn("shard", F.expr("__shards[size(filter(__ends, e -> e < __rank))]"))
        .drop("__block", "__rank", "__ends", "__shards", "__draw")
    )
    # the exchange, then a permutation of each shard: bins by the top of a new draw, ranks within
    n_bins = max(1, math.ceil(total / n_shards / ROWS_PER_BLOCK), math.ceil(64 / n_shards))
    n_bins = min(n_bins, MOST_BLOCKS)
    sent = sent.withColumn("__draw", _uniform(columns + [F.col("shard")], seed + 2))
    sent = sent.withColumn("__bin", (F.shiftrightunsigned("__draw", 33) * n_bins / F.lit(float(1 << 31))).cast("int"))
    bins = sent.groupBy("shard", "__bin").count()
    before = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select("shard", "__bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("shard", "__bin").orderBy("__draw")
    return (
        sent.withColumn("__rank", F.row_number().over(within).cast("long") - 1)
        .join(_hinted(offsets, 3 * n_shards * n_bins), ["shard", "__bin"])  # at most MOST_BLOCKS rows a shard
        .withColumn("slot", F.col("__rank") + F.col("__offset"))
        .select(*[F.col(f"`{c}`") for c in df.columns if c != "__copy"], "shard", "slot")
    )


#: Numbers of a table up to which it is broadcast; beyond it both sides are shuffled.
BROADCAST_NUMBERS = 4_000_000


def _hinted(df: DataFrame, numbers: int) -> DataFrame:
    return F.broadcast(df) if numbers <= BROADCAST_NUMBERS else df


def _copies_numbered(df: DataFrame, columns: list[Column], total: int) -> DataFrame:
    """The frame with ``__copy``, the number of each of rows that are alike, if there are such rows."""
    if df.select(F.xxhash64(*columns)).distinct().count() == total or any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema):
        return df
    alike = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("__n"))
    # in thousands, so that no array is as long as a row has copies
    parts = alike.withColumn("__part", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / 1000))))
    copy = F.explode(F.sequence(F.col("__part") * 1000, F.least(F.col("__part") * 1000 + 999, F.col("__n") - 1)))
    return parts.withColumn("__copy", copy).drop("__n", "__part")


def _by_block(cells: list[tuple[int, int, int, int]]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    out: dict[int, list] = {}
    for cell in cells:
        out.setdefault(cell[0], []).append(cell)
    return list(out.items())
