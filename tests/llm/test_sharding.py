import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import sharding
from millrace.llm.queries import QUERIES

from .data import ODD, clashing, docs


def check(rows, total, shards):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == total and set(counts) <= set(range(shards))
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_sizes_and_slots(spark):
    frame = spark.range(5003).withColumn("shard", F.lit("clash")).withColumn("slot", F.lit(1))
    out = sharding.shuffle_to_shards(frame, 24)
    rows = out.collect()
    check(rows, 5003, 24)
    assert sorted(r.id for r in rows) == list(range(5003))
    assert {(r.id, r.shard, r.slot) for r in rows} == {(r.id, r.shard, r.slot) for r in sharding.shuffle_to_shards(frame.repartition(7), 24).collect()}
    assert {(r.id, r.shard) for r in rows} != {(r.id, r.shard) for r in sharding.shuffle_to_shards(frame, 24, seed=1).collect()}


def test_more_shards_than_rows_and_odd_rows(spark):
    check(sharding.shuffle_to_shards(docs(spark, ODD), 24).collect(), len(ODD), 24)
    check(sharding.shuffle_to_shards(docs(spark, [(1, "same")] * 500), 7).collect(), 500, 7)
    assert sharding.shuffle_to_shards(docs(spark, []), 3).count() == 0


def test_assignment_is_recomputed(spark):
    """Shards and slots from the same seed by the method's steps, one after the other."""
    seed, shards, n = 9, 5, 700
    rows = spark.range(n).select("id", *[F.xxhash64(F.xxhash64(F.lit(s), "id"), F.lit(s ^ 0x5DEECE66D)).alias(f"u{s}") for s in (seed, seed + 1)])
    blocks, draws = {}, {r.id: r for r in rows.collect()}
    n_blocks = max(2 * shards, -(-n // sharding.ROWS_PER_BLOCK))
    for i, r in draws.items():
        blocks.setdefault(r[f"u{seed}"] % n_blocks, []).append(i)
    matrix = sharding.communication_matrix([len(blocks.get(b, [])) for b in range(n_blocks)], [n // shards + (s < n % shards) for s in range(shards)], seed)
    to = {}
    for b, ids in blocks.items():
        ids.sort(key=lambda i: draws[i][f"u{seed + 1}"])
        for s, k in enumerate(matrix[b]):
            to |= {i: s for i in ids[:k]}
            ids = ids[k:]
    again = spark.createDataFrame(list(to.items()), "id bigint, shard int").select("id", "shard", F.xxhash64(F.xxhash64(F.lit(seed + 2), "id", "shard"), F.lit((seed + 2) ^ 0x5DEECE66D)).alias("u"))
    n_bins = max(1, -(-64 // shards))
    order = {}
    for r in again.collect():
        order.setdefault(r.shard, []).append((int(((r.u & (1 << 64) - 1) >> 33) * n_bins / (1 << 31)), r.u, r.id))
    want = {(i, s, k) for s, x in order.items() for k, (_, _, i) in enumerate(sorted(x))}
    assert {tuple(r) for r in sharding.shuffle_to_shards(spark.range(n), shards, seed).select("id", "shard", "slot").collect()} == want


def test_copies_are_dealt_one_by_one(spark):
    """Rows that are alike don't share a block."""
    frame = docs(spark, [(1, "same")] * 3000 + [(k, "other") for k in range(2, 1000)])
    rows = sharding.shuffle_to_shards(frame, 6)
    check(rows.collect(), 3998, 6)
    assert rows.where("doc_id = 1").count() == 3000
    spread = [r["count"] for r in rows.where("doc_id = 1").groupBy("shard").count().collect()]
    assert len(spread) == 6 and max(spread) < 600


def test_uniform(spark):
    """Where a row ends up says nothing about where it was: chi-squared over ids by shards and by slots."""
    rows = sharding.shuffle_to_shards(spark.range(24_000), 24).collect()
    for place in (lambda r: r.shard, lambda r: r.slot * 24 // 1000):
        table = np.zeros((24, 24))
        for r in rows:
            table[r.id * 24 // 24_000, place(r)] += 1
        expected = 24_000 / 576
        assert 400 < ((table - expected) ** 2 / expected).sum() < 680  # 529 on average, 33 to either side


def test_matrix_margins_and_law():
    m = np.array(sharding.communication_matrix([10, 0, 7, 13], [8, 8, 7, 7], 3))
    assert m.sum(axis=1).tolist() == [10, 0, 7, 13] and m.sum(axis=0).tolist() == [8, 8, 7, 7]
    first = [sharding.communication_matrix([10, 20], [15, 15], s)[0][0] for s in range(4000)]
    assert abs(np.mean(first) - 5) < 0.1 and abs(np.var(first) - 10 * 0.25 * 20 / 29) < 0.15


def test_draws_of_large_populations():
    rng = np.random.default_rng(1)
    drawn = [sharding.hypergeometric(rng, 10**9, 2 * 10**9, 900) for _ in range(3000)]
    assert abs(np.mean(drawn) - 300) < 1 and abs(np.var(drawn) - 200) < 20
    from fractions import Fraction

    good, bad, draws, x = 4000, 6000, 900, 360  # against the exact probability
    exact = Fraction(math.comb(good, x) * math.comb(bad, draws - x), math.comb(good + bad, draws))
    told = sharding._log_binomial(x, good, 0.09, 0.91) + sharding._log_binomial(draws - x, bad, 0.09, 0.91) - sharding._log_binomial(draws, good + bad, 0.09, 0.91)
    assert math.exp(told) == pytest.approx(float(exact), rel=1e-12)


def test_query(spark, tmp_path):
    docs(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op2_shuffle_shards"](spark, str(tmp_path)).collect()
    check(rows, len(ODD), 24)
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 8 for _, t in ODD)
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
