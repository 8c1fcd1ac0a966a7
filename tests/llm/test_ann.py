import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann
from millrace.llm.queries import QUERIES


def brute(rows, k, every):
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, v in rows:
        if i % every == 0:
            score = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def vectors(n, dim=16, groups=40, seed=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    x = centre[rng.integers(0, groups, n)] + 0.4 * rng.normal(size=(n, dim))
    return [(k, v.astype(np.float32).astype(float)) for k, v in enumerate(x)]


def test_recall_against_brute_force(spark, tmp_path):
    rows = vectors(4000)
    spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = found(QUERIES["op6_ann"](spark, str(tmp_path))), brute(rows, 20, 20)
    assert set(got) == set(want)
    assert all(len(x) == 20 for x in got.values())
    scores = {(q, i): s for q, x in want.items() for i, s in x}
    for q, x in got.items():
        for i, s in x:
            assert s == pytest.approx(scores.get((q, i), s), rel=1e-12)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9


def test_recall_on_vectors_without_clusters(spark):
    """Directions without any structure are the hardest case of an index."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 64))
    rows = [(k, v) for k, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float))]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<float>")
    got, want = found(ann.nearest(frame, F.col("vec_id") % 20 == 0, 20)), brute(rows, 20, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_small_bins_and_parts(spark, monkeypatch):
    """Lists cut into pieces, and their queries into parts, give the same neighbours."""
    rows = vectors(600, dim=4, groups=3)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<float>")
    whole = found(ann.nearest(frame, F.col("vec_id") % 20 == 0, 5))
    monkeypatch.setattr(ann, "BIN_ROWS", 16)
    monkeypatch.setattr(ann, "PROBE_ROWS", 7)
    assert found(ann.nearest(frame, F.col("vec_id") % 20 == 0, 5)) == whole


def test_lengths_have_their_own_index(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (20, [1.0, 0.0, 1.0]), (21, [2.0, 0.0, 0.0]), (22, [5.0])]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, 3))
    assert got == {0: [(1, 0.5)], 20: [(21, 2.0)]}


def test_graph_search_finds_the_nearest(spark):
    rng = np.random.default_rng(5)
    centroids, x = ann.fit_centroids(rng.normal(size=(4000, 16)), 300), rng.normal(size=(200, 16))
    d = ((x[:, None] - centroids.centres[None]) ** 2).sum(axis=2)
    best, far = centroids.search(x, 24)
    assert (best[:, 0] == d.argmin(axis=1)).mean() > 0.95
    assert far == pytest.approx(np.sqrt(np.take_along_axis(d, best, 1)), rel=1e-3)


def test_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (20, [1.0, 1.0]), (21, [-1.0, 0.0])]
    odd = [(4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (None, [9.0, 9.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumns({"rank": F.lit("clash"), "key": F.lit("clash")})
    got = found(ann.nearest(frame, F.col("vec_id") % 20 == 0, 3))
    assert got == {0: [(1, 2.0), (2, 2.0), (20, 1.0)], 20: [(1, 2.0), (2, 2.0), (0, 1.0)]}


def test_many_equal_vectors(spark):
    rows = [(k, [1.0, 0.5]) for k in range(300)] + [(k, [0.1, float(k)]) for k in range(300, 320)]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, 5))
    assert got == brute([(i, np.array(v)) for i, v in rows], 5, 20)


@pytest.mark.parametrize("n", [5, 30, 100, 500])
def test_small_tables_give_all_neighbours(spark, n):
    """Lists are few and short here, so that the first probes find too few."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32))
    rows = [(k, v) for k, v in enumerate(x.astype(np.float32).astype(float))]
    got = found(ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 20 == 0, 20))
    assert {q: len(v) for q, v in got.items()} == {k: min(20, n - 1) for k in range(0, n, 20)}


def test_queries_that_find_too_few_probe_on(spark, monkeypatch):
    """With a ratio that covers next to nothing every query still gets its k, and with all lists probed the true ones."""
    rows = vectors(800, dim=8, groups=5)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(ann, "_calibrated", lambda *a: (1.0, 1, 1.0, 1))
    got = found(ann.nearest(frame, F.col("vec_id") % 20 == 0, 60))
    assert all(len(x) == 60 for x in got.values()) and len(got) == 40
    assert found(ann.nearest(frame, F.col("vec_id") % 20 == 0, 799)) == {q: [(i, pytest.approx(s)) for i, s in x] for q, x in brute(rows, 799, 20).items()}


def test_the_graph_is_searched_in_bounded_work():
    """The centres that a search compares don't grow with their number."""
    rng = np.random.default_rng(2)
    share = []
    for n in (1000, 8000):
        centroids, x = ann.Centroids(rng.normal(size=(n, 16))), rng.normal(size=(64, 16)).astype(np.float32)
        best, _ = centroids.search(x, 16)
        d = ((x[:, None] - centroids.centres[None]) ** 2).sum(axis=2)
        assert (best[:, 0] == d.argmin(axis=1)).mean() > 0.9
        share.append(len(centroids.hubs) / n)
    assert share[1] < 0.4 * share[0]


def test_empty(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
