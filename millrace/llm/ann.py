"""Operator 6: approximate nearest neighbours by balanced posting lists.

Nearness is the largest inner product. Vectors get one more component so that all have the largest
norm; then the nearest by distance is the one with the largest product. About sqrt(n) centroids are
fitted on a bounded sample, large clusters of it split in two, and searched by an in-memory
neighbour graph that is entered at hubs. Every vector is put into the posting list of its nearest centroid and, at a
boundary, also of those at most ``spread`` times as far, up to ``replicas``. A query probes all lists
at most ``ratio`` times as far as its nearest. None of the three is guessed: a bounded sample of the
queries is answered by brute force over all vectors, for each choice of spread and replicas the
least ratio that covers ``COVER`` of the true neighbours is found, and the choice is taken that
compares the fewest vectors. A query that has found fewer than k neighbours although there are more
probes on, up to all lists.

Lists are packed into bins of about ``BIN_ROWS`` postings; a bin meets the queries that probe any of
its lists, a row a query, and gives each its k + 1 best. A list over ``BIN_ROWS`` is cut into pieces by
hash, each a bin, and so are a bin's queries over ``PROBE_ROWS``. Equal vectors are indexed once with
their k + 1 smallest ids, which is all that a result can hold of them; equal query vectors are
searched once.

Scores are inner products of the original vectors in double precision, summed in one fixed order.

Cases: vectors that are null, zero, or hold null or non-finite components, and rows with a null id,
take no part. Vectors are met by those of their own length only; each length has an index of its
own. Rows with the query's id are its own. Ties go to the smaller id; fewer candidates than k give
them all; an empty table gives no rows; repeated rows count once; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, table

#: Vectors that the centroids are fitted on, at most about as many a list, and the most lists.
SAMPLE, SAMPLE_A_LIST, LISTS = 131_072, 64, 16_384
#: Bytes of the sample, in double precision, on the driver.
SAMPLE_BYTES = 128 << 20
#: Choices of spread and replicas.
REPLICATIONS = ((1.03, 2), (1.1, 2), (1.1, 4), (1.3, 8))
#: Share of true neighbours that the probed lists must hold, and the queries it is measured on.
COVER, CALIBRATION = 0.95, 200
BIN_ROWS, PROBE_ROWS = 16_384, 16_384
#: Edges of a centroid in the graph, hubs at least, and centroids expanded at a time.
DEGREE, STARTS, EXPANDED = 16, 16, 4
#: Centres that a search holds at least.
LEAST_BEAM = 64
#: Rows up to which sizes of bins are broadcast; there is a row a bin.
BROADCAST_ROWS = 200_000
#: Lengths of vectors in one table.
MOST_LENGTHS = 64


class Centroids:
    """Centres of the posting lists and the graph through which they are searched.

    Every centre has an edge to its nearest others. Some centres, about twice the square root of them
    all, are hubs: a search is compared with all hubs, begins at the nearest, and goes along edges
    with a beam of bounded width. Its work grows with the hubs and the beam, not with the centres.
    """

    def __init__(self, centres: np.ndarray):
        self.centres = centres.astype(np.float32)
        self.norms = (self.centres**2).sum(axis=1)
        n = len(centres)
        degree = min(DEGREE, n - 1)
        self.near = np.zeros((n, degree), np.int64)
        for a in range(0, n, 512):
            d = self.norms[None, :] - 2 * self.centres[a : a + 512] @ self.centres.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            if degree:
                self.near[a : a + 512] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        self.hubs = np.unique(np.linspace(0, n - 1, min(n, max(STARTS, 2 * int(n**0.5)))).astype(int))

    def search(self, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``keep`` nearest centres that a walk finds for each row, nearest first, and their distances.

        The beam holds the nearest centres met, ``keep`` or ``LEAST_BEAM`` of them. Its nearest ones
        not expanded yet are expanded, of all rows at once, until a row has none left.
        """
        n, keep = len(self.centres), min(keep, len(self.centres))
        x = x.astype(np.float32)
        wide = min(n, max(keep, LEAST_BEAM))
        far = self.norms[self.hubs] - 2 * x @ self.centres[self.hubs].T
        first = np.argpartition(far, min(wide, len(self.hubs)) - 1, axis=1)[:, :wide]
        node, value = self.hubs[first], np.take_along_axis(far, first, 1)
        fill = ((0, 0), (0, wide - node.shape[1]))
        node, value = np.pad(node, fill, constant_values=-1), np.pad(value, fill, constant_values=np.inf)
        unmet = np.ones((len(x), n), bool)  # looked up, never scanned
        unmet[np.arange(len(x))[:, None], self.hubs[first]] = False
        todo = np.isfinite(value)
        active = np.flatnonzero(todo.any(axis=1)) if self.near.shape[1] else np.zeros(0, np.int64)
        pick = min(EXPANDED, wide)
        while len(active):
            rows = np.arange(len(active))[:, None]
            now = np.where(todo[active], value[active], np.inf)
            chosen = np.argpartition(now, pick - 1, axis=1)[:, :pick]
            usable = np.isfinite(now[rows, chosen])
            todo[active[:, None], chosen] = False
            to = self.near[np.where(usable, node[active[:, None], chosen], 0)]
            to = np.sort(np.where(usable[:, :, None], to, -1).reshape(len(active), -1), axis=1)
            fresh = (to >= 0) & unmet[active[:, None], to]
            fresh[:, 1:] &= to[:, 1:] != to[:, :-1]
            r, c = np.nonzero(fresh)
            unmet[active[r], to[r, c]] = False
            reach = np.full(to.shape, np.inf, np.float32)
            reach[r, c] = self.norms[to[r, c]] - 2 * np.einsum("nd,nd->n", x[active[r]], self.centres[to[r, c]])
            every = np.concatenate((value[active], reach), axis=1)
            best = np.argpartition(every, wide - 1, axis=1)[:, :wide]
            value[active] = np.take_along_axis(every, best, 1)
            node[active] = np.take_along_axis(np.concatenate((node[active], to), axis=1), best, 1)
            todo[active] = np.take_along_axis(np.concatenate((todo[active], fresh), axis=1), best, 1)
            active = active[todo[active].any(axis=1)]
        order = np.argsort(value, axis=1, kind="stable")[:, :keep]
        best, value = np.take_along_axis(node, order, 1), np.take_along_axis(value, order, 1)
        own = (x**2).sum(axis=1, keepdims=True)
        return best, np.sqrt(np.maximum(value + own, 0))

    def postings(self, x: np.ndarray, spread: float, replicas: int) -> np.ndarray:
        """The lists of each row, its nearest first; -1 where there are less than ``replicas``."""
        best, far = self.search(x, 2 * replicas + 8)
        best, far = best[:, :replicas], far[:, :replicas]
        out = np.where(far <= spread * far[:, :1], best, -1)
        out[:, 0] = best[:, 0]
        return np.pad(out, ((0, 0), (0, replicas - out.shape[1])), constant_values=-1)

    def within(self, x: np.ndarray, ratio: float, keep: int) -> Iterator[np.ndarray]:
        """For each row those of its ``keep`` nearest centres that are at most ``ratio`` times as far as the nearest."""
        best, far = self.search(x, keep)
        for row, distance in zip(best, far):
            yield row[(row >= 0) & (distance <= ratio * distance[0])]


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 5, seed: int = 3) -> Centroids:
    """k-means over a sample; an empty cluster, like the least while one has over twice the mean, takes half of the largest."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), k, replace=False)].astype(np.float32)
    x = sample.astype(np.float32)
    for _ in range(rounds):
        norms = (centres**2).sum(axis=1)
        label = np.concatenate([np.argmin(norms - 2 * x[a : a + 2048] @ centres.T, axis=1) for a in range(0, len(x), 2048)])
        count = np.bincount(label, minlength=k)
        order = np.argsort(label, kind="stable")
        edge = np.concatenate(([0], np.cumsum(count)))
        full = np.flatnonzero(count)
        centres[full] = np.add.reduceat(x[order], edge[full], axis=0) / count[full, None]
        least, most = np.argsort(count, kind="stable"), np.argsort(-count, kind="stable")
        for low, high in zip(least.tolist(), most.tolist()):
            if low == high or count[high] < 2 or (count[low] and count[high] <= 2 * len(x) / k):
                break
            members = order[edge[high] : edge[high + 1]]
            a, b = x[rng.choice(members, 2, replace=False)]
            centres[low], centres[high] = (a + centres[high]) / 2, (b + centres[high]) / 2
    return Centroids(centres)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one component more, all of the same norm."""
    rest = np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1, keepdims=True), 0))
    return np.concatenate((x, rest), axis=1)


def _stretched(q: np.ndarray, norm: float) -> np.ndarray:
    """Queries on the sphere of the vectors; the order of products is the same."""
    length = np.sqrt((q**2).sum(axis=1, keepdims=True))
    return np.concatenate((q / length * norm, np.zeros((len(q), 1))), axis=1)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of each q with its own v's (q x n x d), each summed in the same order."""
    return (q[:, None, :] * v).sum(axis=-1)


def _best(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and products of the k largest of each query (a few more are looked at exactly)."""
    wide = min(len(v), k + 8)
    rough = q @ v.T
    at = np.argpartition(-rough, wide - 1, axis=1)[:, :wide] if wide < len(v) else np.tile(np.arange(len(v)), (len(q), 1))
    exact = _products(q, v[at])
    order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(at, order, 1), np.take_along_axis(exact, order, 1)


def nearest(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row among all other rows."""
    clean = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{embedding}`").alias("v"), is_query.alias("q")).where(
        "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    )
    clean = clean.withColumn("key", F.xxhash64("v"))
    lengths = [r[0] for r in clean.where("q").select(F.size("v").alias("d")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of over {MOST_LENGTHS} lengths")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for dim in sorted(lengths):
        some = clean.where(F.size("v") == dim)
        asked = some.where("q").select("id", "key")
        found = (
            asked.select(F.col("id").alias("query_id"), "key").distinct().join(_candidates(some, dim, k), "key")
            .where("query_id <> id").select("query_id", F.col("id").alias("vec_id"), "score")
            .withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
        )
        out = out.unionByName(found) if len(lengths) > 1 else found
    return out


def _candidates(clean: DataFrame, dim: int, k: int) -> DataFrame:
    """(key, id, score): the k + 1 nearest found of each query vector, by its key, of vectors of one length."""
    spark = clean.sparkSession
    # equal vectors once, with the ids that a result can hold
    few = clean.withColumn("r", F.dense_rank().over(Window.partitionBy("key", "v").orderBy("id"))).where(F.col("r") <= k + 1)
    vectors = table(few.groupBy("key", "v").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.max("q").alias("own")).select("v", "ids", "key", "own"))
    # a query's vector may be that of k + 1 smaller ids, so queries are found by themselves
    queries = table(clean.where("q").groupBy("key", "v").agg(F.lit(1)).select("v", "key"))
    n, square = vectors.agg(F.count("*"), F.max(F.expr("aggregate(v, double(0), (s, x) -> s + double(x) * double(x))"))).first()
    norm = float(np.sqrt(square))
    lists = max(1, min(LISTS, round(n**0.5)))
    most = min(SAMPLE, SAMPLE_A_LIST * lists, SAMPLE_BYTES // (8 * (dim + 1)))
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    sample = vectors.where(drawn < int(min(1.0, most / n) * (1 << 30)) + 1).orderBy(drawn, "key").select("v").limit(2 * most).toArrow()
    if not len(sample):
        sample = vectors.select("v").limit(1).toArrow()
    points = _lifted(_matrix(sample.column(0), dim), norm)
    centroids = fit_centroids(points, max(1, min(lists, len(points) // 8)))
    spread, replicas, ratio, keep = _calibrated(vectors, queries, centroids, points, norm, dim, k)
    shared = spark.sparkContext.broadcast(centroids)  # at most LISTS centres

    def post(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                found = shared.value.postings(_lifted(_matrix(part.column(0), dim), norm), spread, replicas)
                rows, at = np.nonzero(found >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[rows, at].astype(np.int32)), *(part.column(c).take(pa.array(rows)) for c in range(3))], names=["list", "v", "ids", "key"]
                )

    kind = vectors.schema["v"].dataType.simpleString()
    postings = table(vectors.select("v", "ids", "key").mapInArrow(post, f"list int, v {kind}, ids array<bigint>, key bigint"))
    # a row a list, of which there are LISTS at most
    sizes = {r[0]: r[1] for r in postings.groupBy("list").count().collect()}
    bin_of, pieces = np.full(len(centroids.centres), -1, np.int32), []
    held = 0
    for x in sorted(sizes):
        if not pieces or held + sizes[x] > BIN_ROWS:
            pieces.append(-(-sizes[x] // BIN_ROWS))
            held = sizes[x] if pieces[-1] == 1 else BIN_ROWS
        else:
            held += sizes[x]
        bin_of[x] = len(pieces) - 1
    bins = spark.sparkContext.broadcast(bin_of)

    named = spark.createDataFrame([(x, int(bin_of[x])) for x in sizes], "list int, bin int")

    def looked_up(asked: DataFrame, ratio: float, keep: int) -> DataFrame:
        """(key, id, score): the k + 1 best of the lists that queries (v, key) probe, as a table."""

        def probe(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    rows, of, lists = [], [], []
                    for r, found in enumerate(shared.value.within(_stretched(_matrix(part.column(0), dim), norm), ratio, keep)):
                        found = np.sort(found[bins.value[found] >= 0])
                        own, start = np.unique(bins.value[found], return_index=True)
                        rows += [r] * len(own)
                        of += own.tolist()
                        lists += [x.tolist() for x in np.split(found, start[1:])] if len(own) else []
                    rows = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(of, pa.int32()), pa.array(lists, pa.list_(pa.int32())), part.column(0).take(rows), part.column(1).take(rows)], names=["bin", "lists", "v", "key"]
                    )

        probes = table(asked.select("v", "key").mapInArrow(probe, f"bin int, lists array<int>, v {kind}, key bigint"))
        parts = {r[0]: -(-r[1] // PROBE_ROWS) for r in probes.groupBy("bin").count().collect()}  # a row a bin
        cut_up = spark.createDataFrame([(b, p, parts[b]) for b, p in enumerate(pieces) if b in parts], "bin int, pieces int, parts int")
        cut_up = F.broadcast(cut_up) if small(cut_up, BROADCAST_ROWS) else cut_up
        piece, part = F.pmod("key", F.col("pieces")).cast("int"), F.pmod("key", F.col("parts")).cast("int")
        left = postings.join(F.broadcast(named), "list").join(cut_up, "bin")  # LISTS rows
        left = left.select("bin", piece.alias("piece"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "list", "v", "ids")
        right = probes.join(cut_up, "bin").select("bin", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), part.alias("part"), "lists", "v", "key")
        by = ["bin", "piece", "part"]
        met = left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(_meet(dim, k, replicas), "key bigint, id array<bigint>, score array<double>")
        first_of = Window.partitionBy("key").orderBy(F.desc("score"), "id")
        return table(
            met.select("key", F.explode(F.arrays_zip("id", "score")).alias("x")).groupBy("key", "x.id").agg(F.max("x.score").alias("score"))
            .withColumn("r", F.row_number().over(first_of)).where(F.col("r") <= k + 1).select("key", "id", "score")
        )

    # every query gets k neighbours, or all there are: those that found too few probe on, four times as many lists each time
    enough = vectors.select(F.explode("ids").alias("id")).distinct().limit(k + 1).count()
    found = looked_up(queries, ratio, keep)
    while keep < len(centroids.centres) or ratio < np.inf:
        counts = found.groupBy("key").agg(F.count("*").alias("n"))
        lacking = table(queries.join(counts, "key", "left").where(F.coalesce("n", F.lit(0)) < enough).select("v", "key"))
        if lacking.isEmpty():
            break
        keep = min(4 * keep, len(centroids.centres))
        ratio = 2 * ratio if keep < len(centroids.centres) else np.inf
        found = found.join(lacking.select("key"), "key", "left_anti").unionByName(looked_up(lacking, ratio, keep))
    return found


def _meet(dim: int, k: int, replicas: int):
    """The k + 1 best of a bin for each of its queries, list by list."""

    def run(vs: pa.Table, qs: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if vs.num_rows and qs.num_rows:
            v, q, of, ids = _matrix(vs.column("v"), dim), _matrix(qs.column("v"), dim), vs.column("list").to_numpy(), vs.column("ids").to_pylist()
            order = np.argsort(of, kind="stable")
            names, start = np.unique(of[order], return_index=True)
            members = dict(zip(names.tolist(), np.split(order, start[1:])))
            # a vector is in several lists; a few more are kept, as rough products may misorder near ties
            wide = replicas * (k + 1) + 8
            best = np.full((len(q), wide), -np.inf)
            place = np.full((len(q), wide), -1)
            asked: dict[int, list[int]] = {}
            for r, lists in enumerate(qs.column("lists").to_pylist()):
                for x in lists:
                    asked.setdefault(x, []).append(r)
            for x, rows in asked.items():
                if x not in members:
                    continue
                rows, at = np.array(rows), members[x]
                score = np.concatenate((best[rows], q[rows] @ v[at].T), axis=1)
                where = np.concatenate((place[rows], np.broadcast_to(at, (len(rows), len(at)))), axis=1)
                top = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
                best[rows], place[rows] = np.take_along_axis(score, top, 1), np.take_along_axis(where, top, 1)
            for a in range(0, len(q), 256):
                exact = _products(q[a : a + 256], v[place[a : a + 256]])
                for key, places, scores in zip(qs.column("key")[a : a + 256].to_pylist(), place[a : a + 256].tolist(), exact.tolist()):
                    found = {i: s for p, s in zip(places, scores) if p >= 0 for i in ids[p]}
                    near = sorted(found.items(), key=lambda x: (-x[1], x[0]))[: k + 1]
                    out[0].append(key)
                    out[1].append([i for i, _ in near])
                    out[2].append([s for _, s in near])
        return pa.table({"key": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.list_(pa.int64())), "score": pa.array(out[2], pa.list_(pa.float64()))})

    return run


def _calibrated(vectors: DataFrame, queries: DataFrame, centroids: Centroids, points: np.ndarray, norm: float, dim: int, k: int) -> tuple[float, int, float, int]:
    """Spread, replicas and ratio that compare the fewest vectors of those that cover COVER, and how many centres a search keeps.

    Covered are the true neighbours of CALIBRATION queries by the search itself; it keeps the fewest
    centres with which any choice covers enough. ``points`` say how many lists a vector is put into.
    """
    sample = queries.orderBy(F.xxhash64("key"), "key").limit(CALIBRATION).select("v").toArrow()
    q = _matrix(sample.column(0), dim)
    shared = vectors.sparkSession.sparkContext.broadcast(q)  # CALIBRATION rows
    kind = vectors.schema["v"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                at, score = _best(shared.value, _matrix(batch.column(0), dim), min(k, batch.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(at)), at.shape[1])), pa.array(score.ravel()), batch.column(0).take(pa.array(at.ravel()))], names=["s", "score", "v"]
                )

    ranked = vectors.select("v").mapInArrow(scan, f"s bigint, score double, v {kind}")
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("score")))).where(F.col("r") <= k)
    true = ranked.select("s", "v").toArrow()  # CALIBRATION x k rows
    whose, x = true.column("s").to_numpy(), _lifted(_matrix(true.column("v"), dim), norm)
    stretched = _stretched(q, norm)
    n, best = len(centroids.centres), None
    for keep in sorted({min(n, LEAST_BEAM << x) for x in range(n.bit_length())}):
        # with the search that probes: what it doesn't find is not covered
        near, distance = centroids.search(stretched, keep)
        ratios = np.full((len(q), n), np.inf)
        ratios[np.arange(len(q))[:, None], near] = distance / np.maximum(distance[:, :1], 1e-12)
        for spread, replicas in REPLICATIONS:
            lists = centroids.postings(x, spread, replicas)
            needed = np.where(lists >= 0, ratios[whose[:, None], lists], np.inf).min(axis=1)
            ratio = float(np.quantile(needed, COVER, method="higher")) + 1e-6
            if not np.isfinite(ratio):
                continue
            probed = (ratios <= ratio).sum(axis=1)
            copies = (centroids.postings(points[:2048], spread, replicas) >= 0).sum(axis=1).mean()
            cost = probed.mean() * copies
            if best is None or cost < best[0]:
                best = (cost, spread, replicas, ratio, keep)
        if best:
            break
    return best[1:]
