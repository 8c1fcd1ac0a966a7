import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import similar, simhash
from millrace.llm.components import components
from millrace.llm.queries import QUERIES

from .data import ODD, clashing, docs


def brute_fingerprint(text, n=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]), seed=42) for k in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(near, n):
    of = list(range(n))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(n):
        for b in np.flatnonzero(near(a)).tolist():
            of[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def near_copies(n=300, seed=4):
    """Random fingerprints with chains of near ones."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = rng.choice(out) if out and rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.choice([0, 1, 3, 4, 5, 7])):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("distance", [0, 3, 4, 8, 11])
@pytest.mark.parametrize("large", [simhash.LARGE_BUCKET, 1])
def test_links_join_all_that_are_near(spark, distance, large):
    fps = near_copies()
    signed = np.array(fps, np.uint64).view(np.int64)
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in signed], "fp bigint"), distance, large=large)
    found = {r.node: r.component for r in components(links.select(F.col("a0").alias("a"), F.col("b0").alias("b"))).collect()}
    a = np.array(fps, np.uint64)
    want = brute_components(lambda k: np.bitwise_count(a ^ a[k]) <= distance, len(a))
    groups = {}
    for x, w in zip(signed.tolist(), want):
        groups.setdefault(w, set()).add(found.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_query(spark, tmp_path):
    rng = random.Random(9)
    pairs = list(ODD)
    for k in range(150):
        words = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(1, 60))]
        pairs.append((1000 + k, " ".join(words)))
        words[rng.randrange(len(words))] = "Changed"
        pairs.append((2000 - k, "\n".join(words)))
    docs(spark, pairs).write.parquet(str(tmp_path / "documents.parquet"))
    fps = np.array([brute_fingerprint(t) for _, t in pairs], np.uint64)
    root = brute_components(lambda k: np.bitwise_count(fps ^ fps[k]) <= 4, len(fps))
    least = {}
    for (i, _), r in zip(pairs, root):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((i, f"{int(f):016x}", least[r]) for (i, _), f, r in zip(pairs, fps, root)), key=str)
    assert sorted(map(tuple, QUERIES["op4_simhash"](spark, str(tmp_path)).collect()), key=str) == want


def test_plan_covers_the_distance():
    costs = [[0.0, 5.0, 9.0, 30.0], [0.0, 7.0, 8.0, 30.0], [0.0, 100.0, 200.0, 300.0]]
    cost, flips = simhash.allocate(costs, 5)
    assert (cost, flips) == (17.0, [1, 1, -1])  # thresholds 2 and 2: 3 + 3 > 5
    assert simhash.allocate(costs, 20) is None
    for bits, apart, flips in ((5, 0, 1), (5, 2, 1), (6, 3, 2), (6, 4, 2)):
        y = (1 << apart) - 1
        by_hand = sum(v.bit_count() <= flips and (v ^ y).bit_count() <= flips for v in range(1 << bits))
        assert simhash._meetings(bits, apart, flips) == by_hand


def test_keep_one(spark):
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    pairs, copies = [], set()
    for k in range(60):
        words = new(300)
        pairs.append((k, " ".join(words)))
        words[rng.randrange(300)] = "changed"
        pairs += [(100 + k, " ".join(words)), (200 + k, pairs[-1][1])]
        copies |= {100 + k, 200 + k}
    frame = docs(spark, pairs + [(500, ""), (501, None), (None, "by itself alone here"), (None, "by itself alone here"), (7, pairs[21][1])])
    kept = simhash.keep_one(clashing(frame, "fp", "class"))
    rows = kept.collect()
    assert kept.columns == [*frame.columns, "fp", "class"]
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and not copies & set(ids)
    assert set(ids) == {*range(60), 500, None}


def test_empty(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == simhash.keep_one(docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}


def sets(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def edited(seed=8, n=260):
    """Pairs of texts from a similarity of 0.6 to 0.95, and pairs that share one line many times over."""
    rng = random.Random(seed)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    pairs = []
    for k in range(n):
        words = new(200)
        pairs.append((2 * k, " ".join(words)))
        for at in rng.sample(range(200), rng.randrange(1, 11)):
            words[at] = "changed"
        pairs.append((2 * k + 1, " ".join(words)))
    line = new(12)
    return pairs + [(2 * n + k, " ".join([*line * 40, *new(60)])) for k in range(4)]


@pytest.mark.parametrize("small, tile", [(similar.SMALL_BUCKET, similar.TILE), (1, 4)])
def test_similar_groups_are_brute_forces(spark, monkeypatch, small, tile):
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "TURNS", 2 if small > 1 else 1)
    pairs = edited(n=260 if small > 1 else 30)
    hub = pairs[0][1].split()
    for k in range(30):  # a large group, some members alike and some not
        words = list(hub)
        for at in range(k, 200, 25 if k % 2 else 100):
            words[at] = f"v{k}"
        pairs.append((5000 + k, " ".join(words)))
    own = [sets(t) for _, t in pairs]
    near = lambda a: np.array([9 * len(own[a] & s) >= 4 * (len(own[a]) + len(s)) for s in own])
    root = brute_components(near, len(pairs))
    least = {}
    for (i, _), r in zip(pairs, root):
        least[r] = min(least.get(r, i), i)
    want = {i: least[r] for (i, _), r in zip(pairs, root)}
    found = {r.doc_id: r.component_id for r in similar.similar_groups(docs(spark, pairs), "doc_id", "text", 5, 0.8, small).collect()}
    assert found == want
    assert similar.majority(np.array([0b0110, 0b0101, 0b0100, 0b1010], np.uint64)) == 0b0100 and similar.majority(np.zeros(0, np.uint64)) == 0
    assert {r.doc_id for r in simhash.keep_one(docs(spark, pairs)).collect()} == set(want.values())
