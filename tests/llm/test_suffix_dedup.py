import hashlib
import random

import numpy as np
import pytest

from millrace.llm import suffix_dedup
from millrace.llm.queries import QUERIES

from .data import ODD, clashing, docs


def brute(pairs, length=200):
    seen, marks = {}, [set() for _ in pairs]
    for k, (_, t) in enumerate(pairs):
        raw = (t or "").encode()
        for a in range(len(raw) - length + 1):
            seen.setdefault(raw[a : a + length], []).append((k, a))
    for places in seen.values():
        if len(places) > 1:
            for k, a in places:
                marks[k].update(range(a, a + length))
    out = []
    for (i, t), gone in zip(pairs, marks):
        raw = (t or "").encode()
        kept = bytes(b for a, b in enumerate(raw) if a not in gone)
        out.append((i, len(raw), len(gone), sum(a - 1 not in gone for a in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases(seed=1):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [text(n) for n in (150, 199, 200, 201, 260, 700)]
    pairs = [(k, text(rng.randrange(500)) + rng.choice(passages) + text(rng.randrange(200)) + rng.choice(passages)) for k in range(60)]
    pairs += [(100, "ab" * 400), (101, "ab" * 90), (102, "q" * 1200), (103, pairs[0][1]), (103, pairs[0][1]), (None, pairs[1][1]), (104, "é" * 150)]
    return pairs + [x for x in ODD if not x[1] or len(x[1]) < 1000]


@pytest.mark.parametrize("large", [suffix_dedup.LARGE_ANCHOR, 3, 1])
def test_removal_is_brute_forces(spark, tmp_path, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup.remove_repeats, "__defaults__", ("doc_id", "text", 200, large))
    pairs = cases(large)
    docs(spark, pairs).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, QUERIES["op7_suffix_dedup"](spark, str(tmp_path)).collect()), key=str) == brute(pairs)


@pytest.mark.parametrize("size", [40, 110, 190, 199, 230, 420])
def test_anchor_with_many_contexts(spark, size):
    """A passage in many texts, also with one byte changed, is dealt out by the bytes around it."""
    rng = random.Random(size)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, tails = word(size), [word(60) for _ in range(4)]
    pairs = [(k, word(220) + rng.choice(tails) + passage + rng.choice(tails) + word(220)) for k in range(40)]
    pairs += [(100 + k, word(150) + passage[: size // 2] + "#" + passage[size // 2 + 1 :] + word(150)) for k in range(10)]
    found = suffix_dedup.remove_repeats(docs(spark, pairs), large=4)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found.collect()) == sorted(brute(pairs))


def test_texts_longer_than_a_portion(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1500)
    rng = random.Random(8)
    long = "".join(rng.choice("abc") for _ in range(9000))
    pairs = [(1, long), (2, "x" + long[2000:7000]), (3, long[4000:4300])]
    found = suffix_dedup.remove_repeats(clashing(docs(spark, pairs), "kept", "n_spans"))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found.collect())
    assert got == brute(pairs)


def test_long_texts_and_empty(spark):
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, [(7, "long words come " * 20_000), (8, "x" * 300_000)])).collect()}
    assert all(r.n_removed == r.n_bytes and r.n_spans == 1 for r in rows.values())
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_blind_trie_and_quicksort():
    rng = random.Random(2)
    raw = bytes(rng.choice(b"ab") for _ in range(40)) * 12
    raw += bytes(60)
    starts = np.arange(len(raw) - 60)
    got = sorted(map(sorted, suffix_dedup.sort_suffixes(raw, starts, np.zeros(len(starts), int), 50, 16)))
    same = {}
    for a in starts.tolist():
        same.setdefault(raw[a : a + 50], []).append(a)
    assert got == sorted(x for x in same.values() if len(x) > 1)
