import math
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from millrace.llm import lm_score
from millrace.llm.common import hold_out
from millrace.llm.queries import QUERIES

from ..conftest import SF
from .data import ODD, clashing, docs


def words(text):
    return [*(text or "").encode().lower().split(), b""]


def brute(pairs, mu=lm_score.MU, add=0.1):
    """Scores by the module's formulas, from counts of all three orders."""
    train = [words(t) for i, t in pairs if crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(w for t in train for w in t)
    total, distinct = sum(c.values()), len(c)
    two, three, after = Counter(), Counter(), Counter({"start": len(train)})
    for t in train:
        for u, v, w in zip([None, "start", *t[:-2]], ["start", *t[:-1]], t):
            two[v, w] += 1
            three[u, v, w] += 1
        after.update(t)
    out = []
    for i, t in pairs:
        base = score = known = 0
        t = words(t)
        for u, v, w in zip([None, "start", *t[:-2]], ["start", *t[:-1]], t):
            p = (c[w] + add) / (total + add * (distinct + 1))
            base += math.log10(p)
            known += c[w] > 0
            p = (two[v, w] + mu * p) / (after[v] + mu)
            if u is not None:
                p = (three[u, v, w] + mu * p) / (two[u, v] + mu)
            score += math.log10(p)
        out.append((i, len(t), known, total, base, score))
    return sorted(out, key=str)


def scored(rows):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows), key=str)


def assert_same(got, want):
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)


@pytest.mark.parametrize("block, part, salt, stretch", [(1_500_000, 1_000_000, 500_000, 512), (700, 300, 5, 3), (1, 2000, 1, 7)])
def test_scores_are_brute_forces(spark, monkeypatch, block, part, salt, stretch):
    """Whole, and with texts over several blocks, few tokens a part, frequent bigrams dealt out and short stretches."""
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm_score, "PORTION", 1 << 18 if block > 10**6 else 90)
    monkeypatch.setattr(lm_score, "PART_TOKENS", part)
    monkeypatch.setattr(lm_score, "PART_WORDS", part)
    monkeypatch.setattr(lm_score, "STRETCH", stretch)
    docs_of = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()
    pairs = [(r.doc_id, (r.text or "")[:900]) for r in docs_of] + [x for x in ODD if not x[1] or len(x[1]) < 1000]
    pairs += [(1000 + k, " ".join("the cat of the mat the cat the end".split() * (1 + k % 5))) for k in range(20)]
    frame = clashing(docs(spark, pairs), "score", "block")
    assert_same(scored(lm_score.score_texts(frame, ~hold_out("doc_id", 10), salt_count=salt).collect()), brute(pairs))


def test_long_texts(spark):
    pairs = [(7, "long words come " * 20_000), (8, "x" * 300_000), (11, " ".join(f"w{k % 977}" for k in range(50_000)))]
    assert_same(scored(lm_score.score_texts(docs(spark, pairs), ~hold_out("doc_id", 10)).collect()), brute(pairs))


@pytest.mark.parametrize("history", [[], ["a"], ["a", "b"], ["b", "a"], ["zzz"], ["zzz", "a"], ["a", "zzz"], ["c", "f"]])
def test_probabilities_sum_to_one(spark, history):
    """Over all known words, the end and the unknown words as one, after any history."""
    train = [(1, "a b a c"), (2, "b a a d e f"), (3, "c c")]
    follow = [*"abcdef", "unknown"]
    asked = [(100 + k, " ".join([*history, w])) for k, w in enumerate(follow)] + [(200, " ".join(history))]
    held = lm_score.score_texts(docs(spark, train + asked), F.col("doc_id") < 100).collect()
    s = {r.doc_id: r.score for r in held}
    c, two, three = Counter(), Counter(), Counter()
    for _, t in train:
        t = t.split()
        c.update([*t, ""])
        two.update(zip(["start", *t], [*t, ""]))
        three.update(zip(["start", *t[:-1]], t, [*t[1:], ""]))

    def end(words):  # what the end adds after these words
        known = 10 ** math.log10((c[""] + 0.1) / (sum(c.values()) + 0.1 * (len(c) + 1)))
        v, u = words[-1] if words else "start", (words[-2] if len(words) > 1 else "start") if words else None
        p = (two[v, ""] + 30 * known) / ((c[v] if words else 3) + 30)
        return p if u is None else (three[u, v, ""] + 30 * p) / (two[u, v] + 30)

    before = 10 ** s[200] / end(history)  # the history alone
    total = sum(10 ** s[100 + k] / end([*history, w]) for k, w in enumerate(follow)) + 10 ** s[200]
    assert total / before == pytest.approx(1, rel=1e-9)


def test_empty_and_untrained(spark):
    assert lm_score.score_texts(docs(spark, []), F.lit(True)).count() == 0
    rows = lm_score.score_texts(docs(spark, ODD), F.lit(False)).collect()
    assert len(rows) == len(ODD) and {r.train_tokens for r in rows} == {0} and all(math.isfinite(r.score) for r in rows)


def test_query(spark):
    rows = QUERIES["op10_lm_score"](spark, SF).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_pair_is_a_state(spark, tmp_path, monkeypatch):
    """Many words in many blocks: each n-gram seen in training counts."""
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 1500)
    pairs = [(k, " ".join(f"w{k}x{j} v{j}" for j in range(30))) for k in range(100)]
    pairs += [(100 + k, pairs[k][1]) for k in range(0, 100, 3)] + [(300, "w0x0 unknown v0 w0x1"), (310, None)]
    docs(spark, pairs).write.parquet(str(tmp_path / "documents.parquet"))
    assert_same(scored(QUERIES["op10_lm_score"](spark, str(tmp_path)).collect()), brute(pairs))
