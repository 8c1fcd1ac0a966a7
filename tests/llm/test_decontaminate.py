import hashlib
import random
import re

from pyspark.sql import functions as F

from millrace.llm import decontaminate
from millrace.llm.queries import QUERIES

from .data import ODD, clashing, docs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(pairs, items, window=13):
    out = []
    for i, text in pairs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            x = words(item)
            n = min(window, len(x))
            spans = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in spans:
                    hit |= set(range(k, k + n))
                    names.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice(["Aa", "b", "cé", "d9", "e"]) for _ in range(n))
    items = [(k, some(rng.randrange(0, 40))) for k in range(12)] + [(12, "x y z"), (13, None), (14, ""), (None, "no id"), (12, "x y z"), (15, "one two " * 30)]
    pairs = list(enumerate((some(rng.randrange(0, 60)) for _ in range(40)), 100))
    pairs += [(200 + k, f"{some(30)}, {items[k][1]}! {some(9)}") for k in range(12)] + [(300, "x-Y.z x y"), (301, "one two " * 15), (302, "no ID"), (302, "no ID")]
    return ODD + pairs, items


def test_exact_matches(spark, tmp_path):
    pairs, items = cases()
    docs(spark, pairs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(map(tuple, QUERIES["op3_decontaminate"](spark, str(tmp_path)).collect()), key=str) == brute(pairs, items)


def test_by_shuffles_alone(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    pairs, items = cases()
    found = decontaminate.contamination(clashing(docs(spark, pairs), "item", "word", "n_hit"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in found.collect()), key=str)
    assert got == sorted((b[:4] for b in brute(pairs, items)), key=str)


def test_one_very_long_text(spark):
    """Three million words with a passage here and there: hits are where they were put."""
    item = " ".join(f"w{k}" for k in range(13))
    filler = "some other words w3 w4 " * 100_000
    frame = docs(spark, [(1, " ".join([filler, item] * 6)), (2, "short")])
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(frame, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert found == {1: (6 * 500_013, 6 * 13, 1), 2: (1, 0, 0)}


def test_proximity_is_brute_forces(spark):
    """Windows of which 10 of 13 words meet, against every place of every item."""
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([4, 13, 20])))) for k in range(5)]
    texts = []
    for k in range(25):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append((k, " ".join([rng.choice(vocabulary) for _ in range(3)] + w[rng.randrange(3) :] + ["end"])))
    want = set()
    for i, t in texts:
        w = words(t)
        for name, item in items:
            x = words(item)
            n = min(13, len(x))
            need = -(-10 * n // 13)
            for start in range(-len(x), len(w)):
                for at in range(len(x) - n + 1):
                    if sum(0 <= start + j < len(w) and w[start + j] == x[j] for j in range(at, at + n)) >= need:
                        want.add((i, str(name), start, at))
    keyed = docs(spark, texts).select(F.col("doc_id").alias("rid"), F.xxhash64("text").alias("rkey"), "text")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.rid, r.name, r.start, r.at) for r in decontaminate.matches(keyed, bench, share=10 / 13).collect()}
    # an item shorter than a window may miss fewer words than the rule for whole windows looks up
    assert got == want


def test_empty_sides(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs(spark, []), none).count() == 0
    assert decontaminate.contamination(docs(spark, ODD), none).where("n_hit > 0 or contaminated").count() == 0


def test_proximity(spark):
    item = " ".join(f"w{k}" for k in range(13))
    far = item.replace("w3 ", "q ").replace("w8 ", "q ")
    frame = docs(spark, [(1, f"a b {far} c"), (2, "w0 w1 w2 w3 z z z"), (3, item)])
    keyed = frame.select(F.col("doc_id").alias("rid"), F.xxhash64("text").alias("rkey"), "text")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert {r.rid for r in decontaminate.matches(keyed, bench, share=0.8).collect()} == {1, 3}
    assert {(r.rid, r.start, r.at) for r in decontaminate.matches(keyed, bench).collect()} == {(3, 0, 0)}


def test_dropping(spark):
    item = " ".join(f"w{k}" for k in range(13))
    frame = docs(spark, [(1, item), (2, "clean"), (None, item), (None, None), (3, item + " filler" * 300)])
    kept = decontaminate.drop_contaminated(frame, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "None"]


def test_repeated_words_and_lines(spark):
    """A word, or a line, repeated through an item and through documents: against every place of every window."""
    rng = random.Random(8)
    line = "one two three four five".split()
    items = [(1, ["same"] * 60), (2, line * 12), (3, [*["same"] * 5, *line, *["same"] * 20]), (4, [rng.choice("ab") for _ in range(60)])]
    texts = [(1, ["same"] * 80), (2, [*line * 9, "x", *line * 2]), (3, [*["same"] * 12, "y", *["same"] * 13]), (4, ["z", *line, *["same"] * 9]), (5, items[3][1][7:40]), (6, [rng.choice("ab") for _ in range(300)])]
    found = decontaminate.contamination(docs(spark, [(i, " ".join(w)) for i, w in texts]), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")).collect()
    for r in found:
        w, hit, names = dict(texts)[r.doc_id], set(), set()
        for name, x in items:
            windows = {tuple(x[k : k + 13]) for k in range(len(x) - 12)}
            for k in range(len(w) - 12):
                if tuple(w[k : k + 13]) in windows:
                    hit |= set(range(k, k + 13))
                    names.add(str(name))
        assert (r.n_words, r.n_hit, r.n_items, r["items"]) == (len(w), len(hit), len(names), sorted(names))


def test_one_word_twenty_thousand_times(spark):
    import time

    text = "same " * 20_000
    began = time.perf_counter()
    found = decontaminate.contamination(docs(spark, [(1, text), (2, f"x {text}"), (3, "same word")]), spark.createDataFrame([(1, text)], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.n_hit) for r in found} == {(1, 20_000), (2, 20_000), (3, 0)}
    assert time.perf_counter() - began < 60
