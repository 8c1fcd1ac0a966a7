import hashlib
import math
import random
import re

import pytest

from millrace.llm import pii
from millrace.llm.queries import QUERIES

from .data import ODD, clashing, docs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            twice = sum(sum(divmod(int(d) * 2, 10)) if k % 2 else int(d) for k, d in enumerate(digits[::-1]))
            if {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                "card": 14 <= len(digits) <= 19 and twice % 10 == 0, "phone": 10 <= len(digits) <= 15,
            }[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def noise(n=500):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x@y.org", ".", "-", " ", "1", "25", "255", "256", "10.0.0.1", "+1 (202) 555-0100", "4111 1111 1111 1111", "+", "(", ")", "é", "中", "\U0001f600", "0", "378282246310005", "%", "\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_base_spans_are_the_patterns(spark, tmp_path):
    pairs = [(i, t) for i, t in ODD if not t or len(t) < 1000] + list(enumerate(noise(), 100))
    docs(spark, pairs).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op9_pii"](spark, str(tmp_path)).collect()
    want = []
    for i, t in pairs:
        spans = brute(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, *(sum(s[0] == k for s in spans) for k in pii.KINDS[:4]), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted(want, key=str)
    for r in rows:
        listed = [s.split(":") for s in r.spans.split(",") if s]
        assert [int(s[1]) for s in listed] == sorted(int(s[1]) for s in listed)


def corpus():
    rng = random.Random(4)
    pairs = [(k, " ".join(rng.choice("red green blue happy little house river cloud".split()) for _ in range(30))) for k in range(80)]
    pairs += [(200 + k, f"case {k} {' '.join(rng.sample('red green blue cloud'.split(), 4))} Zelda Quimby zq@mail.org wrote {k} red") for k in range(5)]
    return pairs + [(300, "zq@mail.org blue"), (301, None), (None, "")]


def brute_terms(pairs):
    """Terms of texts with a value that reveal it, by the module's formulas over distinct texts."""
    both, value_in, term_in, distinct = {}, {}, {}, {(t or "") for _, t in pairs} | {None for _, t in pairs if t is None}
    for t in distinct:
        spans = brute(t)
        for w in set(re.findall(r"[^\W\d_]{3,}", (t or "").lower())):
            term_in[w] = term_in.get(w, 0) + 1
        free = {m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", t or "") if not any(a < m.end() and m.start() < b for _, a, b in spans)}
        for v in {(kind, t[a:b].lower()) for kind, a, b in spans}:
            value_in[v] = value_in.get(v, 0) + 1
            for w in free:
                both[v, w] = both.get((v, w), 0) + 1
    n = len(distinct)
    return {w for (v, w), k in both.items() if k >= 3 and math.log2(n * k / (value_in[v] * term_in[w])) >= 0.95 * math.log2(n / value_in[v]) - 1e-9}


def test_terms_that_disclose(spark):
    pairs = corpus()
    found = pii.find_personal_data(clashing(docs(spark, pairs), "rid", "start"))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "rid", "start", "base", "spans"]
    terms = {r.text[s.start : s.end].lower() for r in found.collect() for s in r.spans if s.kind == "term"}
    assert terms == brute_terms(pairs) == {"case", "zelda", "quimby", "wrote"}


def test_sanitising(spark):
    frame = docs(spark, corpus())
    clean = pii.sanitise(clashing(frame, "spans", "base", "kind"))
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == [*frame.columns, "spans", "base", "kind"]
    assert {(r.spans, r.base, r.kind) for r in clean.collect()} == {("clash",) * 3}
    assert "[TERM] [TERM] [EMAIL]" in rows[200] and rows[300] == "[EMAIL] blue" and rows[301] is None
    assert all(rows[k] == t for k, t in corpus()[:80])


@pytest.mark.parametrize("rows", [pii.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("most", [pii.MOST_TERMS, 7])
def test_odd_and_long_texts(spark, monkeypatch, rows, most):
    """Nulls, empty and very long texts, repeated rows and null ids, with values that many texts share."""
    monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(pii, "MOST_TERMS", most)
    odd = [(i, t if not t or " " in t else t[:3000]) for i, t in ODD]  # the pattern itself takes squares of a word's length
    pairs = odd + [(400 + k, f"{t} q@r.st 10.0.0.1") for k, (_, t) in enumerate(odd)] + corpus()
    found = pii.find_personal_data(docs(spark, pairs)).collect()
    assert sorted((str(r.doc_id), r.text or "", [tuple(s) for s in r.base]) for r in found) == sorted((str(i), t or "", brute(t)) for i, t in pairs)
    terms = {r.text[s.start : s.end].lower() for r in found for s in r.spans if s.kind == "term"}
    assert terms == brute_terms(pairs)


def test_empty(spark):
    assert pii.find_personal_data(docs(spark, [])).count() == pii.sanitise(docs(spark, [])).count() == 0


def far_terms():
    """A name that stands far from its address, in a letter head and in the text."""
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice("red green blue happy little house river cloud".split()) for _ in range(n))
    pairs = [(k, filler(30)) for k in range(80)]
    return pairs + [(200 + k, f"Quimby {filler(20)} quimby's {filler(12)} zq@mail.org {filler(9)}") for k in range(5)]


def test_terms_anywhere_in_the_text(spark):
    pairs = far_terms()
    found = pii.find_personal_data(docs(spark, pairs)).collect()
    marked = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == "term"] for r in found}
    assert marked == {i: ["Quimby", "quimby"] * (i >= 200) for i, _ in pairs}
    assert all("quimby" not in r.text.lower() for r in pii.sanitise(docs(spark, pairs)).collect())


def test_query_and_pipeline_mark_terms_far_away(spark, tmp_path):
    import corpus_pipeline

    frame = docs(spark, far_terms())
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    assert sum("term:" in r.spans for r in QUERIES["op9_pii"](spark, str(tmp_path)).collect()) == 5
    assert all("quimby" not in r.text.lower() for r in corpus_pipeline.remove_personal_data(spark, frame, str(tmp_path)).collect())


@pytest.mark.parametrize("rows", [pii.BROADCAST_ROWS, 0])
def test_copies_count_once(spark, monkeypatch, rows):
    """Copies with other ids and whole rows that repeat; terms broadcast or joined."""
    monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
    rng = random.Random(6)
    filler = lambda n: " ".join(rng.choice("red green blue happy little house river cloud".split()) for _ in range(n))
    pairs = [(k, filler(30)) for k in range(100)] + [(200 + k, f"{filler(9)} Quimby zq@mail.org {filler(9)}") for k in range(3)]
    pairs += [(1000 + k // 2, pairs[-1][1]) for k in range(50)] + [(1, pairs[1][1])] * 3
    found = pii.find_personal_data(docs(spark, pairs)).collect()
    marked = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == "term"] for r in found}
    assert marked == {i: ["Quimby"] * (i >= 200) for i, _ in pairs}


@pytest.mark.parametrize("rows", [pii.BROADCAST_ROWS, 0])
def test_values_of_the_same_texts_are_counted_as_one(spark, monkeypatch, rows):
    """A list of addresses in a few texts: every term that discloses one discloses all, and is met once."""
    monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
    addresses = [f"user{k}@list.org" for k in range(40)]
    pairs = [(k, "red green blue house") for k in range(1)] + [(100 + k, f"red {' '.join(addresses)} Quimby green {k}") for k in range(4)]
    pairs += [(200 + k, f"word{k} blue {addresses[0]} Zelda") for k in range(3)] + [(300 + k, f"plain text number {'abcdefgh'[k]}") for k in range(8)]
    frame = docs(spark, pairs)
    found = pii.find_personal_data(frame).collect()
    terms = {r.text[s.start : s.end].lower() for r in found for s in r.spans if s.kind == "term"}
    assert terms == brute_terms(pairs)
    keyed = frame.selectExpr("cast(doc_id as string) as rid", "hash(text) as rkey", "text as t")
    _, holding, led = pii._disclosing(keyed.withColumn("rkey", keyed.rkey.cast("bigint")), pii.ALPHA, pii.MIN_SUPPORT)
    assert max(len(r.held) for r in holding.collect()) == 2 and led.select("value").distinct().count() == 2 and led.count() == 40


def test_lists_of_addresses_take_time_by_length(spark):
    """Three texts of some 100 KB with the same addresses among as many words."""
    import time

    took = []
    for n in (250, 4000):
        text = " ".join(f"user{k}@list.org {''.join('abcdefghij'[int(d)] for d in str(1000 + k))}" for k in range(n))
        frame = docs(spark, [(k, f"{text} {'xyz'[k] * 3}") for k in range(3)]).cache()
        frame.count()
        began = time.perf_counter()
        spans = {r.doc_id: len(r.spans) for r in pii.find_personal_data(frame).collect()}
        took.append(time.perf_counter() - began)
        assert all(n <= x for x in spans.values())
    assert took[1] < 30 + 3 * took[0]
