import hashlib

import numpy as np
import pytest
import regex

from millrace.llm import fill_in_middle as M
from millrace.llm.queries import op11_fill_in_middle

from ..conftest import SF
from .data import ODD, clashing, docs

TOKEN = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text):
    """n, form, characters of prefix and middle, and output, word by word."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in M.MARKS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_bits_are_counted_and_found():
    rng = np.random.default_rng(3)
    for share in (0.001, 0.3, 1.0):
        bits = rng.random(20_000) < share
        vector, places = M.Bits(bits), np.flatnonzero(bits)
        at = np.arange(len(bits) + 1)
        assert (vector.rank(at) == np.append(0, np.cumsum(bits))).all()
        assert (vector.select(np.arange(1, len(places) + 1)) == places).all()


def test_odd_texts(spark):
    rows = [*ODD, *[(100 + k, t) for k, t in enumerate(["a <P> b", "<M", "<<S", "  x  ", " ", "日本 語　é\t\n", "a\x0bb\x0cc", "\x85x\xa0y"] * 6)]]
    out = M.rearrange(clashing(docs(spark, rows), "form", "n_tokens")).withColumn("back", M.restored("output", "form"))
    assert {"n_tokens", "lang", "text"} <= set(out.columns) and out.columns.count("form") == 1
    got = out.collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text) and r.back == (r.text or "")


def test_query_is_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_fill_in_middle(spark, SF).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert len(got) == len(texts)
    for r in got:
        *rest, output = by_hand(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == tuple(rest)
        assert (r.output_sha256, r.restored_sha256) == (sha(output), sha(texts[r.doc_id] or ""))


def test_marks_and_empty_frames(spark):
    for bad in (("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            M.rearrange(docs(spark, []), marks=bad)
    assert M.rearrange(docs(spark, [])).count() == 0
    everything = M.rearrange(docs(spark, [(k, "one two three") for k in range(30)]), rate=100, suffix_first=0, marks=("[p]", "[s]", "[m]"))
    assert {(r.form, r.back) for r in everything.withColumn("back", M.restored("output", "form", ("[p]", "[s]", "[m]"))).collect()} == {("psm", "one two three")}
