import random

import public_tokenizers
import pytest

from millrace.llm import bpe_codec, pii
from millrace.llm.vocabulary import Vocabulary, read_vocabulary

from .data import ODD, docs


@pytest.mark.parametrize("rows", [pii.BROADCAST_ROWS, 0])
def test_texts_are_sanitised_in_one_pass(spark, monkeypatch, rows):
    """A task of the last step has one Python operator, so one worker; its texts are those of the spans."""
    monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
    rng = random.Random(5)
    words = "red green blue cloud river".split()
    pairs = ODD + [(200 + k, f"{' '.join(rng.sample(words, 4))} Zelda Quimby zq@mail.org, 1.2.3.4+1 202 555 0100 {k}") for k in range(5)]
    frame = docs(spark, pairs + [(300 + k, " ".join(rng.sample(words, 4))) for k in range(40)])
    clean = pii.sanitise(frame)
    assert clean._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert clean.schema["text"].dataType == frame.schema["text"].dataType and clean.columns == frame.columns
    want = []
    for r in pii.find_personal_data(frame).collect():
        out, at = "", 0
        for s in r.spans:
            if s["start"] >= at:
                out += r.text[at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        want.append((r.doc_id, r.text and out + r.text[at:]))
    got = sorted(((r.doc_id, r.text) for r in clean.collect()), key=str)
    assert got == sorted(want, key=str) and any("[TERM]" in (t or "") for _, t in got)


def test_an_encoder_needs_no_merges_of_the_vocabulary():
    whole = Vocabulary(read_vocabulary(public_tokenizers.path(bpe_codec.DEFAULT_VOCABULARY)))
    texts = [t for _, t in ODD if t] + ["".join(random.Random(9).choice("abcdeé  中1.'s") for _ in range(2000))]
    want = [bpe_codec.Encoder(whole).packed(t) for t in texts]
    encoder = bpe_codec.Encoder(whole)
    whole.forget_merges()
    assert not whole.pairs and not whole.made
    assert [encoder.packed(t) for t in texts] == want
