"""New pieces of many texts are encoded side by side, with the library's ids."""

import random
import struct

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from millrace.llm import bpe_codec
from millrace.llm.vocabulary import LATIN, Vocabulary, read_vocabulary

from .data import ODD


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(read_vocabulary(public_tokenizers.path(bpe_codec.DEFAULT_VOCABULARY)))


def made_up(n, rng):
    """Words of syllables, which hardly repeat, in several scripts and with marks between them."""
    parts = ["en", "the", "ing", "Sch", "é", "ção", "ñ", "中文", "ไทย", "\U0001f600", "'ll", "--", "17", "²", "\x00", "  ", "\n", "qzx", "aaaa", "ƿ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def library(texts):
    t = Tokenizer.from_file(public_tokenizers.path(bpe_codec.DEFAULT_VOCABULARY))
    t.no_truncation()
    t.no_padding()
    return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_no_short_piece_is_worked_on_alone(vocabulary, monkeypatch):
    alone = []
    one = bpe_codec.Encoder._piece
    monkeypatch.setattr(bpe_codec.Encoder, "_piece", lambda self, piece: alone.append(piece) or one(self, piece))
    words = [w for w in made_up(6000, random.Random(3))]
    text = " ".join(words)
    encoder = bpe_codec.Encoder(vocabulary)
    assert encoder.packed(text) == library([text])[0]
    assert all(len(piece) > bpe_codec.LONGEST_WORD for piece in alone)


@pytest.mark.parametrize("most_words, most_pieces", [(bpe_codec.MOST_WORDS, bpe_codec.MOST_PIECES), (300, 64), (20, 7)])
def test_ids_are_the_librarys_however_little_is_remembered(vocabulary, monkeypatch, most_words, most_pieces):
    monkeypatch.setattr(bpe_codec, "SIDE_BY_SIDE", 9000)
    monkeypatch.setattr(bpe_codec, "MOST_PIECES", most_pieces)
    monkeypatch.setattr(bpe_codec, "FEW", 5)
    rng = random.Random(4)
    texts = [t or "" for _, t in ODD] + [" ".join(made_up(rng.randrange(200), rng)) for _ in range(60)]
    texts += ["x<|endoftext|>" + " ".join(made_up(500, rng)) + " <|endoftext|><|endoftext|>", "y" * 49, " " * 200, ""]
    encoder = bpe_codec.Encoder(vocabulary, most_words, 64)
    want = library(texts)
    assert encoder.all_packed(texts) == want == encoder.all_packed(texts)
    assert len(encoder.words) <= max(most_words, 9000) and encoder.all_packed([]) == []


def test_latin_letters_are_letters():
    letter = regex.compile(r"\p{L}")
    for code in range(0x300):
        assert bool(LATIN.fullmatch(chr(code))) == (code < 0x250 and bool(letter.fullmatch(chr(code))))
    assert LATIN.fullmatch(" naïve") and not LATIN.fullmatch("  a") and not LATIN.fullmatch(" ") and not LATIN.fullmatch("")
