"""Byte-pair vocabularies of the ``tokenizers`` JSON format, read on the driver and broadcast whole.

A vocabulary file is a fixed-size model file (a few MB), so its broadcast does not grow with data.
"""

from __future__ import annotations

import json
import re
from functools import cached_property

import regex

# The pattern whose pieces no merge crosses, and the white space that its \s stands for.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
SPACE = "\t-\r \x85\xa0  -     　"

#: Letters up to U+024F after one space at most: a single piece.
LATIN = re.compile(" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+")


def pieces_of(word: str) -> list[str]:
    """The pieces of one word; Latin letters after one space at most are a single piece."""
    return [word] if LATIN.fullmatch(word) else PIECES.findall(word)


#: Largest vocabulary file that is broadcast.
MOST_BYTES = 64 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Vocabulary:
    """Symbols, merges and special tokens of one byte-level BPE file."""

    def __init__(self, text: str):
        whole = json.loads(text)
        model = whole["model"]
        pre = whole.get("pre_tokenizer") or {}
        if (
            model.get("type") != "BPE"
            or pre.get("type") != "ByteLevel"
            or not pre.get("use_regex")
            or pre.get("add_prefix_space")
            or whole.get("normalizer")
            or model.get("ignore_merges")
        ):
            raise ValueError("only plain byte-level BPE files are supported")
        back = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = model["vocab"]
        self.token_bytes: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.byte_ids = [vocab[c] for c in byte_alphabet()]
        #: pair of ids -> (rank, id of the merged symbol); id -> (left, right, rank)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, out = vocab[a], vocab[b], vocab[a + b]
            if out in self.made:
                raise ValueError(f"two merges make the token {out}")
            self.pairs[left, right] = (rank, out)
            self.made[out] = (left, right, rank)
        self.specials: dict[str, int] = {}
        for token in whole.get("added_tokens") or []:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError("special tokens that look at their surroundings are not supported")
            self.specials[token["content"]] = token["id"]
            self.token_bytes[token["id"]] = token["content"].encode()

    def forget_merges(self) -> None:
        """Drops the merges, for those who hold them in a form of their own."""
        self.pairs, self.made = {}, {}

    @cached_property
    def special_pattern(self) -> regex.Pattern | None:
        """Splits a text at special tokens, the longest first."""
        if not self.specials:
            return None
        longest = sorted(self.specials, key=lambda s: (-len(s), s))
        return regex.compile("(" + "|".join(map(regex.escape, longest)) + ")")

    def parts(self, text: str) -> list[str]:
        """Ordinary texts at even places, special tokens between them."""
        if self.special_pattern is None or not any(s in text for s in self.specials):
            return [text]
        return self.special_pattern.split(text)


def read_vocabulary(path: str) -> str:
    """The file's content, of a checked size, for a broadcast."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MOST_BYTES + 1)
    if len(text) > MOST_BYTES:
        raise ValueError(f"{path} is over {MOST_BYTES} characters")
    return text
