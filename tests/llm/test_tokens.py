import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe_codec, token_counts
from millrace.llm.queries import QUERIES

from .data import ODD, clashing, docs


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def noise(n=400):
    rng = random.Random(5)
    kinds = [
        lambda: chr(rng.randrange(32, 127)), lambda: rng.choice(" \n\t\r  \x85\x1c\x0b"), lambda: chr(rng.randrange(0xA1, 0x24F)),
        lambda: chr(rng.randrange(0x370, 0x1200)), lambda: chr(rng.randrange(0x4E00, 0x4F00)), lambda: chr(rng.randrange(0x1F300, 0x1F650)),
        lambda: rng.choice(["'s", "'ll", " the", "ing", "<|endoftext|>", "  ", "aaaa", "0000", "====", "²", "_"]),
    ]
    return ["".join(rng.choice(kinds)() for _ in range(rng.randrange(1, 80))) for _ in range(n)]


def test_codec_is_the_librarys(spark, library):
    pairs = ODD + list(enumerate(noise(), 100))
    frame = bpe_codec.decode(bpe_codec.encode(clashing(docs(spark, pairs), "token_ids", "decoded")))
    for row in frame.select("text", "token_ids", "decoded").collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert bytes(row.token_ids) == struct.pack(f"<{len(ids)}I", *ids), ascii((row.text or "")[:90])
        assert row.decoded == library.decode(ids, skip_special_tokens=False) == (row.text or "")


def test_counts_are_the_librarys(spark, library):
    pairs = ODD + list(enumerate(noise(), 100))
    for row in token_counts.count_tokens(clashing(docs(spark, pairs), "n_tokens", "n_bytes")).collect():
        assert row.n_tokens == len(library.encode(row.text or "", add_special_tokens=False).ids)
        assert row.n_bytes == len((row.text or "").encode())


def test_decoding_bytes_that_are_no_text(spark):
    frame = spark.createDataFrame([(bytearray(struct.pack("<3I", 158, 64, 999_999)),), (None,)], "token_ids binary")
    assert {r.decoded for r in bpe_codec.decode(frame).collect()} == {"�a", ""}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert bpe_codec.decode(bpe_codec.encode(none)).count() == token_counts.count_tokens(none).count() == 0


def test_queries(spark, library, tmp_path):
    docs(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op1_bpe_codec"](spark, str(tmp_path)).collect()
    want = set()
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert set(map(tuple, rows)) == want and len(rows) == len(ODD)
    rows = QUERIES["op5_token_counts"](spark, str(tmp_path)).collect()
    assert sorted((r.n_tokens, r.over_limit) for r in rows) == sorted((n, n > 512) for _, n, _, _ in [(i, len(library.encode(t or "", add_special_tokens=False).ids), 0, 0) for i, t in ODD])
