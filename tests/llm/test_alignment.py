import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from millrace.llm import alignment as A
from millrace.llm.common import Tables
from millrace.llm.queries import op13_alignment

from ..conftest import SF
from .data import ODD, clashing, docs


@pytest.fixture(scope="module")
def libraries():
    first = tokenizers.Tokenizer.from_file(public_tokenizers.path(A.FIRST))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(A.SECOND))


def by_hand(libraries, text):
    """Groups of (A ids, B ids) of a text, by the ends that both have."""
    first, second = libraries
    if not text:
        return []
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    raw_a = [A.Vocabulary(A.read_vocabulary(public_tokenizers.path(A.FIRST))).token_bytes] if not hasattr(by_hand, "table") else None
    by_hand.table = raw_a[0] if raw_a else by_hand.table
    of_a = [by_hand.table[i] for i in a]
    of_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def expected(libraries, rows):
    """Contract columns of (id, text) rows."""
    grouped = [(i, by_hand(libraries, t)) for i, t in rows]
    links = [Counter((x, y) for ga, gb in groups for x, times in Counter(ga).items() for y in gb for _ in range(times)) for _, groups in grouped]
    documents = Counter(pair for c in links for pair in c)
    highest = defaultdict(int)
    for (x, _), n in documents.items():
        highest[x] = max(highest[x], n)
    out = []
    for (i, groups), c in zip(grouped, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for (x, y), n in c.items() if documents[x, y] == highest[x])
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(c.values()), best, sum(n * documents[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


TEXTS = [*ODD[:10], *ODD[12:], (20, "x▁y"), (21, "<s> </s> <unk> <0x41> <|endoftext|>"), (22, "naïve café 中文字 🙂🙂‍ 12345 ﬁ \x00"), (23, " \n\n  two  spaces\t"), (24, "word"), (25, "The word, the Word; words")]


def statistics(spark, rows, most):
    """All columns of the links' statistics, with at most so many counts sent to the workers."""
    tables = Tables(spark)
    n = A.sizes()
    aligned = tables.write(A.align(docs(spark, rows)).drop("text"))
    return A.count_links(aligned, tables.write(A.pair_counts(aligned, *n)), *n, most)


@pytest.mark.parametrize("most", [A.MOST_KNOWN, 40, 0])
def test_counts_are_brute_force(spark, libraries, most):
    got = statistics(spark, TEXTS, most).collect()
    rows = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in got]
    assert sorted(rows, key=str) == expected(libraries, TEXTS)


def test_groups_of_very_many_tokens():
    aligner = A.Aligner(A.First(A.read_vocabulary(public_tokenizers.path(A.FIRST))), A.Second(A.read_model(public_tokenizers.path(A.SECOND))))
    a, b = np.array([5, 6] * 3000 + [7]), np.array([8] * 4000 + [9, 7])
    keys, links = aligner.pairs(a, b, np.array([0, 6000, 6001]), np.array([0, 4001, 4002]), np.array([0, 0]))
    pair = lambda x, y: x * aligner.n_b + y
    assert dict(zip(keys.tolist(), links.tolist())) == {pair(5, 8): 3000 * 4000, pair(5, 9): 3000, pair(6, 8): 3000 * 4000, pair(6, 9): 3000, pair(7, 7): 1}
    assert (A.read_links(A.packed_links(links), len(links)) == links).all() and (A.read_links(A.packed_links(links[1:2]), 1) == links[1:2]).all()


def test_long_texts(libraries):
    aligner = A.Aligner(A.First(A.read_vocabulary(public_tokenizers.path(A.FIRST))), A.Second(A.read_model(public_tokenizers.path(A.SECOND))))
    for text in ("x" * 300_000, "long words come " * 20_000, "\n" * 150_000 + "end", "ab" * 100_000):
        groups = by_hand(libraries, text)
        n_a, n_b, n_groups, n_links, written, *_ = aligner.aligned([text])[0]
        assert (n_a, n_b, n_groups, n_links) == (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(len(x) * len(y) for x, y in groups))
        assert written == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def test_other_columns_stay_and_empty_frames(spark):
    out = A.link_statistics(clashing(docs(spark, [(1, "a b")]), "groups", "n_best", "more"))
    row = out.first()
    assert out.columns.count("groups") == 1 and row.more == "clash" and row.n_best == row.n_links > 0 and "text" not in out.columns
    assert A.link_statistics(docs(spark, [])).count() == 0


def test_query_is_brute_force(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    names = ["doc_id", *A.COUNTS[:4], "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in op13_alignment(spark, SF).collect()), key=str) == expected(libraries, rows)
