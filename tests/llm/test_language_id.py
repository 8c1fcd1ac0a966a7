import numpy as np

from millrace.llm import language_id
from millrace.llm.queries import QUERIES

from ..conftest import SF
from .data import ODD, clashing, docs


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op8_language_id"](spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert len(held) > 10 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def brute(learnt, asked):
    """The language and score of texts by the module's formulas, gram by gram."""

    def grams(text):
        raw = [b if b >= 128 or chr(b).isalpha() else 32 for b in f"  {text.lower()}  ".encode()]
        out = []
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            h = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            out.append(h >> 17)
        return out

    # two more grams reach into the next text's first spaces, which the model counts too
    tail = [language_id.grams([""])[0][k] for k in (1, 2)]
    names = sorted({x for x, _ in learnt})
    counts = {x: np.zeros(language_id.FEATURES) for x in names}
    for x, t in learnt:
        for g in grams(t) + list(tail):
            counts[x][g] += 1
    total = {x: sum(c) + 0.5 * len(c) for x, c in counts.items()}
    share = {x: [(n + 0.5) / total[x] for n in c] for x, c in counts.items()}
    codes = language_id.codewords(len(names))
    bits = []
    for column in codes.T:
        ones, others = [[share[x] for x, b in zip(names, column) if b == s] for s in (1, -1)]
        w = np.log(np.mean(ones, axis=0)) - np.log(np.mean(others, axis=0))
        score = {x: sum(p * y for p, y in zip(share[x], w)) for x in names}
        low, high = max(score[x] for x, b in zip(names, column) if b < 0), min(score[x] for x, b in zip(names, column) if b > 0)
        bits.append((w - (low + high) / 2, max(1e-3, (high - low) / 2)))
    scale = sum(x for _, x in bits) / len(bits)
    out = []
    for t in asked:
        found = grams(t) + list(tail)
        n = max(1, len(found) - 3)
        loss = [sum(weight / scale * np.log1p(np.exp(-b * sum(w[g] for g in found) / n**0.5)) for b, (w, weight) in zip(code, bits)) for code in codes]
        odds = [np.exp(min(loss) - x) for x in loss]
        out.append((names[int(np.argmax(odds))], max(odds) / sum(odds)))
    return out


def test_model_is_brute_forces(spark):
    words = {"aa": "alpha beta gamma été", "bb": "beta delta rho über", "cc": "omega kappa alpha rho", "dd": "sigma tau gamma ñu"}
    learnt = [(x, " ".join(w.split()[(k * j) % 4] for j in range(6))) for k in range(5) for x, w in words.items()]
    frame = docs(spark, [])
    for x in words:
        frame = frame.unionByName(docs(spark, list(enumerate(t for y, t in learnt if y == x)), x))
    asked = ["alpha été", "über rho beta", "kappa omega 12 - kappa", "tau", "ñu sigma TAU", "neither of them"]
    rows = {r.doc_id: r for r in language_id.identify(docs(spark, list(enumerate(asked))), language_id.fit(frame)).collect()}
    for k, (language, score) in enumerate(brute(learnt, asked)):
        assert rows[k].lang_pred == language and abs(rows[k].score - score) < 1e-4


def test_rows_without_ids_are_drawn_like_others(spark):
    rows = docs(spark, [(None, f"some words {k}") for k in range(400)], "xx").unionByName(docs(spark, [(1, "other ones")], "yy"))
    model = language_id.fit(rows, rows_per_language=100)
    assert model.languages == ["xx", "yy"] and np.isfinite(model.odds).all()
    drawn = {x: language_id.fit(rows, rows_per_language=x).odds for x in (100, 10_000)}
    assert not np.array_equal(drawn[100], drawn[10_000]) and np.abs(drawn[100]).max() > 1


def test_odd_texts(spark):
    learnt = docs(spark, [(k, "the quick brown fox and the dog " * 3) for k in range(30)], "en").unionByName(
        docs(spark, [(100 + k, "der schnelle braune fuchs und der hund " * 3) for k in range(30)], "de")
    ).unionByName(docs(spark, [(None, None), (None, "x"), (1, "")], None))
    model = language_id.fit(learnt)
    assert model.languages == ["de", "en"]
    rows = language_id.identify(clashing(docs(spark, ODD), "score", "lang_pred"), model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text))
        assert 0 <= r.score <= 1 and not (r.lang_pred == "und" and r.ambiguous)


def test_no_and_one_language(spark):
    none = language_id.fit(docs(spark, []))
    assert {r.lang_pred for r in language_id.identify(docs(spark, ODD), none).collect()} == {"und"}
    one = language_id.fit(docs(spark, [(1, "hello there")], "en"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs(spark, [(1, "any"), (2, "12")]), one).collect()} == {("en", 1.0), ("und", 0.0)}
    assert language_id.identify(docs(spark, []), one).count() == 0


def test_training_leaves_out_what_is_not_asked_for(spark):
    rows = docs(spark, [(1, "aaa bbb")], "xx").unionByName(docs(spark, [(2, "ccc ddd")], "yy"))
    assert language_id.fit(rows, where=rows["doc_id"] == 1).languages == ["xx"]


def test_codewords_tell_all_languages_apart():
    for n in (2, 3, 5, 7, 8, 9, 20):
        c = language_id.codewords(n)
        assert len({tuple(x) for x in c}) == n
        columns = {tuple(x) for x in c.T} | {tuple(-x) for x in c.T}
        assert len(columns) == 2 * c.shape[1]


def test_close_languages_are_flagged(spark):
    a, b = docs(spark, [(k, "alpha beta gamma delta " * 4) for k in range(20)], "a"), docs(spark, [(50 + k, "omega sigma kappa theta " * 4) for k in range(20)], "b")
    c = docs(spark, [(90 + k, "lorem ipsum dolor sit " * 4) for k in range(20)], "c")
    model = language_id.fit(a.unionByName(b).unionByName(c))
    rows = {r.text: r for r in language_id.identify(docs(spark, [(1, "alpha beta gamma"), (2, "zzzz")]), model).collect()}
    assert not rows["alpha beta gamma"].ambiguous and rows["zzzz"].ambiguous
