import random

import corpus_pipeline

from .data import SCHEMA

WORDS = [c + v + d for c in "bdfgklmnprst" for v in "aeiou" for d in "lnrst"]


def test_stages_one_by_one(spark, tmp_path):
    rng = random.Random(7)
    prose = lambda n: [rng.choice(WORDS) for _ in range(n)]
    bench = " ".join(prose(30))
    rows, clean = [], []
    for k in range(60):
        rows.append((k, " ".join(prose(150)), "xx"))
        clean.append(k)
    for k in range(10):
        words = rows[k][1].split()
        words[rng.randrange(150)] = "changed"
        rows += [(100 + k, rows[k][1], "xx"), (200 + k, " ".join(words), "xx")]
        rows.append((300 + k, " ".join([*prose(40), *bench.split()[k : k + 15], *prose(40)]), "xx"))
        rows.append((400 + k, " ".join([*prose(80), f"reach me at user{k}@mail.org or +1 202 555 010{k}", *prose(80)]), "xx"))
    rows += [(500, None, None), (501, "", None), (502, "12 34 - 5", None), (None, None, None), (503, "  ", "xx")]
    frame = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], SCHEMA)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = frame, [set(clean) | {*range(100, 110), *range(200, 210), *range(300, 310), *range(400, 410)}]
    kept += [set(clean) | {*range(300, 310), *range(400, 410)}, set(clean) | {*range(400, 410)}] + [set(clean) | {*range(400, 410)}] * 2
    for (name, stage), want in zip(corpus_pipeline.STAGES, kept, strict=True):
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert {r.doc_id for r in docs.select("doc_id").collect()} == want, name
        if name != "bpe":
            assert docs.columns == frame.columns
        if name == "pii":
            texts = {r.doc_id: r for r in docs.collect()}
            assert all(texts[i].text == t for i, t, _ in rows if i in clean)
            assert all("@" not in r.text and "555" not in r.text and r.n_chars == len(r.text) for r in texts.values())
    assert docs.where("not round_trip or n_tokens = 0").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens").exceptAll(docs.select("doc_id", "n_tokens")).count() == 0


def test_clashing_columns_and_long_texts(spark, tmp_path):
    """Columns named like the operators' outputs come through all stages but the last; long texts are kept whole."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(k, prose(120), "xx", "s", None) for k in range(30)] + [(99, prose(60_000), "xx", "s", None)]
    names = ["score", "lang_pred", "ambiguous", "spans", "base", "fp", "component_id", "rid", "rkey", "token_ids", "items", "key"]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"concat('{n}-', doc_id) as `{n}`" for n in names])
    spark.createDataFrame([(1, prose(20))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == frame.columns, name
        got = {r.doc_id: r for r in docs.collect()}
        assert set(got) == {r[0] for r in rows} and got[99].text == rows[-1][1], name
        assert all(r[n] == f"{n}-{i}" for i, r in got.items() for n in names), name
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()}
    assert len(last) == 31 and all(r.round_trip and len(r.token_ids) == 4 * r.n_tokens for r in last.values())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
