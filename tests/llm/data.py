"""Small frames for the tests of the text operators."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, pairs, lang=None):
    """Documents of (id, text) pairs, in two partitions."""
    rows = [(i, t, lang, None, None if t is None else len(t)) for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


#: Nulls, empty and long texts, ties and repeated rows.
ODD = [
    (1, None), (2, ""), (None, "no id here, really none"), (None, None), (3, "   \t\n"), (4, "word"), (5, "word"), (5, "word"), (5, "another word"),
    (6, "mail a.b@c.org or +1 202 555 0100, 10.0.0.1 and 4111 1111 1111 1111"), (7, "long words come " * 20_000), (8, "x" * 300_000),
    (9, "<|endoftext|> naïve café 中文 \U0001f600\U0001f468‍\U0001f469 ไทย \x00\x1f end"),
]


def clashing(df, *names):
    """The frame with columns that have an output's name."""
    for n in names:
        df = df.selectExpr("*", f"'clash' as `{n}`")
    return df
