"""The index of substrings against the plain search."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import paging, substrings

COLUMNS = ["name", "note"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abCΣİ%_\\é 1") for _ in range(rng.randrange(0, 12)))
    rows = [(k, rng.choice([None, "", word(), f"common {word()}"]), rng.choice([None, word()])) for k in range(600)] + [(600, "needle in here", None), (601, "x", "NEEDLE")]
    df = spark.createDataFrame(rows, "id bigint, name string, note string")
    folder = str(tmp_path_factory.mktemp("index") / "i")
    substrings.build(df, "id", COLUMNS, folder, 50)
    return df, folder


@pytest.mark.parametrize("q", ["needle", "NEEDLE", "eed_e", "need%here", "common", "abC", "bc", "a", "  ", "", None, "%%%", "\\%", "a\\_b", "İab", "aΣ", "é 1", "nowhere", "common ab", "on%é", "\\c\\o\\m", "needle\\"])
def test_same_as_plain_search(spark, indexed, q):
    df, folder = indexed
    want = sorted(r.id for r in paging.search(df, q, COLUMNS).collect())
    assert sorted(r.id for r in substrings.find(spark, folder, q, COLUMNS).collect()) == want


def test_few_rows_are_read(spark, indexed):
    df, folder = indexed
    rows = substrings.parts_with(spark, folder, "needle")
    assert rows.count() <= 110  # of 602, in the parts that have them
    assert substrings.parts_with(spark, folder, "nowhere").count() == 0
    assert substrings.parts_with(spark, folder, "ab").count() == df.count()
    assert {k for r in substrings.candidates(spark, folder, "needle").collect() for k in r["keys"]} == {600, 601}


def test_postings_are_bounded_by_parts(spark, indexed):
    _, folder = indexed
    posted = spark.read.parquet(f"{folder}/postings")
    assert posted.agg(F.max(F.size("keys"))).first()[0] <= 75
    assert posted.groupBy("piece", "part").count().where("count > 1").isEmpty()


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "none")
    substrings.build(spark.createDataFrame([], "id bigint, name string, note string"), "id", COLUMNS, folder)
    assert substrings.find(spark, folder, "abc", COLUMNS).count() == 0 == substrings.find(spark, folder, "", COLUMNS).count()
