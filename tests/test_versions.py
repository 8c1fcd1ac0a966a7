"""Versions of tables: writers from one base, readers, and changes of single rows."""

import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from millrace.sources import versions as V


@pytest.fixture
def store(spark, tmp_path):
    out = V.Store(spark, str(tmp_path / "shop"))
    with out.begin() as t:
        t.replace("a", spark.range(100).select("id", F.lit("old").alias("x")), ["id"])
        t.replace("b", spark.range(5).select("id", F.lit(0).alias("n")), ["id"])
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_one_of_two_writers_fails(spark, store):
    first, second, third = store.begin(), store.begin(), store.begin()
    for k, t in enumerate((first, second)):
        t.upsert("a", spark.createDataFrame([(1, f"w{k}")], "id bigint, x string"))
    third.upsert("b", spark.createDataFrame([(9, 9)], "id bigint, n int"))
    assert first.commit() == 2
    with pytest.raises(V.Conflict, match="version 2 changed a"):
        second.commit()
    assert third.commit() == 3  # another table: it takes the next number
    assert store.numbers() == [1, 2, 3] and store.read("a").where("id = 1").first().x == "w0" and store.read("b").count() == 6
    assert not os.path.exists(f"{store.folder}/{second.here}")


def test_what_was_read_counts(spark, store):
    reader, writer = store.begin(), store.begin()
    n = reader.read("a").count()
    reader.replace("b", spark.createDataFrame([(n, 1)], "id bigint, n int"))
    writer.delete("a", spark.range(3))
    assert writer.commit() == 2
    with pytest.raises(V.Conflict):
        reader.commit()


def test_writers_at_the_same_time(spark, store):
    def write(k):
        t = store.begin()
        t.upsert("a", spark.createDataFrame([(200 + k, "new")], "id bigint, x string"))
        try:
            return t.commit()
        except V.Conflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        got = [n for n in pool.map(write, range(6)) if n]
    assert len(got) == len(set(got)) and store.numbers() == [1, *sorted(got)]
    assert store.read("a").where("id >= 200").count() == len(got) >= 1


def test_readers_keep_their_version(spark, store):
    before = store.read("a", 1)
    with store.begin() as t:
        t.replace("a", spark.createDataFrame([(1, "only")], "id bigint, x string"))
    assert before.count() == store.read("a", 1).count() == 100 and store.read("a").count() == 1
    t = store.begin()
    t.upsert("a", spark.createDataFrame([(2, "mine")], "id bigint, x string"))
    assert t.read("a").count() == 2 and store.read("a").count() == 1  # not seen before the commit
    t.roll_back()
    with pytest.raises(Exception, match="no"), store.begin() as t:
        t.upsert("b", spark.createDataFrame([(1, 1)], "id bigint, n int"))
        t.replace("a", spark.range(1).select("id", F.raise_error(F.lit("no")).cast("string").alias("x")))
    assert store.version() == 2 and store.read("b").count() == 5


def test_a_change_writes_its_rows_only(spark, store):
    with store.begin() as t:
        some = t.rows("a", spark.range(10, 20)).withColumn("x", F.lit("new"))
        assert "In(id" in some._jdf.queryExecution().executedPlan().toString()
        t.upsert("a", some)
    entry = store.tables()["a"]
    assert entry["parts"] == store.tables(1)["a"]["parts"] and [log["rows"] for log in entry["logs"]] == [10]
    assert spark.read.parquet(f"{store.folder}/{entry['logs'][0]['path']}").count() == 10
    assert rows(store.read("a")) == [(k, "new" if 10 <= k < 20 else "old") for k in range(100)]


def test_changes_are_brute_forces(spark, store):
    rng, want = random.Random(2), {k: "old" for k in range(100)}
    for step in range(25):
        with store.begin() as t:
            for _ in range(rng.randrange(1, 3)):
                keys = rng.sample(range(120), rng.randrange(1, 9))
                if rng.random() < 0.3:
                    t.delete("a", spark.createDataFrame([(k,) for k in keys * 2], "id bigint"))
                    want = {k: x for k, x in want.items() if k not in keys}
                else:
                    t.upsert("a", spark.createDataFrame([(f"s{step}", k) for k in keys], "x string, id bigint"))
                    want |= {k: f"s{step}" for k in keys}
    logs = store.tables()["a"]["logs"]
    assert rows(store.read("a")) == sorted(want.items()) and len(logs) <= V.MOST_LOGS
    with store.begin() as t:
        t.compact("a")
    assert rows(store.read("a")) == sorted(want.items()) and not store.tables()["a"]["logs"]


def test_keys_are_checked(spark, store):
    with store.begin() as t:
        t.append("a", spark.createDataFrame([(500, "x"), (501, "y")], "id bigint, x string"))
    assert store.read("a").count() == 102
    for bad in ([(500, "z")], [(600, "z"), (600, "z")]):
        with pytest.raises(ValueError, match="key"), store.begin() as t:
            t.append("a", spark.createDataFrame(bad, "id bigint, x string"))
    with pytest.raises(ValueError, match="twice"), store.begin() as t:
        t.upsert("a", spark.createDataFrame([(1, "z"), (1, "y")], "id bigint, x string"))
    assert store.read("a").count() == 102 and store.version() == 2


def test_old_versions_go(spark, store):
    for k in range(3):
        with store.begin() as t:
            t.replace("b", spark.createDataFrame([(k, k)], "id bigint, n int"))
    kept = store.read("a")
    store.expire(keep=1)
    assert store.numbers() == [4] and rows(store.read("b")) == [(2, 2)] and kept.count() == 100
    assert len(os.listdir(f"{store.folder}/data")) == 2  # the first one's, for a, and the last
