"""Tables that are written first: keys of concurrent requests, scores of a stream, buckets."""

import random
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

from pyspark.sql import functions as F

from millrace.operators import preferences, purchases, writes
from millrace.sources import bucketed
from millrace.sources.bridge import Domain
from millrace.sources.versions import Store
from millrace.streaming import scores as S

from .conftest import SF


def test_requests_get_keys_of_their_own(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with store.begin() as t:
        t.replace("customers", spark.createDataFrame([(41, "x")], "id bigint, name string"), ["id"])
    with ThreadPoolExecutor(4) as pool:
        starts = list(pool.map(lambda n: writes.reserve(store, "customers", n), [3, 1, 5, 2]))
    taken = sorted(k for s, n in zip(starts, [3, 1, 5, 2]) for k in range(s, s + n))
    assert taken == list(range(42, 53))
    assert writes.reserve(store, "other", 1) == 0 and writes.reserve(store, "other", 1) == 1
    rows = spark.createDataFrame([("b", None, None, True), ("a", None, None, True)], "name string, phone string, email string, marketing_opt_in boolean")
    new = writes.new_customers(store.read("customers"), rows, "2001-08-01 00:00:00", writes.reserve(store, "customers", 2))
    assert sorted((r.id, r.name) for r in new.collect()) == [(53, "a"), (54, "b")]


def test_scores_of_a_stream_take_back_what_changed(spark, tmp_path):
    rng = random.Random(3)
    kind = "item_id bigint, customer_id bigint, product_id bigint, feedback string, at int"
    links = spark.createDataFrame([(p, t, rng.choice([None, 0.0, 0.25, 1.5])) for p in range(8) for t in rng.sample(range(5), 2)], "product_id bigint, terpene_id int, percent double")
    store = Store(spark, str(tmp_path / "s"))
    S.create(store, spark.createDataFrame([], kind).drop("at"))
    owner = {k: (rng.randrange(4), rng.randrange(8)) for k in range(30)}
    now, at = {}, 0
    (tmp_path / "in").mkdir()
    for k in range(4):
        rows = []
        for _ in range(25):
            item, at = rng.randrange(30), at + 1
            now[item] = rng.choice(["like", "dislike", "neutral", None])
            rows.append((item, *owner[item], now[item], at))
        rng.shuffle(rows)
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = S.keep_scores(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), store, links).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        items = [(i, i, owner[i][1], f) for i, f in now.items()]
        domain = SimpleNamespace(
            purchases=spark.createDataFrame([(i, owner[i][0]) for i in now], "id bigint, customer_id bigint").withColumn("purchased_at", F.lit("2001-07-01").cast("timestamp_ntz")),
            purchase_items=spark.createDataFrame(items, "id bigint, purchase_id bigint, product_id bigint, feedback string"),
            product_terpenes=links, terpenes=spark.createDataFrame([(t, f"t{t}") for t in range(5)], "id int, name string"),
        )
        want = preferences.preference_scores(domain).drop("terpene")
        assert sorted(map(tuple, S.scores(store).collect())) == sorted(map(tuple, want.collect()))
    version = store.version()
    again = spark.read.parquet(str(tmp_path / "in"))
    assert not S.apply_batch(store, links, again, 3) and store.version() == version


def test_buckets_need_no_exchange(spark):
    d = bucketed.write(Domain(spark, SF), "bucket_test", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        totals = purchases.finalized(d)
        totals.collect()
        assert "Exchange" not in totals._jdf.queryExecution().executedPlan().toString()
        counts = preferences.purchase_counts(d)
        counts.collect()
        plan = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "SortMergeJoin" in plan and "Exchange" not in plan.split("SortMergeJoin", 1)[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop database bucket_test cascade")
