"""What batches of a stream read is made once."""

from pyspark.sql import functions as F

from millrace.plans import QUERIES
from millrace.sources.versions import Store
from millrace.streaming import scores as S

from .conftest import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_of_a_batch_are_made_once(spark, tmp_path, monkeypatch):
    made, rows = [], [(k, k % 3, k % 5, "like") for k in range(40)]
    items = spark.createDataFrame(rows, "item_id int, customer_id int, product_id int, feedback string")
    links = spark.createDataFrame([(p, t, 0.1) for p in range(5) for t in range(2)], "product_id int, terpene_id int, percent double")
    store = Store(spark, str(tmp_path / "s"))
    S.create(store, items)
    upsert = S.Store.begin(store).__class__.upsert
    monkeypatch.setattr(S.Store.begin(store).__class__, "upsert", lambda self, name, df, **more: (made.append((name, df)), upsert(self, name, df, **more))[1])
    S.apply_batch(store, links, items.withColumn("at", F.lit(0)), 0)
    changed = items.where("item_id < 9").withColumns({"feedback": F.lit("dislike"), "at": F.lit(1)})
    S.apply_batch(store, links, changed, 1)
    optimized = [df._jdf.queryExecution().optimizedPlan().toString() for name, df in made if name == S.SUMS][-1]
    assert optimized.count("Union") == 3  # of either table and its log, and of what is taken back and what is added
    want = {}
    for k, customer, product, _ in rows:
        for t in range(2):
            s, likes, dislikes = want.get((customer, t), (0, 0, 0))
            bad = k < 9
            want[customer, t] = (s + (-1000 if bad else 1000), likes + (not bad), dislikes + bad)
    assert {(r.customer_id, r.terpene_id): (round(r.score * 10_000), r.likes, r.dislikes) for r in S.scores(store).collect()} == want


def test_stream_items_are_numbered_once(spark, monkeypatch):
    seen, first = [], S.apply_batch
    monkeypatch.setattr(S, "apply_batch", lambda store, links, changes, batch, *more: (seen.append(plan_of(changes)), first(store, links, changes, batch, *more))[1])
    QUERIES["stream_scores"](spark, SF)
    assert len(seen) == 4 and not any("Window" in p for p in seen)
