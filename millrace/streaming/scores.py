"""An extension: preference scores kept up to date by a stream of feedback, with what was said before taken back.

Each batch of the stream becomes one version of a store: the items' feedback, the sums that it
changes, and the batch's number. A batch that is run again finds its number and does nothing, so
every feedback counts once; an item that is rated again, or whose feedback is cleared, takes its
earlier weight back from the sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.preferences import DEFAULT_PERCENT
from ..sources.versions import Store

ITEMS, SUMS, BATCHES = "rated_items", "score_sums", "batches"
COUNTS = ("likes", "dislikes", "neutrals")


def create(store: Store, items: DataFrame) -> None:
    """Starts a store with items (item_id, customer_id, product_id, feedback) that have no sums yet, or none."""
    spark = store.spark
    with store.begin() as t:
        t.replace(ITEMS, items.limit(0), ["item_id"])
        t.replace(SUMS, spark.createDataFrame([], "customer_id bigint, terpene_id int, s bigint, likes bigint, dislikes bigint, neutrals bigint"), ["customer_id", "terpene_id"])
        t.replace(BATCHES, spark.createDataFrame([], "stream string, batch bigint"), ["stream"])


def _weights(items: DataFrame, links: DataFrame, sign: int) -> DataFrame:
    """What items add to the sums of their customer and product's attributes, or take away."""
    counts = [(F.lit(sign) * (F.col("feedback") == name.removesuffix("s")).cast("bigint")).alias(name) for name in COUNTS]
    percent = F.round(F.coalesce("percent", F.lit(DEFAULT_PERCENT)) * 10_000).cast("bigint")
    met = items.where("feedback is not null").join(links, "product_id").select("customer_id", "terpene_id", percent.alias("w"), *counts)
    return met.withColumn("s", (F.col("likes") - F.col("dislikes")) * F.col("w")).drop("w")


def apply_batch(store: Store, links: DataFrame, changes: DataFrame, batch: int, stream: str = "feedback") -> bool:
    """Applies one batch of changes (item_id, customer_id, product_id, feedback, at); False if it was applied before.

    Of several changes of an item the last by ``at`` holds; a null feedback clears it.
    """
    t = store.begin()
    done = t.read(BATCHES).where(F.col("stream") == stream).first()
    if done and done.batch >= batch:
        return False
    value = F.struct("customer_id", "product_id", "feedback")
    last = changes.groupBy("item_id").agg(F.max_by(value, F.struct("at", "feedback")).alias("x")).select("item_id", "x.*")
    t.upsert(ITEMS, last, once=True)
    new = store.spark.read.parquet(f"{store.folder}/{t.made[ITEMS]['logs'][-1]['path']}").drop("__gone")  # as it was written, once
    old = store.begin()  # the state before; the same base unless another writer came, which commit() finds
    before = old.rows(ITEMS, new)
    sums = _weights(before, links, -1).unionByName(_weights(new, links, 1)).groupBy("customer_id", "terpene_id").agg(*[F.sum(c).alias(c) for c in ("s", *COUNTS)])
    known = t.read(SUMS).withColumnsRenamed({c: f"known_{c}" for c in ("s", *COUNTS)})
    both = sums.join(known, ["customer_id", "terpene_id"], "left")  # the changes' sums are used once, so that they are made once
    after = both.select("customer_id", "terpene_id", *[(F.col(c) + F.coalesce(f"known_{c}", F.lit(0))).alias(c) for c in ("s", *COUNTS)])
    t.upsert(SUMS, after, once=True)
    t.upsert(BATCHES, store.spark.createDataFrame([(stream, batch)], "stream string, batch bigint"))
    t.commit()
    return True


def keep_scores(feedback: DataFrame, store: Store, links: DataFrame, stream: str = "feedback") -> DataStreamWriter:
    """A writer that applies a stream of changes batch by batch; it needs a checkpoint location and a trigger."""
    return feedback.writeStream.foreachBatch(lambda changes, batch: None if apply_batch(store, links, changes, batch, stream) else None)


def scores(store: Store, version: int | None = None) -> DataFrame:
    """(customer_id, terpene_id, score, likes, dislikes, neutrals) as ``preference_scores`` has them, without what nobody rates any more."""
    sums = store.read(SUMS, version).where(" + ".join(COUNTS) + " > 0")
    return sums.select("customer_id", "terpene_id", (F.col("s") / 10_000.0).alias("score"), *COUNTS)
