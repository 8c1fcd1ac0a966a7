"""An extension: feedback as a stream that keeps preference scores up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_changes(feedback: DataFrame, links: DataFrame, late: str = "1 day") -> DataFrame:
    """Signed percents by day, customer and attribute of a stream (at, customer_id, product_id, feedback).

    The watermark bounds the state; links are a static side.
    """
    sign = F.when(F.col("feedback") == "like", 1).when(F.col("feedback") == "dislike", -1).otherwise(0)
    weight = F.round(F.coalesce("percent", F.lit(0.10)) * 10_000).cast("bigint")
    return (
        feedback.withWatermark("at", late).join(links, "product_id")
        .groupBy(F.window("at", "1 day"), "customer_id", "terpene_id").agg((F.sum(sign * weight) / 10_000.0).alias("score"))
        .select(F.col("window.start").alias("day"), "customer_id", "terpene_id", "score")
    )
