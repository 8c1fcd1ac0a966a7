"""Requests are folded without their documents."""

from pyspark.sql import functions as F

from millrace.operators import requests as Q
from millrace.sources.bridge import Domain

from .conftest import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stops_read_no_documents(spark):
    d = Domain(spark, SF)
    requests = d.products.select(F.floor(F.col("id") / 10).alias("request"), F.col("id").alias("pos"), F.col("id").alias("report_id"), F.lit(None).cast("bigint").alias("product_id"))
    after = Q.process_requests(d, requests, d.report_pages)
    for name in ("stops", "taken", "relinked", "lab_reports"):
        assert "confidence_notes" not in plan_of(after[name]) and "ExistingRDD" not in plan_of(after[name]), name
