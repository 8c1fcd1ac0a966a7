"""Purchases and their items stored in buckets by purchase, so that joins and sums of the two don't shuffle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .bridge import Domain
from .shared import shared_folder

#: Tables and the column that their rows are dealt by.
KEYS = {"purchases": "id", "purchase_items": "purchase_id"}
#: Items of a bucket, which one task sorts.
BUCKET_ROWS = 500_000


class Bucketed:
    """A domain whose purchases and items are bucketed tables; the rest is as it was."""

    def __init__(self, domain: Domain, database: str):
        self.domain, self.database = domain, database
        self.spark = domain.spark

    def __getattr__(self, name: str) -> DataFrame:
        if name in KEYS:
            return self.spark.table(f"{self.database}.{name}")
        return getattr(self.domain, name)


def write(domain: Domain, database: str, buckets: int | None = None) -> Bucketed:
    """Writes both tables in as many buckets, sorted by purchase, and gives the domain that reads them.

    All rows of a purchase are in one bucket, which is read by one task. If their number isn't given
    there is one a core, or more so that a bucket has about ``BUCKET_ROWS`` items.
    """
    if buckets is None:
        buckets = max(domain.spark.sparkContext.defaultParallelism, -(-domain.purchase_items.count() // BUCKET_ROWS))
    if not re.fullmatch(r"\w+", database):
        raise ValueError(f"not a name: {database}")
    spark, folder = domain.spark, f"{shared_folder(domain.spark)}/{database}"
    spark.sql(f"create database if not exists {database}")
    for name, key in KEYS.items():
        rows = getattr(domain, name)
        # dealt as the buckets are, so that each bucket is one file
        rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet").option("path", f"{folder}/{name}").saveAsTable(f"{database}.{name}")
    return Bucketed(domain, database)
