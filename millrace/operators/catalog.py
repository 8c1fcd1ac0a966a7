"""Products with their attributes nested, one by one, by batch and by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paging import check_range, page, search_products

MOST_BATCH = 100


def nested(ids: DataFrame, links: DataFrame, dimension: DataFrame, key: str, fields: list[str], out: str) -> DataFrame:
    """(product_id, out): attributes of each given product as an array by name; none gives an empty array.

    The dimension is a list of a few names, and Catalyst broadcasts it by its statistics; links are
    cut to the given products before they are grouped.
    """
    own = links.join(ids, "product_id", "left_semi").join(dimension.withColumnRenamed("id", key), key)
    arrays = own.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))
    kind = arrays.schema[out].dataType
    return ids.join(arrays, "product_id", "left").withColumn(out, F.coalesce(out, F.array().cast(kind)))


def with_attributes(page_of: DataFrame, domain) -> DataFrame:
    """Adds both attribute arrays to a page of products."""
    ids = page_of.select(F.col("id").alias("product_id"))
    t = nested(ids, domain.product_terpenes, domain.terpenes, "terpene_id", ["name", "percent"], "terpenes")
    c = nested(ids, domain.product_cannabinoids, domain.cannabinoids, "cannabinoid_id", ["name", "family", "percent"], "cannabinoids")
    return page_of.join(t.withColumnRenamed("product_id", "id"), "id").join(c.withColumnRenamed("product_id", "id"), "id")


def catalog_nested(domain, q: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of all products, newest first: the page is chosen before its children are joined."""
    newest = [F.desc("created_at"), F.desc("id")]
    rows = page(search_products(domain.products, q), newest, limit, offset)
    return with_attributes(rows, domain).orderBy(*newest).drop("created_at")


def portal_products(domain, q: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of active products by name."""
    rows = page(search_products(domain.products.where("is_active"), q), [F.asc("name"), F.asc("id")], limit, offset)
    return with_attributes(rows, domain).orderBy("name", "id").drop("created_at", "is_active")


def product_detail(domain, product_id: int, active_only: bool = False) -> DataFrame:
    """One product with its attributes, or nothing."""
    row = domain.products.where(F.col("id") == product_id)
    row = row.where("is_active").drop("is_active") if active_only else row
    return with_attributes(row.drop("created_at"), domain)


def batch_attributes(domain, ids: list[int], family: bool = False) -> DataFrame:
    """Attributes of up to 100 asked products; each asked product is there, known or not."""
    check_range("number of ids", len(ids), 1, MOST_BATCH)
    asked = domain.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "product_id bigint")
    if family:
        return nested(asked, domain.product_cannabinoids, domain.cannabinoids, "cannabinoid_id", ["name", "family", "percent"], "cannabinoids")
    return nested(asked, domain.product_terpenes, domain.terpenes, "terpene_id", ["name", "percent"], "terpenes")


def later_wins(maps: list[DataFrame], key: str) -> DataFrame:
    """Frames of one shape as one with a row a key; of a key that comes more than once the last frame's row holds."""
    every = maps[0].withColumn("__pos", F.lit(0))
    for pos, more in enumerate(maps[1:], 1):
        every = every.unionByName(more.withColumn("__pos", F.lit(pos)))
    others = [c for c in maps[0].columns if c != key]
    return every.groupBy(key).agg(F.max_by(F.struct(*others), "__pos").alias("__row")).select(key, *[F.col(f"__row.{c}").alias(c) for c in others])
