"""Purchases: listings, histories, totals, item checks and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paging import check_range, page, search
from .writes import ITEM_RULES, add_items, check

# The filter takes only these, though rows can have another.
FILTER_SOURCES = ("manual", "pos_import")


def _newest():
    return [F.desc("purchased_at"), F.desc("id")]


def list_purchases(domain, q: str | None = None, source: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of purchases with their customer and their number of items, newest first.

    The page is taken before items are joined, so only the page's items are counted.
    """
    if source and source not in FILTER_SOURCES:
        raise ValueError(f"source must be one of {FILTER_SOURCES}")
    bought = domain.purchases.where(F.col("source") == source) if source else domain.purchases
    named = bought.join(
        domain.customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"), F.col("phone").alias("customer_phone")), "customer_id"
    )
    rows = page(search(named, q, ["customer_name", "customer_phone", "external_id"]), _newest(), limit, offset)
    counts = domain.purchase_items.join(rows.select(F.col("id").alias("purchase_id")), "purchase_id", "left_semi").groupBy("purchase_id").agg(F.count("*").alias("item_count"))
    return (
        rows.join(counts, F.col("id") == F.col("purchase_id"), "left")
        .withColumn("item_count", F.coalesce("item_count", F.lit(0)))
        .select("id", "customer_id", "purchased_at", "total_amount_cents", "source", "external_id", "customer_name", "customer_phone", "item_count")
        .orderBy(*_newest())
    )


def purchase_history(domain, customer_id: int, limit: int = 20, offset: int = 0, category: bool = False) -> DataFrame:
    """A page of one customer's purchases with their items nested; none gives an empty array."""
    rows = page(domain.purchases.where(F.col("customer_id") == customer_id), _newest(), limit, offset, most=100)
    names = domain.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), F.col("category").alias("product_category"))
    items = domain.purchase_items.join(rows.select(F.col("id").alias("purchase_id")), "purchase_id", "left_semi").join(names, "product_id", "left")
    fields = ["id", "purchase_id", "product_id", "product_name", *(["product_category"] if category else []), "quantity", "line_amount_cents", "feedback", "feedback_at"]
    lists = items.groupBy("purchase_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    return (
        rows.join(lists, F.col("id") == F.col("purchase_id"), "left")
        .withColumn("items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))
        .select("id", "purchased_at", "total_amount_cents", "source", "notes", "items")
        .orderBy(*_newest())
    )


def finalized(domain, purchase_id: int | None = None) -> DataFrame:
    """Purchases with the total recomputed from their lines: null lines and no lines count as 0."""
    rows, items = domain.purchases, domain.purchase_items
    if purchase_id is not None:
        rows, items = rows.where(F.col("id") == purchase_id), items.where(F.col("purchase_id") == purchase_id)
    sums = items.groupBy("purchase_id").agg(F.sum("line_amount_cents").alias("sum_cents"))
    return rows.join(sums, F.col("id") == F.col("purchase_id"), "left").withColumn("total_amount_cents", F.coalesce("sum_cents", F.lit(0)).cast("bigint")).drop("purchase_id", "sum_cents")


def order_previews(items: DataFrame) -> DataFrame:
    """What an order form shows: quantity times price, unlike the finalized total."""
    return items.groupBy("purchase_id").agg(F.sum(F.col("quantity") * F.coalesce("line_amount_cents", F.lit(0))).alias("preview_cents"))


def first_missing(items: DataFrame, products: DataFrame) -> DataFrame:
    """The first product in input order (``pos``) that isn't known; the batch then is refused whole."""
    unknown = items.join(products.select(F.col("id").alias("product_id")), "product_id", "left_anti")
    return unknown.agg(F.min_by("product_id", "pos").alias("product_id")).where("product_id is not null")


#: Items of one batch.
MOST_ITEMS = 100


def batch_items(domain, purchase_id: int, items: DataFrame, now: str = "2001-08-01 00:00:00") -> DataFrame:
    """Rows to append for one purchase, all or none, with their product's name, in the order of ``pos``.

    items: (pos, product_id, quantity, line_amount_cents, and if given external_id), 1 to 100 of them.
    Refused in this order: a line that breaks a rule, an unknown purchase, no items or too many, the
    first unknown product.
    """
    broken = check(items, ITEM_RULES)[1].orderBy("pos").select("pos", "broken").first()
    if broken:
        raise ValueError(f"line {broken['pos']}: {', '.join(broken['broken'])}")
    if domain.purchases.where(F.col("id") == purchase_id).isEmpty():
        raise ValueError(f"purchase {purchase_id} not found")
    check_range("items", items.limit(MOST_ITEMS + 1).count(), 1, MOST_ITEMS)
    missing = first_missing(items, domain.products).first()
    if missing:
        raise ValueError(f"product {missing[0]} not found")
    return add_items(domain, items.withColumn("purchase_id", F.lit(purchase_id).cast(domain.purchases.schema["id"].dataType)), now)


def apply_feedback(items: DataFrame, updates: DataFrame, now: str) -> DataFrame:
    """Items with feedback set (item_id, feedback); a null clears the feedback and its time."""
    given = updates.select(F.col("item_id").alias("id"), F.col("feedback").alias("given"), F.lit(True).alias("is_given"))
    joined = items.join(given, "id", "left")
    time = F.when(F.col("given").isNotNull(), F.lit(now).cast("timestamp_ntz"))
    return joined.select(
        "id", "purchase_id", "product_id",
        F.when(F.col("is_given"), F.col("given")).otherwise(F.col("feedback")).alias("feedback"),
        F.when(F.col("is_given"), time).otherwise(F.col("feedback_at")).alias("feedback_at"),
    )


def owned_item(domain, customer_id: int, item_id: int) -> DataFrame:
    """The item if it is the customer's, or nothing."""
    own = domain.purchases.where(F.col("customer_id") == customer_id).select(F.col("id").alias("purchase_id"))
    return domain.purchase_items.where(F.col("id") == item_id).join(own, "purchase_id", "left_semi")
