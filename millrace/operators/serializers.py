"""Rows as they leave the engine: ids as text, times in ISO-8601 or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_time


def _text(*ids: str) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in ids]


def customers_out(customers: DataFrame) -> DataFrame:
    """What is shown of a customer."""
    return customers.select(*_text("id"), "name", "phone", "email", "marketing_opt_in", iso_time("last_visit_at").alias("last_visit_at"), *_text("auth_user_id"))


def products_out(nested: DataFrame) -> DataFrame:
    """What is shown of a product; ``nested`` has its attributes as arrays."""
    return nested.select(*_text("id"), "name", "brand", "category", "is_active", "terpenes", "cannabinoids")


def purchases_out(purchases: DataFrame) -> DataFrame:
    """What is shown of a purchase."""
    return purchases.select(*_text("id", "customer_id"), iso_time("purchased_at").alias("purchased_at"), "total_amount_cents", "source", "external_id", "notes")


def items_out(items: DataFrame) -> DataFrame:
    """What is shown of an item; ``items`` has its product's name."""
    return items.select(*_text("id", "purchase_id", "product_id"), "product_name", "quantity", "line_amount_cents", "feedback", iso_time("feedback_at").alias("feedback_at"))
