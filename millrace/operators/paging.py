"""Pages, searches and checks of parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_range(name: str, value: int, low: int, high: int | None = None) -> None:
    """Refuses a parameter outside its range before any plan is made."""
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be from {low} to {high}")


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """A page of rows; the order must end with a unique column. Plans as a top-k, not as a full sort."""
    check_range("limit", limit, 1, most)
    check_range("offset", offset, 0)
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_more(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> tuple[DataFrame, Column]:
    """A page, and an expression over it that tells whether the page is full."""
    return page(df, order, limit, offset), F.count("*") == limit


def search(df: DataFrame, q: str | None, columns: list[str]) -> DataFrame:
    """Rows where any column contains the text in any case; wildcards in it work.

    None and the empty text filter nothing. White space only matches all that is not null.
    """
    if not q:
        return df
    pattern = f"%{escaped(q.strip())}%"
    return df.where(reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in columns]))


def escaped(q: str) -> str:
    """A backslash before an ordinary character stands for that character alone."""
    out, k = [], 0
    while k < len(q):
        if q[k] == "\\":
            k += 1
            follow = q[k] if k < len(q) else "\\"
            out.append("\\" + follow if follow in "%_\\" else follow)
        else:
            out.append(q[k])
        k += 1
    return "".join(out)


def search_customers(customers: DataFrame, q: str | None) -> DataFrame:
    """By name, e-mail or phone."""
    return search(customers, q, ["name", "email", "phone"])


def search_products(products: DataFrame, q: str | None) -> DataFrame:
    """By name, brand or category."""
    return search(products, q, ["name", "brand", "category"])
