"""Seeded synthetic purchases and attribute links; a key's rows depend only on the key and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def _draw(low: int, high: int, seed: int, *keys: Column | str) -> Column:
    """A whole number from low to high, from a hash of the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys]), F.lit(high - low + 1)) + low).cast("int")


def numbered(df: DataFrame, key: str, out: str = "number") -> DataFrame:
    """Adds the place of each row in the order of the key, from 0 on, without one task for all.

    Rows are dealt by ranges of the key and sorted in them; a row's number is its place in its range
    and the rows of the ranges before, of which one number a range comes to the driver.
    """
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("__range", F.shiftrightunsigned("__at", 33).cast("int")))
    counts = {r["__range"]: r.n for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, {}
    for k in sorted(counts):
        starts[k] = before
        before += counts[k]
    if not starts:
        return dealt.withColumn(out, F.lit(0).cast("bigint")).drop("__at", "__range")
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("__range"))
    return dealt.withColumn(out, start.cast("bigint") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__range")


def sampled(n: int, k: Column, seed: int, *keys: str) -> Column:
    """k distinct numbers below n, each set of them as likely as any other.

    The j-th of the last k numbers below n gives way to a number drawn from 0 to itself, unless that
    is chosen already: the drawn one then stays out and the number itself comes in.
    """
    def chosen(held, j):
        draw = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in keys], j), j + 1)
        return F.array_append(held, F.when(F.array_contains(held, draw), j).otherwise(draw))

    last = F.lit(n - 1).cast("bigint")
    return F.aggregate(F.sequence(last - k + 1, last), F.array().cast("array<bigint>"), chosen)


def generate_purchases(customers: DataFrame, products: DataFrame, as_of: str, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(purchases, items): 5-15 purchases a customer in 180 days, of 1-3 distinct products at 3000-15000 cents.

    A customer's purchases are numbered in the order of their times. Products are numbered by id, and
    a purchase's are a uniform sample of the numbers. Only ids of products are numbered and joined, and
    not by a broadcast, which the driver would have to hold; totals come from the draws of the lines.
    """
    known = numbered(products.select(F.col("id").alias("product_id")), "product_id")
    n_products = known.count()
    if n_products < 3:
        raise ValueError("at least three products are needed")
    drawn = F.transform(F.sequence(F.lit(1), _draw(5, 15, seed, "id")), lambda k: _draw(0, 180 * 86_400, seed + 1, "id", k))
    bought = customers.select(F.col("id").alias("customer_id"), F.posexplode(F.reverse(F.array_sort(drawn))).alias("k", "ago"))  # the furthest back first
    bought = bought.withColumn("id", F.concat_ws("-", "customer_id", F.col("k") + 1)).withColumn("purchased_at", F.expr(f"timestamp_ntz '{as_of}'") - F.make_dt_interval(secs=F.col("ago")))
    lines = sampled(n_products, _draw(1, 3, seed + 2, "id").cast("bigint"), seed + 3, "id")
    amount = lambda purchase, line: _draw(3000, 15_000, seed + 5, purchase, line)
    items = bought.select(F.col("id").alias("purchase_id"), F.posexplode(lines).alias("line", "number"))
    items = items.join(known.hint("merge"), "number").select(
        F.concat_ws("-", "purchase_id", "line").alias("id"), "purchase_id", "product_id",
        F.lit(1).alias("quantity"), amount("purchase_id", "line").alias("line_amount_cents"),
    )
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    total = F.aggregate(places, F.lit(0).cast("bigint"), lambda s, line: s + amount("id", line))
    return bought.select("id", "customer_id", (F.col("k") + 1).alias("number"), "purchased_at", total.alias("total_amount_cents"), F.lit("manual").alias("source")), items


def sample_attributes(products: DataFrame, dimension: DataFrame, low: int = 1, high: int = 4, seed: int = 1) -> DataFrame:
    """(product_id, attribute_id): low to high distinct attributes of each product, those with the least hash."""
    names = dimension.agg(F.collect_list("id").alias("all"))  # one row, a small dimension
    keyed = products.select(F.col("id").alias("product_id")).join(F.broadcast(names))
    ranked = F.array_sort(F.transform("all", lambda a: F.struct(F.xxhash64(F.lit(seed), F.col("product_id"), a).alias("h"), a.alias("a"))))
    chosen = F.slice(ranked, 1, _draw(low, high, seed + 1, "product_id"))
    return keyed.select("product_id", F.explode(chosen).alias("x")).select("product_id", F.col("x.a").alias("attribute_id"))


def normalized_percents(weights: DataFrame, total: float = 1.0) -> DataFrame:
    """(product_id, idx, percent) of (product_id, idx, weight): shares of the total in hundredths.

    The largest (the first of equals) takes what rounding leaves; nothing goes below 0.
    """
    own = Window.partitionBy("product_id")
    share = F.round(F.lit(total) * F.col("weight") / F.sum("weight").over(own) * 100).cast("bigint")
    rounded = weights.withColumn("cents", share)
    first = F.row_number().over(own.orderBy(F.desc("cents"), "idx")) == 1
    rest = F.lit(round(total * 100)) - F.sum("cents").over(own)
    fixed = rounded.withColumn("add", F.when(first, rest).otherwise(0))
    return fixed.select("product_id", "idx", (F.greatest(F.col("cents") + F.col("add"), F.lit(0)) / 100.0).alias("percent"))


def family_picks(products: DataFrame, cannabinoids: DataFrame, seed: int = 1) -> DataFrame:
    """(product_id, cannabinoid_id, family, is_main): one of each family and 0-2 others, all distinct."""
    every = sample_attributes(products, cannabinoids, 10_000, 10_000, seed).join(F.broadcast(cannabinoids.select(F.col("id").alias("attribute_id"), "family")), "attribute_id")
    drawn = F.xxhash64(F.lit(seed), "product_id", "attribute_id")
    main = F.row_number().over(Window.partitionBy("product_id", "family").orderBy(drawn)) == 1
    told = every.withColumn("is_main", main)
    rank = F.row_number().over(Window.partitionBy("product_id", "is_main").orderBy(drawn))
    told = told.withColumn("k", rank).where(F.col("is_main") | (F.col("k") <= _draw(0, 2, seed + 7, "product_id")))
    return told.select("product_id", F.col("attribute_id").alias("cannabinoid_id"), "family", "is_main")
