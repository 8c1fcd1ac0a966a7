"""Queries on tables that are first written: versions with changed rows, and the index of substrings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import preferences as R
from ..operators import purchases as P
from ..operators import substrings, writes
from ..sources import bucketed
from ..sources.shared import shared_folder, table
from ..sources.versions import Conflict, Store
from ..streaming import scores as streaming
from .registry import Plans

PLANS = Plans()
add = PLANS.add
#: Rows of a part of the index, so that the given tables have several.
PART_ROWS = 500


def _store(d, **tables):
    """A store of its own with tables by name, keyed by id."""
    store = Store(d.spark, f"{shared_folder(d.spark)}/store-{uuid.uuid4().hex}")
    with store.begin() as t:
        for name, df in tables.items():
            t.replace(name, df, ["id"])
    return store


_CHANGED = """select id, case when id % 60 = 0 then 'both' when id % 50 = 0 then null else name end as name, case when id % 60 = 0 and id % 50 <> 0 then phone when id % 50 = 0 then '555' else phone end as phone, marketing_opt_in or id % 50 = 0 as marketing_opt_in
from customers where id % 70 <> 0 union all select id + 1000000000, name, phone, marketing_opt_in from customers where id % 90 = 0"""


def _changed(d):
    """Customers after a patch, a second patch that meets the first, deletions and new rows, each a log."""
    store = _store(d, customers=d.customers)
    with store.begin() as t:
        given = d.customers.where("id % 50 = 0").select("id", F.lit(" ").alias("name"), F.lit(" 555\t").alias("phone"), F.lit(None).cast("string").alias("email"), F.lit(True).alias("marketing_opt_in"))
        t.upsert("customers", writes.patch_customers(t.rows("customers", given), given))
    with store.begin() as t:
        given = d.customers.where("id % 60 = 0").select("id", F.lit("both").alias("name"), *[F.lit(None).cast(k).alias(c) for c, k in (("phone", "string"), ("email", "string"), ("marketing_opt_in", "boolean"))])
        t.upsert("customers", writes.patch_customers(t.rows("customers", given), given))
        t.delete("customers", d.customers.where("id % 70 = 0"))
        t.append("customers", d.customers.where("id % 90 = 0").withColumn("id", F.col("id") + 1_000_000_000))
    return store


@add("changed_rows", "customers", _CHANGED)
def _(d):
    """The table with its logs merged on read."""
    return _changed(d).read("customers").select("id", "name", "phone", "marketing_opt_in")


@add("compacted_rows", "customers", _CHANGED)
def _(d):
    """The same after the logs were written into the table."""
    store = _changed(d)
    with store.begin() as t:
        t.compact("customers")
    return store.read("customers").select("id", "name", "phone", "marketing_opt_in")


@add("fixed_version", "customers", "select id, name, phone, marketing_opt_in from customers")
def _(d):
    """What a reader of the first version sees after others."""
    return _changed(d).read("customers", 1).select("id", "name", "phone", "marketing_opt_in")


@add("conflicting_writers", "products purchases", "select 'products' as name, id, case when id % 10 = 3 then 'first' else brand end as value from products union all select 'purchases', id, 'third' from purchases where id % 20 = 0")
def _(d):
    """Three writers of one base: the second meets the first's rows and fails, the third's table is another."""
    store = _store(d, products=d.products.select("id", "brand"), purchases=d.purchases.where("id % 20 = 0").select("id", "source"))
    writers = [(store.begin(), "products", "brand", "first"), (store.begin(), "products", "brand", "second"), (store.begin(), "purchases", "source", "third")]
    refused = []
    for t, name, column, value in writers:
        rows = t.read(name).where("id % 10 = 3") if name == "products" else t.read(name)
        t.upsert(name, rows.withColumn(column, F.lit(value)))
        try:
            t.commit()
        except Conflict:
            refused.append(value)
    if refused != ["second"]:
        raise AssertionError(f"refused: {refused}")
    parts = [store.read(n).select(F.lit(n).alias("name"), "id", F.col(c).alias("value")) for n, c in (("products", "brand"), ("purchases", "source"))]
    return parts[0].unionByName(parts[1])


def _indexed(d, df, columns, q, part_rows=PART_ROWS):
    folder = f"{shared_folder(d.spark)}/index-{uuid.uuid4().hex}"
    substrings.build(df, "id", columns, folder, part_rows)
    return substrings.find(d.spark, folder, q, columns)


@add("indexed_search_customers", "customers", "select id, name, phone, email from customers where name ilike '%00_087%' or email ilike '%00_087%' or phone ilike '%00_087%'")
def _(d):
    return _indexed(d, d.customers, ["name", "email", "phone"], " 00_087").select("id", "name", "phone", "email")


@add("indexed_search_products", "products", "select id, name, brand, category from products where name ilike '%brand#1%' or brand ilike '%brand#1%' or category ilike '%brand#1%'")
def _(d):
    return _indexed(d, d.products, ["name", "brand", "category"], "BRAND#1").select("id", "name", "brand", "category")


@add("indexed_search_purchases", "purchases customers", "select p.id, c.name as customer_name, c.phone as customer_phone, p.external_id from purchases p join customers c on c.id = customer_id where c.name ilike '%x12%' or c.phone ilike '%x12%' or external_id ilike '%x12%'")
def _(d):
    """Over purchases with their customer, as the listing searches them."""
    names = d.customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"), F.col("phone").alias("customer_phone"))
    listed = d.purchases.select("id", "customer_id", "external_id").join(names, "customer_id")
    return _indexed(d, listed, ["customer_name", "customer_phone", "external_id"], "x12", 10 * PART_ROWS).select("id", "customer_name", "customer_phone", "external_id")


def _bucketed(d):
    return bucketed.write(d, f"buckets_{uuid.uuid4().hex}")


@add("bucketed_totals", "purchases purchase_items", "select p.id, p.customer_id, cast(coalesce(sum(i.line_amount_cents), 0) as bigint) as total_amount_cents from purchases p left join purchase_items i on i.purchase_id = p.id group by 1, 2")
def _(d):
    """Totals of all purchases from tables bucketed by purchase."""
    return P.finalized(_bucketed(d)).select("id", "customer_id", "total_amount_cents")


@add("bucketed_counts", "purchases purchase_items", "select b.customer_id, i.product_id, count(*) as purchased_count from purchase_items i join purchases b on b.id = i.purchase_id group by all")
def _(d):
    """Lines of each customer and product from tables bucketed by purchase."""
    return R.purchase_counts(_bucketed(d))


_FEEDBACK = """, f as (select i.id, b.customer_id, i.product_id, case when i.id % 11 = 0 then null when i.id % 7 = 0 then 'dislike' when i.id % 13 = 0 then 'like' else i.feedback end as feedback from purchase_items i join purchases b on b.id = i.purchase_id)"""


@add("stream_scores", "purchases purchase_items product_terpenes", f"""{_FEEDBACK}, s as (select customer_id, terpene_id, cast(sum(case feedback when 'like' then 1 when 'dislike' then -1 else 0 end * cast(round(coalesce(percent, 0.1) * 10000) as bigint)) as bigint) as s,
count(case when feedback = 'like' then 1 end) as likes, count(case when feedback = 'dislike' then 1 end) as dislikes, count(case when feedback = 'neutral' then 1 end) as neutrals from f join product_terpenes l on l.product_id = f.product_id where feedback is not null group by all)
select customer_id, terpene_id, s / 10000.0 as score, likes, dislikes, neutrals from s""")
def _(d):
    """Scores kept by three batches of feedback: all that was given, some given anew, some cleared; the second batch comes twice."""
    store = Store(d.spark, f"{shared_folder(d.spark)}/scores-{uuid.uuid4().hex}")
    owner = d.purchases.select(F.col("id").alias("purchase_id"), "customer_id")
    # read by every batch: numbered and joined once
    items = table(d.purchase_items.join(owner, "purchase_id").select(F.col("id").alias("item_id"), "customer_id", "product_id", "feedback"))
    streaming.create(store, items)
    given = lambda value, rule, at: items.where(rule).withColumns({"feedback": value, "at": F.lit(at)})
    none = F.lit(None).cast("string")
    batches = [
        items.where("feedback is not null").withColumn("at", F.lit(0)),
        given(F.lit("like"), "item_id % 13 = 0", 1).unionByName(given(none, "item_id % 7 = 0", 1)).unionByName(given(F.lit("dislike"), "item_id % 7 = 0", 2)),
        given(none, "item_id % 11 = 0", 3),
    ]
    for k in (0, 1, 1, 2):
        streaming.apply_batch(store, d.product_terpenes, batches[k], k)
    return streaming.scores(store)
