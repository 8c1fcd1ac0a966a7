"""Queries on customers, products and their attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import generators, paging, serializers, writes
from ..functions.text import fixed, readings_label, upper
from .registry import Plans, joined

PLANS = Plans()
add = PLANS.add

CUSTOMER = ["id", "name", "phone", "email", "marketing_opt_in", "last_visit_at", "auth_user_id"]
_T = joined("terpenes", "concat(x.name, '=', coalesce(cast(x.percent as string), '-'))")
_C = joined("cannabinoids", "concat(x.name, '/', x.family, '=', coalesce(cast(x.percent as string), '-'))")
_T_SQL = "select pt.product_id, string_agg(concat(t.name, '=', coalesce(cast(percent as varchar), '-')), ';' order by t.name, percent) as s from product_terpenes pt join terpenes t on t.id = terpene_id group by 1"
_C_SQL = "select pc.product_id, string_agg(concat(c.name, '/', c.family, '=', coalesce(cast(percent as varchar), '-')), ';' order by c.name, percent) as s from product_cannabinoids pc join cannabinoids c on c.id = cannabinoid_id group by 1"
_BOTH = f", ts as ({_T_SQL}), cs as ({_C_SQL}) "
_VIEWS = "products terpenes product_terpenes cannabinoids product_cannabinoids"


def _flat(df, *columns):
    return df.select(*columns, F.expr(_T).alias("terpenes"), F.expr(_C).alias("cannabinoids"))


@add("scan_customers", "customers", "select * from customers")
def _(d):
    return d.customers


@add("point_lookup", "customers", "select * from customers where id = 87")
def _(d):
    return d.customers.where("id = 87").limit(1)


@add("page_customers", "customers", f"select {', '.join(CUSTOMER)} from customers order by created_at desc, id desc limit 50 offset 10")
def _(d):
    return paging.page(d.customers, [F.desc("created_at"), F.desc("id")], 50, 10).select(CUSTOMER)


@add("search_customers", "customers", "select id, name, phone, email from customers where name ilike '%00000_7%' or email ilike '%00000_7%' or phone ilike '%00000_7%'")
def _(d):
    return paging.search_customers(d.customers, " 00000_7 ").select("id", "name", "phone", "email")


@add("search_products", "products", "select id, name, brand, category from products where name ilike '%brand#1%' or brand ilike '%brand#1%' or category ilike '%brand#1%'")
def _(d):
    return paging.search_products(d.products, "BRAND#1").select("id", "name", "brand", "category")


@add("active_products", "products", "select id, name, brand, category from products where is_active")
def _(d):
    return d.products.where("is_active").select("id", "name", "brand", "category")


@add("typeahead", "products", "select id, name from (select * from products where name ilike '%a%' or brand ilike '%a%' or category ilike '%a%' order by created_at desc, id desc limit 10) where is_active")
def _(d):
    return paging.page(paging.search_products(d.products, "a"), [F.desc("created_at"), F.desc("id")], 10).where("is_active").select("id", "name")


@add("page_has_more", "customers", "select cast(count(*) as bigint) as rows_returned, count(*) = 20 as has_more from (select id from customers order by id limit 20)")
def _(d):
    rows, more = paging.page_with_more(d.customers, [F.asc("id")], 20)
    return rows.agg(F.count("*").alias("rows_returned"), more.alias("has_more"))


@add("append_pages", "customers", "select id, name from customers order by id limit 40")
def _(d):
    return paging.page(d.customers, [F.asc("id")], 20).unionByName(paging.page(d.customers, [F.asc("id")], 20, 20)).select("id", "name")


@add("append_dedupe", "terpenes cannabinoids", "select name from terpenes where id < 12 union all select name from terpenes where id >= 6 and id not in (select id from terpenes where id < 12)")
def _(d):
    old, new = d.terpenes.where("id < 12").select("name"), d.terpenes.where("id >= 6").select("name")
    return old.unionByName(new.join(old, "name", "left_anti"))


@add("terpene_names", "terpenes", "select name from terpenes order by name")
def _(d):
    return d.terpenes.select("name").orderBy("name")


@add("seed_by_family", "cannabinoids", "select family, cast(count(*) as bigint) as n, string_agg(name, ';' order by name) as names from cannabinoids group by family")
def _(d):
    return d.cannabinoids.groupBy("family").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ";").alias("names"))


@add("product_attributes", "terpenes product_terpenes", "select product_id, name, percent from product_terpenes join terpenes on terpenes.id = terpene_id")
def _(d):
    return d.product_terpenes.join(d.terpenes, F.col("id") == F.col("terpene_id")).select("product_id", "name", "percent")


@add("semi_ids", "products product_terpenes", "select id, name from products where id in (select product_id from product_terpenes where percent > 0.9)")
def _(d):
    return d.products.join(d.product_terpenes.where("percent > 0.9").select(F.col("product_id").alias("id")), "id", "left_semi").select("id", "name")


@add("known_names", "cannabinoids", "select name from (values ('THCA'), ('CBD'), ('THCV')) as t(name) where name in (select name from cannabinoids)")
def _(d):
    given = d.spark.createDataFrame([(" THCA ",), ("CBD",), ("nothing",), ("THCV\t",)], "name string")
    from ..functions.text import py_trim

    return given.select(py_trim("name").alias("name")).join(d.cannabinoids, "name", "left_semi")


@add("catalog_nested", _VIEWS, f"{_BOTH} select id, name, brand, category, is_active, coalesce(ts.s, '') as terpenes, coalesce(cs.s, '') as cannabinoids from products left join ts on ts.product_id = id left join cs on cs.product_id = id where name ilike '%e%' or brand ilike '%e%' or category ilike '%e%' order by created_at desc, id desc limit 50 offset 5")
def _(d):
    return _flat(C.catalog_nested(d, "e", 50, 5), "id", "name", "brand", "category", "is_active")


@add("page_portal_products", _VIEWS, f"{_BOTH} select id, name, brand, category, coalesce(ts.s, '') as terpenes, coalesce(cs.s, '') as cannabinoids from products left join ts on ts.product_id = id left join cs on cs.product_id = id where is_active order by name, id limit 50")
def _(d):
    return _flat(C.portal_products(d), "id", "name", "brand", "category")


@add("product_detail", _VIEWS, f"{_BOTH} select id, name, brand, category, coalesce(ts.s, '') as terpenes, coalesce(cs.s, '') as cannabinoids from products left join ts on ts.product_id = id left join cs on cs.product_id = id where is_active and id = 19")
def _(d):
    return _flat(C.product_detail(d, 19, active_only=True), "id", "name", "brand", "category")


@add("batch_attributes", "terpenes product_terpenes", f", ts as ({_T_SQL}) select a.product_id, coalesce(ts.s, '') as terpenes from (values (3), (4), (5), (999999999)) as a(product_id) left join ts on ts.product_id = a.product_id")
def _(d):
    return C.batch_attributes(d, [3, 4, 5, 999_999_999, 3]).select("product_id", F.expr(_T).alias("terpenes"))


@add("batch_cannabinoids", "cannabinoids product_cannabinoids", f", cs as ({_C_SQL}) select a.product_id, coalesce(cs.s, '') as cannabinoids from (values (3), (4), (7), (999999999)) as a(product_id) left join cs on cs.product_id = a.product_id")
def _(d):
    return C.batch_attributes(d, [3, 4, 7, 999_999_999], family=True).select("product_id", F.expr(_C).alias("cannabinoids"))


@add("terpene_label", "terpenes product_terpenes", "select product_id, string_agg(case when percent is null then name else printf('%s (%.2f%%)', name, percent) end, ', ' order by coalesce(percent, -1) desc, name) as label from product_terpenes join terpenes on terpenes.id = terpene_id group by product_id")
def _(d):
    ids = d.product_terpenes.select("product_id").distinct()
    return C.nested(ids, d.product_terpenes, d.terpenes, "terpene_id", ["name", "percent"], "terpenes").select("product_id", readings_label("terpenes").alias("label"))


@add("minor_pool", "products cannabinoids product_cannabinoids", "select p.id as product_id, c.id as cannabinoid_id from products p cross join cannabinoids c where not exists (select 1 from product_cannabinoids x where x.product_id = p.id and x.cannabinoid_id = c.id)")
def _(d):
    """All attributes that a product does not use."""
    every = F.array(*[F.lit(r.id) for r in d.cannabinoids.select("id").orderBy("id").collect()])  # the seed dimension
    used = d.product_cannabinoids.groupBy("product_id").agg(F.collect_set("cannabinoid_id").alias("used"))
    left = d.products.select(F.col("id").alias("product_id")).join(used, "product_id", "left")
    return left.select("product_id", F.explode(F.array_except(every, F.coalesce("used", F.array().cast("array<int>")))).alias("cannabinoid_id"))


@add("merge_attribute_maps", "terpenes product_terpenes", f", ts as ({_T_SQL}), a as (select * from (values (1, 3), (1, 4), (2, 4), (2, 9)) as t(pos, product_id)) select product_id, case when max(pos) = 1 then coalesce(max(s), '') else concat('later ', coalesce(max(s), '')) end as terpenes from a left join ts using (product_id) group by product_id")
def _(d):
    """Attribute maps of two requests as one, in which the later wins."""
    first, later = (C.batch_attributes(d, ids).select("product_id", F.expr(_T).alias("terpenes")) for ids in ([3, 4], [4, 9]))
    return C.later_wins([first, later.withColumn("terpenes", F.concat(F.lit("later "), "terpenes"))], "product_id")


@add("family_labels", "cannabinoids product_cannabinoids", "select product_id, string_agg(concat(c.name, ' (', upper(c.family), ') ', case when percent is null then '-' else printf('%.1f', percent) end), ', ' order by c.name) as label from product_cannabinoids pc join cannabinoids c on c.id = cannabinoid_id group by product_id")
def _(d):
    """Attributes as a list shows them: family in capitals, percent with one digit."""
    ids = d.product_cannabinoids.select("product_id").distinct()
    nested = C.nested(ids, d.product_cannabinoids, d.cannabinoids, "cannabinoid_id", ["name", "family", "percent"], "all")
    shown = F.transform("all", lambda x: F.concat(x["name"], F.lit(" ("), upper(x["family"]), F.lit(") "), F.coalesce(fixed(x["percent"], 1), F.lit("-"))))
    return nested.select("product_id", F.array_join(shown, ", ").alias("label"))


@add("first_five_label", "terpenes product_terpenes", "select product_id, string_agg(case when percent is null then name else printf('%s (%.2f%%)', name, percent) end, ', ' order by coalesce(percent, -1) desc, name) as label from (select *, row_number() over (partition by product_id order by name) as k from product_terpenes join terpenes on terpenes.id = terpene_id) where k <= 5 group by product_id")
def _(d):
    """The first five attributes as they are stored, sorted only then."""
    ids = d.product_terpenes.select("product_id").distinct()
    nested = C.nested(ids, d.product_terpenes, d.terpenes, "terpene_id", ["name", "percent"], "terpenes")
    return nested.select("product_id", readings_label(F.slice("terpenes", 1, 5)).alias("label"))


@add("customers_out", "customers", "select cast(id as varchar) as id, name, phone, email, marketing_opt_in, strftime(last_visit_at, '%Y-%m-%dT%H:%M:%SZ') as last_visit_at, auth_user_id from customers")
def _(d):
    return serializers.customers_out(d.customers)


@add("products_out", _VIEWS, f"{_BOTH} select cast(id as varchar) as id, name, brand, category, is_active, coalesce(ts.s, '') as terpenes, coalesce(cs.s, '') as cannabinoids from products left join ts on ts.product_id = id left join cs on cs.product_id = id where is_active order by name, products.id limit 50")
def _(d):
    page = C.portal_products(d).withColumn("is_active", F.lit(True))
    return _flat(serializers.products_out(page), "id", "name", "brand", "category", "is_active")


@add("patch_customer", "customers", "select id, case when id % 50 = 0 then null else name end as name, case when id % 50 = 0 then '555' else phone end as phone, marketing_opt_in or id % 50 = 0 as marketing_opt_in from customers")
def _(d):
    given = d.customers.where("id % 50 = 0").select("id", F.lit(" ").alias("name"), F.lit(" 555\t").alias("phone"), F.lit(None).cast("string").alias("email"), F.lit(True).alias("marketing_opt_in"))
    return writes.patch_customers(d.customers, given).select("id", "name", "phone", "marketing_opt_in")


@add("delete_links", "product_terpenes", "select * from product_terpenes where product_id % 3 <> 0")
def _(d):
    return writes.delete_links(d.product_terpenes, d.products.where("id % 3 = 0").select(F.col("id").alias("product_id")))


@add("upsert_dimension", "terpenes", "select id, name from terpenes union all values (20, 'Aroma'), (21, 'Zest')")
def _(d):
    return writes.upsert_dimension(d.terpenes, d.spark.createDataFrame([("Myrcene",), (" Zest ",), ("Aroma",), ("  ",), ("Zest",)], "name string"))


_NEW = "product_id % 100 = 1"


@add("replace_links", "products terpenes product_terpenes", f", n as (select id as product_id from products where id % 100 = 1) select product_id, name, percent from product_terpenes join terpenes on terpenes.id = terpene_id where not {_NEW} union all select product_id, 'Fresh', 0.5 from n union all select product_id, 'Linalool', null from n")
def _(d):
    chosen = d.products.where("id % 100 = 1").select(F.col("id").alias("product_id"))
    payload = chosen.select("product_id", F.expr("inline(array(named_struct('name', ' Fresh', 'percent', double(0.5)), named_struct('name', 'Linalool', 'percent', double(null))))"))
    links, dimension = writes.replace_links(d.product_terpenes, d.terpenes, payload, chosen)
    return links.join(dimension, F.col("id") == F.col("terpene_id")).select("product_id", "name", "percent")


@add("insert_customer", "customers", """select top + k as id, name, phone, email, opt as marketing_opt_in, timestamp '2001-08-01 00:00:00' as created_at, timestamp '2001-08-01 00:00:00' as updated_at
from (select max(id) as top from customers), (values (1, '', null, 'a@b.c', true), (2, 'New', '1', null, false), (3, 'New', '1', null, false)) as v(k, name, phone, email, opt)""")
def _(d):
    rows = d.spark.createDataFrame([(" New ", "1", "", None), ("  ", None, "a@b.c", True), (" New ", "1", "", None)], "name string, phone string, email string, marketing_opt_in boolean")
    return writes.new_customers(d.customers, rows, "2001-08-01 00:00:00")


_WRITTEN = "select p.id, p.name, brand, category, is_active, coalesce(t.s, '') as terpenes, coalesce(c.s, '') as cannabinoids from p left join t on t.product_id = p.id left join c on c.product_id = p.id"


def _shown(tables, where):
    """Products of written tables with their attributes, flat."""
    rows = tables["products"].where(where)
    ids = rows.select(F.col("id").alias("product_id"))
    t = C.nested(ids, tables["product_terpenes"], tables["terpenes"], "terpene_id", ["name", "percent"], "terpenes")
    c = C.nested(ids, tables["product_cannabinoids"], tables["cannabinoids"], "cannabinoid_id", ["name", "family", "percent"], "cannabinoids")
    both = rows.join(t.withColumnRenamed("product_id", "id"), "id", "left").join(c.withColumnRenamed("product_id", "id"), "id", "left")
    shown = _flat(both, "id", "name", "brand", "category", "is_active")
    return shown.fillna("", ["terpenes", "cannabinoids"])


@add("create_product", "products", """select (select max(id) from products) + k as id, name, brand, category, is_active, terpenes, cannabinoids from
(values (1, 'Dawn', null, 'flower', true, 'Aroma=0.5;Myrcene=-', 'CBD/cbd=1.5;Nova/thc=20.0'), (2, 'Dusk', 'B', 'cart', false, '', '')) as v(k, name, brand, category, is_active, terpenes, cannabinoids)""")
def _(d):
    """Two products with both link sets; names that are new get the payload's family, known ones keep theirs."""
    rows = d.spark.createDataFrame([(1, " Dusk ", "B ", "cart", False), (0, "Dawn", "", "flower", True)], "pos int, name string, brand string, category string, is_active boolean")
    terpenes = d.spark.createDataFrame([(0, " Aroma", 0.5), (0, "Myrcene", None), (0, "  ", 1.0)], "pos int, name string, percent double")
    others = d.spark.createDataFrame([(0, "Nova", "thc", 20.0), (0, "CBD", "thc", 1.5)], "pos int, name string, family string, percent double")
    top = d.products.agg(F.max("id")).first()[0] or 0
    return _shown(writes.create_products(d, rows, terpenes, others), F.col("id") > top)


@add("update_product", _VIEWS, f"""{_BOTH} select id, case when id = 9 then 'Noon' else name end as name, case when id = 9 then '' else brand end as brand, category, is_active,
coalesce(ts.s, '') as terpenes, case when id = 9 then 'CBD/cbd=2.5;Star/cbd=-' else coalesce(cs.s, '') end as cannabinoids from products left join ts on ts.product_id = id left join cs on cs.product_id = id""")
def _(d):
    """One product's fields and second link set; what is not given stays."""
    others = d.spark.createDataFrame([("CBD", "thc", 2.5), (" Star", "cbd", None)], "name string, family string, percent double")
    return _shown(writes.update_product(d, 9, {"name": " Noon", "brand": "  "}, cannabinoids=others), F.lit(True))


@add("link_customer", "customers", "select id, auth_user_id, true as linked, false as created from (select id, 'u1' as auth_user_id from customers where phone = '555-0000004') union all select id, 'u1', true, false from customers where email = 'none'")
def _(d):
    after, answer = writes.link_customer(d.customers, "u1", phone="555-0000004", email="customer.000000002@example.com")
    return after.where(F.col("id") == answer["customer_id"]).select("id", "auth_user_id", F.lit(answer["linked"]).alias("linked"), F.lit(answer["created"]).alias("created"))


@add("normalize_percent", "product_terpenes", """, w as (select product_id, terpene_id as idx, cast(round(coalesce(percent, 0.1) * 100) as bigint) + 1 as weight from product_terpenes),
r as (select product_id, idx, cast(round(weight / sum(weight) over (partition by product_id) * 100) as bigint) as cents from w),
m as (select *, row_number() over (partition by product_id order by cents desc, idx) as k, 100 - sum(cents) over (partition by product_id) as rest from r)
select product_id, idx, cast(greatest(cents + case when k = 1 then rest else 0 end, 0) as double) / 100 as percent from m""")
def _(d):
    return generators.normalized_percents(d.product_terpenes.select("product_id", F.col("terpene_id").alias("idx"), (F.round(F.coalesce("percent", F.lit(0.1)) * 100).cast("bigint") + 1).alias("weight")))


@add("sample_attributes", "products", "select id as product_id, true as distinct_ones, true as one_to_four, true as known from products")
def _(d):
    """What must hold of the attributes drawn for each product."""
    drawn = generators.sample_attributes(d.products, d.terpenes).join(d.terpenes.select(F.col("id").alias("attribute_id"), F.lit(1).alias("one")), "attribute_id", "left")
    per = drawn.groupBy("product_id").agg(F.count("*").alias("n"), F.countDistinct("attribute_id").alias("d"), F.count("one").alias("k"))
    return per.select("product_id", (F.col("n") == F.col("d")).alias("distinct_ones"), F.col("n").between(1, 4).alias("one_to_four"), (F.col("n") == F.col("k")).alias("known"))


@add("family_picks", "products cannabinoids", "select p.id as product_id, cast(count(distinct family) as bigint) as mains, true as distinct_ones, true as own_family, true as at_most_two_more from products p cross join cannabinoids group by 1")
def _(d):
    """What must hold of the attributes drawn by family for each product."""
    kinds = d.cannabinoids.select(F.col("id").alias("cannabinoid_id"), F.col("family").alias("known"))
    drawn = generators.family_picks(d.products, d.cannabinoids).join(kinds, "cannabinoid_id")
    per = drawn.groupBy("product_id").agg(
        F.countDistinct(F.when(F.col("is_main"), F.col("family"))).alias("mains"), F.countDistinct("cannabinoid_id").alias("d"), F.count("*").alias("n"),
        F.every(F.col("family") == F.col("known")).alias("own_family"), F.count_if(~F.col("is_main")).alias("more"), F.count_if("is_main").alias("m"),
    )
    return per.select("product_id", "mains", ((F.col("d") == F.col("n")) & (F.col("m") == F.col("mains"))).alias("distinct_ones"), "own_family", (F.col("more") <= 2).alias("at_most_two_more"))
