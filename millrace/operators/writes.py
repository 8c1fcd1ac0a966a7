"""Changes of tables as functions from frames to the frames that replace them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, py_trim, strip_if_given
from ..sources.versions import Conflict, Store


def check(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules (SQL conditions by name), and the others with the names of those broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    told = df.withColumn("broken", broken)
    return told.where(F.size("broken") == 0).drop("broken"), told.where(F.size("broken") > 0)


def check_unique(df: DataFrame, key: list[str]) -> None:
    """An error if a key comes twice: Spark enforces no primary key."""
    twice = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} comes twice: {twice[0]}")


#: Rows of one request, which are numbered in one window.
MOST_PAYLOAD = 10_000


def with_new_ids(table: DataFrame, payload: DataFrame, *order: str, start: int | None = None) -> DataFrame:
    """The payload with ``id``: numbers by the given columns, equal rows too, from ``start`` or after the table's largest.

    Two requests from one base would get the same numbers; with ``reserve`` they get starts of their own.
    """
    if payload.limit(MOST_PAYLOAD + 1).count() > MOST_PAYLOAD:
        raise ValueError(f"at most {MOST_PAYLOAD} rows a request")
    k = F.row_number().over(Window.orderBy(*order))
    kind = table.schema["id"].dataType
    if start is not None:
        return payload.withColumn("id", (k + F.lit(start - 1)).cast(kind))
    top = table.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("__top"))  # one row
    return payload.withColumn("__k", k).join(F.broadcast(top)).withColumn("id", (F.col("__top") + F.col("__k")).cast(kind)).drop("__top", "__k")


SEQUENCES = "sequences"


def reserve(store: Store, name: str, n: int, tries: int = 100) -> int:
    """The first of n keys of a table that no other request gets, in a version of their own.

    The next free key of each table is a row of the store; the first reservation begins after the
    table's largest key. Where another request came first, this one reads again.
    """
    for _ in range(tries):
        t = store.begin()
        try:
            known = t.tables.get(SEQUENCES)
            row = t.read(SEQUENCES).where(F.col("name") == name).first() if known else None
            start = row["next"] if row else (t.read(name).agg(F.max("id")).first()[0] if name in t.tables else None)
            start = start if row else (0 if start is None else start + 1)
            after = store.spark.createDataFrame([(name, start + n)], "name string, next bigint")
            if known:
                t.upsert(SEQUENCES, after)
            else:
                t.replace(SEQUENCES, after, ["name"])
            t.commit()
            return start
        except Conflict:
            continue
    raise Conflict(f"{name}: others came first {tries} times")


def new_customers(customers: DataFrame, payload: DataFrame, now: str, start: int | None = None) -> DataFrame:
    """Rows to append to the customers: trimmed texts, new keys, times set."""
    time = F.lit(now).cast("timestamp_ntz")
    return with_new_ids(customers, payload, "name", "phone", "email", start=start).select(
        "id", *[strip_if_given(c).alias(c) for c in ("name", "phone", "email")],
        F.coalesce("marketing_opt_in", F.lit(False)).alias("marketing_opt_in"), time.alias("created_at"), time.alias("updated_at"),
    )


def patch_customers(customers: DataFrame, updates: DataFrame) -> DataFrame:
    """Sets what the updates (id, name, phone, email, marketing_opt_in) give: null leaves a field, a blank text clears it."""
    given = updates.select(F.col("id"), *[F.col(c).alias(f"new_{c}") for c in ("name", "phone", "email", "marketing_opt_in")])
    joined = customers.join(given, "id", "left")
    for c in ("name", "phone", "email"):
        joined = joined.withColumn(c, F.when(F.col(f"new_{c}").isNull(), F.col(c)).otherwise(blank_to_null(f"new_{c}")))
    joined = joined.withColumn("marketing_opt_in", F.coalesce("new_marketing_opt_in", "marketing_opt_in"))
    return joined.select(customers.columns)


def patch_products(products: DataFrame, updates: DataFrame) -> DataFrame:
    """Sets name, brand, category and is_active; an empty brand becomes null, one of blanks only becomes empty."""
    fields = ["name", "brand", "category", "is_active"]
    given = updates.select("id", *[F.col(c).alias(f"new_{c}") for c in fields if c in updates.columns])
    joined = products.join(given, "id", "left")
    for c, value in (("name", py_trim("new_name")), ("category", F.col("new_category")), ("is_active", F.col("new_is_active"))):
        if c in updates.columns:
            joined = joined.withColumn(c, F.coalesce(value, c))
    if "brand" in updates.columns:
        joined = joined.withColumn("brand", F.when(F.col("new_brand").isNull(), F.col("brand")).otherwise(strip_if_given("new_brand")))
    return joined.select(products.columns)


def delete_links(links: DataFrame, products: DataFrame) -> DataFrame:
    """Links without those of the given products (product_id)."""
    return links.join(products.select("product_id").distinct(), "product_id", "left_anti")


def upsert_dimension(dimension: DataFrame, names: DataFrame) -> DataFrame:
    """The dimension with the names it lacks: trimmed, blanks skipped, keys from the largest on.

    New names take the payload's further columns, such as a family, from the row that comes first
    (``pos`` if there is one). Names that are known keep their row, whatever else the payload says.
    """
    further = [c for c in names.columns if c in dimension.columns and c not in ("id", "name")]
    rows = names.withColumn("name", py_trim("name")).where("name <> ''")
    first = F.struct(*([F.col("pos")] if "pos" in names.columns else []), *further) if further else F.lit(1)
    wanted = rows.groupBy("name").agg(F.min(first).alias("first")).select("name", *[F.col(f"first.{c}").alias(c) for c in further])
    new = with_new_ids(dimension, wanted.join(dimension, "name", "left_anti"), "name").select("id", "name", *further)
    return dimension.unionByName(new, allowMissingColumns=True)


def replace_links(links: DataFrame, dimension: DataFrame, payload: DataFrame | None, products: DataFrame, key: str = "terpene_id") -> tuple[DataFrame, DataFrame]:
    """(links, dimension) after the links of ``products`` (product_id) were replaced by ``payload``.

    payload: (product_id, name, percent); None leaves everything, an empty one clears. A name that
    comes twice for a product is an error.
    """
    if payload is None:
        return links, dimension
    given = payload.withColumn("name", py_trim("name")).where("name <> ''")
    check_unique(given, ["product_id", "name"])  # the links' primary key
    dimension = upsert_dimension(dimension, given)
    new = given.join(dimension.select(F.col("id").alias(key), "name"), "name").select("product_id", key, "percent")
    return delete_links(links, products).unionByName(new), dimension


def create_products(domain, payload: DataFrame, terpenes: DataFrame, cannabinoids: DataFrame) -> dict[str, DataFrame]:
    """The five tables after new products were added with their links; nothing is written, so a failure leaves no part.

    payload: (pos, name, brand, category, is_active); terpenes: (pos, name, percent); cannabinoids:
    (pos, name, family, percent), where pos names the product.
    """
    rows = with_new_ids(domain.products, payload, "pos").withColumns({"name": py_trim("name"), "brand": strip_if_given("brand")})
    products = domain.products.unionByName(rows.drop("pos"), allowMissingColumns=True)
    ids = rows.select("pos", F.col("id").alias("product_id"))
    out = {"products": products}
    for table, key, given in (("terpenes", "terpene_id", terpenes), ("cannabinoids", "cannabinoid_id", cannabinoids)):
        links, dimension = replace_links(getattr(domain, f"product_{table}"), getattr(domain, table), given.join(ids, "pos").drop("pos"), ids, key)
        out |= {table: dimension, f"product_{table}": links}
    return out


def update_product(domain, product_id: int, fields: dict, terpenes: DataFrame | None = None, cannabinoids: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five tables after one product was changed: fields that are not None, and link sets that are given."""
    known = domain.products.where(F.col("id") == product_id)
    if known.isEmpty():
        raise ValueError("product not found")
    kinds = domain.products.schema
    update = known.select("id", *[F.lit(fields.get(c)).cast(kinds[c].dataType).alias(c) for c in ("name", "brand", "category", "is_active")])
    out = {"products": patch_products(domain.products, update)}
    one = known.select(F.col("id").alias("product_id"))
    for table, key, given in (("terpenes", "terpene_id", terpenes), ("cannabinoids", "cannabinoid_id", cannabinoids)):
        given = None if given is None else given.withColumn("product_id", F.lit(product_id).cast(kinds["id"].dataType))
        links, dimension = replace_links(getattr(domain, f"product_{table}"), getattr(domain, table), given, one, key)
        out |= {table: dimension, f"product_{table}": links}
    return out


def create_purchases(domain, payload: DataFrame, now: str, start: int | None = None) -> DataFrame:
    """Rows to append to the purchases: known customers only, total 0, the request's time where none is given.

    payload: (pos, customer_id, purchased_at, source, external_id, notes). An unknown customer refuses all.
    """
    missing = payload.join(domain.customers.select(F.col("id").alias("customer_id")), "customer_id", "left_anti").agg(F.min_by("customer_id", "pos")).first()[0]
    if missing is not None:
        raise ValueError(f"customer {missing} not found")
    time = F.lit(now).cast("timestamp_ntz")
    return with_new_ids(domain.purchases, payload, "pos", start=start).select(
        "id", "customer_id", F.coalesce("purchased_at", time).alias("purchased_at"), F.lit(0).cast("bigint").alias("total_amount_cents"),
        F.coalesce("source", F.lit("manual")).alias("source"), "external_id", "notes", time.alias("created_at"), time.alias("updated_at"),
    )


#: What a line must meet; a null quantity is one.
ITEM_RULES = {"quantity from 1 to 100": "coalesce(quantity, 1) between 1 and 100", "line_amount_cents from 0": "line_amount_cents >= 0"}


def add_items(domain, items: DataFrame, now: str = "2001-08-01 00:00:00", start: int | None = None) -> DataFrame:
    """Rows to append to the purchase items, with their product's name.

    items: (pos, purchase_id, product_id, quantity, line_amount_cents, and if given external_id). A line
    that breaks a rule, an unknown purchase or product refuses all.
    """
    broken = check(items, ITEM_RULES)[1].orderBy("pos").select("pos", "broken").first()
    if broken:
        raise ValueError(f"line {broken['pos']}: {', '.join(broken['broken'])}")
    for column, table in (("purchase_id", domain.purchases), ("product_id", domain.products)):
        missing = items.join(table.select(F.col("id").alias(column)), column, "left_anti").agg(F.min_by(column, "pos")).first()[0]
        if missing is not None:
            raise ValueError(f"{column.removesuffix('_id')} {missing} not found")
    names = domain.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    time, outside = F.lit(now).cast("timestamp_ntz"), F.col("external_id") if "external_id" in items.columns else F.lit(None).cast("string")
    return with_new_ids(domain.purchase_items, items, "pos", start=start).join(names, "product_id").select(
        "id", "purchase_id", "product_id", "product_name", F.coalesce("quantity", F.lit(1)).alias("quantity"), "line_amount_cents", outside.alias("external_id"),
        F.lit(None).cast("string").alias("feedback"), F.lit(None).cast("timestamp_ntz").alias("feedback_at"), time.alias("created_at"), time.alias("updated_at"),
    )


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Writes tables as one version of a folder and returns its path.

    All are written to a staging folder that gets its final name, ``version-`` and a number, in one
    rename; where one fails, the staging folder goes and the versions before stay as they are.
    """
    spark = next(iter(tables.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    staging = f"{folder}/_staging-{uuid.uuid4().hex}"
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        for name, df in tables.items():
            df.write.parquet(f"{staging}/{name}")
        number = max([0, *(int(n) for n in versions(spark, folder))]) + 1
        final = f"{folder}/version-{number:06d}"
        if not fs.rename(path(staging), path(final)):
            raise OSError(f"{final} could not be named")
        return final
    except Exception:
        fs.delete(path(staging), True)
        raise


def versions(spark, folder: str) -> list[str]:
    """Numbers of a folder's published versions, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n.removeprefix("version-") for n in names if n.startswith("version-"))


def link_customer(
    customers: DataFrame, auth_user_id: str, phone: str | None = None, email: str | None = None, name: str | None = None, opt_in: bool | None = None, now: str = "2001-08-01 00:00:00"
) -> tuple[DataFrame, dict]:
    """(customers, answer): links a user to the customer with the phone, else with the e-mail, else to a new one."""
    linked = customers.where(F.col("auth_user_id") == auth_user_id).orderBy("id").select("id").first()
    if linked:
        return customers, {"customer_id": linked[0], "linked": True}
    phone, email = (phone or "").strip() or None, (email or "").strip().lower() or None
    if not phone and not email:
        raise ValueError("give a phone or an e-mail")
    found = matched_customer(customers, phone, email).first()
    time = F.lit(now).cast("timestamp_ntz")
    if found:
        if found["auth_user_id"] and found["auth_user_id"] != auth_user_id:
            raise ValueError("customer already linked")
        mine = F.col("id") == found["id"]
        changed = {
            "auth_user_id": F.lit(auth_user_id),
            "name": F.coalesce(F.nullif("name", F.lit("")), F.lit(name or None).cast("string"), F.col("name")),
            "marketing_opt_in": F.coalesce(F.lit(opt_in).cast("boolean"), "marketing_opt_in"),
            "last_visit_at": F.coalesce("last_visit_at", time),
            "updated_at": time,
        }
        out = customers.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in changed.items() if c in customers.columns})
        return out, {"customer_id": found["id"], "linked": True, "created": False}
    values = {"name": name, "phone": phone, "email": email, "auth_user_id": auth_user_id, "marketing_opt_in": bool(opt_in)}
    new_id = (customers.agg(F.max("id")).first()[0] or 0) + 1
    new = customers.sparkSession.range(1).select(
        F.lit(new_id).alias("id"), *[F.lit(v).alias(c) for c, v in values.items()], *[time.alias(c) for c in ("last_visit_at", "created_at", "updated_at") if c in customers.columns]
    )
    return customers.unionByName(new, allowMissingColumns=True), {"customer_id": new_id, "linked": True, "created": True}


def matched_customer(customers: DataFrame, phone: str | None, email: str | None) -> DataFrame:
    """The customer with the phone, else the one with the e-mail: at most one row."""
    rank = F.when(F.col("phone") == phone, 1).when(F.col("email") == email, 2)
    return customers.withColumn("priority", rank).where("priority is not null").orderBy("priority", "id").limit(1)
