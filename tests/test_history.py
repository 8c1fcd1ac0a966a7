"""The history with terpenes covers all purchases of the customer, as its SQL does."""

from types import SimpleNamespace

import duckdb
import pytest

from millrace.operators.purchases import purchase_history
from millrace.plans import ORACLE_SQL, QUERIES, registry


def test_history_with_terpenes_has_no_page(spark, monkeypatch):
    domain = SimpleNamespace(
        spark=spark,
        purchases=spark.range(150).selectExpr("id", "88L as customer_id", "timestamp_ntz '2001-01-01' + make_interval(0, 0, 0, cast(id as int)) as purchased_at", "1 as total_amount_cents", "'manual' as source", "'' as notes"),
        purchase_items=spark.range(150).selectExpr("id", "id as purchase_id", "id % 2 as product_id", "1 as quantity", "1 as line_amount_cents", "'like' as feedback", "timestamp_ntz '2001-01-01' as feedback_at"),
        products=spark.createDataFrame([(0, "a", "other"), (1, "b", "other")], "id bigint, name string, category string"),
        product_terpenes=spark.createDataFrame([(0, 1, 0.5), (0, 2, None)], "product_id bigint, terpene_id int, percent double"),
        terpenes=spark.createDataFrame([(1, "t"), (2, "u")], "id int, name string"),
    )
    monkeypatch.setattr(registry, "Domain", lambda *_: domain)
    found = sorted(tuple(r) for r in QUERIES["history_with_terpenes"](spark, "").collect())
    assert found == [(k, "ab"[k % 2], ["t=0.5;u=-", ""][k % 2]) for k in range(150)]


def test_history_keeps_items_whose_ids_meet_those_of_another_purchase(spark):
    """Ids are numbered from 100 times the purchase, so one of 150 lines runs into the next purchase's."""
    many = spark.range(300).selectExpr("1 + id div 150 as purchase_id", "id % 150 + 1 as k").selectExpr("purchase_id * 100 + k as id", "purchase_id")
    domain = SimpleNamespace(
        purchases=spark.range(1, 3).selectExpr("id", "88L as customer_id", "timestamp_ntz '2001-01-01' as purchased_at", "1 as total_amount_cents", "'manual' as source", "'' as notes"),
        purchase_items=many.selectExpr("id", "purchase_id", "1L as product_id", "1 as quantity", "1 as line_amount_cents", "'like' as feedback", "timestamp_ntz '2001-01-01' as feedback_at"),
        products=spark.createDataFrame([(1, "a", "other")], "id bigint, name string, category string"),
    )
    assert [(r.id, len(r["items"])) for r in purchase_history(domain, 88).collect()] == [(2, 150), (1, 150)]


@pytest.mark.parametrize("name", ["portal_history", "purchase_history"])
def test_a_purchase_without_items_is_written_as_in_the_sql(spark, tmp_path, name):
    """The SQL writes it as '-|-', the operator has an empty array; the given small tables have none of customer 88."""
    orders = spark.createDataFrame([(k, 88, 10.0, k) for k in (1, 2, 3)], "o_orderkey bigint, o_custkey bigint, o_totalprice double, day int")
    lines = spark.createDataFrame([(1, 1, "A"), (1, 9, "R"), (3, 1, "N")], "l_orderkey bigint, l_partkey bigint, l_returnflag string")
    tables = {
        "orders": orders.selectExpr("o_orderkey", "o_custkey", "o_totalprice", "timestamp_ntz '2001-01-01' + make_interval(0, 0, 0, day) as o_orderdate", "'1-URGENT' as o_orderpriority"),
        "lineitem": lines.selectExpr("l_orderkey", "l_partkey", "1L as l_suppkey", "cast(l_partkey as int) as l_linenumber", "2D as l_quantity", "3D as l_extendedprice", "l_returnflag", "'O' as l_linestatus", "timestamp_ntz '2001-01-01' as l_shipdate"),
        "part": spark.sql("select 1L as p_partkey, 'a' as p_name, 'Brand#1' as p_brand, 'SMALL' as p_type, 1 as p_size"),
    }
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    found = con.execute(ORACLE_SQL[name])
    want = sorted(found.fetchall())
    df = QUERIES[name](spark, str(tmp_path))
    assert df.columns == [c[0] for c in found.description]
    assert sorted(tuple(r) for r in df.collect()) == want
    assert [r["items"] for r in df.orderBy("id").collect()][1] == "-|-"
    assert [r["items"] for r in purchase_history(registry.Domain(spark, str(tmp_path)), 88).collect()][1] == []
