"""What one task or the driver holds doesn't grow with the tables."""

from millrace.operators import generators
from millrace.plans import QUERIES
from millrace.sources import bucketed
from millrace.sources.bridge import Domain

from .conftest import SF


def test_generated_products_are_not_broadcast(spark):
    for name in ("generated_purchases", "generated_totals"):
        plan = QUERIES[name](spark, SF)
        plan.collect()
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_generated_totals_need_no_items(spark):
    bought, items = generators.generate_purchases(spark.range(40), spark.range(7, 300, 30), "2001-08-01 00:00:00")
    sums = dict(items.groupBy("purchase_id").sum("line_amount_cents").collect())
    assert {r.id: r.total_amount_cents for r in bought.collect()} == sums


def test_buckets_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(bucketed, "BUCKET_ROWS", 500)
    d = Domain(spark, SF)
    bucketed.write(d, "bucket_numbers")
    listed = spark.sql("describe extended bucket_numbers.purchase_items").where("col_name = 'Num Buckets'").first()
    assert int(listed.data_type) == -(-d.purchase_items.count() // 500) > 4
