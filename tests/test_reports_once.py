"""Pages are parsed once, however many columns and filters use the result, and by more than one task."""

import pytest

from millrace.operators.documents import parsed_pages
from millrace.plans import QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", ["report_bars", "report_total", "deviation_note", "json_extract", "merge_extractions"])
def test_pages_are_parsed_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_pages_of_one_file_are_dealt(spark):
    pages = spark.range(100).selectExpr("id as report_id", "1 as page_no", "'{}' as raw").coalesce(1)
    assert parsed_pages(pages).rdd.getNumPartitions() == 4
