"""Rules whose results were worked out by hand."""

import base64
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import documents as D
from millrace.operators import generators, paging, preferences, purchases, writes


def shop(spark, items, links, products=None, percent="double"):
    """A domain with one customer; items: (id, product, feedback, at), links: (product, terpene, percent)."""
    ids = sorted({i[1] for i in items} | {x[0] for x in links})
    products = products or [(p, f"p{p}", None, "other", True) for p in ids]
    bought = [(i[0], 1, i[3] if len(i) > 3 else "2001-07-01 00:00:00") for i in items]
    names = sorted({x[1] for x in links}) or [0]
    return SimpleNamespace(
        spark=spark,
        purchases=spark.createDataFrame(bought, "id bigint, customer_id bigint, at string").withColumn("purchased_at", F.col("at").cast("timestamp_ntz")),
        purchase_items=spark.createDataFrame([(i[0] * 100, i[0], i[1], i[2]) for i in items], "id bigint, purchase_id bigint, product_id bigint, feedback string"),
        products=spark.createDataFrame(products, "id bigint, name string, brand string, category string, is_active boolean"),
        product_terpenes=spark.createDataFrame(links, f"product_id bigint, terpene_id int, percent {percent}"),
        terpenes=spark.createDataFrame([(t, f"t{t}") for t in names], "id int, name string"),
    )


def scores(d):
    return {r.terpene: (r.score, r.likes, r.dislikes, r.neutrals) for r in preferences.preference_scores(d).collect()}


def best(d, **options):
    return [(r.id, r.score) for r in sorted(preferences.recommendations(d, **options).collect(), key=lambda r: r["rank"])]


def test_zero_and_null_percent(spark):
    assert scores(shop(spark, [(1, 1, "like")], [(1, 0, 0.0)])) == {"t0": (0.0, 1, 0, 0)}
    assert scores(shop(spark, [(1, 1, "dislike")], [(1, 0, None)])) == {"t0": (-0.1, 0, 1, 0)}
    d = shop(spark, [(1, 1, "like"), (2, 2, "like")], [(1, 0, 0.0), (2, 0, 0.5)])
    assert best(d) == [(2, 0.25), (1, 0.05)]  # 0.0 counts as 0.10 in a match, not in a score


def test_neutral_only_gives_all_active_by_name(spark):
    goods = [(1, "b", None, "other", True), (2, "a", None, "other", True), (3, "c", None, "other", False)]
    d = shop(spark, [(1, 1, "neutral")], [(1, 0, 0.5)], goods)
    assert scores(d) == {"t0": (0.0, 0, 0, 1)} and best(d) == [(2, 0.0), (1, 0.0)]


def test_no_links_no_recommendations(spark):
    goods = [(1, "a", "B", "other", True), (2, "b", "B", "other", True)]
    d = shop(spark, [(1, 1, "like")], [(2, 0, 0.5)], goods)
    assert scores(d) == {} and best(d) == []


def test_brand_swamps_attributes_and_ties_go_by_name_then_id(spark):
    goods = [(1, "x", "B", "other", True), (2, "y", "B", "other", True), (3, "a", None, "other", True), (4, "a", "", "other", True), (5, "a", "C", "other", True)]
    items = [(1, 1, "like"), (2, 1, "like"), (3, 2, "dislike"), (4, 4, "like")]
    d = shop(spark, items, [(1, 0, 1.0)], goods)
    assert best(d) == [(1, 1002.0), (2, 1000.0), (3, 0.0), (4, 0.0), (5, 0.0)]
    assert best(d, limit=2) == [(1, 1002.0), (2, 1000.0)]


@pytest.mark.parametrize("groups", [preferences.MOST_GROUPS, 0])
def test_recommendations_are_brute_forces(spark, monkeypatch, groups):
    import random

    rng = random.Random(5)
    monkeypatch.setattr(preferences, "PRODUCT_BLOCK", 7)
    monkeypatch.setattr(preferences, "MOST_GROUPS", groups)
    goods = [(p, rng.choice("abc"), rng.choice([None, "", "B", "C"]), "other", rng.random() < 0.9) for p in range(60)]
    links = [(p, t, rng.choice([None, 0.0, 0.25, 1.5])) for p in range(60) for t in rng.sample(range(6), rng.choice([0, 0, 1, 2]))]
    items = [(k, rng.randrange(60), rng.choice(["like", "dislike", "neutral", None])) for k in range(12)]
    d = shop(spark, items, links, goods)
    sign = {"like": 1, "dislike": -1, "neutral": 0}
    known, net = {}, {}
    for _, p, f in items:
        if f:
            for q, t, x in links:
                if q == p:
                    known[t] = known.get(t, 0) + sign[f] * (0.1 if x is None else x)
            if goods[p][2]:
                net[goods[p][2]] = net.get(goods[p][2], 0) + sign[f]
    want = []
    for p, name, brand, _, active in goods:
        if active:
            s = sum((x or 0.1) * known.get(t, 0) for q, t, x in links if q == p) + 1000 * (net.get(brand, 0) if brand else 0)
            want.append((-round(s, 6), name, p))
    for limit in (3, 10, 50):
        assert best(d, limit=limit) == [(p, -s + 0.0) for s, _, p in sorted(want)[:limit]]


def test_few_pairs_are_scored(spark, monkeypatch):
    from millrace.sources.bridge import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    pairs = preferences.preference_scores(d).select("customer_id").distinct().count() * d.products.where("is_active").count()
    count = lambda: preferences._candidates(d, None, preferences.AS_OF, 180, 10).groupBy("customer_id").agg(F.max("scored").alias("n")).agg(F.sum("n")).first()[0]
    assert count() < 0.3 * pairs  # of 174 products; the more there are, the fewer
    monkeypatch.setattr(preferences, "MOST_GROUPS", 0)
    assert count() == pairs


def test_window_edges(spark):
    cutoff = ["2001-02-02 00:00:00", "2001-02-01 23:59:59.999999"]
    d = shop(spark, [(1, 1, "like", cutoff[0]), (2, 1, "like", cutoff[1])], [(1, 0, 0.5)])
    assert scores(d)["t0"][1] == 1 and preferences.purchase_counts(d).first().purchased_count == 2
    with pytest.raises(ValueError):
        preferences.preference_scores(d, window_days=0)


def test_searches(spark):
    rows = spark.createDataFrame([(None, None, None), ("", None, None), ("a%c_b", None, None), ("x\\b", None, None)], "name string, email string, phone string")
    found = lambda q: sorted(str(r.name) for r in paging.search_customers(rows, q).collect())
    assert len(found("")) == len(found(None)) == 4 and "None" not in found("  ") and len(found("  ")) == 3
    assert len(found("%")) == 3 and len(found("_")) == 2 and found("\\%") == ["a%c_b"] and len(found("\\b")) == 2
    with pytest.raises(ValueError):
        paging.page(rows, [F.asc("name")], 201)


def test_texts(spark):
    row = spark.createDataFrame([("  ", "", " a\t", None)], "b string, e string, a string, n string").select(
        X.strip_if_given("b").alias("kept"), X.strip_if_given("e").alias("empty"), X.blank_to_null("b").alias("null"), X.py_trim("a").alias("a"),
        X.clamp(F.lit(9), 1, 5).alias("nine"), X.clamp(F.lit(-1), 1, 5).alias("low"), X.clamp(F.lit(None).cast("int"), 1, 5).alias("none"),
        X.dollars(F.lit(1234)).alias("cents"), X.feedback_label("n").alias("dash"), X.joined_notes("e", "n").alias("notes"), X.parsed_ids(F.lit(" 1, ,3")).alias("ids"),
        X.upper(F.lit("thc")).alias("upper"), X.fixed(F.lit(0.25), 3).alias("fixed"), X.kilobytes(F.lit(1536)).alias("kb"), X.base64_text(F.lit(bytearray(b"x" * 90))).alias("b64"),
        X.iso_time(F.lit("2001-02-03 04:05:06.7").cast("timestamp_ntz")).alias("time"),
    ).first()
    assert tuple(row) == ("", None, None, "a", 5, 1, None, "$12.34", "—", None, [1, 3], "THC", "0.250", "1.5 KB", base64.b64encode(b"x" * 90).decode(), "2001-02-03T04:05:06Z")
    with pytest.raises(Exception, match="not an id: x"):
        spark.range(1).select(X.parsed_ids(F.lit("1,x"))).collect()


def test_missing_product_refuses_all(spark):
    d = shop(spark, [(1, 1, "like")], [(1, 0, 0.5)])
    items = spark.createDataFrame([(1, 0, 1, 1), (8, 1, 1, 1), (9, 2, 1, 1)], "product_id bigint, pos int, quantity int, line_amount_cents int")
    with pytest.raises(ValueError, match="product 8 "):
        purchases.batch_items(d, 1, items)
    with pytest.raises(ValueError, match="purchase 999 "):
        purchases.batch_items(d, 999, items)
    for bad, why in ((items.where("false"), "items must be"), (items.where("pos = 0").crossJoin(spark.range(101)).withColumn("pos", F.col("id")).drop("id"), "items must be")):
        with pytest.raises(ValueError, match=why):
            purchases.batch_items(d, 1, bad)
    for column, value in (("quantity", 0), ("quantity", 101), ("line_amount_cents", -1), ("line_amount_cents", None)):
        with pytest.raises(ValueError, match="line 0: "):
            purchases.batch_items(d, 1, items.where("pos = 0").withColumn(column, F.lit(value).cast("int")))
    most = items.where("pos = 0").crossJoin(spark.range(100)).withColumn("pos", F.col("id")).drop("id").withColumn("external_id", F.col("pos").cast("string"))
    rows = sorted(purchases.batch_items(d, 1, most).collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == list(range(101, 201)) and [r.external_id for r in rows] == [str(k) for k in range(100)]


def test_replacing_links(spark):
    links = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.2), (2, 0, 0.3)], "product_id bigint, terpene_id int, percent double")
    names = spark.createDataFrame([(0, "a"), (1, "b")], "id int, name string")
    one = spark.createDataFrame([(1,)], "product_id bigint")
    payload = lambda *x: spark.createDataFrame([(1, n, None) for n in x], "product_id bigint, name string, percent double")

    def after(given):
        new, dimension = writes.replace_links(links, names, given, one)
        return sorted(r.name for r in new.where("product_id = 1").join(dimension, F.col("id") == F.col("terpene_id")).collect())

    assert after(payload("b", " c ")) == ["b", "c"] and after(payload()) == [] and after(None) == ["a", "b"]
    with pytest.raises(ValueError):
        writes.replace_links(links, names, payload("b", "b"), one)


def test_linking_customers(spark):
    rows = [(1, None, "1", None, None), (2, "n", None, "e@x.y", None), (3, "t", "3", None, "other")]
    customers = spark.createDataFrame(rows, "id bigint, name string, phone string, email string, auth_user_id string").withColumn("marketing_opt_in", F.lit(False)).withColumn("last_visit_at", F.lit(None).cast("timestamp_ntz"))
    after, told = writes.link_customer(customers, "u", "1", "E@x.y", "Name")
    assert told == {"customer_id": 1, "linked": True, "created": False} and after.where("id = 1").first().name == "Name"
    assert writes.link_customer(after, "u", "9")[1] == {"customer_id": 1, "linked": True}
    assert writes.link_customer(customers, "u", None, "E@x.y")[1]["customer_id"] == 2
    after, told = writes.link_customer(customers, "u", "77")
    assert told == {"customer_id": 4, "linked": True, "created": True} and after.count() == 4
    for bad in ({"phone": "3"}, {"phone": " "}):
        with pytest.raises(ValueError):
            writes.link_customer(customers, "u", **bad)


def document(readings, confidence=3, total="null", **texts):
    listed = ", ".join(f'{{"name": "t{k}", "percent": {p}}}' for k, p in enumerate(readings))
    named = "".join(f'"{k}": "{v}", ' for k, v in texts.items())
    return f'{{{named}"total_terpenes": {total}, "terpenes": [{listed}], "confidence": {confidence}}}'


def merged(spark, *pages):
    frame = spark.createDataFrame([(1, k, p) for k, p in enumerate(pages, 1)], "report_id bigint, page_no int, raw string")
    return D.merge_pages(D.parsed_pages(frame)).first()


def test_merging_pages(spark):
    two, other = document([1.0, 2.0], 2, batch_id=""), document([5.0, 6.0], 1, batch_id="B")
    row = merged(spark, two, other)
    assert [r.percent for r in row.doc.terpenes] == [1.0, 2.0] and row.doc.batch_id == "B" and row.doc.confidence == 2
    assert len(merged(spark, two, document([1, 2, 3], 1)).doc.terpenes) == 3
    assert len(merged(spark, document([1.0], 3), document([1, 2], 3)).doc.terpenes) == 1  # stops early
    assert merged(spark, document([1.0], 3), "{").error is None and merged(spark, document([1.0], 2), "{").error == "not a document"


def test_checking_pages(spark):
    assert merged(spark, document([20.0])).error is None and merged(spark, document([20.1])).error
    assert merged(spark, document([], 9)).doc.confidence == 5 and merged(spark, document([], -1)).doc.confidence == 1
    assert "15.5%" in merged(spark, document([2.31], 3, "2.0")).doc.confidence_notes and merged(spark, document([2.2], 3, "2.0")).doc.confidence_notes is None
    assert merged(spark, f"```json\n{document([1.0])}\n```").error is None
    row = spark.createDataFrame([("BCP", "4.2", "mg/g"), ("Guaiol", "ND", "%")], "n string, v string, u string").select(D.canonical_name("n").alias("n"), D.in_percent("v", "u").alias("p")).collect()
    assert [r.n for r in row] == ["Caryophyllene", "Guaiol"] and row[0].p == pytest.approx(0.42) and row[1].p is None


def test_processing(spark):
    pages = spark.createDataFrame([(1, 1, document([1.0])), (2, 1, document([])), (3, 1, "x"), (4, 1, document([1.0]))], "report_id bigint, page_no int, raw string")
    targets = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, None)], "report_id bigint, product_id bigint")
    assert {r.report_id: r.status for r in D.process_reports(pages, targets).collect()} == {1: "applied", 2: "extracted", 3: "failed", 4: "extracted"}


def test_a_request_stops_at_the_first_failure(spark):
    raw = {1: document([1.0]), 2: "x", 3: document([1.0]), 4: document([2.0]), 5: document([])}
    pages = spark.createDataFrame([(k, 1, r) for k, r in raw.items()], "report_id bigint, page_no int, raw string")
    targets = spark.createDataFrame([(1, 7, 1, 0, None), (2, 7, 1, 1, 3), (3, 7, 1, 2, 4), (4, 8, 2, 5, None), (5, 8, 2, 4, None)], "report_id bigint, product_id bigint, request int, pos int, old_product_id bigint")
    got = {r.report_id: (r.status, r.product_id, r.error_message) for r in D.process_reports(pages, targets).collect()}
    assert got == {1: ("applied", 7, None), 2: ("failed", 3, "not a document"), 3: ("pending", 4, None), 4: ("applied", 8, None), 5: ("extracted", 8, None)}


def test_readings_that_are_no_number(spark):
    page = '{"terpenes": [{"name": "BCP", "percent": "4.2", "unit": "mg/g"}, {"name": "Guaiol", "percent": "ND"}, {"name": "Linalool", "percent": " <loq "}, {"name": "x", "percent": 1.5}]}'
    assert [(r.name, r.percent) for r in merged(spark, page).doc.terpenes] == [("Caryophyllene", 0.42), ("x", 1.5)]
    assert merged(spark, page.replace("ND", "many")).error == "reading out of range"


def test_new_names_get_the_payloads_family(spark):
    kinds = spark.createDataFrame([(0, "CBD", "cbd")], "id int, name string, family string")
    names = spark.createDataFrame([("CBD", "thc", 0), (" New", "thc", 1), ("New", "cbd", 2)], "name string, family string, pos int")
    assert sorted(map(tuple, writes.upsert_dimension(kinds, names).collect())) == [(0, "CBD", "cbd"), (1, "New", "thc")]


def test_unknown_ids_refuse_a_write(spark):
    d = shop(spark, [(1, 1, "like")], [(1, 0, 0.5)])
    d.customers = spark.createDataFrame([(1,)], "id bigint")
    rows = spark.createDataFrame([(0, 1, None, None, None, None), (1, 9, None, None, None, None)], "pos int, customer_id bigint, purchased_at timestamp_ntz, source string, external_id string, notes string")
    with pytest.raises(ValueError, match="customer 9"):
        writes.create_purchases(d, rows, "2001-08-01 00:00:00")
    items = spark.createDataFrame([(0, 1, 1, 1, 5), (1, 2, 1, 1, 5)], "pos int, purchase_id bigint, product_id bigint, quantity int, line_amount_cents int")
    with pytest.raises(ValueError, match="purchase 2"):
        writes.add_items(d, items)
    with pytest.raises(ValueError, match="product 8"):
        writes.add_items(d, items.where("pos = 0").withColumn("product_id", F.lit(8).cast("bigint")))
    with pytest.raises(ValueError, match="product not found"):
        writes.update_product(d, 99, {})


def test_publishing_whole_versions(spark, tmp_path):
    folder = str(tmp_path / "shop")
    first = writes.publish({"a": spark.range(3), "b": spark.range(2)}, folder)
    broken = spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        writes.publish({"a": spark.range(9), "b": broken}, folder)
    assert writes.versions(spark, folder) == ["000001"] and spark.read.parquet(f"{first}/a").count() == 3
    assert writes.publish({"a": spark.range(4)}, folder).endswith("version-000002") and writes.versions(spark, folder) == ["000001", "000002"]


def test_extraction_stops_when_there_is_enough(spark):
    uploads = spark.createDataFrame([(1, bytearray(b"a,b,c,d")), (2, None)], "report_id bigint, pdf_bytes binary")
    out = D.extract_pages(uploads, lambda pdf: pdf.split(b","), lambda page: page.decode(), lambda raw: raw == "b")
    assert [(r.page_no, r.raw) for r in out.collect()] == [(1, "a"), (2, "b")]


def test_generated_purchases(spark):
    bought, items = generators.generate_purchases(spark.range(40), spark.range(7, 300, 30), "2001-08-01 00:00:00")
    per = [r["count"] for r in bought.groupBy("customer_id").count().collect()]
    assert len(per) == 40 and min(per) >= 5 and max(per) <= 15
    lines = items.groupBy("purchase_id").agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("d"), F.sum("line_amount_cents").alias("s"), F.min("line_amount_cents").alias("a"), F.max("line_amount_cents").alias("b")).collect()
    assert all(r.n == r.d and 1 <= r.n <= 3 and r.a >= 3000 and r.b <= 15_000 for r in lines)
    assert {(r.id, r.total_amount_cents) for r in bought.collect()} == {(r.purchase_id, r.s) for r in lines}
    assert {r.product_id for r in items.collect()} == set(range(7, 300, 30))
    assert [r.purchased_at for r in bought.orderBy("customer_id", "number").collect()] == [r.purchased_at for r in bought.orderBy("customer_id", "purchased_at").collect()]
    assert bought.where("purchased_at > timestamp_ntz '2001-08-01' or purchased_at < timestamp_ntz '2001-02-02'").count() == 0


def test_numbers_without_one_task(spark):
    rows = [(k * 7919 % 1000, "x") for k in range(1000)] + [(5, "again")]
    out = generators.numbered(spark.createDataFrame(rows, "id bigint, x string").repartition(7), "id")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.number, r.id) for r in out.collect())
    assert [n for n, _ in got] == list(range(1001)) and [i for _, i in got] == sorted(r[0] for r in rows)
    assert generators.numbered(spark.createDataFrame([], "id bigint"), "id").count() == 0


def test_samples_are_uniform(spark):
    from collections import Counter
    from itertools import combinations

    n, draws = 7, 21_000
    for k in (2, 3):
        drawn = spark.range(draws).select(generators.sampled(n, F.lit(k).cast("bigint"), 9, "id").alias("x")).collect()
        sets = Counter(tuple(sorted(r.x)) for r in drawn)
        assert set(sets) == set(combinations(range(n), k))
        mean = draws / len(sets)
        # 20 and 34 degrees of freedom: 45.3 and 65.2 are passed by chance once in a thousand times
        assert sum((x - mean) ** 2 / mean for x in sets.values()) < {2: 45.3, 3: 65.2}[k]
    assert spark.range(1).select(generators.sampled(3, F.lit(3).cast("bigint"), 1, "id").alias("x")).first().x.__len__() == 3


def test_generated_links(spark):
    products, kinds = spark.range(50), spark.createDataFrame([(k, f"n{k}", "thc" if k < 4 else "cbd") for k in range(10)], "id int, name string, family string")
    n = generators.sample_attributes(products, kinds).groupBy("product_id").agg(F.count("*").alias("n"), F.countDistinct("attribute_id").alias("d")).collect()
    assert len(n) == 50 and all(r.n == r.d and 1 <= r.n <= 4 for r in n)
    mains = generators.family_picks(products, kinds).groupBy("product_id").agg(F.sum(F.col("is_main").cast("int")).alias("m"), F.count("*").alias("n")).collect()
    assert all(r.m == 2 and 2 <= r.n <= 4 for r in mains)
    total = generators.normalized_percents(spark.createDataFrame([(1, k, w) for k, w in enumerate([1.0, 1.0, 1.0])], "product_id int, idx int, weight double"))
    assert sorted((r.idx, r.percent) for r in total.collect()) == [(0, 0.34), (1, 0.33), (2, 0.33)]


def test_checks(spark):
    good, bad = writes.check(spark.createDataFrame([(1,), (-1,), (None,)], "cents bigint"), {"not negative": "cents >= 0"})
    assert good.count() == 1 and {tuple(r.broken) for r in bad.collect()} == {("not negative",)}
