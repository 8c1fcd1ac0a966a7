"""Requests to process reports against the same requests taken one by one."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millrace.operators import documents as D
from millrace.operators import requests as Q
from millrace.sources.versions import Conflict, Store


def page(readings, confidence=3):
    listed = ", ".join(f'{{"name": "{n}", "percent": {p}}}' for n, p in readings)
    return f'{{"lab_name": "L", "terpenes": [{listed}], "confidence": {confidence}}}'


def shop(spark, reports, products=(1, 2, 3)):
    return SimpleNamespace(
        products=spark.createDataFrame([(p,) for p in products], "id bigint"),
        terpenes=spark.createDataFrame([(0, "a"), (1, "b")], "id int, name string"),
        product_terpenes=spark.createDataFrame([(1, 0, 0.5), (1, 1, None), (2, 1, 0.1)], "product_id bigint, terpene_id int, percent double"),
        lab_reports=spark.createDataFrame([(r, None, "pending", has, None, None) for r, has in reports], "report_id bigint, product_id bigint, status string, has_document boolean, lab_name string, error_message string"),
    )


def one_by_one(reports, requests, documents):
    """(status and product by report, links by product, stops, answers) of requests taken in turn."""
    state = {r: ["pending", None, has] for r, has in reports}
    links = {1: {("a", 0.5), ("b", None)}, 2: {("b", 0.1)}}
    names, stops, answers = {"a", "b"}, [], []
    for k, (product, listed) in enumerate(requests):
        if product is not None and product not in (1, 2, 3):
            stops.append((k, listed[0], Q.NO_PRODUCT))
            continue
        for r in listed:
            readings = documents.get(r)
            cleaned = [n.strip() for n, _ in readings or [] if n.strip()]
            if r not in state:
                stops.append((k, r, Q.NO_REPORT))
            elif not state[r][2]:
                stops.append((k, r, Q.NO_DOCUMENT))
            elif readings is None:
                state[r] = ["failed", state[r][1], False]
                stops.append((k, r, D.NO_PAGES))
            elif product is not None and len(set(cleaned)) < len(cleaned):
                stops.append((k, r, Q.TWICE))
            else:
                status = "applied" if product is not None and readings else "extracted"
                state[r] = [status, product, False]
                answers.append((k, r, status))
                if status == "applied":
                    links[product] = {(n.strip(), p) for n, p in readings if n.strip()}
                    names |= set(cleaned)
                continue
            break
    return {r: tuple(s) for r, s in state.items()}, links, names, sorted(stops), sorted(answers)


def processed(spark, reports, requests, documents):
    rows = [(k, pos, r, product) for k, (product, listed) in enumerate(requests) for pos, r in enumerate(listed)]
    pages = spark.createDataFrame([(r, 1, page(x)) for r, x in documents.items() if x is not None], "report_id bigint, page_no int, raw string")
    out = Q.process_requests(shop(spark, reports), spark.createDataFrame(rows, "request int, pos int, report_id bigint, product_id bigint"), pages)
    links = {}
    for r in out["product_terpenes"].join(out["terpenes"], F.col("id") == F.col("terpene_id")).collect():
        links.setdefault(r.product_id, set()).add((r.name, r.percent))
    return (
        {r.report_id: (r.status, r.product_id, r.has_document) for r in out["lab_reports"].collect()}, links, {r.name for r in out["terpenes"].collect()},
        sorted((r.request, r.report_id, r.reason) for r in out["stops"].collect()), sorted((r.request, r.report_id, r.status) for r in out["answers"].collect()),
    )


def test_requests_that_depend_on_each_other(spark):
    reports = [(r, True) for r in range(1, 9)]
    documents = {1: [("c", 1.0)], 2: None, 3: [("a", 1.0), (" a ", 2.0)], 4: [], 5: [(" ", 1.0)], 6: [("d ", 1.0)], 7: [("a", 2.0)], 8: [("b", 3.0)]}
    requests = [(1, [1, 2, 7]), (1, [7, 1, 8]), (None, [8, 3, 3]), (2, [8]), (2, [3, 6]), (9, [6]), (2, [6, 99, 5]), (2, [4, 5]), (3, [5, 4])]
    got, want = processed(spark, reports, requests, documents), one_by_one(reports, requests, documents)
    assert got[:1] == want[:1] and got[2:] == want[2:]
    assert got[1] == {p: x for p, x in want[1].items() if x}


@pytest.mark.parametrize("seed", range(3))
def test_random_requests(spark, seed):
    rng = random.Random(seed)
    reports = [(r, rng.random() < 0.9) for r in range(25)]
    names = ["a", "b", "c ", " d", "", "e"]
    documents = {r: rng.choice([None, [], *[[(n, float(k)) for k, n in enumerate(rng.sample(names, rng.randrange(1, 4)))] for _ in range(6)], [("c", 1.0), (" c", 2.0)]]) for r in range(25)}
    requests = [(rng.choice([None, 1, 2, 3, 3, 1, 7]), [rng.randrange(27) for _ in range(rng.randrange(1, 7))]) for _ in range(25)]
    got, want = processed(spark, reports, requests, documents), one_by_one(reports, requests, documents)
    assert got[0] == want[0] and got[2:] == want[2:] and got[1] == {p: x for p, x in want[1].items() if x}


def test_a_report_without_pages_stops_its_request(spark):
    pages = spark.createDataFrame([(1, 1, page([("a", 1.0)])), (3, 1, page([("b", 1.0)]))], "report_id bigint, page_no int, raw string")
    targets = spark.createDataFrame([(1, 7, 1, 0), (2, 7, 1, 1), (3, 7, 1, 2)], "report_id bigint, product_id bigint, request int, pos int")
    assert {r.report_id: (r.status, r.error_message) for r in D.process_reports(pages, targets).collect()} == {1: ("applied", None), 2: ("failed", D.NO_PAGES), 3: ("pending", None)}


def render(pdf):
    if pdf == b"broken":
        raise OSError("cannot be opened")
    return [p for p in pdf.split(b",") if p]


def extract(image):
    if image == b"bad":
        raise ValueError("x" * 2000)
    return page([(image.decode(), 1.0)], 1)


def test_errors_of_given_functions_are_rows(spark):
    uploads = spark.createDataFrame([(1, bytearray(b"a,b")), (2, bytearray(b"c,bad,d")), (3, bytearray(b"broken")), (4, bytearray(b"")), (5, bytearray(b"e")), (6, None)], "report_id bigint, pdf_bytes binary")
    found = D.extract_pages(uploads, render, extract)
    rows = sorted((r.report_id, r.page_no, r.raw is None, r.error) for r in found.collect())
    assert rows == [(1, 1, False, None), (1, 2, False, None), (2, 1, False, None), (2, 2, True, "x" * 1000), (3, 0, True, "cannot be opened"), (4, 0, True, D.NO_PAGES), (5, 1, False, None)]
    merged = {r.report_id: r.error for r in D.merge_pages(D.parsed_pages(found)).collect()}
    assert merged == {1: None, 2: "x" * 1000, 3: "cannot be opened", 4: D.NO_PAGES, 5: None}


def test_what_is_known_is_not_extracted_again(spark, tmp_path):
    uploads = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"bad"))], "report_id bigint, pdf_bytes binary")
    known = spark.createDataFrame([(1, 1, "kept", None)], D.PAGES)
    assert sorted((r.report_id, r.raw, r.error and r.error[:1]) for r in D.extract_pages(uploads, render, extract, known=known).collect()) == [(1, "kept", None), (2, None, "x")]


def test_requests_are_one_version(spark, tmp_path):
    reports = [(r, True) for r in range(1, 6)]
    documents = {1: [("c", 1.0)], 2: [("a", 2.0), ("d ", 3.0)], 3: [], 4: None, 5: [("e", 1.0)]}
    requests = [(1, [1, 2]), (2, [3, 4, 5])]
    rows = [(k, pos, r, product) for k, (product, listed) in enumerate(requests) for pos, r in enumerate(listed)]
    pages = spark.createDataFrame([(r, 1, page(x)) for r, x in documents.items() if x is not None], "report_id bigint, page_no int, raw string")
    asked = spark.createDataFrame(rows, "request int, pos int, report_id bigint, product_id bigint")
    d, store = shop(spark, reports), Store(spark, str(tmp_path / "s"))
    documents_stored = d.lab_reports.withColumn("pdf_bytes", F.lit(bytearray(b"x"))).drop("has_document")
    with store.begin() as t:
        for name, df, key in (("products", d.products, ["id"]), ("terpenes", d.terpenes, ["id"]), ("lab_reports", documents_stored, ["report_id"]), ("product_terpenes", d.product_terpenes, ["product_id", "terpene_id"])):
            t.replace(name, df, key)
    late = store.begin()
    late.read("product_terpenes")
    Q.apply_requests(store, asked, pages)
    assert store.version() == 2
    names = {r.id: r.name for r in store.read("terpenes").collect()}
    links = {(r.product_id, names[r.terpene_id], r.percent) for r in store.read("product_terpenes").collect()}
    assert links == {(1, "a", 2.0), (1, "d", 3.0), (2, "b", 0.1)} and set(names.values()) == {"a", "b", "c", "d"}
    got = {r.report_id: (r.status, r.product_id, r.pdf_bytes is None) for r in store.read("lab_reports").collect()}
    assert got == {1: ("applied", 1, True), 2: ("applied", 1, True), 3: ("extracted", 2, True), 4: ("failed", None, True), 5: ("pending", None, False)}
    assert [log["rows"] for log in store.tables()["lab_reports"]["logs"]] == [4]
    late.upsert("product_terpenes", d.product_terpenes.limit(1))
    with pytest.raises(Conflict):
        late.commit()
    Q.apply_requests(store, asked, pages)  # all documents but one are gone: report 1 and 3 stop their requests
    assert {r.report_id: r.status for r in store.read("lab_reports").collect()} == {r: x[0] for r, x in got.items()}
