"""Requests to process reports, folded in their order, up to the links of the products they name.

Many requests are folded at once, as if they had come one after the other: by ``request``, and within
one by ``pos``. A request takes its reports until one stops it:

- a product that isn't known refuses the whole request;
- a report that isn't known, or whose document isn't stored (any more), stops it;
- a report whose extraction fails is failed, loses its document and stops it;
- readings that name an attribute twice can't be applied: the report stays as it was, and stops it;
- any other report is applied, if the request has a product and the report readings, or extracted,
  and loses its document.

What came before a stop stays. Whether a report still has its document depends on earlier requests
that name it, and so on those before them. Each pass settles a request from what is known of earlier
ones; passes go on until nothing changes, which takes one more than the longest chain of requests that
depend on each other, and two where no report is named twice.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_trim
from ..sources.shared import cut, table
from ..sources.versions import Store
from .documents import document_columns, extracted
from .writes import replace_links, upsert_dimension

# why a request stopped
NO_PRODUCT, NO_REPORT, NO_DOCUMENT, TWICE = "product not found", "report not found", "no stored document", "an attribute comes twice"


def _mentions(requests: DataFrame, reports: DataFrame, products: DataFrame, pages: DataFrame) -> DataFrame:
    """Each report that a request names, with what can be said of it whatever other requests do."""
    known = products.select(F.col("id").alias("product_id"), F.lit(True).alias("is_product"))
    stored = reports.select("report_id", _has_document(reports).alias("stored"))
    named = requests.select("request", "pos", "report_id", "product_id").join(known, "product_id", "left").join(stored, "report_id", "left")
    every = extracted(named, pages)
    names = F.filter(F.transform("doc.terpenes", lambda r: py_trim(r["name"])), lambda x: x != "")
    twice = F.col("product_id").isNotNull() & (F.size(names) > F.size(F.array_distinct(names)))
    barred = (
        F.when(F.col("product_id").isNotNull() & F.col("is_product").isNull(), NO_PRODUCT).when(F.col("stored").isNull(), NO_REPORT)
        .when(~F.col("stored"), NO_DOCUMENT).when(F.col("error").isNull() & twice, TWICE)
    )
    return every.withColumn("barred", barred).drop("is_product", "stored")


def _has_document(reports: DataFrame) -> Column:
    """Whether a report's document is stored: by a column of that name, else by pdf_bytes."""
    return F.coalesce("has_document", F.lit(False)) if "has_document" in reports.columns else F.col("pdf_bytes").isNotNull()


def _folded(mentions: DataFrame) -> DataFrame:
    """``mentions`` (request, pos, report_id, barred, failed) with reached, gone and taken.

    reached: all before it in its request were taken without failing; gone: its document was taken
    earlier; taken: reached, neither barred nor gone.
    """
    request = Window.partitionBy("request").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    report = Window.partitionBy("report_id").orderBy("request", "pos").rowsBetween(Window.unboundedPreceding, -1)
    now, settled = cut(mentions.withColumn("taken", F.col("barred").isNull())), False
    while not settled:
        free = now.select(*mentions.columns, F.col("taken").alias("was"), F.coalesce(F.max("taken").over(report), F.lit(False)).alias("gone"))
        free = free.withColumn("free", F.col("barred").isNull() & ~F.col("gone"))
        reached = free.withColumn("reached", F.coalesce(F.min(F.col("free") & ~F.col("failed")).over(request), F.lit(True)))
        now = cut(reached.withColumn("taken", F.col("reached") & F.col("free")))
        settled = now.where("was <> taken").isEmpty()
    return now


def process_requests(domain, requests: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """All frames after the requests: answers, stops, lab_reports, product_terpenes and terpenes; nothing is written.

    requests: (request, pos, report_id, product_id), the product the same in all rows of a request, or
    null; pages: (report_id, page_no, raw, and if given error). domain has products, lab_reports
    (report_id, product_id, status, has_document or pdf_bytes, and others), product_terpenes and terpenes.

    answers: the reports that were processed without failing, as they are shown; stops: the report at
    which a request stopped, and why. Of several reports applied to a product the last in the order of
    requests holds; reports without readings leave the links. New names are kept, also those of
    reports that others followed. taken and relinked are the keys of the reports and products that changed.
    """
    # documents are written once, and read again only for what shows them; all else is folded without them
    mentions = table(_mentions(requests, domain.lab_reports, domain.products, pages).withColumn("readings", F.size("doc.terpenes")))
    flags = _folded(mentions.select("request", "pos", "report_id", "barred", F.col("error").isNotNull().alias("failed")))
    told = mentions.drop("doc").join(flags.select("request", "pos", "taken", "reached", "gone"), ["request", "pos"])
    done, failed = F.col("taken") & F.col("error").isNull(), F.col("taken") & F.col("error").isNotNull()
    applied = done & F.col("product_id").isNotNull() & (F.col("readings") > 0)
    told = table(told.withColumns({"done": done, "status": F.when(applied, "applied").when(done, "extracted").when(failed, "failed")}))
    documents = mentions.select("request", "pos", "doc")
    shown = [c.alias(n) for n, c in document_columns(F.lit(True)).items()]
    answers = told.where("done").join(documents, ["request", "pos"]).select("request", "pos", "report_id", "product_id", *shown, "status", (F.col("status") == "applied").alias("applied_to_product"))
    early = F.coalesce(F.col("barred") != TWICE, F.lit(False))  # what is looked at before the document is
    reason = F.when(F.col("gone") & ~early, NO_DOCUMENT).otherwise(F.coalesce("barred", "error"))
    first = F.row_number().over(Window.partitionBy("request").orderBy("pos"))
    stops = told.where("reached and not done").withColumn("k", first).where("k = 1").select("request", "pos", "report_id", reason.alias("reason"))
    keys = {"taken": told.where("taken").select("report_id"), "relinked": told.where("status = 'applied'").select("product_id").distinct()}
    reports = _reports_after(domain.lab_reports, told.where("taken"), documents)
    return {"answers": answers, "stops": stops, **keys, "lab_reports": reports, **_links_after(domain, told.where("status = 'applied'"), documents)}


def _reports_after(reports: DataFrame, taken: DataFrame, documents: DataFrame) -> DataFrame:
    """Reports with the results of those that were taken, each once; a failed one keeps all but its status and document."""
    done = F.coalesce(F.col("done"), F.lit(False))
    shown = {n: c for n, c in document_columns(done).items() if n in reports.columns}
    taken = taken.join(documents, ["request", "pos"]) if shown else taken
    new = taken.select("report_id", "done", F.col("product_id").alias("new_product_id"), F.col("status").alias("new_status"), F.col("error").alias("new_error"), *[c.alias(f"new_{n}") for n, c in shown.items()])
    joined = reports.join(new, "report_id", "left")
    is_new = F.col("new_status").isNotNull()
    gone = {"has_document": F.col("has_document") & ~is_new} if "has_document" in reports.columns else {}
    gone |= {"pdf_bytes": F.when(~is_new, F.col("pdf_bytes"))} if "pdf_bytes" in reports.columns else {}
    changed = {**gone, "status": F.coalesce("new_status", "status"), "product_id": F.when(done, F.col("new_product_id")).otherwise(F.col("product_id"))}
    for n in shown:
        changed[n] = F.when(done, F.col(f"new_{n}")).otherwise(F.col(n))
    if "error_message" in reports.columns:
        changed["error_message"] = F.coalesce("new_error", "error_message")
    return joined.withColumns(changed).select(reports.columns)


def _links_after(domain, applied: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Links and dimension after reports were applied: each product has the readings of its last."""
    names = applied.select("request", "pos").join(documents, ["request", "pos"]).select(F.explode("doc.terpenes").alias("r")).select("r.name")
    dimension = upsert_dimension(domain.terpenes, names)
    # the last is found by keys alone, so that one row of readings a product is all that moves
    last = applied.groupBy("product_id").agg(F.max(F.struct("request", "pos")).alias("at")).select("product_id", "at.request", "at.pos")
    held = last.join(documents, ["request", "pos"])
    payload = held.select("product_id", F.inline("doc.terpenes"))
    links, dimension = replace_links(domain.product_terpenes, dimension, payload, last)
    return {"product_terpenes": links, "terpenes": dimension}


def apply_requests(store: Store, requests: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """Processes requests on a store's tables; reports, links and names change in one version, or none does.

    Only rows that change are written. ``Conflict`` if another writer changed one of the tables since.
    The frames given back are those of ``process_requests``.
    """
    with store.begin() as t:
        names = ("products", "lab_reports", "product_terpenes", "terpenes")
        before = {n: t.read(n) for n in names}
        after = process_requests(SimpleNamespace(spark=store.spark, **before), requests, pages)
        t.upsert("lab_reports", after["lab_reports"].join(after["taken"], "report_id", "left_semi"))
        t.append("terpenes", after["terpenes"].join(before["terpenes"].select("id"), "id", "left_anti"))
        t.delete("product_terpenes", before["product_terpenes"].join(after["relinked"], "product_id", "left_semi"))
        t.upsert("product_terpenes", after["product_terpenes"].join(after["relinked"], "product_id", "left_semi"))
    return after
