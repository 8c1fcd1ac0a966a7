"""Extracted report pages: parsed, checked, merged page by page, applied to products.

Turning PDF bytes into pages and pages into text needs a renderer and a model; both are given as
functions. All that follows is native: JSON is parsed by schema, pages are folded in page order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, falsy_or, joined_notes, py_trim
from ..sources.files import readings_json

READINGS = "array<struct<name:string,percent:double>>"
#: As a page has them: numbers, or texts such as ND; the unit is percent if there is none.
PRINTED = "array<struct<name:string,percent:string,unit:string>>"
TEXTS = ("lab_name", "lab_license", "test_date", "batch_id", "product_name", "pass_fail")
DOCUMENT = (
    "struct<lab_name:string,lab_license:string,test_date:string,batch_id:string,product_name:string,total_terpenes:double,"
    f"pass_fail:string,terpenes:{READINGS},confidence:int,confidence_notes:string>"
)
MOST_PAGES, MOST_PERCENT, DEVIATION = 3, 20.0, 0.15

# Other names of attributes.
ALIASES = {
    "β-Myrcene": "Myrcene", "beta-Myrcene": "Myrcene", "d-Limonene": "Limonene",
    "β-Caryophyllene": "Caryophyllene", "BCP": "Caryophyllene", "b-Caryophyllene": "Caryophyllene",
    "alpha-Pinene": "α-Pinene", "Pinene": "α-Pinene", "a-Pinene": "α-Pinene", "beta-Pinene": "β-Pinene", "b-Pinene": "β-Pinene",
    "β-Ocimene": "Ocimene", "b-Ocimene": "Ocimene", "α-Humulene": "Humulene", "a-Humulene": "Humulene",
    "α-Bisabolol": "Bisabolol", "a-Bisabolol": "Bisabolol", "α-Terpineol": "Terpineol", "a-Terpineol": "Terpineol",
    "trans-Nerolidol": "Nerolidol", "1,8-Cineole": "Eucalyptol",
}


def canonical_name(c: str | Column) -> Column:
    """The canonical name of an attribute; one without an alias stays."""
    c = F.col(c) if isinstance(c, str) else c
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(table, c), c)


#: Readings that are no number: not detected, or below what can be measured.
NOT_MEASURED = ("ND", "<LOQ")


def in_percent(value: str | Column, unit: str | Column) -> Column:
    """A printed reading in percent: mg/g are tenths; a text that is no number is null."""
    value, unit = (F.col(c) if isinstance(c, str) else c for c in (value, unit))
    number = value.try_cast("double")
    return F.when(unit == "mg/g", number / 10).otherwise(number)


def measured(readings: Column) -> Column:
    """Readings (name, percent and unit as text) as (name, percent): aliases resolved, those not measured left out."""
    number = lambda r: r["percent"].try_cast("double").isNotNull()
    shown = F.filter(readings, lambda r: F.when(number(r), True).otherwise(F.coalesce(~F.upper(py_trim(r["percent"])).isin(*NOT_MEASURED), F.lit(True))))
    return F.transform(shown, lambda r: F.struct(canonical_name(r["name"]).alias("name"), in_percent(r["percent"], r["unit"]).alias("percent")))


def without_fences(c: str | Column) -> Column:
    """JSON text without the code fences around it."""
    opened = F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), r"^```(?:json)?\s*", "")
    return F.regexp_replace(opened, r"\s*```$", "")


def deviation_note(total: Column, readings: Column) -> Column:
    """A note where the readings' sum is over 15 % off the total; null where not, or where either is missing."""
    summed = F.aggregate(readings, F.lit(0.0), lambda s, r: s + r["percent"])
    off = F.abs(summed - total) / F.nullif(total, F.lit(0.0))
    # Fixed value: the note's wording, which users see.
    text = F.concat(F.lit("sum of individuals ("), F.format_string("%.3f", summed), F.lit("%) deviates "), F.format_string("%.1f", off * 100), F.lit("% from total_terpenes ("), total.cast("string"), F.lit("%)"))
    return F.when((total > 0) & (F.size(readings) > 0) & (off > DEVIATION), text)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is evaluated once a row, however often it is used.

    An expression of a projection is written out wherever a later filter or lambda uses it; the one row
    that a generator gives is not.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(report_id, page_no, doc, error): each page's document, checked; doc is null where there is an error.

    ``pages``: report_id, page_no, raw, and if given error, with which the extraction of a page ended.
    They are dealt by report first: few bytes of pages, one file's, are work for many tasks.
    """
    pages = pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "report_id")
    kind = f"{DOCUMENT[:-1]},_bad:string>".replace(READINGS, PRINTED)
    read = _once(pages, "p", F.from_json(without_fences("raw"), kind, {"columnNameOfCorruptRecord": "_bad"}))
    read = _once(read, "readings", F.coalesce(measured(F.col("p.terpenes")), F.array().cast(READINGS)))
    read = _once(read, "rounded", F.transform("readings", lambda r: F.struct(r["name"].alias("name"), F.round(r["percent"], 4).alias("percent"))))
    error = (
        F.when(F.col("p").isNull() | F.col("p._bad").isNotNull(), "not a document")
        .when(F.exists("readings", lambda r: r["percent"].isNull() | (r["percent"] < 0) | (r["percent"] > MOST_PERCENT) | r["name"].isNull()), "reading out of range")
        .when((F.col("p.total_terpenes") < 0) | (F.col("p.total_terpenes") > 100), "total out of range")
    )
    notes = joined_notes(F.col("p.confidence_notes"), F.coalesce(deviation_note(F.col("p.total_terpenes"), F.col("rounded")), F.lit("")))
    doc = F.struct(
        *[F.col(f"p.{c}").alias(c) for c in TEXTS[:5]], F.col("p.total_terpenes").alias("total_terpenes"), F.col("p.pass_fail").alias("pass_fail"),
        F.col("rounded").alias("terpenes"), F.coalesce(clamp("p.confidence", 1, 5), F.lit(1)).alias("confidence"), notes.alias("confidence_notes"),
    ).cast(DOCUMENT)
    read = _once(read.drop("error"), "error", error) if "error" not in pages.columns else _once(read.withColumnRenamed("error", "given"), "error", F.coalesce("given", error))
    return _once(read, "doc", F.when(F.col("error").isNull(), doc)).select("report_id", "page_no", "doc", "error")


def merged(a: Column, b: Column) -> Column:
    """Two documents as one: more readings win, the first non-empty text, the larger confidence, notes joined."""
    more = F.size(b["terpenes"]) > F.size(a["terpenes"])
    readings = F.when(more, b["terpenes"]).otherwise(a["terpenes"])
    total = F.when(more, falsy_or(b["total_terpenes"], a["total_terpenes"], 0.0)).otherwise(falsy_or(a["total_terpenes"], b["total_terpenes"], 0.0))
    notes = joined_notes(joined_notes(a["confidence_notes"], b["confidence_notes"]), F.coalesce(deviation_note(total, readings), F.lit("")))
    texts = {c: falsy_or(a[c], b[c], "").alias(c) for c in TEXTS}
    return F.struct(
        *[texts[c] for c in TEXTS[:5]], total.alias("total_terpenes"), texts["pass_fail"], readings.alias("terpenes"),
        F.greatest(a["confidence"], b["confidence"]).alias("confidence"), notes.alias("confidence_notes"),
    ).cast(DOCUMENT)


def merge_pages(parsed: DataFrame) -> DataFrame:
    """(report_id, doc, error): pages folded in order; once there are readings with confidence 3 no more pages are used.

    An error on a page that is used fails the report; one on a later page does not.
    """
    first = parsed.where(F.col("page_no") <= MOST_PAGES)
    lists = first.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "doc", "error"))).alias("pages"))  # of at most three pages
    done = lambda s: s["error"].isNotNull() | ((F.size(s["doc"]["terpenes"]) > 0) & (s["doc"]["confidence"] >= 3))
    start = F.struct(F.element_at("pages", 1)["doc"].alias("doc"), F.element_at("pages", 1)["error"].alias("error"))
    state = f"struct<doc:{DOCUMENT},error:string>"

    def step(s, x):
        both = F.struct(F.when(x["error"].isNull(), merged(s["doc"], x["doc"])).alias("doc"), x["error"].alias("error")).cast(state)
        return F.when(done(s), s).otherwise(both)

    folded = F.aggregate(F.slice("pages", 2, MOST_PAGES), start.cast(state), step)
    return lists.select("report_id", folded.alias("s")).select("report_id", "s.doc", "s.error")


NO_PAGES = "the document has no pages"


def extracted(reports: DataFrame, pages: DataFrame) -> DataFrame:
    """``reports`` (report_id, ...) with doc and error; one without any page has an error, as has one whose extraction failed."""
    found = merge_pages(parsed_pages(pages))
    error = F.when(F.col("doc").isNull(), F.coalesce("error", F.lit(NO_PAGES)))
    return reports.join(found, "report_id", "left").withColumn("error", F.substring(error, 1, 1000))


def process_reports(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Reports after a request each; ``targets``: report_id, product_id, and if given request, pos and old_product_id.

    A request takes its reports by ``pos`` and stops at the first that fails: what came before stays,
    what comes after is pending still. A failed report has the message's first 1000 characters and
    keeps the product it had; one with a product and readings is applied; else it is extracted.
    Without a request each report is one by itself. No report may come twice: ``process_requests``
    takes those too, and writes the products' links.
    """
    if "request" not in targets.columns:
        targets = targets.withColumns({"request": F.col("report_id"), "pos": F.lit(0)})
    if "old_product_id" not in targets.columns:
        targets = targets.withColumn("old_product_id", F.lit(None).cast(targets.schema["product_id"].dataType))
    before = Window.partitionBy("request").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = extracted(targets, pages).withColumn("stopped", F.coalesce(F.max(F.col("error").isNotNull()).over(before), F.lit(False)))
    done = ~F.col("stopped") & F.col("error").isNull()
    applied = done & F.col("product_id").isNotNull() & (F.size("doc.terpenes") > 0)
    return out.select(
        "report_id", F.when(done, F.col("product_id")).otherwise(F.col("old_product_id")).alias("product_id"), *[c.alias(n) for n, c in document_columns(done).items()],
        F.when(F.col("stopped"), "pending").when(~done, "failed").when(applied, "applied").otherwise("extracted").alias("status"),
        F.coalesce(applied, F.lit(False)).alias("applied_to_product"), F.when(~F.col("stopped"), F.col("error")).alias("error_message"),
    )


def document_columns(shown: Column) -> dict[str, Column]:
    """The columns of ``doc`` where the condition holds, and its readings as JSON."""
    names = (*TEXTS, "total_terpenes", "terpenes", "confidence", "confidence_notes")
    return {**{c: F.when(shown, F.col(f"doc.{c}")) for c in names}, "raw_terpenes_json": F.when(shown, readings_json("doc.terpenes"))}


def last_applied(processed: DataFrame) -> DataFrame:
    """Of several reports applied to one product the last in input order (``pos``) holds."""
    last = Window.partitionBy("product_id").orderBy(F.desc("pos"))
    return processed.where("applied_to_product").withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")


PAGES = "report_id bigint, page_no int, raw string, error string"


def extract_pages(
    uploads: DataFrame, render: Callable[[bytes], list[bytes]], extract: Callable[[bytes], str], enough: Callable[[str], bool] = lambda raw: False, known: DataFrame | None = None
) -> DataFrame:
    """(report_id, page_no, raw, error) of uploads (report_id, pdf_bytes) by given functions, in Arrow batches.

    Pages after one that is ``enough`` are not extracted, so that no paid call is wasted. An exception
    of either function is the error of that report and ends it, and no other: it has no raw, and page 0
    where nothing could be rendered. Reports that ``known`` pages have are not extracted again; their
    rows are part of the result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for report, pdf in zip(batch["report_id"], batch["pdf_bytes"]):
                number = 0
                try:
                    images = render(bytes(pdf))[:MOST_PAGES]
                    if not images:
                        raise ValueError(NO_PAGES)
                    for number, image in enumerate(images, 1):
                        raw = extract(image)
                        rows.append((report, number, raw, None))
                        if enough(raw):
                            break
                except Exception as problem:  # whatever the given functions raise
                    rows.append((report, number, None, str(problem)[:1000] or type(problem).__name__))
            yield pd.DataFrame(rows, columns=["report_id", "page_no", "raw", "error"])

    new = uploads.where("pdf_bytes is not null").select("report_id", "pdf_bytes")
    if known is not None:
        new = new.join(known.select("report_id").distinct(), "report_id", "left_anti")
    found = new.mapInPandas(run, PAGES)
    return found if known is None else known.unionByName(found, allowMissingColumns=True)
