"""Queries on extracted report pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import confidence_label, iso_time
from ..operators import documents as D
from ..operators import paging
from ..operators.requests import apply_requests, process_requests
from ..sources.shared import shared_folder
from ..sources.versions import Store
from .registry import Plans, joined

PLANS = Plans()
add = PLANS.add

_READINGS = joined("{0}", "concat(x.name, '=', cast(x.percent as string))")
def _note(total, percents):
    """SQL for the note where readings are far from their total."""
    off = f"abs(list_sum({percents}) - {total}) / {total}"
    return f"case when {total} > 0 and len({percents}) > 0 and {off} > 0.15 then printf('sum of individuals (%.3f%%) deviates %.1f%% from total_terpenes (%s%%)', list_sum({percents}), {off} * 100, cast({total} as varchar)) end"


def _notes(*notes):
    """SQL for notes joined, without those that are empty."""
    return f"nullif(concat_ws('; ', {', '.join(f'nullif({n}, {chr(39) * 2})' for n in notes)}), '')"


_TEXTS = ("lab_name", "lab_license", "test_date", "batch_id", "product_name", "pass_fail")
_PARSED = f""", j as (select report_id, page_no, trim(regexp_replace(regexp_replace(trim(raw), '^```(?:json)?\\s*', ''), '\\s*```$', '')) as t from report_pages),
p as (select report_id, page_no, case when json_valid(t) then t end as t from j),
f as (select report_id, page_no, t is null as bad, {', '.join(f"json_extract_string(t, '$.{c}') as {c}" for c in _TEXTS)},
  cast(json_extract_string(t, '$.total_terpenes') as double) as total,
  coalesce(list_transform(cast(json_extract(t, '$.terpenes') as json[]), lambda x: json_extract_string(x, '$.name')), []) as names,
  coalesce(list_transform(cast(json_extract(t, '$.terpenes') as json[]), lambda x: cast(json_extract_string(x, '$.percent') as double)), []) as percents,
  greatest(1, least(5, cast(json_extract_string(t, '$.confidence') as int))) as confidence, json_extract_string(t, '$.confidence_notes') as own_notes from p),
g as (select *, {_notes('own_notes', _note('total', 'percents'))} as notes, case when bad then 'not a document' when list_max(percents) > 20 then 'reading out of range' end as error from f)"""
_LIST = "coalesce(array_to_string(list_transform(range(1, len(names) + 1), lambda k: concat(names[k], '=', cast(percents[k] as varchar))), ';'), '')"


@add("json_extract", "report_pages", f"{_PARSED} select report_id, page_no, error, case when error is null then lab_name end as lab_name, case when error is null then batch_id end as batch_id, case when error is null then total end as total_terpenes, case when error is null then {_LIST} end as terpenes, case when error is null then confidence end as confidence from g")
def _(d):
    return D.parsed_pages(d.report_pages).select(
        "report_id", "page_no", "error", "doc.lab_name", "doc.batch_id", "doc.total_terpenes", F.expr(_READINGS.format("doc.terpenes")).alias("terpenes"), "doc.confidence"
    )


@add("report_total", "report_pages", f"{_PARSED} select report_id, page_no, round(coalesce(list_sum(percents), 0), 4) + 0.0 as total from g where error is null")
def _(d):
    total = F.aggregate("doc.terpenes", F.lit(0.0), lambda s, r: s + F.coalesce(r["percent"], F.lit(0.0)))
    return D.parsed_pages(d.report_pages).where("error is null").select("report_id", "page_no", (F.round(total, 4) + 0.0).alias("total"))


@add("report_bars", "report_pages", f"{_PARSED}, u as (select report_id, page_no, percents, unnest(range(1, len(names) + 1)) as k, names from g where error is null) select report_id, page_no, names[k] as name, round(percents[k] / greatest(list_max(percents), 0.001) * 100, 4) + 0.0 as width from u")
def _(d):
    pages = D.parsed_pages(d.report_pages).where("error is null")
    top = F.greatest(F.array_max(F.transform("doc.terpenes", lambda r: r["percent"])), F.lit(0.001))
    return pages.select("report_id", "page_no", top.alias("top"), F.explode("doc.terpenes").alias("r")).select("report_id", "page_no", "r.name", (F.round(F.col("r.percent") / F.col("top") * 100, 4) + 0.0).alias("width"))


@add("deviation_note", "report_pages", f"{_PARSED} select report_id, page_no, printf('sum of individuals (%.3f%%) deviates %.1f%% from total_terpenes (%s%%)', list_sum(percents), abs(list_sum(percents) - total) / total * 100, cast(total as varchar)) as note from g where error is null and total > 0 and len(percents) > 0 and abs(list_sum(percents) - total) / total > 0.15")
def _(d):
    note = D.deviation_note(F.col("doc.total_terpenes"), F.col("doc.terpenes"))
    return D.parsed_pages(d.report_pages).where("error is null").select("report_id", "page_no", note.alias("note")).where("note is not null")


def _step(left, right, done, k):
    """SQL columns of two documents as one, the left alone where it is done: names, percents, confidence, texts, total, notes."""
    more = f"not {done} and len({right}.names) > len({left('names')})"
    texts = ", ".join(f"case when {done} then {left(c)} else coalesce(nullif({left(c)}, ''), {right}.{c}) end as {c}{k}" for c in _TEXTS)
    lists = ", ".join(f"case when {more} then {right}.{c} else {left(c)} end as {c}{k}" for c in ("names", "percents"))
    return f"""{lists}, {texts}, case when {done} then {left('confidence')} else greatest({left('confidence')}, {right}.confidence) end as confidence{k},
  case when {done} then {left('total')} when {more} then coalesce(nullif({right}.total, 0), {left('total')}) else coalesce(nullif({left('total')}, 0), {right}.total) end as total{k},
  case when {done} then {left('notes')} else {_notes(left('notes'), f'{right}.notes', _note(f'total{k}', f'percents{k}'))} end as notes{k}"""


# three pages at most: the fold written out, page by page
_FOLD = f"""{_PARSED}, q as (select a.report_id, a, b, c, len(a.names) > 0 and a.confidence >= 3 as done1 from g a join g b using (report_id) join g c using (report_id) where a.page_no = 1 and b.page_no = 2 and c.page_no = 3),
m2 as (select *, case when done1 then a.error else coalesce(a.error, b.error) end as e2, {_step(lambda x: f'a.{x}', 'b', 'done1', 2)} from q),
m3 as (select *, e2 is not null or (len(names2) > 0 and confidence2 >= 3) as done2 from m2),
n3 as (select *, case when done2 then e2 else c.error end as error, {_step(lambda x: f'{x}2', 'c', 'done2', 3)} from m3),
m as (select report_id, error, {', '.join(f'{x}3 as {x}' for x in ('names', 'percents', *_TEXTS, 'confidence', 'total', 'notes'))} from n3) """
_SHOWN = ("lab_name", "lab_license", "test_date", "batch_id", "product_name", "total", "pass_fail", "confidence", "notes")


def _shown(when):
    """SQL for a document's columns, null where the condition doesn't hold."""
    named = {"total": "total_terpenes", "notes": "confidence_notes"}
    return ", ".join(f"case when {when} then {c} end as {named.get(c, c)}" for c in _SHOWN) + f", case when {when} then {_LIST} end as terpenes"


@add("merge_extractions", "report_pages", f"{_FOLD} select report_id, error, {_shown('error is null')} from m")
def _(d):
    return D.merge_pages(D.parsed_pages(d.report_pages)).select(
        "report_id", "error", *[f"doc.{c}" for c in (*D.TEXTS, "total_terpenes", "confidence", "confidence_notes")], F.expr(_READINGS.format("doc.terpenes")).alias("terpenes")
    )


def _processed(d):
    """Requests of ten reports each, taken by number; some reports have had a product before."""
    targets = d.products.select(
        F.col("id").alias("report_id"), F.when(F.col("id") % 2 == 0, F.floor(F.col("id") / 4) * 4).alias("product_id"), F.floor(F.col("id") / 10).alias("request"), F.col("id").alias("pos"),
        F.when(F.col("id") % 17 == 0, F.col("id") + 1).alias("old_product_id"),
    )
    return D.process_reports(d.report_pages, targets)


_JSON = "concat('[', coalesce(array_to_string(list_transform(range(1, len(names) + 1), lambda k: concat('{{\"name\":\"', names[k], '\",\"percent\":', cast(percents[k] as varchar), '}}')), ','), ''), ']')".replace("{{", "{").replace("}}", "}")
_PROCESSED = f"""{_FOLD}, s as (select *, coalesce(max(case when error is null then 0 else 1 end) over (partition by report_id // 10 order by report_id rows between unbounded preceding and 1 preceding), 0) = 1 as stopped from m),
n as (select *, not stopped and error is null as done, case when report_id % 2 = 0 then report_id // 4 * 4 end as target from s),
o as (select report_id, case when done then target when report_id % 17 = 0 then report_id + 1 end as product_id,
  case when stopped then 'pending' when not done then 'failed' when target is not null and len(names) > 0 then 'applied' else 'extracted' end as status,
  case when not stopped then error end as error, {_shown('done')}, case when done then {_JSON} end as raw_json from n) """


@add("process_reports", "report_pages", f"""{_PROCESSED} select report_id, product_id, status, status = 'applied' as applied_to_product, error as error_message, lab_name, lab_license, test_date, batch_id,
product_name, total_terpenes, pass_fail, terpenes, raw_json as raw_terpenes_json, cast(confidence as int) as confidence, confidence_notes, case when confidence >= 4 then 'High' when confidence = 3 then 'Medium' when confidence is not null then 'Low' end as sure from o""")
def _(d):
    listed = F.expr(_READINGS.format("terpenes"))
    out = _processed(d)
    return out.select(
        "report_id", "product_id", "status", "applied_to_product", "error_message", *D.TEXTS, "total_terpenes", listed.alias("terpenes"), "raw_terpenes_json", "confidence", "confidence_notes",
        F.when(F.col("confidence").isNotNull(), confidence_label("confidence")).alias("sure"),
    )


@add("pending_reports", "report_pages", f"{_PROCESSED} select report_id from o where status = 'pending'")
def _(d):
    """Reports that wait still, as the upload page lists them."""
    return _processed(d).where("status = 'pending'").select("report_id")


@add("apply_last_report", "report_pages", f"{_PROCESSED} select product_id, max(report_id) as report_id from o where status = 'applied' group by 1")
def _(d):
    return D.last_applied(_processed(d).withColumn("pos", F.col("report_id"))).select("product_id", "report_id")


@add("page_lab_reports", "report_pages products", f"""{_PROCESSED} select cast(report_id as varchar) as id, status, lab_name, lab_license, test_date, batch_id, product_name as product_name_on_report, total_terpenes,
pass_fail, cast(confidence as int) as confidence, cast(product_id as varchar) as product_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') as created_at from o join (select id, created_at from products) p on p.id = report_id order by created_at desc, report_id desc limit 50""")
def _(d):
    times = d.products.select(F.col("id").alias("report_id"), "created_at")
    page = paging.page(_processed(d).join(times, "report_id"), [F.desc("created_at"), F.desc("report_id")])
    return page.select(
        F.col("report_id").cast("string").alias("id"), "status", "lab_name", "lab_license", "test_date", "batch_id", F.col("product_name").alias("product_name_on_report"), "total_terpenes",
        "pass_fail", "confidence", F.col("product_id").cast("string").alias("product_id"), iso_time("created_at").alias("created_at"),
    )


def _requested(d):
    """Requests of ten reports each: some without a product, some with one that isn't known, three in a row on one product."""
    request = F.floor(F.col("id") / 10)
    product = F.when(request % 4 == 0, None).when(request % 9 == 5, -1).otherwise(F.floor(request / 3) + 1).cast("bigint")
    return d.products.select(request.alias("request"), F.col("id").alias("pos"), F.col("id").alias("report_id"), product.alias("product_id"))


def _after_requests(d):
    return process_requests(d, _requested(d), d.report_pages)


_WANTED = "report_id // 10 as request, case when report_id // 10 % 4 = 0 then null when report_id // 10 % 9 = 5 then -1 else report_id // 10 // 3 + 1 end as product_id"
_CLEAN = "list_filter(list_transform(names, lambda x: trim(x)), lambda x: x <> '')"
_REQUESTED = f"""{_FOLD}, w as (select *, {_WANTED} from m),
b as (select *, case when product_id is not null and product_id not in (select id from products) then 'product not found' when report_id % 29 = 0 then 'no stored document'
  when error is null and product_id is not null and len(list_distinct({_CLEAN})) < len({_CLEAN}) then 'an attribute comes twice' else error end as reason from w),
r as (select *, coalesce(max(case when reason is null then 0 else 1 end) over (partition by request order by report_id rows between unbounded preceding and 1 preceding), 0) = 0 as reached from b),
o as (select *, reached and reason is null as done, reached and reason is null and product_id is not null and len(names) > 0 as applied from r)"""


@add("request_answers", "report_pages products", f"{_REQUESTED} select request, report_id, product_id, case when applied then 'applied' else 'extracted' end as status, applied as applied_to_product, {_shown('true')} from o where done")
def _(d):
    """What requests answer, report by report."""
    answers = _after_requests(d)["answers"]
    names = [c for c in answers.columns if c not in ("pos", "raw_terpenes_json", "terpenes")]
    return answers.select(*names, F.expr(_READINGS.format("terpenes")).alias("terpenes"))


@add("request_stops", "report_pages products", f"{_REQUESTED} select request, report_id, reason from o where reached and reason is not null")
def _(d):
    """Where requests stopped, and why."""
    return _after_requests(d)["stops"].select("request", "report_id", "reason")


@add("reports_after_requests", "report_pages products lab_reports", f"""{_REQUESTED} select l.report_id, case when done then o.product_id else l.product_id end as product_id,
case when applied then 'applied' when done then 'extracted' when reached and reason = error then 'failed' else l.status end as status, l.has_document and not (done or (reached and coalesce(reason = error, false))) as has_document,
case when reached and reason = error then error end as error_message from lab_reports l join o using (report_id)""")
def _(d):
    return _after_requests(d)["lab_reports"]


@add("applied_links", "report_pages products product_terpenes terpenes", f"""{_REQUESTED}, last as (select product_id, max(report_id) as report_id from o where applied group by 1)
select product_id, name, percent from product_terpenes join terpenes on terpenes.id = terpene_id where product_id not in (select product_id from last)
union all select product_id, trim(unnest(names)), unnest(percents) from last join o using (product_id, report_id)""")
def _(d):
    """The links of all products after several requests on each; reports without readings leave them."""
    after = _after_requests(d)
    return after["product_terpenes"].join(after["terpenes"], F.col("id") == F.col("terpene_id")).select("product_id", "name", "percent")


@add("stored_links", "report_pages products product_terpenes terpenes", f"""{_REQUESTED}, last as (select product_id, max(report_id) as report_id from o where applied group by 1)
select product_id, name, percent from product_terpenes join terpenes on terpenes.id = terpene_id where product_id not in (select product_id from last)
union all select product_id, trim(unnest(names)), unnest(percents) from last join o using (product_id, report_id)""")
def _(d):
    """The same, committed to a store as one version and read back from it."""
    store = Store(d.spark, f"{shared_folder(d.spark)}/requests-{uuid.uuid4().hex}")
    with store.begin() as t:
        for name, key in (("products", ["id"]), ("terpenes", ["id"]), ("lab_reports", ["report_id"]), ("product_terpenes", ["product_id", "terpene_id"])):
            t.replace(name, getattr(d, name), key)
    apply_requests(store, _requested(d), d.report_pages)
    names = store.read("terpenes").select(F.col("id").alias("terpene_id"), "name")
    return store.read("product_terpenes").join(names, "terpene_id").select("product_id", "name", "percent")
