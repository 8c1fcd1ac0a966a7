"""Queries on rules of single values: what is shown, checked, refused, renamed, and written to files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents as D
from ..operators import paging
from ..operators import purchases as P
from ..operators import writes
from ..sources import files
from ..sources.shared import shared_folder
from .registry import Plans

PLANS = Plans()
add = PLANS.add


@add("shown_items", "purchase_items", "select id, case when line_amount_cents is null then '—' else printf('$%.2f', line_amount_cents / 100) end as amount, case when feedback is null then '—' when feedback = 'like' then 'Like' when feedback = 'dislike' then 'Dislike' else 'Neutral' end as label from purchase_items")
def _(d):
    """Amounts and feedback as lists show them."""
    return d.purchase_items.select("id", X.dollars("line_amount_cents").alias("amount"), X.feedback_label("feedback").alias("label"))


@add("parsed_ids", "customers", "select id, unnest([id, id + 1]) as parsed from customers")
def _(d):
    """Ids of texts such as `` 7, ,8``."""
    listed = F.concat(F.lit(" "), F.col("id"), F.lit(", ,\t"), F.col("id") + 1)
    return d.customers.select("id", F.explode(X.parsed_ids(listed)).alias("parsed"))


@add("known_sources", "purchases", "select id, source from purchases where source in ('manual', 'pos_import')")
def _(d):
    return d.purchases.where(F.col("source").isin(*P.FILTER_SOURCES)).select("id", "source")


@add("unfiltered_search", "customers", "select id, name from customers")
def _(d):
    """A search whose text isn't given, or is empty, filters nothing."""
    return paging.search_customers(paging.search_customers(d.customers, None), "").select("id", "name")


@add("checked_items", "purchase_items", """, c as (select id, quantity * 3 - 2 as quantity, case when id % 5 = 0 then null when id % 7 = 0 then -1 else line_amount_cents end as line_amount_cents from purchase_items)
select id, concat_ws(';', case when not quantity between 1 and 100 then 'quantity from 1 to 100' end, case when not coalesce(line_amount_cents >= 0, false) then 'line_amount_cents from 0' end) as broken
from c where not quantity between 1 and 100 or not coalesce(line_amount_cents >= 0, false)""")
def _(d):
    """Lines that break a rule, with the names of those they break."""
    cents = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 7 == 0, -1).otherwise(F.col("line_amount_cents"))
    given = d.purchase_items.select("id", (F.col("quantity") * 3 - 2).alias("quantity"), cents.alias("line_amount_cents"))
    return writes.check(given, writes.ITEM_RULES)[1].select("id", F.array_join("broken", ";").alias("broken"))


_NAMES = [*D.ALIASES, "Myrcene", "Guaiol", "nothing known"]
_NAMED = f"list_extract([{', '.join(repr(n) for n in _NAMES)}], cast(id % {len(_NAMES)} as int) + 1)"
_RENAMED = "case name " + " ".join(f"when '{a}' then '{b}'" for a, b in D.ALIASES.items()) + " else name end"


@add("printed_readings", "products", f""", r as (select id, {_NAMED} as name, case id % 6 when 0 then 'ND' when 1 then ' <loq ' else concat(cast(id % 90 as varchar), '.5') end as value, case when id % 4 = 1 then 'mg/g' else '%' end as unit from products)
select id, {_RENAMED} as name, case when unit = 'mg/g' then cast(value as double) / 10 else cast(value as double) end as percent from r where upper(trim(value)) not in ('ND', '<LOQ')""")
def _(d):
    """Readings as reports print them: names resolved, units turned into percent, those not measured left out."""
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("id") % len(_NAMES)).cast("int") + 1)
    value = F.when(F.col("id") % 6 == 0, "ND").when(F.col("id") % 6 == 1, " <loq ").otherwise(F.concat((F.col("id") % 90).cast("string"), F.lit(".5")))
    printed = F.array(F.struct(name.alias("name"), value.alias("percent"), F.when(F.col("id") % 4 == 1, "mg/g").otherwise("%").alias("unit"))).cast(D.PRINTED)
    return d.products.select("id", F.explode(D.measured(printed)).alias("r")).select("id", "r.name", "r.percent")


def _uploads(d):
    """Products as uploads: names and types that are accepted and not, some empty, some too large for the limit of 60 bytes."""
    kind = F.when(F.col("id") % 3 == 0, "application/pdf").when(F.col("id") % 3 == 1, "text/plain")
    name = F.concat(F.lit("r"), F.col("id"), F.when(F.col("id") % 5 < 3, ".PDF").otherwise(".txt"))
    content = F.when(F.col("id") % 7 == 0, "").when(F.col("id") % 11 == 0, F.repeat(F.col("name"), F.lit(9))).otherwise(F.col("name")).cast("binary")
    return d.products.select("id", kind.alias("content_type"), name.alias("filename"), content.alias("content"))


_UPLOADS = ", u as (select id, case id % 3 when 0 then 'application/pdf' when 1 then 'text/plain' end as content_type, concat('r', id, case when id % 5 < 3 then '.PDF' else '.txt' end) as filename, case when id % 7 = 0 then '' when id % 11 = 0 then repeat(name, 9) else name end as content from products)"
_REFUSED = "case when not (coalesce(content_type = 'application/pdf', false) or filename like '%.PDF') then 'not a PDF' when strlen(content) > 60 then 'too large' when strlen(content) = 0 then 'empty' end"


@add("upload_refusals", "products", f"{_UPLOADS} select id, {_REFUSED} as refused from u")
def _(d):
    return _uploads(d).select("id", files.upload_refusal("content_type", "filename", F.octet_length("content"), 60).alias("refused"))


@add("accepted_uploads", "products", rf"""{_UPLOADS} select regexp_replace(md5(concat_ws(':', 'r1', sha256(concat(filename, '/', content)), '1')), '^(.{{8}})(.{{4}}).(.{{3}}).(.{{3}})(.{{12}})$', '\1-\2-3\3-a\4-\5') as report_id,
filename, content as text, 'pending' as status from u where {_REFUSED} is null""")
def _(d):
    """Uploads that all are accepted, with the ids of a request."""
    good = _uploads(d).where(files.upload_refusal("content_type", "filename", F.octet_length("content"), 60).isNull())
    return files.accepted_uploads(good, 60, "r1").select("report_id", "filename", F.col("pdf_bytes").cast("string").alias("text"), "status")


def _render(pdf: bytes) -> list[bytes]:
    if pdf.startswith(b"bad"):
        raise ValueError("cannot be opened")
    return pdf.split(b",")


def _extract(image: bytes) -> str:
    if image == b"other":
        raise ValueError("cannot be read")
    return image.decode()


@add("extracted_pages", "products", """, r as (select id, list_extract(string_split(concat(name, ',', category, ',', coalesce(brand, ''), ',more'), ','), n) as raw, n from products, (values (1), (2), (3)) as v(n) where id % 13 <> 0)
select id as report_id, n as page_no, case when raw <> 'other' then raw end as raw, case when raw = 'other' then 'cannot be read' end as error from r where n < 3 or (select count(*) from r s where s.id = r.id and s.n < 3 and s.raw = 'other') = 0
union all select id, 0, null, 'cannot be opened' from products where id % 13 = 0""")
def _(d):
    """Pages of documents by given functions that fail on some: at most three each, none after a failure."""
    pdf = F.concat(F.when(F.col("id") % 13 == 0, "bad").otherwise(""), F.col("name"), F.lit(","), F.col("category"), F.lit(","), F.coalesce("brand", F.lit("")), F.lit(",more"))
    return D.extract_pages(d.products.select(F.col("id").alias("report_id"), pdf.cast("binary").alias("pdf_bytes")), _render, _extract)


@add("base64_names", "products", "select id, base64(encode(repeat(name, 5))) as b64 from products")
def _(d):
    """Binary content as one line of base64, as pages are sent."""
    return d.products.select("id", X.base64_text(F.repeat(F.col("name"), F.lit(5)).cast("binary")).alias("b64"))


@add("added_columns", "customers", "select id, name, cast(null as varchar) as note from customers")
def _(d):
    """A table that lacks a column of a later schema."""
    return files.with_missing_columns(d.customers.select("id", "name"), {"id": "bigint", "note": "string"})


@add("csv_ids", "customers", "select cast(id as varchar) as id from customers where id % 4 <> 0")
def _(d):
    """Ids written with blanks around them, and some rows of blanks only, read back."""
    path = f"{shared_folder(d.spark)}/csv-{uuid.uuid4().hex}"
    shown = F.when(F.col("id") % 4 == 0, " ").otherwise(F.concat(F.lit("  "), F.col("id").cast("string"), F.lit("\t")))
    d.customers.select(shown.alias("id"), "name").write.csv(path, header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_ids(d.spark, path)


@add("csv_rows", "product_terpenes", "select cast(product_id as varchar) as product_id, cast(terpene_id as varchar) as terpene_id, coalesce(cast(percent as varchar), '') as percent, true as in_order from product_terpenes")
def _(d):
    """Rows written as CSV, by percent from the largest in each file, and read back in that order."""
    path = f"{shared_folder(d.spark)}/csv-{uuid.uuid4().hex}"
    rows = d.product_terpenes.withColumn("back", -F.coalesce("percent", F.lit(-1.0)))
    files.write_rows(rows, path, ["product_id", "terpene_id", "percent"], ["back"])
    read = files.read_rows(d.spark, path, ["product_id", "percent"]).withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()})
    before = F.lag(F.coalesce(F.col("percent").cast("double"), F.lit(-1.0))).over(Window.partitionBy("file").orderBy("at"))
    return read.select("product_id", "terpene_id", F.coalesce("percent", F.lit("")).alias("percent"), F.coalesce(before >= F.coalesce(F.col("percent").cast("double"), F.lit(-1.0)), F.lit(True)).alias("in_order"))
