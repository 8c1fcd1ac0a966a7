"""The queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe_codec, decontaminate, fill_in_middle, language_id, lm_score, pii, sharding, simhash, suffix_dedup, token_counts, warc
from .common import hold_out


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe_codec.encode_decode(docs)
    return both.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        _digest("token_ids").alias("ids_sha256"),
        _digest("decoded").alias("decoded_sha256"),
    )


def op2_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, shuffled into 24 shards."""
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.shuffle_to_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark windows in all documents."""
    found = decontaminate.contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    counted = token_counts.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that come anywhere else."""
    kept = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from those not held out."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, where=~hold_out("doc_id", 5))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", hold_out("doc_id", 5).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and terms that disclose it."""
    found = pii.find_personal_data(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    count = "cast(size(filter(base, x -> x.kind = '{0}')) as bigint) as n_{0}"
    return found.select(
        "doc_id", *[F.expr(count.format(k)) for k in pii.KINDS[:4]],
        F.sha2(F.expr(listed.format("base")).cast("binary"), 256).alias("base_sha256"), F.expr(listed.format("spans")).alias("spans"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.score_texts(docs, ~hold_out("doc_id", 10))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged for infilling, and their texts rebuilt from the outputs."""
    made = fill_in_middle.rearrange(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", _digest("output").alias("output_sha256"),
        F.sha2(fill_in_middle.restored("output", "form").cast("binary"), 256).alias("restored_sha256"),
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    return warc.round_trip(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups of all documents, and how often their links occur."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(_digest("groups"))
    found = alignment.link_statistics(docs, derived={"groups_sha256": digest})
    return found.select("doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_codec, op2_shuffle_shards, op3_decontaminate, op4_simhash, op5_token_counts,
        op6_ann, op7_suffix_dedup, op8_language_id, op9_pii, op10_lm_score,
        op11_fill_in_middle, op12_warc, op13_alignment,
    )
}

#: In DuckDB's SQL; operators that draw, learn or tokenise can't be expressed there.
ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": r"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents
), b as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark
), windows as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as phrase
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)
), sizes as (select distinct n from windows),
places as (
  select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, w from d, sizes where len(w) >= n
), hits as (
  select p.doc_id, p.i, p.n, x.item_id from places p join windows x on x.n = p.n and x.phrase = array_to_string(p.w[p.i : p.i + p.n - 1], ' ')
), counted as (
  select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from hits) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names
  from (select distinct doc_id, cast(item_id as varchar) as name from hits) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join counted using (doc_id) left join items using (doc_id)
""",
    "op7_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
s as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as m from (select doc_id, h, unnest(range(0, n - 199)) as i from d where n >= 200)),
r as (select doc_id, i from s where m in (select m from s group by m having count(*) > 1)),
g as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i), 1000) > 200 as fresh from r),
k as (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as run from g),
runs as (select doc_id, run, min(i) as a, max(i) + 200 as b from k group by doc_id, run),
kept as (
  select doc_id, lag(b, 1, 0) over (partition by doc_id order by a) as a, a as b from runs
  union all
  select doc_id, max(b), null from runs group by doc_id
),
rest as (
  select d.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' order by a) as h
  from kept join d using (doc_id) group by d.doc_id
),
sums as (select doc_id, sum(b - a) as removed, count(*) as spans from runs group by doc_id)
select d.doc_id, cast(d.n as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(rest.h, d.h))) as kept_sha256
from d left join sums using (doc_id) left join rest using (doc_id)
""",
    "op11_fill_in_middle": r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256(concat('42:', coalesce(cast(doc_id as varchar), ''))) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w
  from documents
), d as (
  select doc_id, text, w, cast(len(w) as bigint) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from t
), c as (
  select doc_id, text, w, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from d
), p as (
  select doc_id, text, n, form, array_to_string(w[1:a], '') as prefix, array_to_string(w[a + 1:b], '') as middle, array_to_string(w[b + 1:], '') as suffix from c
)
select doc_id, n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then concat('<P>', prefix, '<S>', suffix, '<M>', middle) else concat('<S>', suffix, '<P>', prefix, '<M>', middle) end) as output_sha256,
  sha256(text) as restored_sha256
from p
""",
    "op12_warc": """
with p as (
  select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as n, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as kept from pages
)
select page_id, n as payload_bytes, sha1(html) as payload_digest, case when n >= 1000 and page_id is distinct from kept and kept is not null then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id is distinct from kept then kept end as refers_to
from p
""",
}
