"""A corpus pipeline of five stages, each a text operator over all rows its predecessor kept.

Cases, for all stages: an empty table gives an empty table; texts are worked on whole, however long;
further columns are kept as they are, whatever they are called, but for what a stage's docstring
says. Only ``documents``' own columns doc_id, text, lang, source and n_chars are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe_codec, decontaminate, language_id, pii, simhash
from millrace.llm.common import table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters or between languages go.

    Null and empty texts have no letters and go. Documents with a null lang are judged, not learnt
    from. Rows that repeat are judged alike, so all of them stay or go. Columns are unchanged.
    """
    model = language_id.fit(docs)
    hidden = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").alias("__text"))
    found = language_id.identify(hidden, model, "__text")
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous"))
    return kept.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    The smallest doc_id of a group stays; a group without ids keeps the text with the least hash. Rows
    that repeat id and text are copies of each other, as are all texts without words, nulls included.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark's windows.

    Null and empty texts have no words and stay; rows that repeat stay or go together; an item with
    fewer words than a window is one window, one without words none.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data gives way to its kind, disclosing terms to a general one.

    Null and empty texts stay as they are; rows that repeat get the same text. n_chars is counted
    again; of a null text it stays.
    """
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def encode_and_check(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and round_trip: whether decoding the ids gives the text back.

    Null and empty texts have no ids; rows that repeat stay. Texts are compared where they are
    decoded, so that they don't come back.
    """
    # workers still hold what earlier stages needed: fewer words are remembered than for encoding alone
    coded = bpe_codec.encode_checked(docs.select("doc_id", "lang", "source", "text"), most_words=32_768, most_pairs=1 << 18)
    return coded.select("doc_id", "lang", "source", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("language_id", keep_languages),
    ("simhash_dedup", keep_one_of_each),
    ("decontaminate", drop_contaminated),
    ("pii", remove_personal_data),
    ("bpe", encode_and_check),
]

#: Learning, majority fingerprints and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = table(docs) if k < len(STAGES) - 1 else docs
    return docs
