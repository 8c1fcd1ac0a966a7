"""Files in and out: id columns and rows of CSV, CSV sinks, uploaded documents, JSON columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_trim

MOST_UPLOAD_BYTES = 20 * 1024 * 1024


def read_rows(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Rows of a CSV file with a header, all text; a missing column or no row at all is an error."""
    df = spark.read.csv(path, header=True)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The trimmed ids of a CSV file, without blanks; none at all is an error."""
    ids = read_rows(spark, path, ["id"]).select(py_trim("id").alias("id")).where("id <> ''")
    if ids.isEmpty():
        raise ValueError(f"{path} has no ids")
    return ids


def write_rows(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """Writes columns in a fixed order as CSV with a header; ``order`` sorts within each file."""
    df = df.sortWithinPartitions(*order) if order else df
    df.select(columns).write.csv(path, header=True, mode="errorifexists")


#: Content types that are accepted whatever the file is called.
UPLOAD_TYPES = ("application/pdf", "application/octet-stream")


def upload_refusal(content_type: str | Column, filename: str | Column, length: str | Column, most: int = MOST_UPLOAD_BYTES) -> Column:
    """Why an upload is refused, null where it is not: neither type nor name say PDF, too large, or empty."""
    kind, name, size = (F.col(c) if isinstance(c, str) else c for c in (content_type, filename, length))
    known = F.coalesce(kind.isin(*UPLOAD_TYPES), F.lit(False)) | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))
    return F.when(~known, "not a PDF").when(size > most, "too large").when(size == 0, "empty")


def read_uploads(spark: SparkSession, path: str, most: int = MOST_UPLOAD_BYTES) -> DataFrame:
    """Files as uploads with a status: pending, or the reason for the refusal.

    Files have no content type, so the name decides. The size is checked on the file's metadata, so
    content is only read of those that are kept. Spark lists no empty files; ``accepted_uploads``
    takes tables, where content can be empty.
    """
    files = spark.read.format("binaryFile").load(path)
    reason = upload_refusal(F.lit(None).cast("string"), "path", "length", most)
    return files.select("path", "length", reason.alias("refused"), F.when(reason.isNull(), F.col("content")).alias("pdf_bytes"), F.when(reason.isNull(), "pending").alias("status"))


def accepted_uploads(uploads: DataFrame, most: int = MOST_UPLOAD_BYTES, request: str | None = None) -> DataFrame:
    """Pending reports (report_id, filename, pdf_bytes, status) of uploads (filename, content_type, content), refused if one is.

    An id depends on the request, the file and which of several equal files it is, so a task that is
    run again gives the same. ``request`` names the request; by default it is a new one.
    """
    reason = upload_refusal("content_type", "filename", F.octet_length("content"), most)
    refused = uploads.select("filename", reason.alias("reason")).where("reason is not null").first()
    if refused:
        raise ValueError(f"{refused[0]}: {refused[1]}")
    if uploads.isEmpty():
        raise ValueError("no files")
    file = F.sha2(F.concat(F.coalesce("filename", F.lit("")).cast("binary"), F.lit("/").cast("binary"), "content"), 256)
    told = uploads.withColumn("__file", file)
    nth = F.row_number().over(Window.partitionBy("__file").orderBy("__file"))
    digest = F.md5(F.concat_ws(":", F.lit(request or uuid.uuid4().hex), "__file", nth.cast("string")).cast("binary"))
    report_id = F.regexp_replace(digest, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-a$4-$5")
    return told.select(report_id.alias("report_id"), "filename", F.col("content").alias("pdf_bytes"), F.lit("pending").alias("status"))


def readings_json(readings: str | Column) -> Column:
    """Readings as the JSON text of a column."""
    return F.to_json(readings)


def with_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds columns that an older file lacks, as nulls: an additive migration on read."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
