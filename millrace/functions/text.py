"""Expressions with the semantics of the application's scripting layer: truthiness, trimming, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_trim(c: str | Column) -> Column:
    """Trims all white space, not only spaces."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: str | Column) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(py_trim(c), F.lit(""))


def strip_if_given(c: str | Column) -> Column:
    """Trimmed text; an empty one becomes null, one of blanks only becomes empty."""
    return F.when(_col(c) != "", py_trim(c))


def falsy_or(c: str | Column, default: Column, empty) -> Column:
    """The default in place of null and of the type's empty value."""
    return F.coalesce(F.nullif(_col(c), F.lit(empty)), default)


def clamp(c: str | Column, low: int, high: int) -> Column:
    """A number moved into a range; null stays null."""
    return F.when(_col(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), _col(c))))


def joined_notes(a: str | Column, b: str | Column) -> Column:
    """Two notes joined by a semicolon, empty ones left out; null if both are."""
    return F.nullif(F.concat_ws("; ", F.nullif(_col(a), F.lit("")), F.nullif(_col(b), F.lit(""))), F.lit(""))


def iso_time(c: str | Column) -> Column:
    """ISO-8601 with Z and without fractions."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def dollars(c: str | Column) -> Column:
    """Cents as $0.00, null as a dash."""
    return F.when(_col(c).isNull(), "—").otherwise(F.format_string("$%.2f", _col(c) / 100))


def feedback_label(c: str | Column) -> Column:
    """What a feedback is called; null is a dash, anything unknown is neutral."""
    return F.when(_col(c).isNull(), "—").when(_col(c) == "like", "Like").when(_col(c) == "dislike", "Dislike").otherwise("Neutral")


def confidence_label(c: str | Column) -> Column:
    """High from 4, Medium at 3, else Low."""
    return F.when(_col(c) >= 4, "High").when(_col(c) == 3, "Medium").otherwise("Low")


def parsed_ids(c: str | Column) -> Column:
    """Ids of a comma-separated text, trimmed, without blanks; an id that is no number is an error."""
    parts = F.filter(F.transform(F.split(_col(c), ","), py_trim), lambda x: x != "")
    bad = lambda x: F.raise_error(F.concat(F.lit("not an id: "), x)).cast("bigint")
    return F.transform(parts, lambda x: F.coalesce(x.try_cast("bigint"), bad(x)))


def upper(c: str | Column) -> Column:
    """How a family or an outcome is shown."""
    return F.upper(_col(c))


def fixed(c: str | Column, digits: int) -> Column:
    """A number with so many digits after the point; null stays null."""
    return F.when(_col(c).isNotNull(), F.format_string(f"%.{digits}f", _col(c).cast("double")))


def kilobytes(c: str | Column) -> Column:
    """A size in bytes as KB with one digit."""
    return F.concat(fixed(_col(c) / 1024, 1), F.lit(" KB"))


def base64_text(c: str | Column) -> Column:
    """Binary content as one line of base64."""
    return F.regexp_replace(F.base64(_col(c)), r"\s", "")


def readings_label(readings: str | Column) -> Column:
    """``name (p%)`` joined by commas, by percent from the largest; null counts as -1, ties by name."""
    keyed = F.transform(readings, lambda r: F.struct((-F.coalesce(r["percent"], F.lit(-1.0))).alias("k"), r["name"].alias("name"), r["percent"].alias("percent")))
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda r: F.when(r["percent"].isNull(), r["name"]).otherwise(F.concat(r["name"], F.lit(" ("), F.format_string("%.2f", r["percent"]), F.lit("%)")))), ", "
    )
