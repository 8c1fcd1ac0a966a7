"""Operator 9: personal data by patterns, and terms that disclose it by information theory.

Base spans are found by pattern in every whole text. The corpus then says how strongly the words
of texts with a protected value reveal it: over the N distinct texts, with n(t) texts holding term
t, n(e) texts holding value e, and n(e,t) texts holding both,

    PMI(e;t) = log2(N n(e,t) / (n(e) n(t)))        IC(e) = log2(N / n(e))

A term discloses e where PMI >= alpha * IC and n(e,t) >= ``min_support``; with alpha = 1 the term is
never seen without e. Each occurrence of such terms outside base spans, in texts that hold e, becomes
a span of kind ``term``; ``sanitise`` replaces base spans by their kind and generalises terms. Copies
of one text count once in all four counts, so copies alone are no evidence: of the rows of one text
those with the smallest id are counted, divided by their number. Texts are not shuffled for this;
only their hashes and ids are.

Cases: a null or empty text has no spans; very long texts are looked through whole: patterns take time
that grows with their length, co-occurrence the number of their terms times that of their sets of
values which ``min_support`` other texts tell apart; ties in a start are listed in the order email, ip, card, phone, term;
repeated rows get the same spans; an empty frame gives an empty frame; ``find_personal_data`` replaces
columns with an output's name, ``sanitise`` keeps all columns but the text as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small, small_batches, text_key, texts, with_arrow_columns

KINDS = ("email", "ip", "card", "phone", "term")
ALPHA, MIN_SUPPORT = 0.95, 3
#: Rows up to which copied texts, values and disclosing terms are broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 100_000
#: Terms counted or listed in a Python worker before it hands them on.
MOST_TERMS = 100_000

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")

SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def luhn(digits: str) -> bool:
    """Whether a number passes the Luhn check."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, from each @ outwards: linear in the text."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = at = found.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of e-mail addresses, IP addresses, card and phone numbers, by start and then kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _value(kind: str, raw: str) -> str:
    """A protected value in one spelling."""
    return f"{kind}:{raw.lower()}" if kind in ("email", "ip") else f"{kind}:{''.join(_DIGIT.findall(raw))}"


def _free(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the words outside all spans."""
    words = [(m.start(), m.end()) for m in _TERM.finditer(text)]
    merged = []
    for _, a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    free, k = [], 0
    for a, b in words:
        while k < len(merged) and merged[k][1] <= a:
            k += 1
        if k == len(merged) or b <= merged[k][0]:
            free.append((a, b))
    return free


def _protected(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    """Hashes of the distinct protected values of a text."""
    return {hashlib.blake2b(_value(k, text[a:b]).encode(), digest_size=8).hexdigest() for k, a, b in spans}


def with_base_spans(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds the base spans of each text."""

    def make():
        return lambda column: [
            pa.array([[dict(zip(("kind", "start", "end"), s)) for s in base_spans(x)] for x in texts(column)], _SPAN_ARROW)
        ]

    return with_arrow_columns(df, [text], [T.StructField(out, T.ArrayType(SPAN))], make)


def _counted(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows (rkey, t, share) that count, and how many texts there are; a text counts in ``share`` rows alike in id and text."""
    ids = rows.select("rkey", F.coalesce("rid", F.lit("")).alias("rid")).groupBy("rkey", "rid").count()
    of = ids.groupBy("rkey").agg(F.min(F.struct("rid", "count")).alias("first"), F.sum("count").alias("all"))
    n_texts = of.count()
    copied = _hinted(of.where("all > 1").select(F.col("rkey").alias("ckey"), F.col("first.rid").alias("crid"), F.col("first.count").alias("share")))
    met = rows.join(copied, F.col("rkey") == F.col("ckey"), "left").where("ckey is null or crid = coalesce(rid, '')")
    return met.select("rkey", "t", F.coalesce("share", F.lit(1)).alias("share")), n_texts


def _number(n: str) -> Column:
    """Sum over counted rows, each divided by its share."""
    return F.round(F.sum(F.col(n) / F.col("share"))).cast("bigint")


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, n_term): in how many texts each term occurs; counts of a task are summed before the shuffle."""

    def run(batches):
        counts: dict[tuple[str, int], int] = {}

        def flush():
            keys = [list(x) for x in zip(*counts)] or [[], []]
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["term", "share", "n"]
            )
            counts.clear()
            return out

        for batch in batches:
            for x, share in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                for w in set(_TERM.findall(x.lower())):
                    counts[w, share] = counts.get((w, share), 0) + 1
                if len(counts) >= MOST_TERMS:
                    yield flush()
        yield flush()

    return rows.select("t", "share").mapInArrow(run, "term string, share bigint, n bigint").groupBy("term").agg(_number("n").alias("n_term"))


def _values(rows: DataFrame) -> DataFrame:
    """(rkey, value) of each protected value in the texts."""

    def run(batches):
        for batch in batches:
            keys, values = [], []
            for key, x in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                for v in _protected(x, base_spans(x)):
                    keys.append(key)
                    values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.string())], names=["rkey", "value"])

    return rows.select("rkey", "t").mapInArrow(run, "rkey bigint, value string").distinct()


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(value, term, n_pair) over texts (t, held, share): a task sums its own before the shuffle."""

    def run(batches):
        counts: dict[tuple[str, str, int], int] = {}

        def flush():
            keys = [list(x) for x in zip(*counts)] or [[], [], []]
            kinds = (pa.string(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays(
                [*(pa.array(k, t) for k, t in zip(keys, kinds)), pa.array(list(counts.values()), pa.int64())], names=["value", "term", "share", "n"]
            )
            counts.clear()
            return out

        for batch in batches:
            for x, held, share in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = {x[a:b].lower() for a, b in _free(x, base_spans(x))}
                for value in held:
                    for term in found:
                        counts[value, term, share] = counts.get((value, term, share), 0) + 1
                    if len(counts) >= MOST_TERMS:
                        yield flush()
        yield flush()

    counted = rows.select("t", "held", "share").mapInArrow(run, "value string, term string, share bigint, n bigint")
    return counted.groupBy("value", "term").agg(_number("n").alias("n_pair"))


def _text_terms(rows: DataFrame) -> DataFrame:
    """(rkey, value, term) of each term in the texts (rkey, t, held) and each value there."""

    def run(batches):
        cols: list[list] = [[], [], []]

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=["rkey", "value", "term"])
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for rkey, x, held in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist()):
                found = {x[a:b].lower() for a, b in _free(x, base_spans(x))}
                for value in held:
                    for term in found:
                        for c, v in zip(cols, (rkey, value, term)):
                            c.append(v)
                    if len(cols[0]) >= MOST_TERMS:
                        yield flush()
        yield flush()

    return rows.select("rkey", "t", "held").mapInArrow(run, "rkey bigint, value string, term string")


def _disclosing(rows: DataFrame, alpha: float, min_support: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(value, term) of the terms that disclose a leading value, the texts with such values (rkey, t, share, held), and (other, value): the leading value of each.

    Values that are in the same texts have the same counts with every term. One of them, the least,
    leads the others and is counted for all, so that a list of many values that is in a few texts is
    one value to be met with their terms.
    """
    counted, n_texts = _counted(rows)
    found = cut(_values(counted))
    # values of few texts can't have support; only texts with other values are looked into
    alike = ["n_value", "x", "y"]  # how many texts, and 128 bits of which
    values = found.groupBy("value").agg(F.count("*").alias("n_value"), F.bit_xor(F.xxhash64("rkey")).alias("x"), F.bit_xor(F.xxhash64("rkey", F.lit(7))).alias("y")).where(F.col("n_value") >= min_support)
    values = cut(values)
    leaders = values.groupBy(*alike).agg(F.min("value").alias("lead"))
    led = cut(values.join(leaders, alike).select(F.col("value").alias("other"), F.col("lead").alias("value")))
    values = leaders.select(F.col("lead").alias("value"), "n_value")
    held = found.join(values.select("value"), "value", "left_semi").groupBy("rkey").agg(F.collect_list("value").alias("held"))  # of one text
    holding = counted.join(_hinted(held), "rkey")
    pairs = _pair_counts(holding).where(F.col("n_pair") >= min_support)
    n = F.lit(float(max(n_texts, 1)))
    # only terms of pairs with support take part in the join; the counts come from all texts
    scored = (
        pairs.join(values, "value").join(_term_counts(counted), "term")
        .where(F.log2(n * F.col("n_pair") / (F.col("n_value") * F.col("n_term"))) >= alpha * F.log2(n / F.col("n_value")) - 1e-9)
        .select("value", "term")
    )
    return cut(scored), holding, led


def _hinted(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast if it is small."""
    df = cut(df)
    return F.broadcast(df) if small(df, BROADCAST_ROWS) else df


def find_personal_data(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA, min_support: int = MIN_SUPPORT, out: str = "spans", base: str = "base"
) -> DataFrame:
    """Adds ``out`` (base spans and terms, by start and kind) and ``base`` (base spans only)."""
    lists = lambda x, found, marked: [[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in (found, marked)]
    return _by_spans(df.drop(out, base), doc_id, text, _span_fields(base, out), [_SPAN_ARROW] * 2, lists, alpha, min_support)


def _by_spans(df: DataFrame, doc_id: str, text: str, fields: list[T.StructField], kinds: list[pa.DataType], row, alpha: float = ALPHA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Adds ``fields``, of ``row(text, base spans, all spans)``: spans are found and used in one pass over the texts."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{doc_id}`").cast("string").alias("rid"), text_key(text).alias("rkey"), F.col(f"`{text}`").alias("t"))
    scored, holding, led = _disclosing(rows, alpha, min_support)
    named = cut(led.join(scored.select("value").distinct(), "value", "left_semi"))
    if small(scored, BROADCAST_ROWS) and small(named, BROADCAST_ROWS):
        of_leader: dict[str, set[str]] = {}
        for value, term in scored.collect():  # at most BROADCAST_ROWS
            of_leader.setdefault(value, set()).add(term)
        shared = df.sparkSession.sparkContext.broadcast({r.other: of_leader[r.value] for r in named.collect()})  # as many
        return with_arrow_columns(df, [text], fields, _marker(kinds, row, lambda x, spans: set().union(*{id(t): t for v in _protected(x, spans) if (t := shared.value.get(v))}.values())))
    marked = _text_terms(holding).join(scored, ["value", "term"], "left_semi").groupBy(F.col("rkey").alias("__rkey")).agg(F.collect_set("term").alias("__terms"))
    joined = df.withColumn("__key", text_key(text)).join(_hinted(marked), F.col("__key") == F.col("__rkey"), "left")
    return with_arrow_columns(joined, [text, "__terms"], fields, _marker(kinds, row, lambda x, spans, terms: set(terms or ()))).drop("__key", "__rkey", "__terms")


def _span_fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.ArrayType(SPAN)) for n in names]


def _marker(kinds: list[pa.DataType], row, asked):
    """What ``row`` makes of a text, its base spans, and these with the occurrences of the terms that ``asked`` gives for it."""

    def make():
        def compute(column, *more):
            out = []
            for x, *given in zip(column.to_pylist(), *(c.to_pylist() for c in more)):
                whole = x or ""
                found = base_spans(whole)
                terms = asked(whole, found, *given) if found else ()
                marked = [("term", a, b) for a, b in _free(whole, found) if whole[a:b].lower() in terms] if terms else []
                out.append(row(x, found, sorted(found + marked, key=lambda s: (s[1], KINDS.index(s[0])))))
            return [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]

        return compute

    return make


def _replaced(x: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span's kind in its place; of spans that overlap the first is named."""
    if x is None or not spans:
        return x
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [x[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, x[at:]])


def sanitise(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Replaces base spans by their kind in capitals and generalises disclosing terms; other columns stay as they are.

    Texts go to Python once: a second pass behind the first would need a second worker beside each, which outlives the stage.
    """
    fields = [T.StructField(text, df.schema[text].dataType, True)]
    out = _by_spans(df, doc_id, text, fields, [pa.string()], lambda x, found, spans: [_replaced(x, spans)], **options)
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
