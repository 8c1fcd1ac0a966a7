"""Operator 3: benchmark decontamination by a distributed positional inverted index (native).

Postings are (word, document, position). Of each window of ``window`` consecutive benchmark words the
rarest in the documents is looked up first; its postings, moved by its offset in the item, say where
the item would have to begin in a document (an alignment). Where m words of a window may miss, the
m + 1 rarest are. Lists are then intersected from the rarest on: the next ``NEXT`` rarest words of
each window are posted for documents with an alignment only, and met at alignment + offset; what
lacks more than m of a window's words goes. For the documents that are left all benchmark words are
posted, and the lists of the words of those windows are met at their alignments. Windows of which all
words meet are exact matches, those of which a share does are proximity matches. An item's windows
with the same words are looked for once, so that a word or a line repeated in an item and in a
document meets once a place and not at every offset.

So of the index only what the rarest terms leave is ever written: three tables of postings, each a
word at most once a document and position. No text is sent anywhere but for the join with the
documents asked for, if these are too many to be broadcast. The benchmark side is broadcast only if
counted small, else all joins shuffle. Everything is DataFrame and SQL expressions.

Cases: null and empty texts have no words and no hits; an item without words has no window, one
with fewer words than a window is one window; an item that comes twice, or with a null id, counts
by its id as text, null as the empty text; repeated documents get the same figures; very long
texts are looked through whole, as rows of words; an empty benchmark hits nothing; columns of other names are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, cut, small, text_key

WINDOW = 13
#: Words of benchmark items up to which their side of a join is broadcast.
BROADCAST_ROWS = 200_000
#: Words of a window that are looked up after the rarest, before all others.
NEXT = 3
#: Everything that is no word: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | Column) -> Column:
    """The words of a text, A-Z in lower case; of a null, none."""
    text = F.col(text) if isinstance(text, str) else text
    # a text without letters beyond ASCII takes the fast way to lower case
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BETWEEN), "")


def _bench(df: DataFrame, small_enough: bool) -> DataFrame:
    return F.broadcast(df) if small_enough else df


def item_words(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, name, size, words) of every distinct item text; item is a number for joins."""
    named = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("name"), words_of(F.col(f"`{text}`")).alias("words"))
    return named.where(F.size("words") > 0).distinct().select(F.xxhash64("name", "words").alias("item"), "name", F.size("words").alias("size"), "words")


def _places(items: DataFrame, frequency: DataFrame, window: int, misses: int) -> DataFrame:
    """(item, first, n, need, rank, at, word): the rarest places of each window of n words, from ``first`` on, and how many must meet.

    Of an item's windows with the same words only the first is looked for, as it is found wherever the
    others are. A window with more words that no document has than may miss is left out. Windows are
    found per item; an item is one text.
    """
    span = Window.partitionBy("item").orderBy("at").rowsBetween(0, window - 1)
    ranked = items.join(frequency, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("df", "at", "word")).over(span)), 1, misses + 1 + NEXT)
    told = ranked.withColumns({"rarest": rarest, "phrase": F.collect_list("word").over(span), "unknown": F.count_if(F.col("df") == 0).over(span)})
    whole = told.where((F.col("at") + window <= F.col("size")) | (F.col("at") == 0)).where(F.col("unknown") <= misses)
    alike = Window.partitionBy("item", "phrase")
    return (
        whole.withColumn("least", F.min("at").over(alike)).where("at = least")
        .select("item", F.col("at").alias("first"), F.least(F.lit(window), F.col("size")).alias("n"), (F.size("rarest") - misses).alias("need"), F.posexplode("rarest").alias("rank", "x"))
        .select("item", "first", "n", "need", "rank", F.col("x.at").alias("at"), F.col("x.word").alias("word"))
    )


def _postings(docs: DataFrame, words: DataFrame, few: bool) -> DataFrame:
    """(word, rid, rkey, pos) of the given words in the documents."""
    every = docs.select("rid", "rkey", F.posexplode(words_of("text")).alias("pos", "word"))
    return every.join(_bench(words.select("word").distinct(), few), "word", "left_semi")


def _of_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of some rows (rid, rkey)."""
    asked = cut(found.select(F.col("rid").alias("__rid"), F.col("rkey").alias("__rkey")).distinct())
    return docs.join(_bench(asked, small(asked, BROADCAST_ROWS)), docs["rid"].eqNullSafe(F.col("__rid")) & (docs["rkey"] == F.col("__rkey")), "left_semi")


def _met(lines: DataFrame, postings: DataFrame) -> DataFrame:
    """Rows of ``lines`` (rid, rkey, pos, word, ...) whose word stands at their position."""
    there = postings.select(F.col("rid").alias("__rid"), F.col("rkey").alias("__rkey"), F.col("pos").alias("__pos"), F.col("word").alias("__word"))
    same = lines["rid"].eqNullSafe(there["__rid"]) & (lines["rkey"] == there["__rkey"]) & (lines["pos"] == there["__pos"]) & (lines["word"] == there["__word"])
    return lines.join(there, same, "left_semi")


LINE = ["rid", "rkey", "item", "start"]


def alignments(tables: Tables, docs: DataFrame, items: DataFrame, window: int, few: bool, misses: int = 0) -> DataFrame:
    """(rid, rkey, item, start, first, n): where an item would begin if its window of n words from ``first`` on is there, as far as its rarest words tell.

    ``docs``: rid, rkey, text. ``misses``: words of a window that need not meet. start may lie before a
    document's first word or after its last. What a posting says is asked of its own windows only.
    """
    frequency = cut(_postings(docs, items, few).groupBy("word").agg(F.count("*").alias("df")))
    places = tables.write(_places(items, frequency, window, misses))
    hint = lambda df: _bench(df, few)
    rarest, others = places.where(F.col("rank") <= misses), places.where(F.col("rank") > misses)
    words = rarest.select("item", "at", "word").distinct()
    # a table: what each of its words says of where windows are is asked for twice
    first = tables.write(_postings(docs, words, few))
    hits = first.join(hint(words), "word").select("rid", "rkey", "item", (F.col("pos") - F.col("at")).alias("start"), "at")
    hits = tables.write(hits.join(hint(rarest.select("item", "at", "first", "n", "need")), ["item", "at"]).select(*LINE, "first", "n", "need"))
    second = tables.write(_postings(_of_documents(docs, hits), others, few))
    asked = hits.select(*LINE, "first", "n", "need").distinct() if misses else hits
    asked = asked.join(hint(others.select("item", "first", "at", "word")), ["item", "first"]).withColumn("pos", F.col("start") + F.col("at"))
    # what is met of each window, of its words that were looked up
    both = hits.unionByName(_met(asked, second).select(*LINE, "first", "n", "need"))
    out = tables.write(both.groupBy(*LINE, "first", "n", "need").agg(F.count("*").alias("met")).where("met >= need").select(*LINE, "first", "n"))
    tables.drop(first, second, hits, places)
    return out


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 1.0, item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(rid, rkey, name, start, n, at): windows, by their offset ``at`` in the item, of which a share of the words meets.

    A window's words are those of the document from start + at on, n of them. ``docs``: rid, rkey, text.
    Of an item's windows with the same words the first stands for all.
    """
    tables = Tables(docs.sparkSession)
    named = cut(item_words(benchmark, item_id, item_text))
    items = named.select("item", "size", F.posexplode("words").alias("at", "word"))
    few = small(items, BROADCAST_ROWS)
    misses = window - math.ceil(share * window - 1e-9)
    lines = alignments(tables, docs, items, window, few, misses)
    postings = tables.write(_postings(_of_documents(docs, lines), items, few))
    # the places of all windows of a line, each once
    wanted = F.array_distinct(F.flatten(F.transform(F.collect_list(F.struct("first", "n")), lambda x: F.sequence(x["first"], x["first"] + x["n"] - 1))))
    asked = lines.groupBy(*LINE).agg(wanted.alias("ats")).select(*LINE, F.explode("ats").alias("at"))
    asked = asked.join(_bench(items.select("item", "at", "word"), few), ["item", "at"]).withColumn("pos", F.col("start") + F.col("at"))
    met = _met(asked, postings).groupBy(*LINE).agg(F.array_sort(F.collect_list("at")).alias("met"))  # of one item
    n = F.least(F.lit(window), F.col("size"))
    found = met.join(_bench(named.select("item", "name", "size"), few), "item").withColumns({"n": n, "need": F.greatest(F.lit(1), F.ceil(share * n - 1e-9)).cast("int")})
    # need places that meet, from one to another less than a window apart, are in the windows that hold both
    held = "transform(sequence(1, size(met) - need + 1), j -> struct(element_at(met, j) as a, element_at(met, j + need - 1) as b))"
    spans = found.where("size(met) >= need").select("rid", "rkey", "name", "start", "size", "n", F.explode(F.expr(f"filter({held}, x -> x.b - x.a < n)")).alias("x"))
    low, high = F.greatest(F.col("x.b") - F.col("n") + 1, F.lit(0)), F.least(F.col("x.a"), F.col("size") - F.col("n"))
    return spans.where(low <= high).select("rid", "rkey", "name", "start", "n", F.explode(F.sequence(low, high)).alias("at")).distinct()


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items (names, sorted), contaminated, rkey."""
    docs = documents.select(F.col(f"`{doc_id}`").alias("rid"), text_key(text).alias("rkey"), F.col(f"`{text}`").alias("text"))
    hits = cut(matches(docs, benchmark, window, 1.0, item_id, item_text).select("rid", "rkey", "name", (F.col("start") + F.col("at")).alias("first"), "n").distinct())
    per_item = hits.select("rid", "rkey", "name").distinct().groupBy("rid", "rkey").agg(F.array_sort(F.collect_list("name")).alias("items"))
    covered = hits.select("rid", "rkey", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("pos"))
    per_doc = covered.distinct().groupBy("rid", "rkey").agg(F.count("*").alias("n_hit"))
    found = cut(per_doc.join(per_item.withColumnsRenamed({"rid": "irid", "rkey": "irkey"}), F.col("rid").eqNullSafe(F.col("irid")) & (F.col("rkey") == F.col("irkey"))).select(F.col("rid").alias("frid"), F.col("rkey").alias("frkey"), "n_hit", "items"))
    counted = docs.select("rid", "rkey", F.size(words_of("text")).cast("bigint").alias("n_words"))
    both = counted.join(_bench(found, small(found, BROADCAST_ROWS // 4)), F.col("rid").eqNullSafe(F.col("frid")) & (F.col("rkey") == F.col("frkey")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return both.select(
        F.col("rid").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "rkey",
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    bad = cut(contamination(documents, benchmark, window, doc_id, text).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("rkey").alias("__key")).distinct())
    bad = _bench(bad, small(bad, BROADCAST_ROWS))
    keyed = documents.withColumn("__text", text_key(text))
    return keyed.join(bad, F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left_anti").drop("__text")
