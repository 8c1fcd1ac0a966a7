"""Substring search by an index of three-character pieces.

The index has the searched rows, dealt by key into parts of a bounded size, and postings: for each
piece of the lower-cased texts and each part, the keys of the rows that have it. A search takes the
pieces of its pattern that are in fewest rows, meets their keys part by part, reads the parts where
some row has them all, and looks at the texts there as the plain search does. A pattern without three
plain characters in a row, or whose pieces are nearly everywhere, reads all rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paging import escaped, search

#: Rows of a part, keys of a posting at most.
PART_ROWS = 10_000
#: Pieces of a pattern that are met, those in fewest rows.
MOST_PIECES = 4
#: Parts that are listed in a filter; more are joined.
MOST_LISTED = 1000
#: Share of rows from which on reading them all is cheaper.
OFTEN = 0.2
LENGTH = 3


def pieces(text: Column) -> Column:
    """The distinct pieces of a text's lower case."""
    low = F.lower(text)
    each = F.transform(F.sequence(F.lit(1), F.char_length(low) - LENGTH + 1), lambda k: F.substring(low, k, F.lit(LENGTH)))
    return F.when(F.char_length(low) >= LENGTH, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def build(df: DataFrame, key: str, columns: list[str], folder: str, part_rows: int = PART_ROWS) -> None:
    """Writes the index of a frame: its rows, their postings, and how many rows have each piece.

    Rows are dealt by ranges of the key. A posting is of one part, so a piece that all rows have is
    many rows of the postings, and in as many tasks.
    """
    n = df.count()
    dealt = df.repartitionByRange(max(1, -(-n // part_rows)), key).withColumn("part", F.spark_partition_id())
    df.sparkSession.createDataFrame([(n, dealt.schema.json())], "n bigint, kind string").write.parquet(f"{folder}/total")
    dealt.write.partitionBy("part").parquet(f"{folder}/rows")
    rows = _rows(df.sparkSession, folder)
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(pieces(F.col(c)), F.array().cast("array<string>")) for c in columns])))
    found = rows.select("part", key, F.explode(every).alias("piece"))
    posted = found.groupBy("piece", "part").agg(F.sort_array(F.collect_list(key)).alias("keys"))  # of one part, at most its rows
    posted.repartitionByRange("piece", "part").sortWithinPartitions("piece", "part").write.parquet(f"{folder}/postings")
    counts = df.sparkSession.read.parquet(f"{folder}/postings").groupBy("piece").agg(F.sum(F.size("keys")).alias("n"))
    counts.repartitionByRange("piece").sortWithinPartitions("piece").write.parquet(f"{folder}/counts")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    kind = spark.read.parquet(f"{folder}/total").first()["kind"]  # an empty table has no files to tell
    return spark.read.schema(T.StructType.fromJson(json.loads(kind))).parquet(f"{folder}/rows")


def plain_runs(pattern: str) -> list[str]:
    """The characters of a LIKE pattern that stand for themselves, in runs between its wildcards."""
    runs, k = [""], 0
    while k < len(pattern):
        if pattern[k] in "%_":
            runs.append("")
        else:
            k += pattern[k] == "\\" and k + 1 < len(pattern)
            runs[-1] += pattern[k]
        k += 1
    return [r for r in runs if r]


def candidates(spark: SparkSession, folder: str, q: str) -> DataFrame | None:
    """(part, keys): the rows that have all of the pattern's rarest pieces; None if all rows are to be read."""
    low = spark.range(1).select(F.lower(F.lit(escaped(q.strip())))).first()[0]  # as the plain search does
    wanted = sorted({run[k : k + LENGTH] for run in plain_runs(low) for k in range(len(run) - LENGTH + 1)})
    if not wanted:
        return None
    counts = {r.piece: r.n for r in spark.read.parquet(f"{folder}/counts").where(F.col("piece").isin(wanted)).collect()}  # at most a pattern's pieces
    postings = spark.read.parquet(f"{folder}/postings")
    if len(counts) < len(wanted):
        return postings.where("false").select("part", "keys")
    rarest = sorted(wanted, key=lambda x: (counts[x], x))[:MOST_PIECES]
    if counts[rarest[0]] > OFTEN * spark.read.parquet(f"{folder}/total").first()["n"]:
        return None
    lists = postings.where(F.col("piece").isin(rarest)).groupBy("part").agg(F.collect_list("keys").alias("lists"))  # at most MOST_PIECES of a part
    met = lists.where(F.size("lists") == len(rarest)).select("part", F.aggregate(F.slice("lists", 2, MOST_PIECES), F.col("lists")[0], F.array_intersect).alias("keys"))
    return met.where(F.size("keys") > 0)


def parts_with(spark: SparkSession, folder: str, q: str) -> DataFrame:
    """The rows of the parts that can hold what is searched."""
    rows, met = _rows(spark, folder), candidates(spark, folder, q)
    if met is None:
        return rows
    some = [r.part for r in met.select("part").limit(MOST_LISTED + 1).collect()]
    return rows.where(F.col("part").isin(some)) if len(some) <= MOST_LISTED else rows.join(met.select("part"), "part", "left_semi")


def find(spark: SparkSession, folder: str, q: str | None, columns: list[str]) -> DataFrame:
    """The rows in which any column contains the text, as ``paging.search`` gives them, from the index."""
    if not q:
        return _rows(spark, folder).drop("part")
    return search(parts_with(spark, folder, q), q, columns).drop("part")
