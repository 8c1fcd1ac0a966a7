"""Tables in numbered versions: several writers, readers of a fixed version, changes of single rows.

A version is one small file that names, for each table, the Parquet folders that hold it: parts, and
logs of changed rows that are merged when the table is read. Folders are written first and never
changed. A version's file is then created only if it isn't there yet, so of two writers from one base
one gets the number. The other looks at what came between: if that touched none of the tables it has
read or changed it takes the next number, else it fails with ``Conflict`` and leaves nothing.

The file is made whole under another name and then linked (local folders) or renamed (others) to its
own. Both refuse a name that is taken, HDFS in one step; an object store whose rename isn't one step
needs one writer at a time.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Changed rows whose keys are broadcast to a table's parts.
MOST_SENT = 200_000
#: Keys that are sent to the scan as a filter, so that it can skip files and row groups.
MOST_LISTED = 1000
#: Logs of a table from which on a change rewrites it whole.
MOST_LOGS = 20
GONE, AT = "__gone", "__at"


class Conflict(Exception):
    """Another writer has changed a table that this transaction read or changed."""


class Store:
    """The versions of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The versions that are there, in order."""
        at = self.path(f"{self.folder}/versions")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n))

    def version(self) -> int:
        """The latest version, 0 if there is none."""
        return max(self.numbers(), default=0)

    def tables(self, version: int | None = None) -> dict:
        """What a version's file says of each table; nothing for version 0."""
        return self._said(self.version() if version is None else version)["tables"]

    def _said(self, version: int) -> dict:
        if version == 0:
            return {"tables": {}, "changed": []}
        stream = self.fs.open(self.path(self._file(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _file(self, version: int) -> str:
        return f"{self.folder}/versions/{version:09d}.json"

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it was in a version, the latest if none is given."""
        return self._merged(self.tables(version)[name])

    def _load(self, paths: list[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths])

    def _changes(self, entry: dict) -> DataFrame:
        """The last change of each key in a table's logs."""
        schema = T.StructType.fromJson(entry["schema"])
        logged = T.StructType([*schema.fields, T.StructField(GONE, T.BooleanType())])
        each = [self._load([log["path"]], logged).withColumn(AT, F.lit(k)) for k, log in enumerate(entry["logs"])]
        others = [c for c in logged.names if c not in entry["key"]]
        if len(each) == 1:  # a key is in a log once
            return each[0].drop(AT)
        last = reduce(DataFrame.unionByName, each).groupBy(*entry["key"]).agg(F.max_by(F.struct(*others), AT).alias("__last"))
        return last.select(*entry["key"], "__last.*")

    def _merged(self, entry: dict) -> DataFrame:
        """Parts without the keys that were changed, and the changed rows that aren't gone."""
        schema = T.StructType.fromJson(entry["schema"])
        parts = self._load(entry["parts"], schema)
        if not entry["logs"]:
            return parts
        changes = self._changes(entry)
        keys = changes.select(*entry["key"])
        keys = F.broadcast(keys) if sum(log["rows"] for log in entry["logs"]) <= MOST_SENT else keys
        return parts.join(keys, entry["key"], "left_anti").unionByName(changes.where(~F.col(GONE)).select(schema.names))

    def begin(self) -> Transaction:
        """A transaction on the latest version; as a context it commits at its end, unless there is an exception."""
        return Transaction(self)

    def claim(self, version: int, said: dict) -> bool:
        """Creates a version's file, or tells that another writer has."""
        hidden, final = f"{self.folder}/versions/.{uuid.uuid4().hex}", self._file(version)
        stream = self.fs.create(self.path(hidden))
        try:
            stream.write(bytearray(json.dumps(said).encode()))
        finally:
            stream.close()
        try:
            if self.fs.getScheme() == "file":
                os.link(_local(hidden), _local(final))
                return True
            return bool(self.fs.rename(self.path(hidden), self.path(final)))
        except FileExistsError:
            return False
        finally:
            self.fs.delete(self.path(hidden), False)

    def expire(self, keep: int = 10) -> None:
        """Deletes all versions but the last ones, and what only they hold; readers and writers of those must be done."""
        numbers = self.numbers()
        kept = {p.split("/")[1] for v in numbers[-keep:] for e in self.tables(v).values() for p in (*e["parts"], *(log["path"] for log in e["logs"]))}
        gone = {p.split("/")[1] for v in numbers[:-keep] for e in self.tables(v).values() for p in (*e["parts"], *(log["path"] for log in e["logs"]))}
        for v in numbers[:-keep]:
            self.fs.delete(self.path(self._file(v)), False)
        for name in sorted(gone - kept):
            self.fs.delete(self.path(f"{self.folder}/data/{name}"), True)


def _local(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


class Transaction:
    """Changes of several tables that become one version, or none."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.version()
        self.tables = store.tables(self.base)
        self.seen: set[str] = set()
        self.made: dict[str, dict] = {}
        self.here = f"data/{uuid.uuid4().hex}"

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()
        else:
            self.roll_back()

    def _entry(self, name: str) -> dict:
        return self.made.get(name) or self.tables[name]

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.here}/{name}-{uuid.uuid4().hex[:8]}"
        try:
            df.write.parquet(f"{self.store.folder}/{path}")
        except Exception:
            self.roll_back()
            raise
        return path

    def read(self, name: str) -> DataFrame:
        """A table as it was when the transaction began, with the transaction's own changes."""
        self.seen.add(name)
        return self.store._merged(self._entry(name))

    def rows(self, name: str, keys: DataFrame) -> DataFrame:
        """The table's rows with the given keys; few keys reach the scan as a filter."""
        key = self._entry(name)["key"]
        listed = keys.select(*key)
        if len(key) == 1:
            some = [r[0] for r in listed.limit(MOST_LISTED + 1).collect()]
            if len(some) <= MOST_LISTED:
                return self.read(name).where(F.col(key[0]).isin(sorted({k for k in some if k is not None})))
        return self.read(name).join(listed, key, "left_semi")

    def replace(self, name: str, df: DataFrame, key: list[str] | None = None) -> None:
        """Writes a table whole; a new table needs its key."""
        key = key or self._entry(name)["key"]
        self.made[name] = {"key": key, "schema": df.schema.jsonValue(), "parts": [self._write(df, name)], "logs": []}

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows with new keys as a further part; a key that is there or comes twice is an error."""
        self.seen.add(name)
        entry = self._entry(name)
        key = entry["key"]
        df = self._as_table(df, entry)
        path = self._write(df, name)
        new = self.store._load([path], T.StructType.fromJson(entry["schema"]))
        twice = new.groupBy(*key).count().where("count > 1").drop("count").unionByName(new.select(*key).join(self.rows(name, new).select(*key), key, "left_semi")).first()
        if twice:
            self.roll_back()
            raise ValueError(f"{name} has the key already: {twice.asDict()}")
        self.made[name] = {**entry, "parts": [*entry["parts"], path]}

    def upsert(self, name: str, df: DataFrame, once: bool = False) -> None:
        """Changes rows by key, or adds them: only these rows are written.

        ``once``: the frame is grouped by the key, so that what is written needn't be looked at again.
        """
        self._log(name, df, False, once)

    def delete(self, name: str, keys: DataFrame) -> None:
        """Takes rows away by key: only the keys are written."""
        self._log(name, keys, True)

    def _as_table(self, df: DataFrame, entry: dict) -> DataFrame:
        """The frame with the table's columns and types; those it lacks are null."""
        fields = T.StructType.fromJson(entry["schema"]).fields
        return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def _log(self, name: str, df: DataFrame, gone: bool, once: bool = False) -> None:
        self.seen.add(name)
        entry = self._entry(name)
        key = entry["key"]
        rows = self._as_table(df.select(*key).distinct() if gone else df, entry).withColumn(GONE, F.lit(gone))
        path = self._write(rows, name)
        written = self.store.spark.read.parquet(f"{self.store.folder}/{path}")
        twice = None if gone or once else written.groupBy(*key).count().where("count > 1").first()
        if twice:
            self.roll_back()
            raise ValueError(f"{name} gets the key twice: {twice.asDict()}")
        self.made[name] = {**entry, "logs": [*entry["logs"], {"path": path, "rows": written.count()}]}
        if len(self.made[name]["logs"]) > MOST_LOGS:
            self.compact(name)

    def compact(self, name: str) -> None:
        """Writes a table with its changes merged, so that readers needn't."""
        if self._entry(name)["logs"]:
            self.replace(name, self.read(name))

    def commit(self) -> int:
        """The number of the new version; ``Conflict`` if another writer came first to what was read or changed."""
        if not self.made:
            return self.base
        number, tables = self.base + 1, self.tables
        while not self.store.claim(number, {"tables": {**tables, **self.made}, "changed": sorted(self.made)}):
            other = self.store._said(number)
            touched = set(other["changed"]) & (self.seen | set(self.made))
            if touched:
                self.roll_back()
                raise Conflict(f"version {number} changed {', '.join(sorted(touched))}")
            number, tables = number + 1, other["tables"]
        return number

    def roll_back(self) -> None:
        """Deletes what the transaction has written."""
        self.made = {}
        self.store.fs.delete(self.store.path(f"{self.store.folder}/{self.here}"), True)
