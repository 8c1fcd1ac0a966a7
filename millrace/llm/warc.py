"""Operator 12: web pages as WARC archives, and a normaliser of archives that were compressed whole.

Spark's own writer makes an archive of each partition: one gzip stream over all its records. The
normaliser inflates such a stream once, in pieces, and writes each record as a gzip member of its
own, with a sidecar of offsets beside the archive, so that any record can be read alone. Records with
the payload of another one are revisits that refer to it.

Every archive is rewritten under its own name from its own bytes alone: it is written under a hidden
name and then renamed, so a task that is run again, or twice, leaves the same file, and readers see
whole files only. Files are reached by pyarrow's file systems, as streams; a table with a ``content``
column can give archives from elsewhere.

Cases: a null payload is an empty one; payloads under ``least`` bytes are never revisits; of equal
payloads the largest id is the response, all rows with that id and payload are, and null ids refer to
it like others (if all ids are null, all are responses); rows that repeat are records that repeat; a
page of any length is one record, held whole by the task that writes or reads it; CR and LF in a URL
are percent-encoded, a null URL is left out; an empty table gives no archive and no rows; further
columns are left alone by ``planned`` and are not archived. A stream that is cut off or a record of
the wrong length is an error.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, shared_folder, small, small_batches

END = b"\r\n\r\n"
#: Payloads from so many bytes on are kept once.
LEAST = 1000
#: Records of an archive.
MOST_RECORDS = 50_000
#: Revisits that are broadcast to the pages.
MOST_SENT = 200_000
#: Bytes inflated at once.
PIECE = 1 << 20
DATE = "2001-08-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset bigint, length bigint, record_id string, type string, id string, url string"
RECORD = "record_id string, id string, type string, url string, refers_to string, digest string, payload binary"


def planned(pages: DataFrame, page_id: str = "page_id", payload: str = "html", least: int = LEAST) -> DataFrame:
    """Adds payload_digest (SHA-1, hex) and refers_to: the id of the page with the same payload that is kept, null on that one."""
    text = F.coalesce(F.col(payload), F.lit(""))
    size, key = F.octet_length(text), ["payload_digest", "__more", "__size"]
    hashed = pages.withColumns({"payload_digest": F.sha1(text.cast("binary")), "__more": F.xxhash64(text), "__size": size})
    tables = Tables(pages.sparkSession)
    seen = tables.write(hashed.where(F.col("__size") >= least).select(F.col(page_id).alias("__id"), *key))
    kept = seen.groupBy(*key).agg(F.max("__id").alias("__kept"), F.count("*").alias("n")).where("n > 1 and __kept is not null").drop("n")
    others = tables.write(seen.join(kept, key).where(~F.col("__id").eqNullSafe(F.col("__kept"))).distinct())
    tables.drop(seen)
    others = others.select("__id", F.col("__kept").alias("refers_to"), *[F.col(c).alias(f"{c}_") for c in key])
    others = F.broadcast(others) if small(others, MOST_SENT) else others
    same = F.col(page_id).eqNullSafe(F.col("__id"))
    for c in key:
        same &= F.col(c) == F.col(f"{c}_")
    columns = [F.col(f"`{c}`") for c in pages.columns if c not in ("refers_to", "payload_digest")]
    return hashed.drop("refers_to").join(others, same, "left").select(*columns, "payload_digest", "refers_to")


def record_id(page_id: Column, digest: Column) -> Column:
    """A record's identifier, which depends on the page's id and payload alone."""
    name = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest).cast("binary"))
    return F.regexp_replace(name, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "<urn:uuid:$1-$2-3$3-a$4-$5>")


def records(plan: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE) -> DataFrame:
    """(value): each page's WARC record, but for the four bytes that end it."""
    body = F.coalesce(F.col(payload), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    address = F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, body))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        field("WARC-Record-ID", record_id(F.col(page_id), F.col("payload_digest"))), field("WARC-Date", F.lit(date)), field("WARC-Target-URI", address),
        field("Page-ID", F.col(page_id).cast("string")), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to"), F.col("payload_digest")))), field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return plan.select(F.concat(head, block).alias("value"))


def write_whole(written: DataFrame, folder: str) -> None:
    """Writes records as archives of one gzip stream each, by Spark's text writer: what ends its lines ends a record."""
    written.write.option("compression", "gzip").option("lineSep", END.decode()).option("maxRecordsPerFile", MOST_RECORDS).text(folder)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI as Spark writes it."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "/", uri)))


class Inflated:
    """The inflated bytes of a gzip stream, taken in order; never more than a record and a piece are held."""

    def __init__(self, stream):
        self.stream, self.held, self.rest = stream, bytearray(), b""
        self.inflater, self.begun = zlib.decompressobj(31), False

    def more(self) -> bool:
        """Inflates a piece; False at the end of the stream."""
        while True:
            self.rest = self.rest or self.stream.read(PIECE)
            if not self.rest and not self.begun:
                return False
            piece = self.inflater.decompress(self.rest, PIECE) if self.rest else self.inflater.flush()
            if self.inflater.eof:  # another member may follow
                self.rest, self.inflater, self.begun = self.inflater.unused_data, zlib.decompressobj(31), False
            elif not self.rest:
                raise ValueError("the archive is cut off")
            else:
                self.rest, self.begun = self.inflater.unconsumed_tail, True
            if piece:
                self.held += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        """All up to the mark and the mark; None at the end."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held:
                    raise ValueError("the archive ends within a record's head")
                return None
        return self.exactly(at + len(mark))

    def exactly(self, n: int) -> bytes:
        """The next n bytes."""
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def fields_of(head: bytes) -> dict[str, str]:
    """A record's named fields, in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {name.lower(): value.removeprefix(" ") for name, colon, value in (x.partition(":") for x in lines[1:]) if colon}


def parsed(stream) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """Head, fields and block of each record of a gzip stream."""
    source = Inflated(stream)
    while (head := source.until(END)) is not None:
        fields = fields_of(head)
        block = source.exactly(int(fields["content-length"]))
        if source.exactly(len(END)) != END:
            raise ValueError(f"{fields.get('warc-record-id')} isn't as long as it says")
        yield head, fields, block


def rewrite(stream, store: fs.FileSystem, folder: str, name: str) -> tuple[int, int]:
    """Writes a stream's records as members of their own, and their sidecar; (records, bytes)."""
    mine = uuid.uuid4().hex
    hidden = [f"{folder}/.{name}{end}.{mine}" for end in ("", ".idx")]
    offset = count = 0
    with store.open_output_stream(hidden[0]) as out, store.open_output_stream(hidden[1]) as index:
        for head, fields, block in parsed(stream):
            member = gzip.compress(head + block + END, 6, mtime=0)
            out.write(member)
            entry = {"archive": name, "offset": offset, "length": len(member), "record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "id": fields.get("page-id"), "url": fields.get("warc-target-uri")}
            index.write(json.dumps(entry).encode() + b"\n")
            offset, count = offset + len(member), count + 1
    for path, end in zip(hidden, ("", ".idx")):
        store.move(path, f"{folder}/{name}{end}")
    return count, offset


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives (path, and content if they aren't to be opened by path) into a folder: (archive, records, bytes), a table.

    Names of archives must differ, as the new archive takes its name from the old.
    """
    small_batches(archives.sparkSession)
    given = ["path", *(["content"] if "content" in archives.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                name = re.sub(r"(\.warc|\.txt)?(\.gz)?$", "", row["path"].rsplit("/", 1)[-1]) + ".warc.gz"
                if row.get("content") is None:
                    source, path = opened(row["path"])
                    with source.open_input_stream(path, compression=None) as stream:
                        rows.append((name, *rewrite(stream, store, root, name)))
                else:
                    rows.append((name, *rewrite(io.BytesIO(row["content"]), store, root, name)))
            columns = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return Tables(archives.sparkSession).write(archives.select(*given).mapInArrow(run, "archive string, records bigint, bytes bigint"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path): a folder's archives, listed without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """All sidecars of a folder: one row a record."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(folder)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of index rows, each read alone at its offset; the payload is what follows the HTTP head, if there is one."""
    small_batches(index.sparkSession)
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        name = source = None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, store.open_input_file(f"{root}/{archive}")
                _, fields, block = next(parsed(io.BytesIO(source.read_at(length, offset))))
                payload = block.partition(END)[2] if fields.get("content-type", "").startswith("application/http") else block
                rows.append((fields.get("warc-record-id"), fields.get("page-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), payload))
                held += len(payload)
                if held >= 8 * PIECE:
                    yield as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield as_batch(rows)
        if source is not None:
            source.close()

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return index.select("archive", "offset", "length").mapInArrow(run, RECORD)


def with_payloads_of_responses(read: DataFrame) -> DataFrame:
    """(id, type, payload_bytes, payload_digest, refers_to) of records; a revisit has its response's payload and id.

    ``read``: record_id, id, type, refers_to, payload_bytes, payload_digest, as a table. A revisit whose
    response isn't there has nulls.
    """
    own = read.where("type <> 'revisit'").select("id", "type", "payload_bytes", "payload_digest", F.lit(None).cast("string").alias("refers_to"))
    found = read.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("id").alias("of"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    back = read.where("type = 'revisit'").select("id", "type", "refers_to").join(found, "refers_to", "left")
    return own.unionByName(back.select("id", "type", "payload_bytes", "payload_digest", F.col("of").alias("refers_to")))


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of archives."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """Writes pages as normalised archives with sidecars into a folder; (archive, records, bytes)."""
    spark = pages.sparkSession
    whole = f"{shared_folder(spark)}/whole-{uuid.uuid4().hex}"
    write_whole(records(planned(pages, page_id, payload, least), page_id, url, payload), whole)
    done = normalise(listed(spark, whole), folder)
    delete(spark, whole)
    return done


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) written as archives and read back by their index: page_id, record_type, payload_bytes, payload_digest, refers_to."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archive(pages, folder)
    read = read_records(read_index(spark, folder), folder)
    summed = read.select("record_id", "id", "type", "refers_to", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    table = Tables(spark).write(summed)
    delete(spark, folder)
    kind = pages.schema["page_id"].dataType
    return with_payloads_of_responses(table).select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
