"""Helpers shared by the text operators: row keys, Arrow column functions, durable checkpoints."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_key(text: str = "text") -> Column:
    """64-bit hash that, with the id beside it, tells rows apart even where ids are null or repeat."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def hold_out(doc_id: str, modulus: int) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == 0


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables: the session's ``spark.checkpoint.dir``, or the context's.

    Only one machine (a ``local`` master, as in tests) may do without: it gets a temporary folder. On
    a cluster a folder of one machine would lose data, so there it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder."""
    folder, context = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return df.checkpoint()


class Tables:
    """Parquet tables of one call in the shared folder, for what is large and read more than once.

    Unlike a checkpoint a table is compressed and its columns are read one by one. ``drop`` deletes
    those that no frame still to be run reads; the others stay until the folder is cleared, as a
    result may be read at any time.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        """Writes a frame and reads it back."""
        path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that ``write`` gave."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(frame))[0])
            path.getFileSystem(conf).delete(path, True)


def table(df: DataFrame) -> DataFrame:
    """Writes a frame as a table in the shared folder and reads it back."""
    return Tables(df.sparkSession).write(df)


#: Rows of a batch sent to Python: texts of some KB each, in several copies there and in the JVM.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch, so that batches of texts fit beside each other in an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Returns the memory that a worker no longer uses to the machine, as far as its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def with_arrow_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: list[T.StructField],
    make: Callable[[], Callable[..., list[pa.Array]]],
    without: list[str] | None = None,
) -> DataFrame:
    """Adds columns computed batch by batch in Python.

    ``make()`` runs once in a task and returns a function from the input arrays of a batch to the
    output arrays. Existing columns with an output's name are replaced; those in ``without`` go to
    Python, but don't come back.
    """
    small_batches(df.sparkSession)
    names = {f.name for f in outputs} | set(without or ())
    kept = [c for c in df.columns if c not in names]
    missing = [c for c in inputs if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    carried = [c for c in inputs if c in names]
    hidden = {c: f"__in_{c}" for c in carried}
    fed = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(hidden[c]) for c in carried])
    schema = T.StructType([df.schema[c] for c in kept] + outputs)
    takes = [hidden.get(c, c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = None
        for batch in batches:
            compute = compute or make()
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            fresh = compute(*[batch.column(batch.schema.get_field_index(c)) for c in takes])
            yield pa.RecordBatch.from_arrays(columns + fresh, names=kept + [f.name for f in outputs])
        # workers outlive their tasks: what one operator holds must not stand beside the next one's
        del compute
        give_back()

    return fed.mapInArrow(run, schema)


def text_bytes(array: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow string array; a null gives no bytes."""
    return (x or b"" for x in array.cast(pa.binary()).to_pylist())


def texts(array: pa.Array) -> Iterator[str]:
    """Each text of an Arrow string array; a null gives the empty text."""
    return (x or "" for x in array.to_pylist())


def portions(whole: list, size: int = 1 << 20) -> Iterator[slice]:
    """Slices of a list of texts with about ``size`` characters each, for arrays that grow with the text."""
    start = held = 0
    for k, x in enumerate(whole):
        held += len(x or "")
        if held >= size:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(whole):
        yield slice(start, len(whole))


def small(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most so many rows: the check before any broadcast."""
    return df.limit(rows + 1).count() <= rows
