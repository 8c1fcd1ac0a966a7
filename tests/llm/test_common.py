import os
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common


def stub(master, folder=None, set_before=None):
    """A session with a master, a configured folder and one set on the context."""
    held = SimpleNamespace(isEmpty=lambda: set_before is None, get=lambda: set_before)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: folder))


def test_no_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(stub(master))
        assert common.shared_folder(stub(master, "hdfs://x/y/")) == "hdfs://x/y"
        assert common.shared_folder(stub(master, set_before="hdfs://z")) == "hdfs://z"


def test_tables_are_dropped(spark):
    tables = common.Tables(spark)
    kept, gone = tables.write(spark.range(5)), tables.write(spark.range(3))
    path = gone.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and gone.count() == 3
    tables.drop(gone)
    assert not os.path.exists(path) and kept.count() == 5


def test_columns_that_do_not_come_back(spark):
    frame = spark.range(4).select("id", F.lit("abc").alias("text"), F.lit(1).alias("n"))
    out = common.with_arrow_columns(frame, ["text"], [T.StructField("n", T.LongType())], lambda: lambda x: [pa.array([len(t) for t in x.to_pylist()], pa.int64())], without=["text"])
    assert out.columns == ["id", "n"] and {r.n for r in out.collect()} == {3}
    with pytest.raises(ValueError):
        common.with_arrow_columns(frame, ["missing"], [], lambda: None)
