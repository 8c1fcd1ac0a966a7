import pytest
from pyspark.sql import functions as F

from millrace.sources import files
from millrace.sources.database import jdbc_options
from millrace.streaming.feedback import score_changes


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n 1 ,x\n ,y\n2,z\n")
    (tmp_path / "b.csv").write_text("key\n1\n")
    assert sorted(r.id for r in files.read_ids(spark, str(tmp_path / "a.csv")).collect()) == ["1", "2"]
    with pytest.raises(ValueError):
        files.read_ids(spark, str(tmp_path / "b.csv"))
    files.write_rows(spark.range(3).withColumn("x", F.lit("q")), str(tmp_path / "out"), ["x", "id"], ["id"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["x", "id"]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.txt").write_bytes(b"text")
    (tmp_path / "c.PDF").write_bytes(b"")
    rows = {r.path[-5:]: r for r in files.read_uploads(spark, str(tmp_path)).collect()}
    assert rows["a.pdf"].status == "pending" and rows["b.txt"].refused == "not a PDF" and "c.PDF" not in rows and rows["b.txt"].pdf_bytes is None


def test_accepted_uploads(spark):
    rows = [("a.pdf", "text/plain", b"1"), ("b", "application/pdf", b"2"), ("c.x", "application/octet-stream", b"3")]
    frame = lambda r: spark.createDataFrame([(n, t, bytearray(c)) for n, t, c in r], "filename string, content_type string, content binary")
    kept = files.accepted_uploads(frame(rows)).collect()
    assert len({r.report_id for r in kept}) == 3 and {r.status for r in kept} == {"pending"}
    for bad, why in ((("d.txt", "text/plain", b"4"), "not a PDF"), (("d.PDF", None, b""), "empty"), ((None, None, b"1"), "not a PDF")):
        with pytest.raises(ValueError, match=why):
            files.accepted_uploads(frame([*rows, bad]))
    with pytest.raises(ValueError, match="too large"):
        files.accepted_uploads(frame(rows), most=0)


def test_ids_of_uploads_depend_on_the_request(spark):
    rows = [("a.pdf", None, bytearray(b"1")), ("a.pdf", None, bytearray(b"1")), ("b.pdf", None, bytearray(b"1"))]
    frame = spark.createDataFrame(rows, "filename string, content_type string, content binary")
    ids = lambda request: sorted(r.report_id for r in files.accepted_uploads(frame.repartition(3), request=request).collect())
    assert ids("r1") == ids("r1") != ids("r2") and len(set(ids("r1"))) == 3 and ids(None) != ids(None)
    with pytest.raises(ValueError, match="no files"):
        files.accepted_uploads(frame.limit(0))


def test_connection_options():
    assert jdbc_options({"DATABASE_URL": " postgresql://x/y "}) == {"url": "jdbc:postgresql://x/y"}
    assert jdbc_options({"DB_HOST": "h", "DB_USER": "u", "DB_PASSWORD": "p", "DB_PORT": "1"}) == {"url": "jdbc:postgresql://h:1/postgres", "user": "u", "password": "p"}
    with pytest.raises(ValueError, match="DB_HOST, DB_PASSWORD"):
        jdbc_options({"DB_USER": "u", "DB_PASSWORD": ""})


def test_added_columns(spark):
    assert files.with_missing_columns(spark.range(1), {"id": "string", "note": "string"}).dtypes == [("id", "bigint"), ("note", "string")]


def test_stream_of_feedback(spark, tmp_path):
    links = spark.createDataFrame([(1, 0, 0.5), (1, 1, None)], "product_id bigint, terpene_id int, percent double")
    rows = [("2001-01-01 10:00:00", 7, 1, "like"), ("2001-01-01 11:00:00", 7, 1, "like"), ("2001-01-02 11:00:00", 7, 1, "dislike")]
    frame = spark.createDataFrame(rows, "t string, customer_id bigint, product_id bigint, feedback string").withColumn("at", F.col("t").cast("timestamp")).drop("t")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = score_changes(stream, links).writeStream.format("memory").queryName("changes").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.day.day, r.terpene_id, r.score) for r in spark.table("changes").collect()) == [(1, 0, 1.0), (1, 1, 0.2), (2, 0, -0.5), (2, 1, -0.1)]
