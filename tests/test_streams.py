from pyspark.sql import functions as F

from lodestar.streaming import streams

SF = "/root/testdata/sf0.001"


def test_stream_windows_equal_the_batch(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    mark = lambda d: d.withColumn("outcome", F.when(F.col("event_type") == "error", "error").otherwise("ok"))
    want = {tuple(r) for r in streams.rolling(mark(batch), "ts", ["event_type"], "value", "1 hour", "1 hour").collect()}
    got = {tuple(r) for r in streams.run_once(streams.rolling(mark(live), "ts", ["event_type"], "value", "1 hour", "1 hour", "1 hour"), f"{tmp_path}/cp", "rolled", "update").collect()}
    assert want <= got


def test_ingest_skips_repeats_and_keeps_bad_rows_apart(spark, tmp_path):
    rows = [(1, "hello world " * 20), (2, "hello world " * 20), (3, "  "), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    streams.ingest(streams.file_stream(spark, f"{tmp_path}/in", "doc_id long, text string"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/out/chunks").collect()} == {1}
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/out/dead").collect()} == {3, 4}
