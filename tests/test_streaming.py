"""Streams give what their batch equivalents give."""

from pyspark.sql import functions as F

from codeloom.streaming import jobs as J


def events(spark, path):
    rows = [(i, f"2024-01-01 {h:02d}:{m:02d}:00", u, t, float(i)) for i, (h, m, u, t) in enumerate([(0, 0, 1, "a"), (0, 30, 1, "b"), (5, 0, 1, "c"), (0, 10, 2, "a"), (9, 0, 2, "d")])]
    df = spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(path)
    return df


def drain(spark, stream, name, mode="complete"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def key(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_debounce(spark, tmp_path):
    batch = events(spark, str(tmp_path / "e"))
    stream = J.watch_files(spark, str(tmp_path / "e"), batch.schema)
    want = key(J.debounce(batch))
    assert len(want) == 4
    # a closed burst is emitted once the watermark has passed it; complete mode shows all
    assert key(drain(spark, J.debounce(stream), "bursts")) == want


def test_sliding(spark, tmp_path):
    batch = events(spark, str(tmp_path / "e"))
    stream = J.watch_files(spark, str(tmp_path / "e"), batch.schema)
    assert key(drain(spark, J.sliding_metrics(stream), "slides")) == key(J.sliding_metrics(batch))


def test_first_seen(spark, tmp_path):
    batch = events(spark, str(tmp_path / "e"))
    stream = J.watch_files(spark, str(tmp_path / "e"), batch.schema)
    got = drain(spark, J.first_seen(stream, ["user_id"]).select("user_id"), "firsts", "append")
    assert key(got) == key(J.first_seen(batch, ["user_id"]).select("user_id"))


def test_incremental_upsert(spark, tmp_path):
    target, check, source = (str(tmp_path / x) for x in ("t", "c", "s"))
    schema = "file_id bigint, content string, status string, indexed_at timestamp"
    make = lambda rows: spark.createDataFrame(rows, "file_id bigint, content string, status string, t string").withColumn("indexed_at", F.to_timestamp("t")).drop("t")
    make([(1, "a", None, "2024-01-01"), (2, "b", None, "2024-01-01")]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    J.incremental_index(stream, target, check).awaitTermination()
    make([(1, "c", None, "2024-01-02"), (2, None, "deleted", "2024-01-02")]).coalesce(1).write.mode("append").parquet(source)
    J.incremental_index(stream, target, check).awaitTermination()
    assert key(spark.read.parquet(f"{target}/v1").select("file_id", "content")) == [(1, "c")]
    assert J.upsert_parquet(spark, make([(9, "z", None, "2024-01-03")]), target, "file_id", "indexed_at", 1).endswith("v1")
    assert spark.read.parquet(f"{target}/v1").count() == 1
