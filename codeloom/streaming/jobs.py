"""Structured Streaming jobs over (key, event_type, ts, value) events, and their batch equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType


def debounce(events: DataFrame, quiet: str = "2 hours", key: str = "user_id", lateness: str = "1 day") -> DataFrame:
    """(key, first, last, n, final_type): bursts of a key's events that are followed by a quiet period; works on both kinds of frames.

    The last event of a burst decides its type, so a deletion cancels what came before it.
    """
    e = events.where(F.col("ts").isNotNull())
    e = e.withWatermark("ts", lateness) if events.isStreaming else e
    g = e.groupBy(F.session_window("ts", quiet).alias("w"), key).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("final_type"))
    return g.select(key, "first", "last", "n", "final_type")


def sliding_metrics(events: DataFrame, width: str = "1 day", slide: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """(event_type, start, n, total, high) of overlapping windows."""
    e = events.where(F.col("ts").isNotNull())
    e = e.withWatermark("ts", lateness) if events.isStreaming else e
    g = e.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("high"))
    return g.select("event_type", F.col("w.start").alias("start"), "n", "total", "high")


def recent_window(events: DataFrame, seconds: int, key: str) -> DataFrame:
    """Rows with the count and mean of the key's events within so many seconds before, the row itself included; the bound is open."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("n", F.count("*").over(w)).withColumn("mean", F.avg("value").over(w))


def first_seen(events: DataFrame, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """Events once per key: within the watermark on a stream, over all rows in batch."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def upsert_parquet(spark: SparkSession, batch: DataFrame, target: str, key: str, order: str, version: int) -> str:
    """Merge a batch into the newest version under the target and write the next one; a replayed version changes nothing.

    The last row of a key by `order` wins, and rows with status 'deleted' remove their key. Returns the version's path.
    """
    import re

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(conf)
    done = sorted(int(m[1]) for st in (fs.listStatus(root) if fs.exists(root) else []) if (m := re.fullmatch(r"v(\d+)", st.getPath().getName())) and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")))
    path = f"{target}/v{version}"
    if version in done:
        return path
    before = [v for v in done if v < version]
    rows = spark.read.parquet(f"{target}/v{before[-1]}").unionByName(batch, allowMissingColumns=True) if before else batch
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")
    last.where("coalesce(status, '') <> 'deleted'").write.mode("overwrite").parquet(path)
    return path


def incremental_index(source: DataFrame, target: str, checkpoint: str, key: str = "file_id", order: str = "indexed_at"):
    """A query that upserts each micro-batch of a stream into versions under the target, exactly once per batch."""
    spark = source.sparkSession
    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: upsert_parquet(df.sparkSession, df, target, key, order, n) and None).start()


def watch_files(spark: SparkSession, folder: str, schema: StructType, most: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream, so many per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).parquet(folder)
