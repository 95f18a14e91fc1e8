"""Streams: gap-based episodes and a growing graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Streams get a watermark, which needs a time with a zone; batch frames stay as they are."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def episodes(events: DataFrame, time: str = "ts", by: str = "user_id", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(by, start_time, end_time, events): sessions; a batch frame gives the same rows as a stream that has ended. ``end_time`` is that of the last event."""
    rows = _timed(events, time, late)
    each = rows.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events"), F.max(time).alias("end_time"))
    return each.select(by, F.col("w.start").alias("start_time"), "end_time", "events")


def windows(events: DataFrame, time: str, size: str, slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Counts by tumbling or sliding window."""
    rows = _timed(events, time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.groupBy(w.alias("w"), *(by or [])).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n")


def deduplicate(events: DataFrame, time: str, key: list[str], late: str = "10 minutes") -> DataFrame:
    return _timed(events, time, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def grow(stream: DataFrame, folder: str, checkpoint: str, attributes: list[str]):
    """A query that upserts each micro-batch of edges (src, dst, ord, attributes) into versioned Parquet tables.

    A version is written whole, then named as current by its batch id, so a batch that is run again after a failure gives the same table.
    """
    from kgspark.operators.enrich import upsert_edges

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        old = [int(s.getPath().getName()[2:]) for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getPath().getName().startswith("v=")]
        before = [v for v in old if v < batch_id]
        rows = batch.select("src", "dst", "ord", *attributes)
        if before:
            rows = rows.unionByName(spark.read.parquet(f"{folder}/v={max(before)}"))
        latest = rows.groupBy("src", "dst").agg(F.max("ord").alias("ord")).withColumnsRenamed({"src": "_s", "dst": "_d"})
        merged = upsert_edges(rows, attributes).join(latest, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d"))).drop("_s", "_d")
        merged.write.mode("overwrite").parquet(f"{folder}/v={batch_id}")
        for v in before[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={v}"), True)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    return spark.read.parquet(f"{folder}/v={max(versions)}")
