"""Structured Streaming over event files: buckets, sliding windows and once-only messages as tables that runs add to.

Each run takes what is new (availableNow) and goes on from its checkpoint: with the output folder and checkpoint of an
earlier run it adds to that one, wherever it was stopped; without, it begins anew in the shared folder. Windowed sums are written as updates with their batch's number; readers take the last of each window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.functions.storage import new_path

#: Rows may come so late; a window is kept open as long.
LATE = "7 days"


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """The files at path (a folder, a file or a pattern) as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def window_sums(events: DataFrame, keys: list[str], ts: str, value: str, length: str, slide: str | None = None, start: str | None = None) -> DataFrame:
    """(keys, window_start, total, n) of tumbling or sliding windows of event time, with room for late rows."""
    w = F.window(ts, length, slide, start) if slide or start else F.window(ts, length)
    sums = events.withWatermark(ts, LATE).groupBy(*keys, w.alias("w")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return sums.select(*keys, F.col("w.start").alias("window_start"), "total", "n")


def run_updates(stream: DataFrame, keys: list[str], name: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run an aggregation until its input is used up and return its last state: one row a key."""
    spark = stream.sparkSession
    out = out or new_path(spark, f"{name}-updates")

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces its own folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint or new_path(spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    # the number of a batch comes from its folder
    rows = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", out).parquet(out)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, "v.*")


def once_only(events: DataFrame, key: Column, condition: Column, ts: str) -> DataFrame:
    """A message for each key that fulfils the condition, once for ever: (message). Its state is one entry a key."""
    return events.filter(condition).select(key.alias("message"), ts).withWatermark(ts, LATE).dropDuplicates(["message"]).select("message")


def once_a_period(events: DataFrame, key: Column, condition: Column, ts: str) -> DataFrame:
    """A message for each key that fulfils the condition, once, for keys of one period, as of a day: (message).

    A key is forgotten once the watermark has left its period behind, so the state holds no more than LATE and a period.
    """
    return events.filter(condition).select(key.alias("message"), ts).withWatermark(ts, LATE).dropDuplicatesWithinWatermark(["message"]).select("message")


def run_appends(stream: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream of rows until its input is used up and return all that it has written."""
    spark = stream.sparkSession
    out = out or new_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint or new_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def refused_rows(query) -> int:
    """Rows that a run's stateful operators refused because they came after the watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
