"""Tables laid out for what is asked of them: partitions by month for ranges of days, buckets by key for single keys and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_daily(rows: DataFrame, table: str, key: str, day: str, path: str, buckets: int = 16) -> None:
    """Save rows at path as a table with partitions by the month of `day` and buckets by `key`, sorted by key and day.

    Rows are dealt by month and bucket before writing, so that a partition gets one file a bucket. Buckets are for the
    table's size: rows of one key stay in one bucket of each month.
    """
    dealt = rows.withColumn("month", F.trunc(day, "month")).repartition(buckets, key)
    dealt.write.mode("overwrite").option("path", path).partitionBy("month").bucketBy(buckets, key).sortBy(key, day).saveAsTable(table)


def between(spark: SparkSession, table: str, day: str, start: str, end: str) -> DataFrame:
    """Rows of the days from start to end: only their months are listed, the days are left to the files' statistics."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = F.col("month").between(F.trunc(first, "month"), F.trunc(last, "month"))
    return spark.table(table).filter(months & F.col(day).between(first, last)).drop("month")


def of_keys(spark: SparkSession, table: str, key: str, *wanted: str) -> DataFrame:
    """Rows of some keys: only their buckets are read."""
    return spark.table(table).filter(F.col(key).isin(*wanted)).drop("month")
