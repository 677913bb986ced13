"""Running quantities kept up to date as late fills come: only the months from the first changed day on are made anew.

A folder holds two tables, both partitioned by month: `levels`, a row for each day with trades with the change and the
running sum, and `opening`, what every holding had when a month began. Late rows read the opening sums of their first
month and the later months' changes; no earlier partition is read or written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.functions.money import QTY
from ledgerwell.functions.storage import stored

KEYS = ["account_id", "ticker"]
LEVELS = "account_id string, ticker string, day date, delta decimal(28,10), quantity decimal(28,10), month date"
OPENING = "account_id string, ticker string, quantity decimal(28,10), month date"


def levels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LEVELS).parquet(f"{folder}/levels")


def opening(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(OPENING).parquet(f"{folder}/opening")


def _levels(changes: DataFrame, before: DataFrame | None) -> DataFrame:
    """Running sums of changes (KEYS, day, delta), from what each holding had before."""
    by_day = changes.groupBy(*KEYS, "day").agg(F.sum("delta").cast(QTY).alias("delta"))
    running = F.sum("delta").over(Window.partitionBy(*KEYS).orderBy("day"))
    if before is not None:
        by_day = by_day.join(before, KEYS, "left")
        running = running + F.coalesce("start_", F.lit(0))
    return by_day.select(*KEYS, "day", "delta", running.cast(QTY).alias("quantity"), F.trunc("day", "month").alias("month"))


def _openings(found: DataFrame, before: DataFrame, first: str, last: str) -> DataFrame:
    """What every holding had at the beginning of each month after `first` and up to the one after `last`."""
    ends = found.groupBy(*KEYS, "month").agg(F.max_by("quantity", "day").alias("quantity")).select(*KEYS, F.add_months("month", 1).alias("month"), "quantity")
    known = ends.unionByName(before.select(*KEYS, F.lit(first).cast("date").alias("month"), F.col("start_").cast(QTY).alias("quantity")))
    after = F.coalesce(F.lead("month").over(Window.partitionBy(*KEYS).orderBy("month")), F.lit(last).cast("date") + F.expr("interval 2 months"))
    spread = known.withColumn("after_", after.cast("date")).withColumn("month", F.explode(F.sequence("month", F.add_months("after_", -1), F.expr("interval 1 month"))))
    return spread.filter(F.col("month") > F.lit(first).cast("date")).select(*KEYS, "quantity", "month")


def _write(df: DataFrame, path: str) -> None:
    """Replace the partitions that df has; it was stored before, so a run that fails halfway can be done again."""
    stored(df, "replaced").repartition("month").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("month").parquet(path)


def write_levels(changes: DataFrame, folder: str) -> None:
    """The tables of all changes (account_id, ticker, day, delta)."""
    found = stored(_levels(changes, None), "levels")
    first, last = (str(d) for d in found.agg(F.coalesce(F.min("month"), F.lit("1970-01-01").cast("date")), F.coalesce(F.max("month"), F.lit("1970-01-01").cast("date"))).first())
    nothing = found.limit(0).select(*KEYS, F.col("quantity").alias("start_"))
    _write(found, f"{folder}/levels")
    _write(_openings(found, nothing, first, last), f"{folder}/opening")


def affected(spark: SparkSession, folder: str, late: DataFrame, first: str) -> DataFrame:
    """The levels from the month `first` on as they are with the late rows; reads no earlier partition."""
    stays = levels(spark, folder).filter(F.col("month") >= F.lit(first).cast("date")).select(*KEYS, "day", "delta")
    return _levels(stays.unionByName(late.select(*stays.columns)), _before(spark, folder, first))


def _before(spark: SparkSession, folder: str, first: str) -> DataFrame:
    return opening(spark, folder).filter(F.col("month") == F.lit(first).cast("date")).select(*KEYS, F.col("quantity").alias("start_"))


def add_late(spark: SparkSession, folder: str, late: DataFrame) -> str | None:
    """Take late rows (account_id, ticker, day, delta) into the tables; returns the first month made anew.

    Rows later than all known months are taken too: the last opening sums hold on until then.
    """
    late = stored(late.select(*KEYS, "day", F.col("delta").cast(QTY).alias("delta")), "late")
    first, last_late = late.agg(F.trunc(F.min("day"), "month"), F.trunc(F.max("day"), "month")).first()
    if first is None:
        return None
    known = opening(spark, folder).agg(F.max("month")).first()[0]
    if known is not None and first > known:
        more = opening(spark, folder).filter(F.col("month") == F.lit(known)).withColumn("month", F.explode(F.sequence(F.add_months("month", 1), F.lit(first), F.expr("interval 1 month"))))
        _write(more, f"{folder}/opening")
    found = stored(affected(spark, folder, late, str(first)), "levels")
    last = max([d for d in (last_late, found.agg(F.max("month")).first()[0], known and (known.replace(day=1))) if d is not None])
    before = stored(_before(spark, folder, str(first)), "before")
    _write(found, f"{folder}/levels")
    _write(_openings(found, before, str(first), str(last)), f"{folder}/opening")
    return str(first)
